"""The registered queries of the training-text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, byte_bpe, chat, collocations, context_mixing, decontaminate, licenses, pieces, pii, quality_mil, quality_rules, simhash, toxicity
from .tables import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scores(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.licenses(read(spark, sf_dir, "documents"))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first_word"], x["last_word"], x["matched"], F.round(x["coverage"], 4)))
    return out.select("doc_id", "n_found", "best", F.array_join(spans, ",").alias("spans"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def joined_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op7_decontamination``, on the path for benchmarks that are too large to broadcast."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), broadcast_bytes=0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotated(read(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("conv_id", "speaker", "part", "n_turns", "text", masks.alias("masks"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.decoded(byte_bpe.encoded(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.with_inertia(*ball_kmeans.clusters(read(spark, sf_dir, "embeddings")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_context_mixing": op2_context_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses,
    "op6_pieces": op6_pieces,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_collocations": op13_collocations,
    "joined_decontamination": joined_decontamination,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))


def _bounds() -> str:
    parts = []
    for name, least, most in quality_rules.RULES:
        parts += [f"{name} >= {least}"] if least is not None else []
        parts += [f"{name} <= {most}"] if most is not None else []
    return " and ".join(parts)


def _kmeans() -> str:
    """All rounds as common tables: assignments ``a<t>`` over all pairs of vectors and centroids ``c<t>``."""
    parts = [rf"""
with x as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda e: floor({ball_kmeans.SCALE} * e::double)::bigint) v from embeddings
  where len(embedding) = {ball_kmeans.SIZE} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
p as materialized (select r, unnest(v) y, generate_subscripts(v, 1) i from x),
c0 as materialized (select c, unnest(v) y, generate_subscripts(v, 1) i from (
  select row_number() over (order by sha256('{ball_kmeans.SEED}:' || coalesce(vec_id::varchar, '')), v) - 1 c, v from x order by c limit {ball_kmeans.K}))"""]
    for t in range(ball_kmeans.ROUNDS + 1):
        parts.append(f"""a{t} as materialized (select r, arg_min(c, (d, c)) c, min(d) d from (
  select r, c, sum((p.y - k.y) * (p.y - k.y))::bigint d from p join c{t} k using (i) group by r, c) group by r)""")
        if t < ball_kmeans.ROUNDS:
            parts.append(f"""c{t + 1} as materialized (select c, coalesce((s - ((s % n) + n) % n) // n, k.y)::bigint y, i from c{t} k left join (
  select c, i, sum(p.y)::hugeint s, count(*) n from p join a{t} using (r) group by c, i) using (c, i))""")
    last = ball_kmeans.ROUNDS
    return ",\n".join(parts) + f"""
select vec_id, c::int "cluster", d distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, h centroid_sha256
from a{last} join x using (r) join (select c, sha256(string_agg(y::varchar, ',' order by i)) h from c{last} group by c) using (c)"""


def _collocations() -> str:
    most, least = collocations.WORDS, collocations.LEAST
    return rf"""
with p as (select coalesce(lang, '{collocations.UNKNOWN}') lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
t as (select lang, sum(len(w))::bigint n from w group by lang),
g as (select lang, size, array_to_string(w[i:i + size - 1], ' ') phrase
      from (select lang, w, size, unnest(range(1, len(w) - size + 2)) i from w, (select unnest(range(1, {most + 1})) size) s where len(w) >= size)),
f as materialized (select lang, size, phrase, count(*)::bigint a from g group by all having count(*) >= {least}),
c as (select * from f where size > 1),
s as (select c.*, k, string_split(phrase, ' ') w from c, (select unnest(range(1, {most})) k) k where k < size),
u as (select s.lang, s.phrase, s.size, s.a, k, x.a l, y.a r, n, (1000::hugeint * s.a * n) // (x.a::hugeint * y.a) score
      from s join f x on x.lang = s.lang and x.phrase = array_to_string(w[1:k], ' ') join f y on y.lang = s.lang and y.phrase = array_to_string(w[k + 1:], ' ') join t on t.lang = s.lang),
b as (select * from u qualify row_number() over (partition by lang, phrase order by score, k) = 1),
d as (select distinct c.lang, c.phrase from c join c z on z.lang = c.lang and z.size > c.size and z.a >= c.a and contains(' ' || z.phrase || ' ', ' ' || c.phrase || ' '))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score::bigint score
from b anti join d using (lang, phrase) qualify "rank" <= {collocations.TOP}"""


SQL = {
    "op13_collocations": _collocations(),
    "op12_ball_kmeans": _kmeans(),
    "op10_chat": rf"""
with t as (select distinct conv_id, turn, coalesce(role, '{chat.UNKNOWN}') as role, coalesce(text, '') as text from conversations),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from t),
s as (select distinct conv_id c, role as speaker from t where role not in ('system')),
e as (select p.*, s.speaker, (pos // {chat.PART})::bigint as part,
        case when role in ('system') then '<|' || role || '|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10) else '<|user|>' || replace(replace(role, '<|', '<\|'), chr(10), ' ') || chr(10) end as head,
        replace(text, '<|', '<\|') || '<|end|>' || chr(10) as body from p join s on p.conv_id is not distinct from s.c),
o as (select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, speaker, part order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as start from e)
select conv_id, speaker, part, count(*)::bigint as n_turns, string_agg(head || body, '' order by pos) as text,
  coalesce(string_agg((start + length(head))::varchar || ':' || (start + length(head) + length(body) - 1)::varchar, ',' order by pos) filter (where role = speaker), '') as masks
from o group by conv_id, speaker, part""",
    "op4_quality_rules": rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
a as (select *, regexp_extract_all(t, '{_WORD}') w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select r, i, array_to_string(w[i:i+4], ' ') v from (select r, w, unnest(range(1, len(w) - 3)) i from a)),
h as (select r, i from g qualify count(*) over (partition by r, v) > 1),
c as (select r, count(distinct i + k) n from h, (select unnest(range(5)) k) group by r),
m as (select doc_id, len(w)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
        (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(l) n_lines,
        length(t) - length(replace(t, '|', '')) n_pipes,
        len(list_filter(w, lambda x: suffix(x, '!!') or suffix(x, '!!.'))) n_shouts,
        len(list_filter(w, lambda x: lower(x) in ({_STOP}))) n_stop_words,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) n_ellipsis_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]\x20'))) n_bullet_lines
      from a left join c using (r)),
q as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
        word_chars / greatest(n_words, 1) mean_word_chars, n_symbols / greatest(word_chars, 1) symbol_ratio,
        n_shouts / greatest(n_words, 1) shout_ratio, n_pipes / greatest(n_words, 1) pipe_ratio,
        n_stop_words / greatest(n_words, 1) stop_word_ratio, n_dup_lines / greatest(n_lines, 1) dup_line_ratio,
        n_ellipsis_lines / greatest(n_lines, 1) ellipsis_line_ratio, n_bullet_lines / greatest(n_lines, 1) bullet_line_ratio from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_bounds()} kept from q""",
    "op7_decontamination": rf"""
with d as (select row_number() over () r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
v as (select distinct item_id, size, array_to_string(w[i:i+size-1], ' ') g
      from (select item_id, w, least(len(w), 10) size, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
z as (select distinct size from v),
x as (select r, i, size, array_to_string(w[i:i+size-1], ' ') g from (select r, w, size, unnest(range(1, len(w) - size + 2)) i from d, z)),
h as (select x.r, x.i, x.size, v.item_id from x join v using (size, g)),
n as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + size)) p from h) group by r),
k as (select r, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from h group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n using (r) left join k using (r)""",
}
SQL["joined_decontamination"] = SQL["op7_decontamination"]
