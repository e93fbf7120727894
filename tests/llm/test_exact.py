"""Operators whose results are fixed, against brute force over the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factspan.llm import decontaminate, entry, pii, quality_rules, simhash
from factspan.llm.tables import dealt_join
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_against_sql(spark, name):
    compare(spark, SF, entry.QUERIES[name], entry.SQL[name])


# ---- personal data -----------------------------------------------------------------------------------------------

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = [[m.span() for m in p.finditer(text)] for p in PATTERNS]
    digits = lambda s: [int(c) for c in text[s[0]:s[1]] if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    out[1] = [s for s in out[1] if all(int(p) <= 255 for p in text[s[0]:s[1]].split("."))]
    out[2] = [s for s in out[2] if 13 <= len(digits(s)) <= 19 and luhn(digits(s))]
    out[3] = [s for s in out[3] if 9 <= len(digits(s)) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ ()0é", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(documents, texts):
    got = {r["doc_id"]: r for r in pii.personal_data(documents).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        base = plain_spans(text or "")
        flat = [f"{k}:{a}:{b}" for k, ss in zip(pii.KINDS, base) for a, b in ss]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [len(s) for s in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(got[i]["spans"].split(","))


def test_field_reads_unseen_lines():
    field = pii.Field.train(pii.labelled_table())
    hit = total = false = 0
    for line in pii.labelled_table(seed=99, rows=200):
        text = " ".join(w for w, _ in line)
        (base, added), = pii.find(pa.array([text]), field)
        marked = {p for ss in base for a, b in ss for p in range(a, b)} | {p for _, a, b in added for p in range(a, b)}
        at = 0
        for w, label in line:
            inside = any(p in marked for p in range(at, at + len(w)))
            total += label != "outside"
            hit += inside and label != "outside"
            false += inside and label == "outside"
            at += len(w) + 1
    assert hit >= 0.9 * total and false <= 0.03 * total


def test_viterbi_cuts_are_exact():
    """Cutting the chain at plain words gives the path of a full Viterbi pass."""
    import numpy as np

    from factspan.llm.textkernel import NOT_SPACE, Tokens, padded

    field = pii.Field.train(pii.labelled_table())
    for line in pii.labelled_table(seed=5, rows=60):
        data = " ".join(w for w, _ in line).encode()
        pad = padded(np.frombuffer(data, np.uint8))
        codes, begins = pii.features(pad, Tokens(pad, np.array([0, len(data)]), NOT_SPACE))
        score = field.weights[codes].sum(1)
        best, back = score[0], []
        for s in score[1:]:
            step = best[:, None] + field.trans
            back.append(step.argmax(0))
            best = step.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert field.decode(codes, begins).tolist() == path[::-1]


def test_redacted(spark, odd):
    docs = spark.createDataFrame([(1, "mail a.b@c.example now", "x"), (2, None, "y"), (3, "plain words", "z")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert got == {1: "mail [EMAIL] now", 2: None, 3: "plain words"}
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


# ---- rules -------------------------------------------------------------------------------------------------------

def test_rules_on_odd_rows(odd, nothing):
    rows = quality_rules.apply_rules(odd).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["n_words"] < 10)
    assert quality_rules.apply_rules(nothing).count() == 0
    assert quality_rules.apply_rules(odd, []).count() == len(rows)


def test_repeated_words(documents, texts):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(documents).collect()}
    for i, text in texts:
        w = SPACE.findall(text or "")
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(covered))


# ---- benchmark windows -------------------------------------------------------------------------------------------

def windows_of(benchmark_rows):
    by = defaultdict(set)
    for i, text in benchmark_rows:
        w = ALNUM.findall((text or "").translate(AZ))
        size = min(len(w), decontaminate.WINDOW)
        for k in range(len(w) - size + 1 if w else 0):
            by[tuple(w[k:k + size])].add(str(i))
    return by


def plain_contamination(text, by):
    w = ALNUM.findall((text or "").translate(AZ))
    hit, items = set(), set()
    for size in {len(x) for x in by}:
        for k in range(len(w) - size + 1):
            ids = by.get(tuple(w[k:k + size]))
            if ids:
                hit |= set(range(k, k + size))
                items |= ids
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_contamination(spark, documents, texts, benchmark, broadcast_bytes):
    extra = spark.createDataFrame([(1000, "very short item"), (1001, ""), (1002, None), (None, "null id"), (1003, "very short item"), (1000, "very short item")], benchmark.schema)
    items = benchmark.unionByName(extra)
    more = [(-1, "x VERY short,item y very short item"), (-2, None), (-3, ""), (-3, "")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    by = windows_of([(r["item_id"], r["text"]) for r in items.where("item_id is not null").collect()])
    want = Counter((i, *plain_contamination(t, by)) for i, t in texts + more)
    got = Counter((r["doc_id"], *(r[f] for f in FIELDS)) for r in decontaminate.contamination(docs, items, broadcast_bytes).collect())
    assert got == want and any(k[-1] for k in want)
    left = Counter(r["doc_id"] for r in decontaminate.uncontaminated(docs, items, broadcast_bytes).select("doc_id").collect())
    assert left == Counter(k[0] for k, n in want.items() if not k[-1] for _ in range(n))


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_contamination_on_odd_rows(spark, odd, nothing, benchmark, broadcast_bytes):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = decontaminate.contamination(odd, items, broadcast_bytes).collect()
    assert len(rows) == odd.count() and sum(r["contaminated"] for r in rows) == 3
    kept = decontaminate.uncontaminated(odd, items, broadcast_bytes)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.contamination(nothing, benchmark, broadcast_bytes).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, items.limit(0), broadcast_bytes).collect())


# ---- near-duplicates ---------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = SPACE.findall((text or "").translate(AZ))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in rows)


def test_near_duplicates(documents, texts, odd, nothing):
    rows = [(i, plain_fingerprint(t)) for i, t in texts]
    assert Counter(map(tuple, simhash.near_duplicates(documents).collect())) == plain_components(rows)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == plain_components(rows)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("split_above", [128, 2])
def test_links_lose_none(spark, split_above):
    """Close and distant fingerprints around a few centres; also where every key is split to the last level."""
    import random

    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split_above=split_above).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and want


def test_one_per_group(spark, odd):
    docs = spark.createDataFrame([(3, "a b c d"), (1, "A b c d"), (2, "z y x w v"), (1, "A b c d"), (None, "a b c d")], "doc_id long, text string")
    assert Counter(r["doc_id"] for r in simhash.one_per_group(docs).collect()) == Counter([1, 2])
    assert simhash.one_per_group(odd).columns == odd.columns


def test_one_per_group_by_rows(spark):
    """Repeated ids with different texts stand in their own groups; a row with a null id stays where its group has no other."""
    docs = spark.createDataFrame([(1, "a b c d"), (1, "z y x w v"), (1, "z y x w v"), (2, "z y x w v"), (None, "p q r s t"), (None, "p q r s t"), (None, "k l m n o")], "doc_id long, text string")
    assert Counter(map(tuple, simhash.one_per_group(docs).collect())) == Counter([(1, "a b c d"), (1, "z y x w v"), (None, "p q r s t"), (None, "k l m n o")])
    same = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert list(map(tuple, simhash.one_per_group(same).collect())) == [(1, "a b c d")]


def test_rows_of_a_much_copied_text_are_dealt_out(spark):
    marked = spark.createDataFrame([(i, i % 3 and 7) for i in range(500)] + [(None, 7)] * 3, "doc_id long, fp long").repartition(4)
    labels = marked.groupBy("fp").count().selectExpr("fp", "count n", "fp * 10 component_id")
    got = dealt_join(marked, labels, "fp", together=20)
    assert Counter(map(tuple, got.select("doc_id", "fp", "component_id").collect())) == Counter((r["doc_id"], r["fp"], r["fp"] * 10) for r in marked.collect())


def test_remainder_is_crc32(spark):
    from factspan.llm.labelled import remainder

    for r in spark.range(50).select("id", remainder(10, "id").alias("m")).collect():
        assert r["m"] == zlib.crc32(str(r["id"]).encode()) % 10
