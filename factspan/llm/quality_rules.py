"""Document rules: one table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (measure, least, most); None leaves that side open.  A text is kept if every measure lies within its bounds.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("shout_ratio", None, 0.30),
    ("pipe_ratio", None, 0.10),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.30),
    ("ellipsis_line_ratio", None, 0.30),
    ("bullet_line_ratio", None, 0.90),
]

#: Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or she that the this to was we were with you "
    "au aux avec ce dans de des du elle en est et il la le les ne nous par pas pour que qui sur un une vous "
    "als auf aus das dem den der des die ein eine er für ist im in mit nicht sich sie und von wir zu "
    "al como con de del el en es esta la las los no para por que se su sus un una y"
).split()

SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]"


def _windows(words: Column, n: Column, make) -> Column:
    """One value per window of five words."""
    return F.transform(F.sequence(F.lit(0), n - 5), make)


def _twins(s: Column) -> Column:
    """Of the sorted windows ``s`` (struct of text and position), the sorted positions of those that occur twice or more."""
    after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.struct(x["w"].alias("w"), x["i"].alias("i"), (x["w"] == y["w"]).alias("after")))
    before = F.concat(F.array(F.lit(None).cast("struct<w:string,i:int>")), F.slice(s, 1, F.size(s) - 1))
    twin = F.zip_with(after, before, lambda x, y: F.struct(x["i"].alias("i"), (F.coalesce(x["after"], F.lit(False)) | F.coalesce(x["w"] == y["w"], F.lit(False))).alias("twin")))
    return F.array_sort(F.transform(F.filter(twin, lambda x: x["twin"]), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words in the union of windows of five that begin at the sorted positions ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")))["n"]


def apply_rules(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts, ``base_failed``, the measures and ``kept``.

    Null and empty texts have no words and fail.  Repeated rows give repeated rows, an empty table none.  Other
    columns are not read.  ``kept`` is false if ``base_failed``, else whether every rule of the table holds.

    Whether any window of five words can repeat is told by hashes, whose set is linear; only texts where some hash
    occurs twice sort the windows themselves, so equal hashes of different windows count for nothing.
    """
    a = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    a = a.withColumns({"w": F.array_remove(F.split("t", _GAP + "+"), ""), "l": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    a = a.withColumn("n", F.size("w"))
    a = a.withColumn("h", F.when(F.col("n") > 5, _windows(F.col("w"), F.col("n"), lambda i: F.xxhash64(*[F.get("w", i + F.lit(k)) for k in range(5)]))))
    a = a.withColumn("some", F.size(F.array_distinct("h")) < F.size("h"))
    a = a.withColumn("s", F.when(F.col("some"), F.array_sort(_windows(F.col("w"), F.col("n"), lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(5)), " ").alias("w"), i.alias("i"))))))
    a = a.withColumn("r", _twins(F.col("s")))
    a = a.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("r")), F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("t") - F.length(F.translate("t", "|", ""))).alias("n_pipes"),
        F.size(F.filter("w", lambda x: x.endswith("!!") | x.endswith("!!."))).alias("n_shouts"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]\x20"))).alias("n_bullet_lines"))
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    a = a.withColumns({
        "mean_word_chars": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "shout_ratio": F.col("n_shouts") / n, "pipe_ratio": F.col("n_pipes") / n, "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines, "ellipsis_line_ratio": F.col("n_ellipsis_lines") / lines, "bullet_line_ratio": F.col("n_bullet_lines") / lines})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bounds = [c for name, least, most in rules for c in ([F.col(name) >= least] if least is not None else []) + ([F.col(name) <= most] if most is not None else [])]
    verdict = reduce(lambda x, y: x & y, bounds, F.lit(True))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"), *[r[0] for r in rules])
