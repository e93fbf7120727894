"""SimHash near-duplicate grouping with pigeonhole blocks.

Fingerprints come from numpy over whole texts.  Links between distinct fingerprints are found by joins on
blocks: of five blocks of a fingerprint, two fingerprints that differ in three bits or fewer share at least two,
so every pair of blocks is one key (of six or seven blocks three or four, where there are very many fingerprints).  A key that too many fingerprints share is split again by the same rule over
its remaining bits (exact, since the remaining bits also differ in three at most), three times at most, after
which 14 free bits bound what a key can hold.  No key is dropped or capped.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, dealt_join, written
from .textkernel import NOT_SPACE, Tokens, padded, slices, string_buffer

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: A block key with more fingerprints than this is split further before pairs are compared.
SPLIT_ABOVE = 128
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0].copy()


def fingerprints(column: pa.Array) -> np.ndarray:
    """64-bit SimHash of every text: A-Z lower-cased, words between ASCII white space, shingles of three words
    joined by a space and counted as often as they occur.  Fewer words: the whole sequence.  None, null or
    empty: zero."""
    buf, offsets = string_buffer(column)
    out = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for lo, hi in slices(offsets):
        pad = padded(buf[offsets[lo]:offsets[hi]], lower=True)
        t = Tokens(pad, offsets[lo:hi + 1] - offsets[lo], NOT_SPACE)
        size = t.end - t.start
        at = np.cumsum(size + 1) - (size + 1)
        text = pad[np.repeat(t.start - at, size + 1) + np.arange(int((size + 1).sum()))]
        text[at + size] = 32
        data = text.tobytes()
        per = np.where(t.counts >= SHINGLE, t.counts - SHINGLE + 1, np.minimum(t.counts, 1))
        first = np.concatenate([[0], np.cumsum(per)])
        a = np.repeat(t.first[:-1] - first[:-1], per) + np.arange(first[-1])
        b = a + np.repeat(np.minimum(t.counts, SHINGLE) - 1, per)
        hashes = np.fromiter((digest(data[x:y], SEED) for x, y in zip(at[a].tolist(), (at + size)[b].tolist())), dtype=np.uint64, count=len(a))
        ones = np.zeros((hi - lo, 64), np.int64)
        some = np.flatnonzero(per)
        if len(some):
            # Byte lanes count up to 255 shingles; blocks of that many are summed first, then the blocks of a text.
            blocks = -(-per[some] // 255)
            begin = np.concatenate([[0], np.cumsum(blocks)])
            starts = np.repeat(first[:-1][some] - 255 * begin[:-1], blocks) + 255 * np.arange(begin[-1])
            lanes = _SPREAD[hashes.astype(">u8").view(np.uint8)].reshape(-1, 8)
            sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
            ones[some] = np.add.reduceat(sums, begin[:-1], axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > per[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64))
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs(doc_id, text, ...)``; other columns are not read."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(parent: int, blocks: int = 5) -> list[int]:
    """``parent`` plus all but three of the blocks, in any choice, of the bits that it leaves free."""
    free = [b for b in range(64) if not parent >> b & 1]
    cuts = [round(k * len(free) / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in free[cuts[k]:cuts[k + 1]]) for k in range(blocks)]
    return [parent | sum(some) for some in itertools.combinations(parts, blocks - MAX_BITS)]


def _blocks(n: int) -> int:
    """How many blocks spread ``n`` fingerprints so that a key of chance holds a few: five up to 800 million (10 keys
    each), six up to 70 billion (20 keys), then seven (35)."""
    return next((b for b in (5, 6) if n <= 16 * 2 ** (64 * (b - MAX_BITS) / b)), 7)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE, blocks: int | None = None) -> DataFrame:
    """All pairs ``(a, b)`` of the distinct fingerprints ``fps(fp)`` that differ in ``max_bits`` (at most 3) bits or fewer.

    Every level compares the fingerprints of small keys and hands those of large keys to the next level.  The first
    level has ``blocks`` blocks, by the count of the fingerprints where none are given.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two of five blocks are shared only at three differing bits or fewer")
    spark = fps.sparkSession
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    parents, found = [0], None
    blocks = blocks or _blocks(fps.count())
    for level in range(3):
        steps = {p: _masks(p, 5 if level else blocks) for p in parents}
        if level:
            table = spark.createDataFrame([(_signed(p), _signed(m)) for p, ms in steps.items() for m in ms], "mask long, next long")
            rows = rows.join(F.broadcast(table), "mask").select("fp", F.col("next").alias("mask"))
        else:
            rows = rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in steps[0]])).alias("mask"))
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        keyed = written(rows.join(sizes, ["mask", "part"]), "simhash-keys")
        small = keyed if level == 2 else keyed.where(F.col("n") <= split_above)
        left, right = small.select("mask", "part", F.col("fp").alias("a")), small.select("mask", "part", F.col("fp").alias("b"))
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        pairs = left.alias("l").join(right.alias("r"), (F.col("l.mask") == F.col("r.mask")) & (F.col("l.part") == F.col("r.part")) & near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        rows = keyed.where(F.col("n") > split_above).select("fp", "mask")
        if level == 2 or rows.isEmpty():
            break
        parents = [m for ms in steps.values() for m in ms]
    return found.distinct()


def _rooted(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root)`` of the distinct fingerprints ``fps(fp)``: the root is one fingerprint of the component."""
    joined = components(links(fps, max_bits), "simhash-cc")
    return fps.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text, ...)``.

    ``fingerprint``: 16 lowercase hex digits.  ``component_id``: the smallest doc_id reachable over links of
    ``max_bits`` differing bits or fewer, the row's own included.  Null and empty texts have fingerprint zero and
    link like any other.  Repeated rows give repeated rows; null ids take no part in the minimum, and a group of
    null ids only has a null component.  An empty table gives an empty result.
    """
    marked = written(with_fingerprint(docs), "simhash-fp")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    rooted = classes.join(_rooted(classes.select("fp"), max_bits), "fp")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "n", "component_id")
    return dealt_join(marked, labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the least by doc_id (null ones last) and then by a hash of the whole
    row; columns stay.

    The row is chosen by its own text, so rows of one id with different texts count each in its own group, and a row with
    a null id stays only where its group has no other.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)
    known = docs.withColumn("_row", row)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fingerprints(b.column(1)).view(np.int64))], names=["doc_id", "_row", "fp"])

    marked = known.select("doc_id", F.col("text").cast("string"), "_row").mapInArrow(run, f"doc_id {kind}, _row string, fp long")
    # The least row of a fingerprint first, so that no join sees the rows of a much copied text.
    classes = written(marked.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("least")), "simhash-classes")
    rooted = _rooted(classes.select("fp"), max_bits)
    kept = classes.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    return known.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
