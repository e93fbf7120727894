"""Benchmark decontamination by winnowing.

Of every six consecutive hashes of five words the least is kept, on both sides.  A shared span of ten words holds
six such hashes in common, so its least one is kept on both sides: every shared window is met.  Kept hashes of a text
that items have too are extended to the ten-word windows around them, and these are compared byte for byte with the
distinct windows of the items.  A window of a text meets one distinct window at most, however often words repeat on
either side, so work follows the words and not the pairs of places.

The fingerprints and windows of the benchmark are broadcast while they stay under ``broadcast_bytes`` (its texts are
measured first); beyond that the windows around kept hashes that items may have meet the items' windows in a shuffled join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import dealt_join, written
from .textkernel import ALNUM, Tokens, grams, hash_spans, mix, padded, same_spans, slices, string_buffer

WINDOW = 10
GRAM = 5
KEEP = WINDOW - GRAM + 1
#: Bytes of an index that may be broadcast, and how many it takes for each byte of the items' texts.
BROADCAST_BYTES, INDEX_BYTES = 24 << 20, 10
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(buf: np.ndarray, offsets: np.ndarray):
    pad = padded(buf, lower=True)
    t = Tokens(pad, offsets, ALNUM)
    return pad, t, hash_spans(pad, t.start, t.end)


def _inside(t: Tokens, k: int, n: int) -> np.ndarray:
    """Of ``n`` k-grams of the running word list, those that stay within one row."""
    row = t.row
    return row[:n] == row[k - 1:k - 1 + n] if n else np.zeros(0, bool)


def winnow(h: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept: least of any ``KEEP`` consecutive ones of a row."""
    g = grams(h, GRAM)
    n = len(g)
    if not n:
        return np.zeros(0, np.int64), g
    g[~_inside(t, GRAM, n)] = _NONE
    ext = np.concatenate([np.full(KEEP - 1, _NONE), g, np.full(KEEP - 1, _NONE)])
    least = ext[:n + KEEP - 1].copy()
    for j in range(1, KEEP):
        np.minimum(least, ext[j:j + n + KEEP - 1], out=least)
    # least[w] is the minimum of g over [w-KEEP+1, w]; windows that cross rows only add hashes, which is harmless.
    keep = np.zeros(n, bool)
    for j in range(KEEP):
        keep |= g == least[j:j + n]
    keep &= g != _NONE
    at = np.flatnonzero(keep)
    return at, g[at]


class Index:
    """The fingerprints and distinct windows of a block of benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list):
        column = pa.array(texts, pa.large_string())
        buf, offsets = string_buffer(column)
        self.ids = np.array([str(i) for i in ids], dtype=object)
        self.pad, self.t, h = _words(buf, offsets)
        row = self.t.row
        at, kept = winnow(h, self.t)
        self.kept = np.unique(kept[self.t.counts[row[at]] >= WINDOW])
        #: By size: hashes of distinct windows, a place of each, and the rows that hold it.
        self.windows = {}
        for size in sorted({int(min(c, WINDOW)) for c in self.t.counts if c}):
            whole = np.flatnonzero(_inside(self.t, size, max(len(h) - size + 1, 0)))
            starts = whole if size == WINDOW else self.t.first[:-1][self.t.counts == size]
            self.windows[size] = self._distinct(_at(h, starts, size), starts, row, size)

    def _distinct(self, keys, starts, row, size):
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        while True:  # windows of one hash and different words make groups of their own
            _, first = np.unique(group, return_index=True)
            other = np.flatnonzero(~self.equal(self.pad, self.t, starts, starts[first][group], size))
            if not len(other):
                break
            group[other] += len(first)
            _, group = np.unique(group, return_inverse=True)
        pairs = np.unique(np.stack([group, row[starts]], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        by = np.argsort(keys[first], kind="stable")  # groups again in the order of their hashes
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        own = np.argsort(rank[pairs[:, 0]], kind="stable")
        held = rank[pairs[own, 0]]
        return keys[first][by], starts[first][by], np.searchsorted(held, np.arange(len(by) + 1)), pairs[own, 1]

    def equal(self, pad, t, a, b, size):
        """Whether windows of a text at ``a`` and of items at ``b`` have the same words."""
        ok = np.ones(len(a), bool)
        for j in range(size):
            live = np.flatnonzero(ok)
            ok[live] = same_spans(pad, t.start[a[live] + j], t.end[a[live] + j], self.pad, self.t.start[b[live] + j], self.t.end[b[live] + j])
        return ok

    def spans(self, pad, t, h):
        """Windows of the texts that items have, by size: (first words, numbers of distinct windows)."""
        n, out = len(h), {}
        for size, (keys, where, _, _) in self.windows.items():
            inside = _inside(t, size, max(n - size + 1, 0))
            if size == WINDOW:
                at, kept = winnow(h, t)
                spot = np.minimum(np.searchsorted(self.kept, kept), max(len(self.kept) - 1, 0))
                met = at[self.kept[spot] == kept] if len(self.kept) else at[:0]
                near = np.zeros(len(inside) + WINDOW, bool)
                for shift in range(KEEP):
                    near[np.maximum(met - shift, 0)] = True
                inside &= near[:len(inside)]
            a = np.flatnonzero(inside)
            g = _at(h, a, size)
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            found = []
            while True:  # one round, but for different windows of one hash
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                a, lo, hi = a[live], lo[live], hi[live]
                ok = self.equal(pad, t, a, where[lo], size)
                found.append((a[ok], lo[ok]))
                a, lo, hi = a[~ok], lo[~ok] + 1, hi[~ok]
            out[size] = tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return out

    def items(self, size: int, rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Distinct (row of a text, row of an item) of windows met."""
        if not len(rows):
            return np.zeros((0, 2), np.int64)
        _, _, first, held = self.windows[size]
        rows, groups = np.unique(np.stack([rows, groups], 1), axis=0).T
        n = first[groups + 1] - first[groups]
        at = np.repeat(first[groups] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.unique(np.stack([np.repeat(rows, n), held[at]], 1), axis=0)


def _at(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from some places on, as ``grams`` has them."""
    out = np.full(len(starts), k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[starts + j])
    return out


_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _sha(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _report(index: Index, column: pa.Array) -> pa.RecordBatch:
    buf, offsets = string_buffer(column)
    words, hits, count, sha = [], [], [], []
    empty = _sha([])
    for lo, hi in slices(offsets):
        pad, t, h = _words(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        cover, row = np.zeros(len(h) + 1, np.int64), t.row
        items: dict[int, set] = {}
        for size, (a, group) in index.spans(pad, t, h).items():
            np.add.at(cover, a, 1)
            np.add.at(cover, a + size, -1)
            for r, i in index.items(size, row[a], group).tolist():
                items.setdefault(r, set()).add(index.ids[i])
        mark = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        n_hit = mark[t.first[1:]] - mark[t.first[:-1]]
        words += t.counts.tolist()
        hits += n_hit.tolist()
        count += [len(items.get(r, ())) for r in range(hi - lo)]
        sha += [_sha(items[r]) if r in items else empty for r in range(hi - lo)]
    return pa.record_batch(
        [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())],
        names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: words, words inside any benchmark window, items met.

    Words: runs of digits, letters and characters outside ASCII, A-Z lower-cased.  A window is ten consecutive
    words of an item, or the whole of a shorter one.  Null or empty texts have no words; items without words have
    no window; items with a null id are ignored; items of one id count once.  Repeated documents give repeated
    rows.  An empty benchmark hits nothing.  Other columns are not read.
    """
    items, texts = _items(benchmark), docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = _small(items, broadcast_bytes)
    return _by_join(texts, items).drop("text") if known is None else _by_broadcast(texts, known)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _small(items: DataFrame, broadcast_bytes: int) -> list | None:
    """The items, if their index stays within ``broadcast_bytes``."""
    size = items.agg(F.sum(F.octet_length("text") + F.length("item_id") + 16)).first()[0] or 0
    return [(r[0], r[1]) for r in items.collect()] if size * INDEX_BYTES <= broadcast_bytes else None


def uncontaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; columns and order of columns stay.
    Null and empty texts stay.  Past ``broadcast_bytes`` the contaminated rows are removed by a join on id and text."""
    items = _items(benchmark)
    known = _small(items, broadcast_bytes)
    if known is None:
        bad = _by_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), items).where("contaminated").select("doc_id", "text").distinct()
        same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("d.text").cast("string").eqNullSafe(F.col("b.text"))
        return docs.alias("d").join(bad.alias("b"), same, "left_anti")
    shared, at = docs.sparkSession.sparkContext.broadcast(Index([k[0] for k in known], [k[1] for k in known])), docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = _report(shared.value, b.column(at)).column("contaminated")
            yield b.filter(pa.array([not x for x in out.to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _by_broadcast(texts: DataFrame, known: list) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(Index([k[0] for k in known], [k[1] for k in known]))

    def run(batches):
        for b in batches:
            out = _report(shared.value, b.column(1))
            yield pa.record_batch([b.column(0), *out.columns], names=["doc_id", *out.schema.names])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_FIELDS}")


def _short(h: np.ndarray, t: Tokens, size: int, item: bool) -> np.ndarray:
    """Where windows of a length under ``WINDOW`` begin: in items of that length, in texts everywhere."""
    return t.first[:-1][t.counts == size] if item else np.flatnonzero(_inside(t, size, max(len(h) - size + 1, 0)))


def _keys(column: pa.Array, sizes: set[int]) -> np.ndarray:
    """Distinct kept hashes of a batch of items, and hashes of those items that are one window of a length of ``sizes``."""
    keys = [np.zeros(0, np.uint64)]
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        _, t, h = _words(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        keys += [winnow(h, t)[1], *(_at(h, _short(h, t, size, True), size) ^ np.uint64(size) for size in sizes)]
    return np.unique(np.concatenate(keys))


class Filter:
    """Which hashes items have, up to those that share a bit."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.width)
        return self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0


def _windows(column: pa.Array, sizes: set[int], known: Filter | None):
    """Windows of a batch: rows, first words, lengths and texts (words with a space between).  Of items (no filter) all; of
    texts those around kept hashes, and short ones, that items may have."""
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        pad, t, h = _words(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        inside = _inside(t, WINDOW, max(len(h) - WINDOW + 1, 0))
        if known is not None:
            at, kept = winnow(h, t)
            near = np.zeros(len(inside) + WINDOW, bool)
            for shift in range(KEEP):
                near[np.maximum(at[known.has(kept)] - shift, 0)] = True
            inside &= near[:len(inside)]
        found = [(np.flatnonzero(inside), WINDOW)]
        for size in sizes:
            a = _short(h, t, size, known is None)
            found.append((a if known is None else a[known.has(_at(h, a, size) ^ np.uint64(size))], size))
        long = t.end - t.start
        begin = np.cumsum(long + 1) - (long + 1)
        data = np.full(int((long + 1).sum()), 32, np.uint8)
        inner = np.cumsum(long) - long
        data[np.repeat(begin - inner, long) + np.arange(int(long.sum()))] = pad[np.repeat(t.start - inner, long) + np.arange(int(long.sum()))]
        text, row = data.tobytes(), t.row
        for a, size in found:
            if len(a):
                yield row[a] + lo, a - t.first[row[a]], size, [text[x:y] for x, y in zip(begin[a].tolist(), (begin + long)[a + size - 1].tolist())]


def _counted(texts: DataFrame) -> DataFrame:
    """``(k, n_words)`` of ``texts(k, text)``."""
    def run(batches):
        for b in batches:
            buf, offsets = string_buffer(b.column(1))
            n = [c for lo, hi in slices(offsets) for c in Tokens(padded(buf[offsets[lo]:offsets[hi]], True), offsets[lo:hi + 1] - offsets[lo], ALNUM).counts.tolist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["k", "n_words"])

    return texts.select("k", "text").mapInArrow(run, "k long, n_words long")


#: Bits of the number of slots of the filter of hashes that items have: by their count, within these (2 MB and 128 MB).
FILTER = (24, 30)


def _filter(items: DataFrame, sizes: set[int]) -> Filter:
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array(_keys(b.column(0), sizes).view(np.int64))], names=["key"])

    keys = written(items.select("text").mapInArrow(run, "key long").distinct(), "decontaminate-keys")
    width = min(max((8 * keys.count()).bit_length(), FILTER[0]), FILTER[1])
    # Bytes of the filter that are not zero, added up by tasks: at most as many as the filter has.
    slots = keys.select(F.shiftrightunsigned("key", 64 - width).alias("slot"))
    parts = slots.selectExpr("shiftrightunsigned(slot, 3) at", "shiftleft(1, cast(slot % 8 as int)) bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for b in parts.select("at", F.col("bits").cast("short")).toArrow().to_batches():
        bits[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return Filter(bits, width)


def _by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The same, with the text, for a benchmark of any size: windows of the texts meet the distinct windows of the items, word
    for word, and no text is shuffled for it.

    Equal rows of id and text are one row with a number of its own and a count; numbers are written once.  Windows that
    no item can have, by a filter of bounded size, stay out of the join, and those that very many texts hold are dealt to
    several keys.
    """
    spark = texts.sparkSession
    base = texts.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    base = written(base.withColumn("k", F.monotonically_increasing_id()), "decontaminate-texts")
    items = written(items.distinct().withColumn("k", F.monotonically_increasing_id()), "decontaminate-items")
    counted = written(_counted(base), "decontaminate-words")
    short = _counted(items).where(F.col("n_words").between(1, WINDOW - 1)).select(F.col("n_words").cast("int").alias("n")).distinct()
    sizes = {r[0] for r in short.collect()}  # nine numbers at most
    known = spark.sparkContext.broadcast(_filter(items, sizes))

    def cut(item: bool):
        def run(batches):
            for b in batches:
                for rows, first, size, windows in _windows(b.column(1), sizes, None if item else known.value):
                    yield pa.record_batch([b.column(0).take(pa.array(rows)), pa.array(first, pa.int64()), pa.array(first + size, pa.int64()), pa.array(windows, pa.binary())], names=["k", "start", "stop", "window"])
        return run

    layout = "k long, start long, stop long, window binary"
    theirs = items.select("k", "text").mapInArrow(cut(True), layout).select("k", "window").join(items.select("k", "item_id"), "k").select("window", "item_id").distinct()
    theirs = written(theirs, "decontaminate-windows")
    ours = written(base.select("k", "text").mapInArrow(cut(False), layout), "decontaminate-candidates")
    met = theirs.select("window").distinct().join(ours.groupBy("window").agg(F.count("*").alias("n")), "window")
    met = written(met.withColumn("w", F.monotonically_increasing_id()), "decontaminate-met")
    spans = written(dealt_join(ours, met, "window").select("k", "start", "stop", "w"), "decontaminate-spans")
    once = written(spans.select("k", "w").distinct(), "decontaminate-once")
    holders = once.groupBy("w").agg(F.count("*").alias("n")).join(met.select("w", "window"), "w").join(theirs, "window").select("w", "n", "item_id")
    ids = dealt_join(once, holders, "w").select("k", "item_id").distinct().groupBy("k").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    # Words covered: what each span adds to the furthest end of those that begin ahead of it.
    reach = Window.partitionBy("k").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.max("stop").over(reach), F.lit(0))
    covered = spans.select("k", "start", "stop").distinct().withColumn("more", F.greatest(F.col("stop") - F.greatest("start", ahead), F.lit(0))).groupBy("k").agg(F.sum("more").alias("n_hit"))
    out = base.join(counted, "k").join(ids, "k", "left").join(covered, "k", "left")
    return out.select(
        "doc_id", "text", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"),
        F.col("ids").isNotNull().alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
