"""Phrases of a corpus whose words stand together more often than by chance.

Frequencies are found level by level.  For phrases of 1, 2, ... words every task hashes its occurrences into the counters
of a sketch of two rows, and the counters are added up by ranges in a shuffle; an upper bound of a phrase's frequency is
the smaller of its two counters.  Only whether it reaches the least frequency asked for matters later, so counters
saturate and what is left of a level is one bit each.  A phrase is hashed at all only where both phrases of one word less
within it passed their level, since none can be more frequent than they.

What passed is a candidate.  Every shard of texts compiles the candidates that occur in it into an Aho-Corasick automaton,
each between delimiters so that it matches whole words within one piece only, and scans its texts for overlapping matches.
The counts are summed over the shards of a task, then over tasks by parts of the phrases (they travel packed, one row per
task, part and language), and the threshold is applied to exact counts; a sketch that is too small costs
time, never a result.  No automaton holds more than the phrases of one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, written
from .textkernel import Tokens, cut, hash_spans, mix, padded, slices, string_buffer

LEAST = 100
WORDS = 5
TOP = 2000
UNKNOWN = "und"
#: Bytes of texts that one automaton scans.
SHARD = 4 << 20
#: Different phrases whose counts a task adds up before it gives them out.
HELD = 1 << 19
#: Bytes of texts for each part that the phrases are dealt to for the sums over all tasks.
PART = 16 << 20
#: Counters of a row of the sketch: one for so many bytes of text, as a power of two within bounds.  The upper one
#: bounds what tasks are sent: a bit for each counter, that is 64 MiB a level.
BYTES_A_COUNTER, NARROWEST, WIDEST = 64, 1 << 22, 1 << 28
ROWS = 2
RANGE = 1 << 16

_SPACE, _DELIMITER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_DELIMITER[[10, 11, 12, 13, *b".,;:!?"]] = True
_WORD = ~(_SPACE | _DELIMITER)


def width(n_bytes: int) -> int:
    return min(max(1 << (n_bytes // BYTES_A_COUNTER).bit_length(), NARROWEST), WIDEST)


class Shard:
    """Words of a bounded part of a batch: places, hashes with the language in them, and how many words of the piece
    are left from each on."""

    def __init__(self, pad: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        t = Tokens(pad, offsets, _WORD)
        self.pad, self.start, self.end, self.row = pad, t.start, t.end, t.row
        n = len(self.start)
        self.hash = mix(hash_spans(pad, self.start, self.end) + languages[self.row]) if n else np.zeros(0, np.uint64)
        seen = np.cumsum(_DELIMITER[pad[:int(offsets[-1])]])
        self.opens = np.ones(n, bool)
        if n:
            self.opens[1:] = (seen[self.start[1:]] != seen[self.start[:-1]]) | (self.row[1:] != self.row[:-1])
        opened = np.flatnonzero(self.opens)
        self.left = np.repeat(np.append(opened[1:], n), np.diff(np.append(opened, n))) - np.arange(n)

    def levels(self, hot: list[np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Of phrases of 1, 2, ... words: those whose parts passed the levels known, as word places and hashes, and
        which of them pass their own level (None on the first level that is not known, the last one given)."""
        n = len(self.hash)
        alive, full = np.ones(n + 1, bool), self.hash
        alive[n] = False
        for size in range(1, most + 1):
            ok = self.left >= size
            if size > 1:
                ok &= alive[:n] & alive[1:]
            at = np.flatnonzero(ok)
            if size > 1:
                now = np.zeros(n, np.uint64)
                now[at] = mix(full[at] * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + size - 1])
                full = now
            hashes = full[at]
            if size > len(hot):
                yield size, at, hashes, None
                return
            passed = np.ones(len(at), bool)
            for row, bits in zip(buckets(hashes, 8 * hot[size - 1].shape[1]), hot[size - 1]):
                passed &= (bits[row >> 3] >> (row & 7).astype(np.uint8) & 1).astype(bool)
            alive = np.zeros(n + 1, bool)
            alive[at] = passed
            yield size, at, hashes, passed


def shards(batches, limit: int = SHARD) -> Iterator[tuple[Shard, np.ndarray, list[str]]]:
    """Shards of batches ``(lang, text)``, with the language number of each of their rows and the names of these."""
    for b in batches:
        coded = b.column(0).dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = [x.encode() for x in names]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        codes = hash_spans(padded(np.frombuffer(b"".join(raw), np.uint8)), ends[:-1], ends[1:], 7) if raw else np.zeros(0, np.uint64)
        buf, offsets = string_buffer(b.column(1))
        offsets, rows = cut(buf, offsets, limit, _DELIMITER)
        for lo, hi in slices(offsets, limit):
            some = number[rows[lo:hi]]
            pad = padded(buf[offsets[lo]:offsets[hi]], lower=True)
            yield Shard(pad, offsets[lo:hi + 1] - offsets[lo], codes[some]), some, names


def buckets(hashes: np.ndarray, wide: int) -> list[np.ndarray]:
    """The counter of every hash in each row of the sketch."""
    return [((hashes >> np.uint64(32 * row)) & np.uint64(wide - 1)).astype(np.int64) for row in range(ROWS)]


def _hot(texts: DataFrame, known, level: int, wide: int, least: int) -> np.ndarray:
    """The bits of counters that reach ``least``, one array a row, of phrases of ``level`` words."""
    ranges = wide // RANGE

    def count(batches):
        for shard, _, _ in shards(batches):
            for size, _, hashes, _ in shard.levels(known.value, level):
                if size < level:
                    continue
                for row, places in enumerate(buckets(hashes, wide)):
                    at, n = np.unique(places, return_counts=True)
                    n = np.minimum(n, 255).astype(np.uint8)
                    low, part = (at & (RANGE - 1)).astype("<u2"), at // RANGE
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(at)]]) if len(at) else [0]
                    spans = list(zip(cuts[:-1], cuts[1:]))
                    yield pa.record_batch([pa.array([row * ranges + int(part[x]) for x, _ in spans], pa.int32()), pa.array([low[x:y].tobytes() for x, y in spans], pa.binary()),
                                           pa.array([n[x:y].tobytes() for x, y in spans], pa.binary())], names=["part", "low", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, low, n in zip(*(c.to_pylist() for c in b.columns)):
                held = sums.setdefault(part, np.zeros(RANGE, np.uint8))
                at = np.frombuffer(low, "<u2")
                held[at] = np.minimum(held[at].astype(np.int64) + np.frombuffer(n, np.uint8), 255)
        bits = {p: np.packbits(s >= least, bitorder="little") for p, s in sums.items()}
        bits = {p: b for p, b in bits.items() if b.any()}
        yield pa.record_batch([pa.array(list(bits), pa.int32()), pa.array([b.tobytes() for b in bits.values()], pa.binary())], names=["part", "bits"])

    counted = texts.mapInArrow(count, "part int, low binary, n binary").repartition(max(8, ROWS * ranges // 16), "part")
    out = np.zeros((ROWS * ranges, RANGE // 8), np.uint8)
    # Written first: an iterator over the sums themselves would add up one partition after the other.
    table = written(counted.mapInArrow(add, "part int, bits binary"), "phrase-bits")
    for r in table.toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    drop(table)
    return out.reshape(ROWS, -1)


def _scan(shard: Shard, hot: list[np.ndarray], rows: np.ndarray, names: list[str], most: int) -> Iterator[tuple[str, list[int], list[str], list[int]]]:
    """Exact counts of a shard's candidates, by an automaton for each of its languages: the language, and sizes, phrases
    and counts; the count of all its words has size 0."""
    import ahocorasick

    long = shard.end - shard.start
    word_rows = rows[shard.row]
    levels = [(size, at[passed], hashes[passed]) for size, at, hashes, passed in shard.levels(hot, most)]
    for lang in np.unique(word_rows):
        own = np.flatnonzero(word_rows == lang)
        # " word word \n word ": a space on both sides of every word, a line break between pieces.
        gap = 2 * shard.opens[own]
        begin = np.cumsum(long[own] + 1 + gap) - long[own] - 1
        text = np.full(int(begin[-1] + long[own][-1] + 1), 32, np.uint8)
        text[begin[shard.opens[own]] - 2] = 10
        inner = np.repeat(begin - (np.cumsum(long[own]) - long[own]), long[own]) + np.arange(int(long[own].sum()))
        text[inner] = shard.pad[np.repeat(shard.start[own] - (np.cumsum(long[own]) - long[own]), long[own]) + np.arange(int(long[own].sum()))]
        data, finish = text.tobytes(), begin + long[own]
        where = np.full(len(shard.start), -1, np.int64)
        where[own] = np.arange(len(own))
        machine, phrases, sizes = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
        for size, at, hashes in levels:
            mine = word_rows[at] == lang
            first = where[at[mine][np.unique(hashes[mine], return_index=True)[1]]]
            for x, y in zip(begin[first].tolist(), finish[first + size - 1].tolist()):
                phrase = data[x:y].decode("utf-8", "replace")
                if machine.add_word(f" {phrase} ", len(phrases)):
                    phrases.append(phrase)
                    sizes.append(size)
        n = np.zeros(0, np.int64)
        if phrases:
            machine.make_automaton()
            n = np.bincount(np.fromiter((k for _, k in machine.iter(data.decode("utf-8", "replace"))), np.int64), minlength=len(phrases))
        yield names[lang], [0, *sizes], ["", *phrases], [len(own), *n.tolist()]


def _summed(tables: list[pa.Table]) -> list[pa.Table]:
    """Counts of equal phrases added up."""
    both = pa.concat_tables(tables)
    return [both.group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "size", "phrase", "n"]).combine_chunks()]


class Sums:
    """Counts of phrases, added up as they come; no more than twice ``HELD`` are held at once unless they are all different."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.n = self.least = 0

    def add(self, lang: pa.Array, size: pa.Array, phrase: pa.Array, n: pa.Array) -> None:
        self.tables.append(pa.table([lang, size, phrase, n], names=["lang", "size", "phrase", "n"]))
        self.n += len(n)
        if self.n - self.least >= max(HELD, self.least):
            self.fold()

    def fold(self) -> pa.Table | None:
        self.tables = _summed(self.tables) if self.tables else []
        self.n = self.least = sum(map(len, self.tables))
        return self.tables[0] if self.tables else None

    def out(self, parts: int) -> Iterator[pa.RecordBatch]:
        """All counts, one row for the phrases of a language that a part of all phrases has; none are left."""
        for some in [] if self.fold() is None else self.tables[0].group_by("lang", use_threads=False).aggregate([("size", "list"), ("phrase", "list"), ("n", "list")]).to_batches():
            for i in range(len(some)):
                size, phrase, n = (some.column(c)[i].values for c in ("size_list", "phrase_list", "n_list"))
                buf, at = string_buffer(phrase)
                part = (mix(hash_spans(padded(buf), at[:-1], at[1:])) % np.uint64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
                ends = pa.array(np.append(cuts, len(by)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(by))) for x in (size, phrase, n)]
                yield pa.record_batch([pa.array(part[by][cuts]), pa.array([some.column("lang")[i].as_py()] * len(cuts), pa.string()), *lists], names=["part", "lang", "sizes", "phrases", "counts"])
        self.__init__()


def frequencies(docs: DataFrame, least: int = LEAST, most: int = WORDS) -> DataFrame:
    """``(lang, size, phrase, n)``: all phrases of up to ``most`` words that occur ``least`` times or more in a language,
    with their exact counts; and per language a row of size 0 with the count of all words.

    ``docs(lang, text, ...)``: A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words are runs of anything
    but spaces and tabs.  A null language counts as ``UNKNOWN``, a null text as empty; repeated rows count as often as they
    occur.  ``least`` is at most 255, where counters saturate.
    """
    if not 1 <= least <= 255:
        raise ValueError("counters of the sketch saturate at 255")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    wide = width(n_bytes)
    send = docs.sparkSession.sparkContext.broadcast
    hot: list[np.ndarray] = []
    known = send(hot)
    for level in range(1, most + 1):
        hot = [*hot, _hot(texts, known, level, wide, least)]
        known.unpersist()
        known = send(hot)

    parts = max(8, -(-n_bytes // PART))

    def scan(batches):
        sums = Sums()
        for shard, rows, names in shards(batches):
            if len(shard.start):
                for lang, sizes, phrases, counts in _scan(shard, known.value, rows, names, most):
                    sums.add(pa.repeat(lang, len(sizes)), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()))
            if sums.least >= HELD:
                yield from sums.out(parts)
        yield from sums.out(parts)

    def add(batches):
        sums = Sums()
        for b in batches:
            sizes, phrases, counts = (b.column(c) for c in ("sizes", "phrases", "counts"))
            sums.add(b.column("lang").take(pc.list_parent_indices(sizes)), sizes.flatten(), phrases.flatten(), counts.flatten())
        if (all_ := sums.fold()) is not None:
            yield from all_.filter(pc.or_(pc.greater_equal(all_["n"], least), pc.equal(all_["size"], 0))).to_batches()

    counted = texts.mapInArrow(scan, "part int, lang string, sizes array<int>, phrases array<string>, counts array<long>")
    return counted.repartition(parts, "part").mapInArrow(add, "lang string, size int, phrase string, n long")


#: Copies of a one-word part's count and of a language's count of words, so that no frequent one is a hot key of a join.
SALTS = 16


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def collocations(docs: DataFrame, least: int = LEAST, most: int = WORDS, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``most`` words by score,
    then frequency ``a``, then the phrase.

    A cut after k words has frequencies ``l`` and ``r`` and the score floor(1000 * a * n / (l * r)), ``n`` the language's
    words; the cut of least score counts, of several the first.  A phrase that lies within a longer one of the same
    frequency is left out: it is so exactly where one more word on either side leaves the frequency as it is.  Tables
    without frequent phrases, and empty ones, give an empty result.
    """
    counts = written(frequencies(docs, least, most), "phrases")
    phrases = counts.where("size > 1")
    shorter = phrases.where("size > 2").select("lang", F.col("n").alias("m"), F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("part"))
    kept = phrases.alias("p").join(shorter.alias("s"), (F.col("p.lang") == F.col("s.lang")) & (F.col("p.phrase") == F.col("s.part")) & (F.col("p.n") == F.col("s.m")), "left_anti")
    cuts = kept.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    salted = counts.where("size > 0").select("lang", "phrase", "n", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))

    def with_part(frame: DataFrame, part: str, other: str, words: str, name: str) -> DataFrame:
        known = salted.select("lang", F.col("phrase").alias(part), F.col("n").alias(name), F.col("salt").alias("_salt"))
        return frame.withColumn("_salt", F.when(F.expr(f"{words} = 1"), _salt(other)).otherwise(0)).join(known, ["lang", part, "_salt"]).drop("_salt")

    cuts = with_part(with_part(cuts, "left", "right", "k", "l"), "right", "left", "size - k", "r")
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cuts = cuts.withColumn("_salt", _salt("phrase")).join(totals, ["lang", "_salt"]).drop("_salt")
    exact = "cast(1000 * a as decimal(19, 0)) * cast(total as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    best = cuts.withColumn("score", F.expr(exact).cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("x"))
    best = best.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first of every salted part, then the first of these: no language is sorted in one task.
    some = best.withColumn("_salt", _salt("phrase")).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
