"""Language-model scoring by logistic context mixing over running texts.

A text is read as its words, lower-cased and each ended by a space, and one space more that ends the text.  It is
predicted bit by bit in six contexts, its last one to six bytes, whatever words they lie in.  Counts of the bytes that
followed a context in the training texts are turned into log-odds of the next bit, combined by weights chosen by a gate
(how many of the contexts have been seen, and the bit's place), and refined by an adaptive probability map.

What is counted grows with the corpus: every context met in a training text has counts of its own, keyed by its bytes.
Texts are dealt into blocks of bounded size by a hash of the row, so neither blocks nor scores depend on how the input
is partitioned.  Every block learns weights and map online over its own training texts, each pair of a context and a
byte left out of the block's counts; the averages by use are the model.  For its scores a block sends the distinct
pairs it holds, with their counts, to shards by context; a shard adds them up and answers every block with the counts
along the eight bits of each of its pairs.  Both travel as packed arrays, one row per block and shard that have pairs
in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder
from .tables import written
from .textkernel import NOT_SPACE, Tokens, hash_spans, mix, padded, release, segment_sum, slices, string_buffer

MODULUS, HELD_OUT = 10, 0
#: Contexts: the last one to so many bytes.
ORDERS = 6
#: Slots of one order in tables that are handed to ``Mixer`` by hand; blocks bring tables of their own size.
SLOTS = 1 << 19
GATES = (ORDERS + 1) * 8
BUCKETS = 24
#: Bytes of texts in a block, about (a longer text makes a longer block), and how many blocks there are at least while
#: each has so many bytes.
BLOCK, BLOCKS, LEAST = 20 << 20, 8, 1 << 16
#: Tasks that blocks or shards are dealt to, at most; each may take several.
TASKS = 8192
#: Pairs of a step of learning, those predicted at once, bytes whose pairs are read at once, and pairs sorted at once.
_STEP, _LOAD, _PART, _SORT = 1 << 13, 1 << 12, 1 << 16, 1 << 24
#: Ahead of a text: a byte that no word has, so many times that every context is whole.
_AHEAD = 10
_MASKS = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(1, ORDERS + 1)]
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32)
_SIGNS = np.ascontiguousarray(2 * _BITS.T - 1)


# ---- words of texts ----------------------------------------------------------------------------------------------

def _streams(column: pa.Array):
    """Slices of a column, as row numbers and texts whose words are lower-cased and each followed by a space."""
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        pad = padded(buf[offsets[lo]:offsets[hi]], lower=True)
        t = Tokens(pad, offsets[lo:hi + 1] - offsets[lo], NOT_SPACE)
        size = t.end - t.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        data = pad[np.repeat(t.start - at[:-1], size) + np.arange(at[-1])]
        data[at[1:] - 1] = 32
        yield lo, hi, pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at[t.first].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def _blocks(texts: DataFrame, many: int) -> DataFrame:
    """One row per block of ``texts(doc_id, text, held_out)``: its distinct rows in the order of a hash of the text,
    how often each occurs, the streams of the texts behind each other, what it learnt, and its training words."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    own = ["ids", "held", "copies", "sizes", "streams"]

    def lists(rows: pa.Table) -> list[pa.Array]:
        buf, at = string_buffer(rows.column("stream"))
        columns = [rows.column(c).combine_chunks() for c in ("doc_id", "held_out", "copies")] + [pa.array(np.diff(at))]
        return [*(pa.ListArray.from_arrays([0, len(rows)], c) for c in columns), pa.array([_packed(buf)], pa.binary())]

    def read(batches):
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by(["block", "doc_id", "held_out", "text"]).aggregate([([], "count_all")]).rename_columns(["block", "doc_id", "held_out", "text", "copies"])
            rows = rows.sort_by("block").combine_chunks()
            for lo, hi, streams in _streams(rows.column("text").combine_chunks()):
                part = rows.slice(lo, hi - lo).append_column("stream", streams)
                block = part.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), hi - lo]
                for x, y in zip(cuts, cuts[1:]):
                    yield pa.record_batch([pa.array(block[x:x + 1]), *lists(part.slice(x, y - x))], names=["block", *own])

    def pack(key, chunks):
        parts = []
        for row in _rows(chunks.to_batches()):
            parts.append(pa.table([row["ids"], row["held"], row["copies"], _column(row)], names=["doc_id", "held_out", "copies", "stream"]))
        rows = pa.concat_tables(parts).group_by(["doc_id", "held_out", "stream"]).aggregate([("copies", "sum")]).rename_columns(["doc_id", "held_out", "stream", "copies"])
        del parts
        buf, at = string_buffer(rows.column("stream"))
        rows = rows.append_column("h", pa.array(hash_spans(padded(buf), at[:-1], at[1:]).view(np.int64)))
        rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("stream", "ascending")])
        out = lists(rows)
        s = Spelling(rows.column("stream").combine_chunks())
        del rows, buf
        release()
        held, copies = (x[0].values.to_numpy(zero_copy_only=False) for x in out[1:3])
        m, words, tokens = _learnt(s, np.where(held, 0, copies))
        del s
        release()
        weights = pa.array([np.concatenate([m.weights.ravel(), m.map.ravel(), np.repeat(m.seen, ORDERS + 1), m.map_seen.ravel()]).tolist()], pa.list_(pa.float64()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *out, weights, pa.array([tokens]), pa.array([len(words)]), pa.array([_packed(np.diff(words, prepend=np.uint64(0)))], pa.binary())],
                        names=["block", *own, "learnt", "n_tokens", "n_words", "words"])

    fields = f"block int, ids array<{kind}>, held array<boolean>, copies array<long>, sizes array<long>, streams binary"
    read_out = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)).cast("int").alias("block"), "doc_id", "held_out", "text").mapInArrow(read, fields)
    return read_out.repartitionById(min(many, TASKS), "block").groupBy("block").applyInArrow(pack, fields + ", learnt array<double>, n_tokens long, n_words long, words binary")


def _rows(batches):
    """Rows of blocks or parts of them: lists as arrays, the rest as Python values."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i].values if n in ("ids", "held", "copies", "sizes") else c[i].as_py() for n, c in zip(b.schema.names, b.columns)}


def _column(row: dict) -> pa.Array:
    """The streams of a row."""
    at = np.concatenate([[0], np.cumsum(row["sizes"].to_numpy())]).astype(np.int64)
    data = _unpacked(row["streams"], np.uint8, int(at[-1]))
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def _packed(a: np.ndarray) -> bytes:
    """An array as compressed bytes, the first bytes of all numbers ahead of their second ones."""
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), asbytes=True)


def _unpacked(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


# ---- spelling ----------------------------------------------------------------------------------------------------

class Index:
    """Places of keys among distinct sorted ones: tables of ranks by hash, each for the keys that the one ahead lost.  The
    rank in a place that several keys met is there as its complement, and compared; any other is the right one."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            bits, odd = int(len(left)).bit_length() + 1, np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            at = self._places(keys[left], bits, odd)
            table = np.zeros(1 << bits, np.int32)
            table[at] = left
            lost = np.flatnonzero(table[at] != left)
            at, left = at[lost], left[lost]
            table[at] = ~table[at]
            self.tables.append((bits, odd, table))

    @staticmethod
    def _places(keys: np.ndarray, bits: int, odd: np.uint64) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * odd >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of keys, all of which must be there."""
        rank, live = np.zeros(len(keys), np.int32), None
        for bits, odd, table in self.tables:
            got = np.take(table, self._places(keys, bits, odd))
            met = np.flatnonzero(got < 0)
            got[met] = own = ~got[met]
            if live is None:
                rank = got
            else:
                rank[live] = got
            lost = met[np.take(self.keys, own) != keys[met]]
            live, keys = lost if live is None else live[lost], keys[lost]
        return rank


class Spelling:
    """Streams as bytes, each with the space that ends it, and the pairs of a context and the byte after it.

    A pair is one number, the byte in its last eight bits, so the pairs of a context are next to each other.  The pair
    of a shorter context is the end of that of a longer one.
    """

    def __init__(self, column: pa.Array):
        buf, at = string_buffer(column)
        size = np.diff(at) + 1
        self.first = np.concatenate([[0], np.cumsum(size)])
        rows, n = len(size), int(self.first[-1])
        self.gap = ORDERS * np.arange(1, rows + 1)  # what lies ahead of each row's bytes besides other rows' bytes
        self.bytes, self.flat = np.full(n, 32, np.uint8), np.full(n + ORDERS * rows + 16, _AHEAD, np.uint8)
        for lo, hi, own in self._parts():
            ends = self.first[own.start + 1:own.stop + 1] - 1 - lo
            inner = np.ones(hi - lo, bool)
            inner[ends[ends < hi - lo]] = False
            begin = lo - own.start
            self.bytes[lo:hi][inner] = buf[begin:begin + int(inner.sum())]
            self.flat[np.arange(lo, hi) + self.spread(self.gap, lo, hi, own)] = self.bytes[lo:hi]
        self.eight = np.ndarray((max(len(self.flat) - 7, 0),), dtype=">u8", buffer=self.flat, strides=(1,))

    def _parts(self, size: int = _PART, most: int | None = None):
        """Ranges of bytes, and the rows that they lie in, so many rows at most."""
        hi = 0
        while hi < len(self.bytes):
            lo, hi = hi, min(hi + size, len(self.bytes))
            a, b = (np.searchsorted(self.first, [lo, hi - 1], side="right") - 1).tolist()
            if most and b >= a + most:
                b, hi = a + most - 1, int(self.first[a + most])
            yield lo, hi, slice(a, b + 1)

    def spread(self, values: np.ndarray, lo: int, hi: int, own: slice) -> np.ndarray:
        """Values of rows, for every byte of a range."""
        return np.repeat(values[own], np.diff(np.clip(self.first[own.start:own.stop + 1], lo, hi)))

    def pairs(self, *limits):
        """Ranges of bytes, the rows they lie in (``limits`` as for ``_parts``), and their pairs of the longest context; _MASKS has what is left of
        them for shorter ones."""
        for lo, hi, own in self._parts(*limits):
            begin = lo + int(self.gap[own.start])
            #: A pair has seven bytes: those at place - 6 to place are the first of the eight from there.
            p = self.eight[begin - ORDERS:hi + int(self.gap[own.stop - 1]) - ORDERS].astype(np.uint64) >> np.uint64(8)
            if own.stop - own.start > 1:  # what lies ahead of the later rows
                inner = np.ones(len(p), bool)
                ahead = self.first[own.start + 1:own.stop] + self.gap[own.start + 1:own.stop] - begin
                inner[ahead[:, None] - np.arange(1, ORDERS + 1)] = False
                p = p[inner]
            yield lo, hi, own, p

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the first of each row.  Every word ends in one space, and the last of a text is empty."""
        ends = np.flatnonzero(self.bytes == 32)
        first = np.searchsorted(ends, self.first)
        ends += np.repeat(self.gap, np.diff(first))
        start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        start[first[:-1]] = self.first[:-1] + self.gap
        out = np.empty(len(ends), np.uint64)
        for lo in range(0, len(ends), _PART):
            out[lo:lo + _PART] = hash_spans(self.flat, start[lo:lo + _PART], ends[lo:lo + _PART])
        return out, first

    @property
    def contexts(self) -> list[np.ndarray]:
        """The context of every byte, by order."""
        all_pairs = np.concatenate([p for *_, p in self.pairs()] or [np.zeros(0, np.uint64)])
        return [(all_pairs & m) >> np.uint64(8) for m in _MASKS]

    def distinct(self, copies: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every order: the distinct pairs in order, and how often they occur, rows weighted by ``copies``."""
        return self.nested(copies)[0]

    def nested(self, copies: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """``distinct``, and for every order but the longest the places in it of the pairs of the order above."""
        return _nested(*self._longest(np.ones(len(self.gap), np.int64) if copies is None else copies))

    def asked(self) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """``nested``, without counts.  Keeps what ``log10`` reads: ``pieces``, which are up to 256 rows' pairs in order, as
        their rows, whether each is another than the one ahead, and the places of these among the distinct pairs."""
        pieces, found = [], []
        for lo, hi, own, p in self.pairs(1 << 20, 256):
            p = p << np.uint64(8) | self.spread(np.arange(len(self.gap)) - own.start, lo, hi, own).astype(np.uint64)
            p.sort()  # the number of the row in the bits that a pair leaves free
            row, keys = p.astype(np.uint8), p >> np.uint64(8)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            pieces.append([own, row, np.packbits(new), keys[new]])
            found.append(pieces[-1][-1])
            if len(found) > 8 or hi == len(self.bytes):
                keys = np.concatenate(found)
                keys.sort()
                found = [keys[_starts(keys)]]
        keys = found[0] if found else np.zeros(0, np.uint64)
        for x in pieces:
            x[-1] = np.searchsorted(keys, x[-1]).astype(np.int32)
        self.pieces = pieces
        return _nested(keys, np.ones(len(keys), np.int32))

    def forget(self) -> None:
        """Drops the texts themselves, once it is known what they ask and of what words they are."""
        self.bytes = self.flat = self.eight = None
        self.tokens = None, self.tokens[1]
        release()

    def _longest(self, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of the longest context.  They have 56 bits; their rows' copies, up to 255, are sorted along
        in the other eight."""
        few, total = np.minimum(copies, 255).astype(np.uint8), len(self.bytes)
        room, filled, found = np.empty(min(total, _SORT + _PART), np.uint64), 0, []
        for lo, hi, own, p in self.pairs():
            np.bitwise_or(p << np.uint64(8), self.spread(few, lo, hi, own), out=room[filled:filled + hi - lo])
            filled += hi - lo
            if filled >= _SORT or hi == total:
                now = room[:filled]
                now.sort()
                new = [np.zeros(1, np.int64)]
                for x in range(0, filled, _PART):
                    keys = now[x:x + _PART + 1] >> np.uint64(8)
                    new.append(np.flatnonzero(keys[1:] != keys[:-1]) + x + 1)
                new = np.concatenate(new)
                n = np.empty(len(new), np.int32)
                for x in range(0, len(new), _PART):
                    part, end = new[x:x + _PART], new[x + _PART] if x + _PART < len(new) else filled
                    n[x:x + _PART] = np.add.reduceat(now[part[0]:end].astype(np.uint8), part - part[0], dtype=np.int32)
                found.append((now[new] >> np.uint64(8), n))
                filled = 0
                del now
        del room
        keys, n = _merged(found)
        if (copies > 255).any():
            n = n.astype(np.int64)
            for lo, hi, own, p in self.pairs():
                more = self.spread(np.maximum(copies - 255, 0), lo, hi, own)
                some, extra = _added(p[more > 0], more[more > 0])
                n[np.searchsorted(keys, some)] += extra
        return keys, n

    def words(self, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words in order, and how often they occur, rows weighted by ``copies``."""
        words, first = self.tokens
        return _counted(words, np.repeat(copies, np.diff(first)))

    @cached_property
    def index(self) -> tuple[np.ndarray, Rows, np.ndarray]:
        """The distinct pairs of the longest context, their rows of counts in every order, and the first row of each order."""
        return _indexed(*self.nested())

    def ranks(self):
        """Ranges of bytes, the rows they lie in, and where their pairs are in the index."""
        index = Index(self.index[0])
        for lo, hi, own, p in self.pairs():
            yield lo, hi, own, index(p)

    def bit(self, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bits at one place of each byte, and the slots of its contexts: eight for every row of counts."""
        rank = np.concatenate([r for *_, r in self.ranks()] or [np.zeros(0, np.int32)])
        return _BITS[self.bytes, depth].astype(np.uint32), [r.astype(np.int64) * 8 + depth for r in self.index[1][rank].T]


def _nested(keys: np.ndarray, n: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    out, ranks = [(keys, n)], []
    for mask in reversed(_MASKS[:-1]):
        *shorter, rank = _ranked(out[0][0] & mask, out[0][1])
        out.insert(0, tuple(shorter))
        ranks.insert(0, rank)
    return out, ranks


class Rows:
    """The rows of counts, one for each order, of pairs of the longest context: each order's place leads to the next one's."""

    def __init__(self, ranks: list[np.ndarray], base: np.ndarray, n: int):
        self.ranks, self.base, self.n = ranks, base, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, pairs: np.ndarray) -> np.ndarray:
        out, at = np.empty((len(pairs), ORDERS), np.int32 if self.base[-1] < 1 << 31 else np.int64), pairs
        for k in range(ORDERS - 1, -1, -1):
            at = at if k == ORDERS - 1 else np.take(self.ranks[k], at)
            out[:, k] = at + self.base[k]
        return out


def _indexed(distinct: list[tuple[np.ndarray, np.ndarray]], ranks: list[np.ndarray], base: np.ndarray | None = None) -> tuple[np.ndarray, Rows, np.ndarray]:
    base = np.cumsum([0, *(len(k) for k, _ in distinct)]) if base is None else base
    return distinct[-1][0], Rows(ranks, base, len(distinct[-1][0])), base


def _merged(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and sums of counts of several such pairs of arrays."""
    if len(found) == 1:
        return found[0]
    return _added(*(np.concatenate(x) for x in zip(*found))) if found else _added(np.zeros(0, np.uint64), None)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights, most of which are 1."""
    found, n = _added(np.sort(keys), None)
    other = np.flatnonzero(weights != 1)
    if len(other):
        some, more = _added(keys[other], weights[other] - 1)
        n[np.searchsorted(found, some)] += more.astype(n.dtype)
    return found, n


def _added(keys: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of ``n``; without ``n`` the keys are sorted and count once each.  A block's
    counts fit 32 bits; those of a shard come as 64."""
    if n is None:
        new = _starts(keys)
        return keys[new], np.diff(np.append(new, len(keys))).astype(np.int32)
    by = np.argsort(keys, kind="stable")  # of sorted runs, mostly
    keys, n = keys[by], n[by]
    del by
    new = _starts(keys)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _ranked(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_added``, and the place of every key among the distinct ones."""
    by, rank = np.argsort(keys, kind="stable"), np.empty(len(keys), np.int32)
    keys, n = keys[by], n[by]
    new = _starts(keys)
    rank[by] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(new, append=len(keys)))
    return keys[new], np.add.reduceat(n, new) if len(new) else n, rank


def _bytes(keys: np.ndarray) -> np.ndarray:
    """The bytes of pairs."""
    return (keys & np.uint64(255)).astype(np.uint8)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each of sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


# ---- mixing ------------------------------------------------------------------------------------------------------

class Mixer:
    """Counts by slot of how often a 0 and a 1 followed, gated weights, and the adaptive map over the last byte."""

    def __init__(self, n0: np.ndarray | None, n1: np.ndarray | None):
        self.n0, self.n1 = n0, n1
        self.weights = np.full((GATES, ORDERS + 1), 0.3, np.float32)
        self.weights[:, -1] = 0.0
        centre = np.linspace(-8, 8, BUCKETS)
        self.map = np.tile(1 / (1 + np.exp(-centre)), (256, 1)).astype(np.float32)
        self.seen = np.zeros(GATES)
        self.map_seen = np.zeros((256, BUCKETS))

    def prepare(self) -> None:
        """Log-odds of all slots, and whether their contexts have been seen."""
        self._room(len(self.n0) // 8)
        for lo in range(0, len(self.n0), 8 * _LOAD):
            self._load(lo // 8, self.n0[lo:lo + 8 * _LOAD], self.n1[lo:lo + 8 * _LOAD])

    def _room(self, rows: int) -> None:
        self.odds, self.full = np.empty(rows * 8, np.float32), np.empty(rows, np.int8)

    def _load(self, row: int, n0: np.ndarray, n1: np.ndarray) -> None:
        hi = row + len(n0) // 8
        self.odds[row * 8:hi * 8] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
        self.full[row:hi] = (n0[::8] + n1[::8]) > 0

    def load(self, rows: np.ndarray, last: np.ndarray, paths: np.ndarray, left_out: bool = False) -> None:
        """Takes the counts along the bits of pairs for their rows, ``last`` their bytes, all pairs left out of them once
        if so asked."""
        for lo in range(0, len(rows), _LOAD):
            part, at = paths[:, lo:lo + _LOAD].astype(np.float32, copy=False), rows[lo:lo + _LOAD]
            own, other, n = np.empty((8, part.shape[1]), np.float32), part[:8], part[8]
            for depth in range(7, -1, -1):
                own[depth] = n
                n = n + part[depth]
            if left_out:
                own = np.maximum(own - 1, 0)
            odds = np.log((own + np.float32(0.4)) / (other + np.float32(0.4)))
            odds *= np.take(_SIGNS, last[lo:lo + _LOAD], axis=1)
            self.odds.reshape(-1, 8)[at] = odds.T
            self.full[at] = (own[0] + other[0]) > 0

    def _inputs(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What the contexts of some bits say, and how many of the contexts have been seen."""
        x = np.empty((ORDERS + 1, len(slots[0])), np.float32)
        gate = np.zeros(len(slots[0]), np.int64)
        for k, at in enumerate(slots):
            x[k] = self.odds[at]
            gate += self.full[at // 8]
        x[-1] = 0.5
        return x, gate

    def _predict(self, x, gate, last):
        return self._refined((self.weights.T[:, gate] * x).sum(0), last)

    def _refined(self, z, last):
        """Probabilities of a 1 by log-odds and by the map, and the map's cells that were asked."""
        z = np.clip(z, -8, 8)
        share = (z + np.float32(8)) * np.float32((BUCKETS - 1) / 16)
        low = np.minimum(share.astype(np.int32), BUCKETS - 2)
        share -= low
        p = np.exp(np.negative(z, out=z), out=z)
        p += 1
        np.reciprocal(p, out=p)
        cell, cells = last.astype(np.int64) * BUCKETS + low, self.map.ravel()
        refined = np.take(np.diff(cells, append=cells[-1:]), cell)
        refined *= share
        refined += np.take(cells, cell)
        return p, refined, low, share

    @staticmethod
    def _last(s: Spelling, part=slice(None)):
        last = np.zeros(len(s.bytes), np.uint8)
        last[1:] = s.bytes[:-1]
        last[s.first[:-1][s.first[:-1] < len(last)]] = 32
        return last[part].astype(np.int32)

    def _gates(self, s: Spelling) -> np.ndarray:
        """How many contexts of every pair have been seen."""
        rows = s.index[1]
        gate = np.zeros(len(rows), np.int8)
        for lo in range(0, len(rows), _LOAD):
            for at in rows[np.arange(lo, min(lo + _LOAD, len(rows)))].T:
                gate[lo:lo + _LOAD] += np.take(self.full, at)
        return gate

    def _wide(self) -> np.ndarray:
        """Weights of every gate as a matrix from the odds of all orders, eight each, to the eight bits."""
        out = np.zeros((ORDERS + 1, 8, ORDERS, 8), np.float32)
        out[:, range(8), :, range(8)] = self.weights.reshape(ORDERS + 1, 8, ORDERS + 1)[:, :, :ORDERS].transpose(1, 0, 2)
        return out.reshape(ORDERS + 1, 8, 8 * ORDERS)

    def _mixed(self, s: Spelling, pairs: np.ndarray, gate: np.ndarray, wide: np.ndarray):
        """Some pairs, grouped by their gates: their order, groups, inputs of all orders, and by place of the bit the mixed
        log-odds, last bytes and bits."""
        by = np.argsort(gate, kind="stable")
        ends = np.cumsum(np.bincount(gate, minlength=ORDERS + 1)).tolist()
        groups = [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
        pairs = pairs[by]
        x = np.take(self.odds.reshape(-1, 8), s.index[1][pairs].ravel(), axis=0).reshape(len(by), 8 * ORDERS)
        z, bias = np.empty((8, len(by)), np.float32), 0.5 * self.weights.reshape(ORDERS + 1, 8, ORDERS + 1)[:, :, ORDERS:]
        for g, at in groups:
            np.matmul(wide[g], x[at].T, out=z[:, at])
            z[:, at] += bias[g]
        keys = np.take(s.index[0], pairs)
        last = (keys >> np.uint64(8) & np.uint64(255)).astype(np.int32)
        last[last == _AHEAD] = 32
        return by, groups, x, z, last, np.take(_BITS.T, (keys & np.uint64(255)).astype(np.int64), axis=1)

    def learn(self, s: Spelling, counts: np.ndarray | None = None, rate: float = 0.1) -> None:
        """Online, pair by pair of the longest context in the order of their hashes, each as often as ``counts`` has
        it: predict a step of them, then move weights and map towards their bits."""
        keys = s.index[0]
        if counts is None:
            counts = s.distinct()[-1][1]
        if not hasattr(self, "odds"):
            self.prepare()
        weights = self.weights.reshape(ORDERS + 1, 8, ORDERS + 1)
        there = np.flatnonzero(counts)
        there = there[np.argsort(mix(keys[there]), kind="stable")]
        gates = self._gates(s)
        for lo in range(0, len(there), _STEP):
            pairs = np.sort(there[lo:lo + _STEP])
            by, groups, x, z, last, bits = self._mixed(s, pairs, gates[pairs], self._wide())
            n = counts[pairs[by]].astype(np.float32)
            p, _, low, share = self._refined(z, last)
            err = (bits - p) * n
            for g, at in groups:
                own = float(n[at].sum())
                step = rate * 30 / (30 + np.sqrt(self.seen[g * 8] / 1e3)) / own
                weights[g, :, :ORDERS] += step * np.einsum("jkj->jk", (err[:, at] @ x[at]).reshape(8, ORDERS, 8))
                weights[g, :, ORDERS] += step * 0.5 * err[:, at].sum(1)
                self.seen[g * 8:g * 8 + 8] += own
            cell = (last * BUCKETS + low + (share > 0.5)).ravel()
            hits = np.bincount(cell, weights=np.tile(n, 8), minlength=256 * BUCKETS).reshape(256, BUCKETS)
            ones = np.bincount(cell, weights=(bits * n).ravel(), minlength=256 * BUCKETS).reshape(256, BUCKETS)
            self.map += ((ones - hits * self.map) / (self.map_seen + hits + 40)).astype(np.float32)
            self.map_seen += hits

    def log10(self, s: Spelling) -> np.ndarray:
        """log10 probability of every stream: of the eight bits of every byte.  All that they depend on is the pair of
        the longest context, so a pair is worked out once however often it occurs in the block."""
        if not hasattr(self, "odds"):
            self.prepare()
        if not hasattr(s, "pieces"):
            s.index = _indexed(*s.asked())
        value, gates, wide = np.zeros(len(s.index[0])), self._gates(s), self._wide()
        for lo in range(0, len(value), _LOAD):
            pairs = np.arange(lo, min(lo + _LOAD, len(value)))
            by, _, _, z, last, bits = self._mixed(s, pairs, gates[lo:lo + _LOAD], wide)
            p, refined, _, _ = self._refined(z, last)
            p = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
            p = np.where(bits == 1, p, 1 - p)
            p = (p[:4] * p[4:]).astype(np.float64)  # all eight at once would leave the range of 32 bits
            p = p[:2] * p[2:]
            value[pairs[by]] = np.log10(p[0] * p[1])
        total = np.zeros(len(s.gap))
        for own, row, new, rank in s.pieces:
            first = np.flatnonzero(np.unpackbits(new, count=len(row)))
            each = np.repeat(np.take(value, rank), np.diff(first, append=len(row)))
            total[own] += np.bincount(row, weights=each, minlength=own.stop - own.start)
        return total


# ---- counts of all training texts --------------------------------------------------------------------------------

def _learnt(s: Spelling, copies: np.ndarray) -> tuple[Mixer, np.ndarray, int]:
    """What a block learns from its training texts with its own counts, the distinct words of these texts, and how many
    words they have in all."""
    words, first = s.tokens
    many = np.diff(first)
    words = np.sort(words[np.repeat(copies > 0, many)])
    words, total = words[_starts(words)], int((copies * many).sum())
    distinct, ranks = s.nested(copies)
    s.forget()
    m, s.index = Mixer(None, None), _indexed(distinct, ranks)
    del ranks
    m._room(int(s.index[2][-1]))
    for (keys, n), row in zip(distinct, s.index[2]):
        hi = 0
        while hi < len(keys):  # contexts stay whole
            lo, hi = hi, hi + _PART
            hi = len(keys) if hi >= len(keys) else int(np.searchsorted(keys, (keys[hi] >> np.uint64(8)) + np.uint64(1) << np.uint64(8)))
            m.load(np.arange(row + lo, row + hi), _bytes(keys[lo:hi]), _paths(keys[lo:hi], n[lo:hi]), left_out=True)
    del distinct[:-1], keys
    release()
    m.learn(s, n)
    return m, words, total


def _averaged(blocks: DataFrame) -> Mixer:
    """A mixer whose weights and map are the averages, by use, of those that the blocks have learnt."""
    m = Mixer(None, None)
    size = m.weights.size + m.map.size
    value = lambda a, b: F.element_at("learnt", F.col("i") + 1 + a) * F.element_at("learnt", F.col("i") + 1 + b)
    each = blocks.select("learnt", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).select("i", F.element_at("learnt", F.col("i") + 1 + size).alias("n"), value(0, size).alias("v"))
    got = each.where("n > 0").groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    flat = np.concatenate([m.weights.ravel(), m.map.ravel()]).astype(float)
    flat[got.column("i").to_numpy()] = got.column("v").to_numpy() / got.column("n").to_numpy()
    m.weights, m.map = flat[:m.weights.size].reshape(m.weights.shape).astype(np.float32), flat[m.weights.size:].reshape(m.map.shape).astype(np.float32)
    return m


def _training_words(blocks: DataFrame) -> int:
    """How many different words the training texts have."""
    def run(batches):
        for row in _rows(batches):
            yield pa.record_batch([pa.array(np.cumsum(_unpacked(row["words"], np.uint64, row["n_words"]), dtype=np.uint64).view(np.int64))], names=["h"])

    return blocks.select("n_words", "words").mapInArrow(run, "h long").distinct().count()


def _dealt(distinct: list[tuple[np.ndarray, np.ndarray]], shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every order, its pairs by the shard of their contexts, and where each shard begins among them."""
    out = []
    for k, (keys, _) in enumerate(distinct):
        shard = (mix(keys >> np.uint64(8) if k < ORDERS else keys) % np.uint64(shards)).astype(np.int32)
        by = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable").astype(np.int32)
        out.append((by, np.searchsorted(shard[by], np.arange(shards + 1))))
    return out


def _copies(row: dict) -> np.ndarray:
    """How often each text of a block counts in training."""
    return np.where(row["held"].to_numpy(zero_copy_only=False), 0, row["copies"].to_numpy())


def _asks(blocks: DataFrame, shards: int) -> DataFrame:
    """Distinct pairs and words of every block, with their counts in texts not held out, by shard."""
    def run(batches):
        for row in _rows(batches):
            s, copies = Spelling(_column(row)), _copies(row)
            distinct = [*s.distinct(copies), s.words(copies)]
            del s
            dealt = _dealt(distinct, shards)
            out: list[list] = [[], [], [], []]
            for shard in range(shards):
                own = [by[at[shard]:at[shard + 1]] for by, at in dealt]
                if not any(map(len, own)):
                    continue
                keys = np.concatenate([np.diff(keys[i], prepend=np.uint64(0)) for (keys, _), i in zip(distinct, own)])
                n = np.concatenate([n[i] for (_, n), i in zip(distinct, own)])
                for x, y in zip(out, (shard, list(map(len, own)), _packed(keys), _packed(n.astype(np.uint32)))):
                    x.append(y)
            yield pa.record_batch([pa.array(np.full(len(out[0]), row["block"], np.int32)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), *(pa.array(x, pa.binary()) for x in out[2:])],
                                  names=["block", "shard", "sizes", "pairs", "n"])
            del distinct, dealt, out
            release()

    return blocks.select("block", "held", "copies", "sizes", "streams").mapInArrow(run, "block int, shard int, sizes array<int>, pairs binary, n binary")


def _paths(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts along the eight bits of sorted distinct pairs: of the other bit at each place, and of the pair."""
    #: Of 32 bits unless a shard has more.
    kind = np.uint32 if n.sum(dtype=np.int64) < 1 << 32 else np.uint64
    out, ahead = np.empty((9, len(keys)), kind), None
    if not len(keys):
        return out
    apart = np.minimum(keys[1:] ^ keys[:-1], np.uint64(256)).astype(np.uint16)
    ends = np.zeros(len(keys) + 1, kind)
    np.cumsum(n, out=ends[1:], dtype=kind)
    for depth in range(8):
        new = np.concatenate([[0], np.flatnonzero(apart >= 1 << 8 - depth) + 1, [len(keys)]])
        now = np.repeat(np.diff(ends[new]), np.diff(new))
        if depth:
            np.subtract(ahead, now, out=out[depth - 1])
        ahead = now
    out[8] = n
    np.subtract(ahead, out[8], out=out[7])
    return out


def _answers(asks: DataFrame, shards: int) -> DataFrame:
    """For every block that asked a shard: the counts along its pairs, and of its words."""
    def run(key, rows):
        block, sizes = rows.column("block").to_numpy(), np.array(rows.column("sizes").to_pylist(), np.int64)
        pairs, counts = ([_unpacked(x.as_py(), kind, int(s.sum())) for x, s in zip(rows.column(c), sizes)] for c, kind in (("pairs", np.uint64), ("n", np.uint32)))
        at = np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(sizes, 1)], 1)
        out: list[list] = [[] for _ in sizes]
        for k in range(ORDERS + 1):
            parts = [slice(a[k], a[k + 1]) for a in at]
            keys = np.concatenate([np.cumsum(p[i], dtype=np.uint64) for p, i in zip(pairs, parts)])
            found, sums, rank = _ranked(keys, np.concatenate([c[i] for c, i in zip(counts, parts)]).astype(np.int64))
            paths = _paths(found, sums) if k < ORDERS else sums[None].astype(np.uint32 if sums.sum() < 1 << 32 else np.uint64)
            for o, i in zip(out, np.split(rank, np.cumsum(sizes[:, k])[:-1])):
                o.append(np.take(paths, i, axis=1).ravel())
        blobs, bits = [], []
        for o in out:
            bits.append(8 * max(x.itemsize for x in o))
            blobs.append(_packed(np.concatenate(o)))
        return pa.table([pa.array(block, pa.int32()), pa.array(np.full(len(block), key[0].as_py(), np.int32)), pa.array(bits, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "shard", "bits", "paths"])

    return asks.repartitionById(min(shards, TASKS), "shard").groupBy("shard").applyInArrow(run, "block int, shard int, bits int, paths binary")


def _with_counts(row: dict, answers: Iterator[dict], shards: int) -> tuple[Spelling, Mixer, np.ndarray]:
    """A block's texts, a mixer over the counts of their contexts, and the counts of all their words."""
    s = Spelling(_column(row))
    tokens = s.tokens[0]
    spelt = _added(np.sort(tokens), None)[0]
    find, words = Index(spelt), np.empty(len(tokens), np.int32)
    for lo in range(0, len(tokens), _PART):
        words[lo:lo + _PART] = find(tokens[lo:lo + _PART])
    s.tokens = None, s.tokens[1]
    del tokens, find
    distinct, ranks = s.asked()
    s.forget()
    dealt = _dealt([*((k, None) for k, _ in distinct), (spelt, None)], shards)
    known, last = np.zeros(len(spelt), np.int64), np.concatenate([_bytes(k) for k, _ in distinct])
    base = np.cumsum([0, *(len(k) for k, _ in distinct)])
    del distinct[:-1], spelt
    release()
    m = Mixer(None, None)
    m._room(len(last))
    m.odds[:], m.full[:] = 0, 0
    for answer in answers:
        *own, word = (by[at[answer["shard"]]:at[answer["shard"] + 1]] for by, at in dealt)
        flat, lo, paths = _unpacked(answer["paths"], f"u{answer['bits'] // 8}", sum(9 * len(i) for i in own) + len(word)), 0, []
        for i in own:
            paths.append(flat[lo:lo + 9 * len(i)].reshape(9, len(i)))
            lo += 9 * len(i)
        rows = np.concatenate([i + b for i, b in zip(own, base)])
        m.load(rows, last[rows], np.concatenate(paths, axis=1))
        known[word] = flat[lo:]
    del dealt, last
    words, s.index = np.take(known, words), _indexed(distinct, ranks, base)
    return s, m, words


# ---- texts -------------------------------------------------------------------------------------------------------

def scores(docs: DataFrame, head: int = 0) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: held_out, n_tokens, n_known, train_tokens, base_score, score,
    and bits_per_byte of the model.

    A null text is empty: it has the token that ends a text only.  A null id counts as empty text for the split.
    Equal rows are counted as often as they occur, learnt from once, and come back as often; an empty table gives an
    empty one; other columns are not read.  ``head`` is there for callers of old: no table of words is broadcast.
    Weights are learnt block by block and averaged, and the number of blocks follows the bytes of the table, so the score
    of a text depends on the whole table, though not on its partitions or their order.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (remainder(MODULUS) == HELD_OUT).alias("held_out"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    many = max(1, -(-int(size) // BLOCK), min(BLOCKS, int(size) // LEAST))
    blocks = written(_blocks(texts, many), "lm-blocks", maxRecordsPerFile=1)
    m, v = _averaged(blocks), _training_words(blocks)
    shared = docs.sparkSession.sparkContext.broadcast((m.weights, m.map))
    answers = _answers(_asks(blocks, many), many)
    streams = blocks.select("block", "ids", "held", "copies", "sizes", "streams")
    n = int(blocks.agg(F.sum("n_tokens")).first()[0] or 0)
    floor = np.log10(n + 0.1 * (v + 1))

    def run(key, texts, answers):
        out = []
        for row in _rows(texts.to_batches()):
            s, m, c = _with_counts(row, _rows(answers.to_batches()), many)
            m.weights, m.map = shared.value
            first, size = s.tokens[1], np.diff(s.first)
            score, base = m.log10(s), segment_sum(np.log10(c + 0.1) - floor, first)
            own = pa.array(np.repeat(np.arange(len(size)), row["copies"].to_numpy()))
            columns = [row["ids"], row["held"], *map(pa.array, (np.diff(first), segment_sum((c > 0).astype(np.int64), first), np.full(len(size), n), base, score, -score / np.log10(2) / size))]
            out.append(pa.table([x.take(own) for x in columns], names=names))
            del s, m, c
            release()
        return pa.concat_tables(out)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    dealt = (x.repartitionById(min(many, TASKS), "block").groupBy("block") for x in (streams, answers))
    return next(dealt).cogroup(next(dealt)).applyInArrow(run, schema)
