"""SentencePiece encoding and decoding over the piece lattice of a public model, with the N best segmentations.

Spaces are part of pieces and no piece goes on from another character into a space, so the lattice of a text falls
apart at every space that follows another character.  The parts (a word with the spaces before it) are solved once
per slice of texts in numpy: a walk down the piece trie from every byte gives the edges, a forward and a backward
Viterbi pass the best path and the loss of the second best.  The N best paths of a text deviate from the best one in
its N-1 parts of least loss only; for these, A-star runs backward from the end of the part, with the forward
Viterbi scores as exact heuristics, and the lists are merged.

The model file ranks its pieces, and a sum of ranks would favour short ones.  A piece of rank r counts as having the
probability that Zipf's law gives it, in proportion to 1 / (r + 1), so paths are compared as in a unigram model and
common words stay whole.  Nothing is learnt for this.

A part longer than ``LONG`` (texts without spaces) is solved by itself, position by position, over edges that are
found window by window: exact, with some twenty bytes of memory for each of its own, for any N.

A character without a piece is spelt in byte pieces.  A literal U+2581 is spelt too, and not read as a space, so that
every text decodes to itself.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import math
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import Tokens, hash_spans, padded, slices, string_buffer

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 4 << 20
CELLS = 1 << 21
#: Bytes of parts beyond which one is solved by itself, and bytes whose edges are held at once.
LONG, SPAN = 1 << 10, 1 << 14
MARK = "▁"
_EVERY = np.ones(256, bool)


class Model:
    """Pieces as bytes (a space for the mark), their scores and ids, and the trie as an open-addressed table."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], spelling: list[int], ids: int):
        self.spelling = np.array(spelling, np.int32)
        self.of = {p: (s, i) for i, p, s in pieces}
        self.unknown = min((s for _, _, s in pieces if s > -1e8), default=0.0) - 10.0
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.single = np.zeros(256, bool)
        table = [b""] * ids
        for i, p, _ in pieces:
            table[i] = p
        for b, i in enumerate(spelling):
            table[i] = bytes([b])
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        nodes, ends = {b"": 0}, {}
        keys, nexts = [], []
        for i, p, s in pieces:
            node = 0
            for k in range(1, len(p) + 1):
                child = nodes.get(p[:k])
                if child is None:
                    child = nodes[p[:k]] = len(nodes)
                    keys.append(node << 8 | p[k - 1])
                    nexts.append(child)
                node = child
            ends[node] = (s, i)
        self.score = np.full(len(nodes), -np.inf)
        self.id = np.full(len(nodes), -1, np.int32)
        for node, (s, i) in ends.items():
            self.score[node], self.id[node] = s, i
        bits = max(int(np.ceil(np.log2(max(len(keys), 1) * 5))), 4)
        self.bits = bits
        self.slot_key, self.slot_next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, child, at in zip(keys, nexts, self._slot(np.array(keys, np.int64)).tolist() if keys else []):
            while self.slot_key[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            self.slot_key[at], self.slot_next[at] = key, child

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelling = [], [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                spelling[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in p.lstrip(MARK):
                    raise ValueError("a piece goes on from another character into a space")
                pieces.append((i, p.replace(MARK, " ").encode(), sp.get_score(i)))
        whole = sum(1 / (k + 1) for k in range(len(pieces)))
        by = sorted(pieces, key=lambda x: (-x[2], x[0]))
        pieces = [(i, p, -math.log((k + 1) * whole)) for k, (i, p, _) in enumerate(by)]
        return cls(pieces, spelling, sp.get_piece_size())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, or -1."""
        keys = node.astype(np.int64) << 8 | byte
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_next[at], -1)
        open_ = np.flatnonzero((got != keys) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.slot_next[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    # ---- one part, in plain Python -------------------------------------------------------------------------------

    def edges(self, part: bytes) -> list[list[tuple[int, float, int]]]:
        """Edges (begin, score, id) that end at each position of a part."""
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(part) + 1)]
        for a in range(len(part)):
            for b in range(a + 1, min(a + self.longest, len(part)) + 1):
                known = self.of.get(part[a:b])
                if known:
                    into[b].append((a, *known))
        a = 0
        while a < len(part):
            b = a + 1
            while b < len(part) and part[b] & 0xC0 == 0x80:
                b += 1
            if part[a:b] not in self.of:
                for k in range(a, b):
                    into[k + 1].append((k, self.unknown, int(self.spelling[part[k]])))
            a = b
        return into

    def nbest(self, part: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a part, best first: A-star backward from its end, forward scores as heuristics."""
        if len(part) > LONG:
            return self._nbest_long(np.frombuffer(part, np.uint8), n)
        into = self.edges(part)
        ahead = [0.0] + [-np.inf] * len(part)
        for b in range(1, len(part) + 1):
            ahead[b] = max((ahead[a] + s for a, s, _ in into[b]), default=-np.inf)
        heap = [(-ahead[len(part)], len(part), 0, 0.0, None)]
        out, count = [], 0
        # Rest paths of one position come up best first, so no more than n of them can be part of the n best.
        popped = [0] * (len(part) + 1)
        while heap and len(out) < n:
            _, at, _, done, rest = heapq.heappop(heap)
            if at == 0:
                ids = []
                while rest:
                    ids.append(rest[0])
                    rest = rest[1]
                out.append((done, tuple(ids)))
                continue
            popped[at] += 1
            if popped[at] > n:
                continue
            for a, s, i in into[at]:
                if ahead[a] > -np.inf and popped[a] < n:
                    count += 1
                    heapq.heappush(heap, (-(ahead[a] + s + done), a, count, done + s, (i, rest)))
        return out

    # ---- one long part -------------------------------------------------------------------------------------------

    def _walk(self, data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (begin, size, score, id) that begin in ``[lo, hi)`` of a part, which begins with a whole character."""
        n = len(data)
        at = np.arange(lo, hi)
        alive, node, found = at, np.zeros(hi - lo, np.int64), []
        lead = data[at]
        length = np.where(lead < 0x80, 1, np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2)))
        covered = lead & 0xC0 == 0x80
        for k in range(1, self.longest + 1):
            inside = alive + k <= n
            alive, node = alive[inside], node[inside]
            node = self.step(node, data[alive + k - 1])
            alive, node = alive[node >= 0], node[node >= 0]
            if not len(alive):
                break
            hit = self.score[node] > -np.inf
            a = alive[hit]
            found.append((a, np.full(len(a), k), self.score[node[hit]], self.id[node[hit]]))
            covered[a - lo] |= length[a - lo] == k
        bare = np.flatnonzero(~covered)
        for k in range(4):
            a = at[bare[(length[bare] > k) & (at[bare] + k < n)]] + k
            found.append((a, np.ones(len(a), np.int64), np.full(len(a), self.unknown), self.spelling[data[a]]))
        begin, size, score, ids = (np.concatenate(x) for x in zip(*found))
        return begin, size, score, ids

    def _window(self, data: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, float, int]]:
        """The edges that begin in a range of a part, in the order of their begins."""
        n = len(data)
        while lo and data[lo] & 0xC0 == 0x80:
            lo -= 1  # windows begin with whole characters, as spelling needs
        while hi < n and data[hi] & 0xC0 == 0x80:
            hi -= 1
        edges = self._walk(data, lo, hi)
        by = np.argsort(edges[0], kind="stable")
        return list(zip(*(x[by].tolist() for x in edges)))

    def _forward(self, data: np.ndarray) -> tuple[array, np.ndarray, np.ndarray]:
        """Best scores up to every position of a part, and the size and the id of the last piece on the way there."""
        n = len(data)
        best, size, ids = array("d", [-math.inf]) * (n + 1), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        best[0] = 0.0
        for lo in range(0, n, SPAN):
            for a, k, s, i in self._window(data, lo, min(lo + SPAN, n)):
                via = best[a] + s
                if via > best[a + k]:
                    best[a + k] = via
                    size[a + k], ids[a + k] = k, i
        return best, size, ids

    def _turns(self, data: np.ndarray, best: array, size: np.ndarray) -> Callable[[int], list[tuple[float, int, int]]]:
        """For a position, the edges into it that its best way does not take: (loss, begin, id).  Edges are made window by
        window, and those of the last few windows asked for are held."""
        @functools.lru_cache(maxsize=3)
        def window(lo: int) -> dict[int, list[tuple[float, int, int]]]:
            into: dict[int, list[tuple[float, int, int]]] = {}
            for a, k, s, i in self._window(data, max(lo - self.longest, 0), min(lo + SPAN, len(data))):
                b = a + k
                if lo < b <= lo + SPAN and k != size[b]:
                    into.setdefault(b, []).append((max(best[b] - best[a] - s, 0.0), a, i))
            return into

        return lambda at: window((at - 1) // SPAN * SPAN).get(at, ())

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Ids of the best path of one part, its score, and the loss of the second best: the least turn off the best."""
        best, size, ids = self._forward(data)
        turns, out, at, least = self._turns(data, best, size), [], len(data), math.inf
        while at > 0:
            out.append(int(ids[at]))
            least = min(least, min((t[0] for t in turns(at)), default=math.inf))
            at -= int(size[at])
        return np.array(out[::-1], np.int32), best[len(data)], least

    def _nbest_long(self, data: np.ndarray, n: int) -> list[tuple[float, array]]:
        """As ``nbest``, for a part of any length.

        A state is a position, what its way there has lost against the best, and the turns it has taken off best ways; the
        rest of a path follows from the best ways.  Every open state ends in a path of just its loss, and no two in the
        same one, so only the n states of least loss need to be open.
        """
        best, size, ids = self._forward(data)
        turns, count = self._turns(data, best, size), 0
        open_: list[tuple[float, int, int, tuple]] = [(0.0, 0, len(data), ())]
        out: list[tuple[float, tuple]] = []
        while open_ and len(out) < n:
            lost, _, at, taken = open_.pop(0)
            room = n - len(out) - 1
            while at > 0:
                for more, a, i in turns(at):
                    if len(open_) < room or room and lost + more < open_[-1][0]:
                        count += 1
                        bisect.insort(open_, (lost + more, count, a, (*taken, (at, a, i))))
                        del open_[room:]
                at -= int(size[at])
            out.append((lost, taken))
        paths = []
        for lost, taken in out:
            own, at, back = {b: (a, i) for b, a, i in taken}, len(data), array("i")
            while at > 0:
                a, i = own.get(at) or (at - int(size[at]), int(ids[at]))
                back.append(i)
                at = a
            paths.append((best[len(data)] - lost, back[::-1]))
        return paths

    # ---- many parts, in numpy ------------------------------------------------------------------------------------

    def solve(self, pad: np.ndarray, start: np.ndarray, end: np.ndarray):
        """For each part: number of pieces, their ids in one pool, best score, loss of the second best path."""
        counts, best, loss = np.zeros(len(start), np.int64), np.zeros(len(start)), np.full(len(start), np.inf)
        order = np.argsort(end - start, kind="stable")
        order = order[:int(np.searchsorted((end - start)[order], LONG, "right"))]
        size = (end - start)[order]
        pools, spots, lo = [], [], 0
        for k in np.flatnonzero(end - start > LONG).tolist():
            ids, best[k], loss[k] = self._long(pad[start[k]:end[k]])
            counts[k] = len(ids)
            pools.append(ids)
            spots.append(np.array([k]))
        while lo < len(order):
            # Parts of like length share a block; its size is bounded by cells, not by parts.
            longest = max(int(size[lo]) * 3 // 2, 6)
            lanes = max(CELLS // (longest * min(longest, self.longest)), 1)
            hi = min(int(np.searchsorted(size, longest, "right")), lo + lanes)
            pick = order[lo:hi]
            c, pool, b, x = self._block(pad, start[pick], end[pick])
            counts[pick], best[pick], loss[pick] = c, b, x
            pools.append(pool)
            spots.append(pick)
            lo = hi
        pool = np.concatenate(pools) if pools else np.zeros(0, np.int32)
        picked = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        where = np.zeros(len(start), np.int64)
        where[picked] = np.cumsum(counts[picked]) - counts[picked]
        return counts, pool, where, best, loss

    def _block(self, pad, start, end):
        lanes, longest = len(start), int((end - start).max())
        size = end - start
        text = np.where(np.arange(longest) < size[:, None], pad[np.minimum(start[:, None] + np.arange(longest), len(pad) - 1)], 0)
        width = min(self.longest, longest)
        score = np.full((width + 1, longest, lanes), -np.inf)
        ids = np.full((width + 1, longest, lanes), -1, np.int32)
        lane, at = np.nonzero(np.arange(longest) < size[:, None])
        node = np.zeros(len(lane), np.int64)
        lead = text[lane, at]
        length = np.where(lead < 0x80, 1, np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, 2)))
        covered = lead & 0xC0 == 0x80
        alive = np.arange(len(lane))
        for k in range(1, width + 1):
            inside = at[alive] + k <= size[lane[alive]]
            alive, node = alive[inside], node[inside]
            node = self.step(node, text[lane[alive], at[alive] + k - 1])
            alive, node = alive[node >= 0], node[node >= 0]
            if not len(alive):
                break
            s = self.score[node]
            hit = s > -np.inf
            a = alive[hit]
            score[k, at[a], lane[a]], ids[k, at[a], lane[a]] = s[hit], self.id[node[hit]]
            covered[a] |= length[a] == k
        bare = np.flatnonzero(~covered)
        for k in range(4):
            own = bare[(length[bare] > k) & (at[bare] + k < size[lane[bare]])]
            score[1, at[own] + k, lane[own]] = self.unknown
            ids[1, at[own] + k, lane[own]] = self.spelling[text[lane[own], at[own] + k]]
        ahead = np.full((longest + 1, lanes), -np.inf)
        back = np.zeros((longest + 1, lanes), np.int64)
        ahead[0] = 0
        for b in range(1, longest + 1):
            for k in range(1, min(width, b) + 1):
                via = ahead[b - k] + score[k, b - k]
                better = via > ahead[b]
                np.copyto(ahead[b], via, where=better)
                np.copyto(back[b], k, where=better)
        behind = np.full((longest + 1, lanes), -np.inf)
        everyone = np.arange(lanes)
        behind[size, everyone] = 0
        for a in range(longest - 1, -1, -1):
            for k in range(1, min(width, longest - a) + 1):
                np.maximum(behind[a], behind[a + k] + score[k, a], out=behind[a])
        best = ahead[size, everyone]
        counts, at, trail = np.zeros(lanes, np.int64), size.copy(), []
        live = everyone[at > 0]
        while len(live):
            k = back[at[live], live]
            a = at[live] - k
            trail.append((live, ids[k, a, live]))
            counts[live] += 1
            score[k, a, live] = -np.inf  # what is left are the edges off the best path
            at[live] = a
            live = live[a > 0]
        begin = np.cumsum(counts) - counts
        pool = np.zeros(int(counts.sum()), np.int32)
        for k, (live, i) in enumerate(trail):
            pool[begin[live] + counts[live] - 1 - k] = i
        second = np.full(lanes, -np.inf)
        for k in range(1, width + 1):
            for a in range(longest - k + 1):
                np.maximum(second, ahead[a] + score[k, a] + behind[a + k], out=second)
        return counts, pool, best, best - second

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of rows of ids; the space put before each text is taken off."""
        size = self.size[ids]
        out = np.cumsum(size) - size
        data = self.bytes[np.repeat(self.start[ids] - out, size) + np.arange(int(size.sum()))]
        ends = np.append(out, len(data))[first]
        some = first[1:] > first[:-1]
        keep = np.ones(len(data), bool)
        keep[ends[:-1][some]] = False
        return data[keep], ends - np.concatenate([[0], np.cumsum(some)])


def encode_column(model: Model, column: pa.Array, n: int):
    """Per slice: ids, first id of each row, best scores, and per row the other n-1 paths as (loss, patches);
    a patch (first piece, number of pieces, ids) replaces pieces of the best path."""
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets, SLICE):
        rows = hi - lo
        own = np.diff(offsets[lo:hi + 1])
        some = own > 0
        # One space goes before every text that is not empty.
        shift = np.cumsum(some)
        o = offsets[lo:hi + 1] - offsets[lo] + np.concatenate([[0], shift])
        data = np.full(int(o[-1]), 32, np.uint8)
        data[np.arange(int(own.sum())) + np.repeat(shift, own)] = buf[offsets[lo]:offsets[hi]]
        pad = padded(data)
        space = data == 32
        head = np.zeros(len(data) + 1, bool)
        head[:-1] = space
        head[1:-1] &= ~space[:-1]
        head[o] = True
        cuts = np.flatnonzero(head)
        start, end = cuts[:-1], cuts[1:]
        first = np.searchsorted(start, o)
        _, index, unit = np.unique(hash_spans(pad, start, end), return_index=True, return_inverse=True)
        counts, pool, where, best, loss = model.solve(pad, start[index], end[index])
        c = counts[unit]
        at = np.cumsum(c) - c
        ids = pool[np.repeat(where[unit] - at, c) + np.arange(int(c.sum()))]
        first_id = np.append(at, len(ids))[first]
        total = np.concatenate([[0.0], np.cumsum(best[unit])])
        scores = total[first[1:]] - total[first[:-1]]
        others: list[list] = [[] for _ in range(rows)]
        if n > 1 and len(unit):
            left = loss[unit]
            picks: list[list[int]] = [[] for _ in range(rows)]
            filled = np.flatnonzero(first[1:] > first[:-1])
            row = np.repeat(np.arange(rows), np.diff(first))
            for _ in range(n - 1):
                least = np.full(rows, np.inf)
                least[filled] = np.minimum.reduceat(left, first[:-1][filled])
                hit = np.flatnonzero((left == least[row]) & np.isfinite(left))
                _, once = np.unique(row[hit], return_index=True)
                for r, k in zip(row[hit[once]].tolist(), hit[once].tolist()):
                    picks[r].append(k)
                left[hit[once]] = np.inf
            known: dict[int, list] = {}
            for r, ks in enumerate(picks):
                if ks:
                    lists = []
                    for k in sorted(ks):
                        u = int(unit[k])
                        if u not in known:
                            known[u] = model.nbest(data[start[k]:end[k]].tobytes(), n)
                        lists.append((int(at[k] - first_id[r]), int(c[k]), known[u]))
                    others[r] = _merge(lists, n)
        yield ids, first_id, scores, others


def _merge(lists: list[tuple[int, int, list]], n: int) -> list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]:
    """The n-1 best combinations of the lists but for the best one."""
    heap, seen, out = [(0.0, (0,) * len(lists))], {(0,) * len(lists)}, []
    while heap and len(out) < n:
        lost, choice = heapq.heappop(heap)
        out.append((lost, [(at, c, paths[k][1]) for (at, c, paths), k in zip(lists, choice) if k]))
        for j, (_, _, paths) in enumerate(lists):
            if choice[j] + 1 < len(paths):
                then = (*choice[:j], choice[j] + 1, *choice[j + 1:])
                if then not in seen:
                    seen.add(then)
                    heapq.heappush(heap, (lost + paths[choice[j]][0] - paths[choice[j] + 1][0], then))
    return out[1:]


_PATHS = "array<struct<score:double, patches:array<struct<first:int, pieces:int, ids:array<int>>>>>"
_PATHS_ARROW = pa.list_(pa.struct([("score", pa.float64()), ("patches", pa.list_(pa.struct([("first", pa.int32()), ("pieces", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encoded(docs: DataFrame, n: int = 3, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``ids`` of the best path, ``n_pieces``, its ``score``,
    ``others`` (the n-1 next paths as patches of the best one, best first, fewer if there are no more) and
    ``decoded_same`` (whether the ids decode to the text).

    A null or empty text has no pieces, score 0 and no other path.  Of equal paths any may stand first.  Repeated
    rows give repeated rows, an empty table none; other columns are not read.  The model is read on the driver and
    broadcast: its size does not follow the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(model))

    def run(batches):
        m = shared.value
        for b in batches:
            texts, base = string_buffer(b.column(1)), 0
            ids, n_pieces, scores, others, same = [], [], [], [], []
            for i, first, s, o in encode_column(m, b.column(1), n):
                data, ends = m.decode(i, first)
                rows = len(s)
                given = texts[0][texts[1][base]:texts[1][base + rows]]
                want = texts[1][base:base + rows + 1] - texts[1][base]
                if np.array_equal(ends, want) and np.array_equal(data, given):
                    same.append(np.ones(rows, bool))
                else:
                    same.append(np.array([data[ends[r]:ends[r + 1]].tobytes() == given[want[r]:want[r + 1]].tobytes() for r in range(rows)], bool))
                base += rows
                ids.append(i)
                n_pieces.append(np.diff(first))
                scores.append(s)
                others += [[{"score": float(s[r] - lost), "patches": [{"first": a, "pieces": c, "ids": list(p)} for a, c, p in patches]} for lost, patches in o[r]] for r in range(rows)]
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            count = cat(n_pieces, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(cat(ids, np.int32)))
            yield pa.record_batch([b.column(0), lists, pa.array(count), pa.array(cat(scores, float)), pa.array(others, _PATHS_ARROW), pa.array(cat(same, bool))],
                                  names=["doc_id", "ids", "n_pieces", "score", "others", "decoded_same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.col("text").cast("string"))
    return plain.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, score double, others {_PATHS}, decoded_same boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of ``rows(doc_id, ids, ...)``; null ids decode to an empty text, unknown ids fail."""
    shared = rows.sparkSession.sparkContext.broadcast(Model.load(model))

    def run(batches):
        for b in batches:
            lists = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, ends = shared.value.decode(np.concatenate([np.zeros(0, np.int64), *lists]), first)
            yield pa.record_batch([b.column(0), pa.array([data[ends[r]:ends[r + 1]].tobytes().decode("utf-8", "replace") for r in range(len(lists))], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
