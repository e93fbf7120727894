"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 32 words.  Every passage is encoded (letter, mark and repetition rates, and the
mean of hashed embeddings of its words), gated attention weighs the encodings, and the weighted sum is scored.  Labels
exist for documents only; the weights of the passages are learnt from them.  Trained in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import averaged, blocks, outputs, remainder
from .textkernel import NOT_SPACE, Tokens, grams, hash_spans, padded, segment_sum, slices, string_buffer

PASSAGE = 32
BUCKETS = 1 << 14
DIM, HIDDEN, GATE = 8, 16, 8
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0

_CLASSES = [np.zeros(256, np.uint8) for _ in range(7)]
for _k, _c in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&<>", b"!?", b"|", b".,;:")):
    _CLASSES[_k][list(_c)] = 1
STATS = len(_CLASSES) + 5


def encode(column: pa.Array):
    """Slices of the column as (statistics per passage, word buckets, first word per passage, first passage per row).
    A text without words is one passage without words."""
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        raw = padded(buf[offsets[lo]:offsets[hi]])
        t = Tokens(raw, offsets[lo:hi + 1] - offsets[lo], NOT_SPACE)
        low = padded(buf[offsets[lo]:offsets[hi]], lower=True)
        h = hash_spans(low, t.start, t.end)
        ids = (h >> np.uint64(44)).astype(np.int64) % BUCKETS
        per = np.maximum(-(-t.counts // PASSAGE), 1)
        first_passage = np.concatenate([[0], np.cumsum(per)])
        begin = np.repeat(t.first[:-1] - PASSAGE * first_passage[:-1], per) + PASSAGE * np.arange(first_passage[-1])
        first_word = np.append(begin, len(h))
        words = np.diff(first_word)
        size = segment_sum((t.end - t.start).astype(np.int64), first_word)
        stats = np.zeros((len(words), STATS), np.float32)
        total, some = np.maximum(size, 1), np.maximum(words, 1)
        for k, table in enumerate(_CLASSES):
            sums = np.concatenate([[0], np.cumsum(table[raw[:len(raw) - 16]], dtype=np.int64)])
            stats[:, k] = segment_sum(sums[t.end] - sums[t.start], first_word) / total
        stats[:, -5] = size / some / 10
        stats[:, -4] = words / PASSAGE
        row = t.row
        # Words of windows of five that occur again in the same text, and whole texts' lengths in words.
        g = grams(h, 5)
        if len(g):
            inside = row[:len(g)] == row[4:]
            g = np.where(inside, g ^ (row[:len(g)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(len(g), dtype=np.uint64))
            order = np.argsort(g)
            again = np.zeros(len(g), bool)
            same = g[order[1:]] == g[order[:-1]]
            again[order[1:][same]] = again[order[:-1][same]] = True
            repeat = np.zeros(len(h), np.int64)
            repeat[:len(g)] = again & inside
            stats[:, -3] = segment_sum(repeat, first_word) / some
        stats[:, -2] = np.repeat(np.log1p(t.counts) / 10, per)
        titled = (_CLASSES[0][raw[t.start]] > 0) if len(h) else np.zeros(0, bool)
        stats[:, -1] = segment_sum(titled.astype(np.int64), first_word) / some
        yield stats, ids, first_word, first_passage


class Bags:
    """Encoded passages of many texts, as the network reads them."""

    def __init__(self, parts):
        self.stats = np.concatenate([p[0] for p in parts])
        self.ids = np.concatenate([p[1] for p in parts])
        w, p = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for _, _, first_word, first_passage in parts:
            w.append(first_word[1:] + w[-1][-1])
            p.append(first_passage[1:] + p[-1][-1])
        self.first_word, self.first = np.concatenate(w), np.concatenate(p)

    def take(self, rows):
        passages = np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in rows])
        words = np.concatenate([np.arange(self.first_word[self.first[r]], self.first_word[self.first[r + 1]]) for r in rows])
        first = np.concatenate([[0], np.cumsum([self.first[r + 1] - self.first[r] for r in rows])])
        counts = self.first_word[passages + 1] - self.first_word[passages]
        return self.stats[passages], self.ids[words], np.concatenate([[0], np.cumsum(counts)]), first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionNet:
    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.p = {"w": draw(STATS + DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE),
                  "a": draw(GATE), "o": draw(HIDDEN), "c": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)
        self.shift = 0.0

    def forward(self, stats, ids, first_word, first):
        counts = np.maximum(np.diff(first_word), 1)[:, None]
        x = np.concatenate([(stats - self.mean) / self.scale, (segment_sum(self.table[ids], first_word) / counts).astype(np.float32)], 1)
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        tv, su = np.tanh(h @ self.p["v"]), _sigmoid(h @ self.p["u"])
        e = (tv * su) @ self.p["a"]
        per = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), per))
        att = e / np.repeat(np.add.reduceat(e, first[:-1]), per)
        bag = np.add.reduceat(att[:, None] * h, first[:-1], axis=0)
        return x, h, tv, su, att, bag, bag @ self.p["o"] + self.p["c"][0]

    def scores(self, stats, ids, first_word, first):
        if len(first) < 2:
            return np.zeros(0)
        return _sigmoid(self.forward(stats, ids, first_word, first)[-1].astype(np.float64) + self.shift)

    def fit(self, bags: Bags, labels: np.ndarray, rows: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.01) -> None:
        """Adam; both classes weigh the same."""
        epochs = epochs or int(np.clip(30_000 // len(rows), 2, 12))  # small blocks are seen more often
        rng = np.random.default_rng(13)
        self.mean, self.scale = bags.stats.mean(0), bags.stats.std(0) + 1e-3
        weight = np.where(labels == 1, 0.5 / max(labels[rows].mean(), 1e-6), 0.5 / max(1 - labels[rows].mean(), 1e-6)).astype(np.float32)
        p = self.p
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        tm = np.full(BUCKETS, 1e-3, np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(rows)
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                stats, ids, first_word, first = bags.take(pick)
                x, h, tv, su, att, bag, z = self.forward(stats, ids, first_word, first)
                per = np.diff(first)
                dz = (_sigmoid(z) - labels[pick]) * weight[pick] / len(pick)
                dbag = np.repeat(dz[:, None] * p["o"], per, axis=0)
                dh = att[:, None] * dbag
                datt = (dbag * h).sum(1)
                de = att * (datt - np.repeat(np.add.reduceat(att * datt, first[:-1]), per))
                dtv, dsu = de[:, None] * p["a"] * su * (1 - tv ** 2), de[:, None] * p["a"] * tv * su * (1 - su)
                dh += dtv @ p["v"].T + dsu @ p["u"].T
                dh *= 1 - h ** 2
                g = {"o": bag.T @ dz, "c": np.array([dz.sum()]), "a": (tv * su).T @ de, "v": h.T @ dtv, "u": h.T @ dsu, "w": x.T @ dh, "b": dh.sum(0)}
                dx = (dh @ p["w"].T)[:, STATS:] / np.maximum(np.diff(first_word), 1)[:, None]
                some, inverse = np.unique(ids, return_inverse=True)
                sums = np.zeros((len(some), DIM), np.float32)
                np.add.at(sums, inverse, np.repeat(dx, np.diff(first_word), axis=0).astype(np.float32))
                tm[some] += (sums ** 2).mean(1)
                self.table[some] -= 0.02 * sums / np.sqrt(tm[some])[:, None]
                step += 1
                for k in p:
                    y = (g[k] + 1e-4 * p[k]).astype(np.float32)
                    m[k] += 0.1 * (y - m[k])
                    v[k] += 0.01 * (y * y - v[k])
                    p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)

    def calibrate(self, z: np.ndarray, labels: np.ndarray, n: np.ndarray) -> None:
        """The cut with the best balanced accuracy on held rows becomes ``THRESHOLD``; ``n`` rows have each output and label."""
        if not len(z) or labels.min() == labels.max():
            return
        cuts, at = np.unique(z, return_inverse=True)
        mids = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        bad, good = (np.append(0, np.cumsum(np.bincount(at, n * (labels == k), len(cuts)))) for k in (0, 1))
        value = 1 - good / good[-1] + bad / bad[-1]
        top = np.flatnonzero(value >= value.max() - 1e-12)
        self.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - mids[top[len(top) // 2]])


def _fitted(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    net, bags = AttentionNet(), Bags(list(encode(texts)))
    net.fit(bags, labels, np.arange(len(labels)))
    return np.concatenate([*(x.ravel() for x in net.p.values()), net.mean, net.scale]), net.table, np.bincount(bags.ids, minlength=BUCKETS)


def train(docs: DataFrame, labels: DataFrame) -> AttentionNet:
    """The network fitted on all labelled texts (whole texts), but for a fifth, all of which calibrate: every block of them fits
    one from the same start, and these are averaged.  Without labelled texts of both classes it stays untrained, at even
    scores."""
    net, many = AttentionNet(), blocks(docs)
    classes, vector, rows, values = averaged(docs, labels, "quality", MODULUS, HELD_OUT, many, _fitted)
    if not classes.all():
        net.p["o"][:] = 0
        return net
    at = 0
    for x in (*net.p.values(), net.mean, net.scale):
        x[...] = vector[at:at + x.size].reshape(x.shape)
        at += x.size
    net.table[rows] = values
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def logits(texts):
        z = np.concatenate([shared.value.forward(*x)[-1] for x in encode(texts)])
        return z, np.zeros(len(z))

    z, y, _, n = outputs(docs, labels, "quality", MODULUS, HELD_OUT, many, logits)
    net.calibrate(z, y, n)
    return net


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text, ...)``.

    Only the text is an input of a score.  Null and empty texts score as one passage without words.  Repeated rows
    give repeated rows, an empty table none; other columns are not read.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(plain, labels))

    def run(batches):
        for b in batches:
            s = [shared.value.scores(*x) for x in encode(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    out = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
