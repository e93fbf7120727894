"""A convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy.

Thresholds are calibrated by language, as guessed from the function words of the text itself: logits are shifted
so that the threshold which separates best in the calibration part of a language lies at the same score in all.

All labelled texts are learnt from: every block of them fits a network from the same start, and the networks are averaged,
a row of the embeddings by how many texts of each block have its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import averaged, blocks, outputs, remainder
from .textkernel import ALNUM, SLICE_BYTES, Tokens, cut, hash_spans, padded, slices, string_buffer

BUCKETS = 1 << 17
#: Bytes of the word starts that are embedded beside the word, so that inflected forms share what is learnt.
STEMS = (4, 6)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
THRESHOLD = 0.3
MODULUS, HELD_OUT = 4, 2
#: Words to which filters are applied at once.
RUN = 1 << 17

#: Function words that tell the languages apart.
LANGUAGE_WORDS = {
    "en": "the and of to in is that it for was with this are be on by from".split(),
    "fr": "le la les des et un une que qui pour dans est du sur avec pas elle".split(),
    "de": "der die das und ist den von zu mit ein eine im nicht sich auf für auß".split(),
    "es": "el los las del que y en un una con por para se su al esta como".split(),
}
LANGUAGES = tuple(LANGUAGE_WORDS)


def _word_hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    pad = padded(np.frombuffer(data, np.uint8))
    t = Tokens(pad, np.array([0, len(data)]), ALNUM)
    return hash_spans(pad, t.start, t.end)


def function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, sorted, and the language of each."""
    known = np.concatenate([_word_hashes(w) for w in LANGUAGE_WORDS.values()])
    language = np.repeat(np.arange(len(LANGUAGES)), [len(w) for w in LANGUAGE_WORDS.values()])
    order = np.argsort(known, kind="stable")
    return known[order], language[order]


_KNOWN, _KNOWN_LANGUAGE = function_words()


def encode(column: pa.Array):
    """Slices of the column as (buckets of each word and its starts, first word of each row, language guessed).  A text that
    is longer than a slice is read in parts, cut between words."""
    buf, offsets = string_buffer(column)
    for lo, hi in slices(offsets):
        ends, rows = cut(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], SLICE_BYTES, ~ALNUM)
        ids, counts, votes = [], np.zeros(hi - lo, np.int64), np.zeros((hi - lo, len(LANGUAGES)), np.int64)
        for a, b in slices(ends):
            pad = padded(buf[offsets[lo] + ends[a]:offsets[lo] + ends[b]], lower=True)
            t = Tokens(pad, ends[a:b + 1] - ends[a], ALNUM)
            h = hash_spans(pad, t.start, t.end)
            parts = [h, *(hash_spans(pad, t.start, np.minimum(t.start + k, t.end), seed=k) for k in STEMS)]
            ids.append(np.stack([((x >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1).astype(np.int32) for x in parts], 1))
            row = rows[a:b][t.row]
            np.add.at(counts, rows[a:b], t.counts)
            left, right = np.searchsorted(_KNOWN, h, "left"), np.searchsorted(_KNOWN, h, "right")
            for k in range(2):  # a word may belong to two languages
                hit = np.flatnonzero(left + k < right)
                np.add.at(votes, (row[hit], _KNOWN_LANGUAGE[left[hit] + k]), 1)
        yield np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)]), votes.argmax(1)


class Network:
    """Embedding table, one filter bank for each width, and a linear layer over the pooled filters."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.banks = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.shift = np.zeros(len(LANGUAGES), np.float32)
        self.slope = np.ones(len(LANGUAGES), np.float32)

    @staticmethod
    def padded_ids(ids: np.ndarray, first: np.ndarray):
        """Three empty words after each text, so that no filter spans two texts and none is without a window."""
        counts = np.diff(first)
        gap = max(WIDTHS)
        begin = first[:-1] + gap * np.arange(len(counts))
        out = np.zeros((len(ids) + gap * len(counts), ids.shape[1]), np.int32)
        out[np.arange(len(ids)) + np.repeat(gap * np.arange(len(counts)), counts)] = ids
        return out, begin, counts

    def maps(self, ids: np.ndarray):
        """Filter responses at every position."""
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        n = len(ids)
        y = x @ np.concatenate([part for bank in self.banks for part in bank], axis=1)
        out, at = np.empty((n, len(WIDTHS) * FILTERS), np.float32), 0
        for k, width in enumerate(WIDTHS):
            own = out[:, k * FILTERS:(k + 1) * FILTERS]
            own[:] = y[:, at:at + FILTERS]
            for o in range(1, width):
                own[:n - o] += y[o:, at + o * FILTERS:at + (o + 1) * FILTERS]
            at += width * FILTERS
        return out

    def pooled(self, maps, begin, counts):
        # The windows of a text begin at its words and at the first empty word after them.
        edges = np.stack([begin, begin + counts + 1], 1).ravel()
        return np.maximum.reduceat(maps, edges, axis=0)[::2]

    def logits(self, ids, first):
        """The output for every text.  Filters are applied to ``RUN`` words at a time, and the largest responses kept, so memory
        does not follow the length of a text."""
        if len(first) < 2:
            return np.zeros(0, np.float32)
        ids, begin, counts = self.padded_ids(ids, first)
        p = np.full((len(begin), len(self.bias)), -np.inf, np.float32)
        for lo in range(0, len(ids), RUN):
            hi = min(lo + RUN, len(ids))
            maps = self.maps(ids[lo:hi + max(WIDTHS) - 1])
            r = slice(int(np.searchsorted(begin + counts, lo)), int(np.searchsorted(begin, hi)))  # texts with a window here
            if r.start < r.stop:
                a = np.maximum(begin[r], lo) - lo
                p[r] = np.maximum(p[r], self.pooled(maps, a, np.minimum(begin[r] + counts[r], hi - 1) - lo - a))
        return np.maximum(p + self.bias, 0) @ self.out + self.out_bias

    def scores(self, ids, first, language):
        z = self.logits(ids, first) * self.slope[language] + self.shift[language]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.02) -> None:
        """Adam on the dense parts and Adagrad on the rows of the table; gradients flow to the pooled positions only.
        The first embedding axis starts as the clipped log-odds that a word's bucket occurs in a text of class 1."""
        rng = np.random.default_rng(11)
        epochs = epochs or int(np.clip(16_000 // len(texts), 2, 20))  # small samples are seen more often
        seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for ids, y in zip(texts, labels):
            seen[int(y)][np.unique(ids)] += 1
        n1, n0 = max(labels.sum(), 1), max((1 - labels).sum(), 1)
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        self.used = (seen[0] + seen[1]).astype(np.int64)
        odds *= self.used >= 3
        self.table[:, 0] = np.clip(odds, -3, 3) / 3
        self.table[0] = 0
        for bank in self.banks:
            bank[0, 0, :2] = 1.0
        self.out[::FILTERS] = 1.0
        total = np.zeros(BUCKETS, np.float32) + 1e-3
        params = [*self.banks, self.bias, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        bias_m = bias_v = 0.0
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
                ids, begin, counts = self.padded_ids(np.concatenate([texts[i] for i in pick]), first)
                maps = self.maps(ids)
                p = self.pooled(maps, begin, counts) + self.bias
                hidden = np.maximum(p, 0)
                z = hidden @ self.out + self.out_bias
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[pick]).astype(np.float32) / len(pick)
                grads = [np.zeros_like(b) for b in self.banks]
                up = d[:, None] * self.out * (p > 0)
                rows, delta = [], []
                for r in range(len(pick)):
                    at = begin[r] + maps[begin[r]:begin[r] + counts[r] + 1].argmax(0)
                    for k, bank in enumerate(self.banks):
                        cols = slice(k * FILTERS, (k + 1) * FILTERS)
                        for o in range(len(bank)):
                            words = ids[at[cols] + o]
                            grads[k][o] += self.table[words].sum(1).T * up[r, cols]
                            rows.append(words.ravel())
                            delta.append(np.repeat(bank[o].T * up[r, cols, None], words.shape[1], axis=0))
                rows, delta = np.concatenate(rows), np.concatenate(delta)
                some, inverse = np.unique(rows, return_inverse=True)
                sums = np.zeros((len(some), DIM), np.float32)
                np.add.at(sums, inverse, delta)
                total[some] += (sums ** 2).mean(1)
                self.table[some] -= 0.05 * sums / np.sqrt(total[some])[:, None]
                self.table[0] = 0
                step += 1
                g = [*grads, up.sum(0), hidden.T @ d]
                for i, (x, y) in enumerate(zip(params, g)):
                    y = y + 1e-4 * x
                    m[i] += 0.1 * (y - m[i])
                    v[i] += 0.01 * (y * y - v[i])
                    x -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-7)
                bias_m += 0.1 * (d.sum() - bias_m)
                bias_v += 0.01 * (d.sum() ** 2 - bias_v)
                self.out_bias -= np.float32(rate * (bias_m / (1 - 0.9 ** step)) / (np.sqrt(bias_v / (1 - 0.99 ** step)) + 1e-7))

    def calibrate(self, z: np.ndarray, labels: np.ndarray, language: np.ndarray, n: np.ndarray) -> None:
        """Per language, the threshold of the best F1 becomes ``THRESHOLD``; languages with few texts take that of all.
        ``n``: how many texts have this output, label and language."""
        def best(own):
            cuts, at = np.unique(z[own], return_inverse=True)
            mids = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
            above = [np.append(np.cumsum(np.bincount(at, n[own] * (labels[own] == k), len(cuts))[::-1])[::-1], 0) for k in (0, 1)]
            f1 = 2 * above[1] / np.maximum(above[1] + above[0] + above[1][0], 1e-9)
            top = np.flatnonzero(f1 >= f1.max() - 1e-12)
            return mids[top[len(top) // 2]]

        goal = np.log(THRESHOLD / (1 - THRESHOLD))
        if not len(z) or labels.min() == labels.max():
            return
        pooled = best(np.ones(len(z), bool))
        for k in range(len(LANGUAGES)):
            own = language == k
            self.shift[k] = goal - (best(own) if min(n[own & (labels == y)].sum() for y in (0, 1)) >= 15 else pooled)


def _fitted(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    net, words = Network(), []
    for ids, first, _ in encode(texts):
        words += [ids[first[r]:first[r + 1]] for r in range(len(first) - 1)]
    net.fit(words, labels)
    return np.concatenate([*(b.ravel() for b in net.banks), net.bias, net.out, [net.out_bias]]), net.table, net.used


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted on all labelled texts (whole texts), but for a fifth, all of which calibrate.  Without labelled texts
    of both classes it is left untrained, at even scores."""
    net, many = Network(), blocks(docs)
    classes, vector, rows, values = averaged(docs, labels, "toxic", MODULUS, HELD_OUT, many, _fitted)
    if not classes.all():
        net.out[:] = 0
        return net
    at = 0
    for x in (*net.banks, net.bias, net.out):
        x[...] = vector[at:at + x.size].reshape(x.shape)
        at += x.size
    net.out_bias = np.float32(vector[at])
    net.table[:, 0] = 0
    net.table[rows] = values
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def logits(texts):
        found = [(shared.value.logits(ids, first), language) for ids, first, language in encode(texts)]
        return [np.concatenate(x) for x in zip(*found)]

    net.calibrate(*outputs(docs, labels, "toxic", MODULUS, HELD_OUT, many, logits))
    return net


def _scores(net: Network, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(net.scores(*x) for x in encode(column))])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text, ...)``.

    Only the text is an input of a score.  Null and empty texts score as a text without words.  Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(plain, labels))

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(_scores(shared.value, b.column(1)))], names=["doc_id", "score"])

    out = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; columns and order of columns stay."""
    net = train(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    shared, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(shared.value, b.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
