"""Networks against versions that go word by word, and the learning of the gated attention against differences."""

import math

import numpy as np
import pyarrow as pa
import pytest

from factspan.llm import quality_mil as q
from factspan.llm import toxicity as x

TEXTS = ["the old mill stands", "", "a", "never " * 40, "Über 漢字 and more words here, with marks! and again", "one two three four five six seven eight nine ten " * 20]


def test_convolutions_word_by_word():
    rng = np.random.default_rng(1)
    net = x.Network()
    net.table = rng.normal(0, 1, net.table.shape).astype(np.float32)
    net.table[0] = 0
    net.bias, net.out, net.out_bias = rng.normal(0, 1, net.bias.shape).astype(np.float32), rng.normal(0, 1, net.out.shape).astype(np.float32), np.float32(0.3)
    net.shift, net.slope = rng.normal(0, 1, net.shift.shape).astype(np.float32), rng.uniform(0.5, 1, net.slope.shape).astype(np.float32)
    (ids, first, language), = x.encode(pa.array(TEXTS))
    got = net.scores(ids, first, language)
    for r in range(len(TEXTS)):
        words = [net.table[w].astype(float).sum(0) for w in ids[first[r]:first[r + 1]]] + [np.zeros(x.DIM)] * max(x.WIDTHS)
        pooled = []
        for bank in net.banks:
            at = [sum(words[i + o] @ bank[o].astype(float) for o in range(len(bank))) for i in range(first[r + 1] - first[r] + 1)]
            pooled += np.max(at, axis=0).tolist()
        z = sum(max(p + b, 0) * o for p, b, o in zip(pooled, net.bias, net.out)) + net.out_bias
        z = z * net.slope[language[r]] + net.shift[language[r]]
        assert got[r] == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-4)


def slow_attention(net, stats, ids, first_word, first):
    """Logits of documents, passage by passage."""
    p, out = {k: v.astype(float) for k, v in net.p.items()}, []
    for d in range(len(first) - 1):
        codes, marks = [], []
        for s in range(first[d], first[d + 1]):
            words = [net.table[i].astype(float) for i in ids[first_word[s]:first_word[s + 1]]]
            mean = sum(words) / len(words) if words else np.zeros(q.DIM)
            h = np.tanh(np.concatenate([(stats[s] - net.mean) / net.scale, mean]) @ p["w"] + p["b"])
            codes.append(h)
            marks.append((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"])
        share = np.exp(np.array(marks) - max(marks))
        out.append(sum(a * h for a, h in zip(share / share.sum(), codes)) @ p["o"] + p["c"][0])
    return np.array(out)


def test_attention_passage_by_passage():
    net = q.AttentionNet()
    bags = q.Bags(list(q.encode(pa.array(TEXTS))))
    net.mean, net.scale = bags.stats.mean(0), bags.stats.std(0) + 1e-3
    every = bags.take(np.arange(len(TEXTS)))
    assert net.forward(*every)[-1] == pytest.approx(slow_attention(net, *every), abs=1e-4)


def test_first_step_of_learning_goes_against_the_difference_quotient():
    """One step over one batch moves every weight by the rate against the sign of its gradient."""
    labels = np.array([1, 0, 1, 0, 1, 0], np.float32)
    bags = q.Bags(list(q.encode(pa.array(TEXTS))))
    net, rows = q.AttentionNet(), np.arange(len(TEXTS))
    net.mean, net.scale = bags.stats.mean(0), bags.stats.std(0) + 1e-3
    every = bags.take(rows)

    def loss():
        z = slow_attention(net, *every)
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)) + 0.5e-4 * sum((v.astype(float) ** 2).sum() for v in net.p.values())

    quotient, rng = {}, np.random.default_rng(2)
    for name in ("o", "a", "w", "v", "u", "b"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(flat.size, 6), replace=False).tolist():
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            quotient[name, i] = (up - loss()) / 2e-3
            flat[i] = old
    before = {k: v.copy() for k, v in net.p.items()}
    net.fit(bags, labels, rows, epochs=1, batch=len(rows), rate=0.01)
    for (name, i), g in quotient.items():
        if abs(g) > 1e-3:
            assert net.p[name].reshape(-1)[i] - before[name].reshape(-1)[i] == pytest.approx(-0.01 * np.sign(g), rel=0.05), (name, i, g)
