"""The language model against a slow scorer that knows nothing of blocks, shards or pairs, and its independence of partitions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factspan.llm import context_mixing as cm

SF = "/root/testdata/sf0.001"


def stream(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return "".join(w + " " for w in words).encode() + b" "


def slow_score(data, counts, model):
    """Every byte of a text in turn, every bit in turn, from counts of (order, context) -> bytes that followed."""
    total = 0.0
    for i, byte in enumerate(data):
        after = [counts.get((k, (b"\n" * k + data[:i])[-k:]), Counter()) for k in range(1, cm.ORDERS + 1)]
        gate = sum(bool(a) for a in after)
        last = data[i - 1] if i else 32
        for depth in range(8):
            bit, z = byte >> (7 - depth) & 1, 0.0
            for k, a in enumerate(after):
                here = {b: n for b, n in a.items() if b >> (8 - depth) == byte >> (8 - depth)}
                one = sum(n for b, n in here.items() if b >> (7 - depth) & 1)
                z += float(model.weights[gate * 8 + depth, k]) * math.log((one + 0.4) / (sum(here.values()) - one + 0.4))
            z = max(-8.0, min(8.0, z + 0.5 * float(model.weights[gate * 8 + depth, -1])))
            p = 1 / (1 + math.exp(-z))
            q = (z + 8) * (cm.BUCKETS - 1) / 16
            low = min(int(q), cm.BUCKETS - 2)
            refined = float(model.map[last, low]) * (1 - q + low) + float(model.map[last, low + 1]) * (q - low)
            p = min(max(0.5 * p + 0.5 * refined, 1e-6), 1 - 1e-6)
            total += math.log10(p if bit else 1 - p)
    return total


@pytest.fixture
def small(monkeypatch):
    """Blocks so small that there are many, with many shards."""
    monkeypatch.setattr(cm, "BLOCK", 1 << 12)
    monkeypatch.setattr(cm, "LEAST", 1 << 10)


ROWS = [(i, t) for i, t in enumerate([
    "the old mill stands by the slow river and turns all day", "The OLD river", "", None, " \t\n", "a", "ünï 漢字 the river",
    "the the the the", "x" * 300, "in the old days the mill stood by the river " * 30, "the old mill stands by the slow river",
    *("word%d of the river mill %d" % (i % 7, i) for i in range(60)), "z\x00nul \x7f",
])]


def test_equals_slow_scorer(spark, small, monkeypatch):
    kept = []
    trained = cm._averaged
    monkeypatch.setattr(cm, "_averaged", lambda *a: kept.append(trained(*a)) or kept[-1])
    got = {r["doc_id"]: r for r in cm.scores(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    counts: dict = {}
    for i, t in ROWS:
        if zlib.crc32(str(i).encode()) % 10:
            data = stream(t)
            for at, byte in enumerate(data):
                for k in range(1, cm.ORDERS + 1):
                    counts.setdefault((k, (b"\n" * k + data[:at])[-k:]), Counter())[byte] += 1
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        want = slow_score(stream(t), counts, kept[0])
        assert got[i]["score"] == pytest.approx(want, rel=1e-4), (i, t)
        assert got[i]["bits_per_byte"] == pytest.approx(-want / math.log10(2) / len(stream(t)), rel=1e-4)


def test_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 1 << 16)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a, b = ({r["doc_id"]: r["score"] for r in cm.scores(docs.repartition(n)).collect()} for n in (4, 7))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-12) for i in a)


def test_equal_rows_come_back_as_often(spark, small):
    rows = [(1, "the old mill by the river")] * 50 + [(None, "the old mill by the river")] * 3 + [(1, None), (1, "")]
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in cm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(got.values()) == [2, 3, 50]


def test_learning_and_step_by_step_prediction_agree():
    """Pairs worked out once and grouped by gate give what the plain definition gives bit by bit."""
    texts = [stream(t)[:-1] for _, t in ROWS]
    s = cm.Spelling(pa.array(texts, pa.binary()))
    rng = np.random.default_rng(1)
    m = cm.Mixer(*(rng.integers(0, 4, int(s.index[2][-1]) * 8).astype(np.float32) for _ in range(2)))
    m.learn(s)
    got = m.log10(s)
    total, last = np.zeros(len(s.bytes)), m._last(s)
    for depth in range(8):
        bit, slots = s.bit(depth)
        x, gate = m._inputs(slots)
        p, refined, _, _ = m._predict(x, gate * 8 + depth, last)
        p = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    want = [total[a:b].sum() for a, b in zip(s.first, s.first[1:])]
    assert got == pytest.approx(want, rel=1e-4)


def test_index_finds_all_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 56, 50_000).astype(np.uint64))
    index = cm.Index(keys)
    asked = np.random.default_rng(3).integers(0, len(keys), 200_000)
    assert (index(keys[asked]) == asked).all()
    assert len(cm.Index(keys[:0])(keys[:0])) == 0


def test_pairs_of_texts_are_met_in_order(monkeypatch):
    """Places in the index are found for the distinct pairs of some texts at once, not by a look-up for every byte."""
    texts = pa.array([stream("the old mill by the river %d" % (i % 90))[:-1] for i in range(700)] + [stream("a river " * 200_000)[:-1]], pa.binary())
    s, looked = cm.Spelling(texts), []
    m = cm.Mixer(*(np.random.default_rng(4).integers(0, 4, int(s.index[2][-1]) * 8).astype(np.float32) for _ in range(2)))
    want, value = [], {}
    find = cm.Index.__call__
    monkeypatch.setattr(cm.Index, "__call__", lambda self, keys: looked.append(len(keys)) or find(self, keys))
    got = m.log10(s)
    assert sum(looked) < len(s.bytes) / 10
    for at in list(range(0, 700, 233)) + [700]:  # alone, with the counts that the texts have together
        one = cm.Spelling(texts.slice(at, 1))
        rows = np.searchsorted(s.index[0], one.index[0])
        own = cm.Mixer(None, None)
        own.odds, own.full = m.odds, m.full
        one.index = s.index
        one.pieces = [[o, r, f, rows[x]] for (o, r, f, x) in _pieces(one)]
        want.append(own.log10(one)[0])
    assert got[list(range(0, 700, 233)) + [700]] == pytest.approx(want, rel=1e-9)


def _pieces(s):
    s.asked()
    return s.pieces


def test_counts_of_rows_with_many_copies():
    texts = ["the mill", "the river", "a", "the old mill"] * 80
    copies = np.tile([0, 1, 255, 256, 70_000, 300, 2, 1], 40)
    want: list = [Counter() for _ in range(cm.ORDERS)]
    for t, c in zip(texts, copies.tolist()):
        data = stream(t)
        for at in range(len(data)):
            for k, n in enumerate(want):
                n[int.from_bytes((b"\n" * cm.ORDERS + data)[at + cm.ORDERS - k - 1:at + cm.ORDERS + 1], "big")] += c
    got = cm.Spelling(pa.array([stream(t)[:-1] for t in texts], pa.binary())).distinct(copies)
    for (keys, n), w in zip(got, want):
        assert (np.diff(keys.astype(np.int64)) > 0).all() and dict(zip(keys.tolist(), n.tolist())) == w


def test_counts_of_a_shard_pass_32_bits(spark):
    """At tens of GB a context of one byte is met more than 2^32 times."""
    keys, many = np.array([0x2061, 0x2062], np.uint64), 3_000_000_000
    row = (1, [2, 0, 0, 0, 0, 0, 1], bytearray(cm._packed(np.array([0x2061, 1, 77], np.uint64))), bytearray(cm._packed(np.array([many, 5, many], np.uint32))))
    asks = spark.createDataFrame([(b, *row) for b in range(2)], "block int, shard int, sizes array<int>, pairs binary, n binary")
    for r in cm._answers(asks, 2).collect():
        got = cm._unpacked(bytes(r["paths"]), f"u{r['bits'] // 8}", 19)
        paths = got[:18].reshape(9, 2)
        assert paths[8].tolist() == [2 * many, 10] and got[18] == 2 * many
        assert paths[6].tolist() == [10, 2 * many]  # 0x61 and 0x62 part at the seventh bit
        m = cm.Mixer(None, None)
        m._room(2)
        m.load(np.arange(2), keys & np.uint64(255), paths)
        assert m.odds[6] == pytest.approx(math.log(10.4 / (2 * many + 0.4)), rel=1e-5)
