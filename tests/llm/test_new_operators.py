"""Byte-level BPE, ball k-means and collocations against slow versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from factspan.llm import ball_kmeans, byte_bpe, collocations, entry, textkernel
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_ball_kmeans", "op13_collocations"])
def test_against_sql(spark, name):
    compare(spark, SF, entry.QUERIES[name], entry.SQL[name])


# Byte-level BPE


def slow_bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        i = min(known)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def ranks():
    split, _ = byte_bpe.encoders(byte_bpe.RANKS, byte_bpe.public_tokenizers.PATTERN)
    return {split.decode_single_token_bytes(i): i for i in range(split.n_vocab)}


def test_ids_against_merges_by_hand(ranks, texts):
    import regex

    for _, text in texts[:40]:
        text = (text or "")[:3000]
        want = [i for m in regex.findall(byte_bpe.public_tokenizers.PATTERN, text) for i in slow_bpe(m.encode(), ranks)]
        assert byte_bpe.encode(text).tolist() == want
        assert byte_bpe.encode(text, size=50).tolist() == want


@pytest.mark.parametrize("size", [1, 3, 8])
def test_cut_texts_have_the_ids_of_whole_ones(size):
    rng, (split, _) = random.Random(size), byte_bpe.encoders(byte_bpe.RANKS, byte_bpe.public_tokenizers.PATTERN)
    letters = "aZ9 é漢 \n\t'sdlrve1!。,_½²ª" + chr(0x85) + chr(0x3000) + chr(0x1C)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        text = text[:20] + " " * rng.choice([0, 0, 5, 30]) + text[20:] + " " * rng.choice([0, 0, 9])
        assert "".join(p for p, _ in byte_bpe.parts(text, size)) == text
        ids = byte_bpe.encode(text, size=size)
        assert ids.tolist() == split.encode_ordinary(text)
        assert byte_bpe.decode(ids, size=3) == text.encode()


def test_very_long_runs():
    for text in (" " * 2_000_000, "x" + "\n" * 500_000 + "y", "ab " * 10 + "q" * 300_000 + " " * 300_000 + "z"):
        ids = byte_bpe.encode(text)
        assert byte_bpe.decode(ids).decode() == text


def test_encoded_rows(spark, odd, nothing):
    got = byte_bpe.decoded(byte_bpe.encoded(odd)).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())
    assert all(4 * r["n_tokens"] == len(r["ids"]) for r in got)
    assert byte_bpe.decoded(byte_bpe.encoded(nothing)).count() == 0


# Ball k-means


def slow_kmeans(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return Counter((i, c, d) for (i, _), (d, c) in zip(kept, assign())), centroids


def test_clusters_with_ties_nulls_and_other_sizes(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)] + [(7, [0.5, 0.5, 0.5])] * 3
    rows += [(None, [0.1, -0.2, 0.3]), (200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "extra", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, label int").repartition(3)
    for k in (1, 9):
        members, centroids = ball_kmeans.clusters(table, k=k, rounds=3, size=3)
        want, final = slow_kmeans(rows, k, 3, 3)
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in members.collect()) == want
        assert centroids.tolist() == final
    assert ball_kmeans.with_inertia(*ball_kmeans.clusters(table.where("false"), k=4, size=3)).count() == 0
    few = ball_kmeans.with_inertia(*ball_kmeans.clusters(table.where("vec_id < 3"), k=9, size=3)).collect()
    assert len(few) == 3 and {r["inertia"] for r in few} == {sum(r["distance"] for r in few)}


def test_balls_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (30, 8))
    points = (centroids[rng.integers(0, 30, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    cluster, _ = ball_kmeans.nearest(points, centroids)
    later = centroids + rng.integers(-20, 20, centroids.shape)
    got, distance, compared = ball_kmeans.moved(points, cluster, later, ball_kmeans.neighbours(later))
    want, least = ball_kmeans.nearest(points, later)
    assert (got == want).all() and (distance == least).all()
    assert compared < len(points) * 10
    far = points * 40_000
    assert (ball_kmeans.nearest(far, centroids * 40_000)[0] == cluster).all()


# Collocations


def slow_collocations(rows, least, most, top):
    n, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of(frame):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


def test_collocations_against_counts_by_hand(spark, documents, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    table = documents.withColumn("phrase", documents["source"]).withColumn("n", documents["n_chars"]).repartition(3)
    assert rows_of(collocations.collocations(table, least=8, top=300)) == slow_collocations(rows, 8, 5, 300)
    # Long texts cut in small shards, and a sketch so narrow that nearly all phrases are candidates.
    monkeypatch.setattr(collocations, "NARROWEST", 1 << 16)
    monkeypatch.setattr(collocations, "WIDEST", 1 << 16)
    assert rows_of(collocations.collocations(table, least=30, top=50)) == slow_collocations(rows, 30, 5, 50)


def test_collocations_of_odd_texts(spark, nothing):
    texts = ["a a a a a a", "A a,a\ta  a", "x y x y x y", None, "", " \t ", ".,;", "é ü é ü é ü", "to be or not to be or not to be or not", "\x00 b \x00 b \x00 b"]
    rows = [(lang, t) for t in texts for lang in ("en", None, "und", "")] * 2
    table = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, size int")
    for least in (2, 4):
        assert rows_of(collocations.collocations(table, least=least)) == slow_collocations(rows, least, 5, 2000)
    assert collocations.collocations(nothing).count() == 0


def test_long_texts_are_cut_between_pieces(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["one two", " three", ", ", ".", "\n", " four "]) for _ in range(3000))
    buf = np.frombuffer(text.encode(), np.uint8)
    ends, rows = textkernel.cut(buf, np.array([0, len(buf)]), 200, collocations._DELIMITER)
    assert len(rows) == len(ends) - 1 > 10 and ends[-1] == len(buf)
    assert all(buf[e - 1] in b".,;:!?\n" for e in ends[1:-1].tolist())


# Memory of earlier operators


def test_filters_in_runs_pool_the_same(monkeypatch):
    """Responses of a text are pooled run by run, and long texts read in parts, with the same scores."""
    import pyarrow as pa

    from factspan.llm import toxicity

    rng, net = np.random.default_rng(1), toxicity.Network()
    net.bias = rng.normal(0, 1, net.bias.shape).astype(np.float32)
    texts = ["", "a", None, "hello world the of " * 9, "x y z " * 300, "le la " * 40] + ["".join(rng.choice(list("abc de"), int(rng.integers(0, 300)))) for _ in range(80)]
    want = toxicity._scores(net, pa.array(texts))
    for run in (5, 64):
        monkeypatch.setattr(toxicity, "RUN", run)
        assert np.allclose(toxicity._scores(net, pa.array(texts)), want, atol=1e-6)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 200)
    assert np.allclose(toxicity._scores(net, pa.array(texts)), want, atol=1e-6)


def test_long_conversations_are_dealt_out(spark):
    """A conversation of many parts, and one without an id, give the same rows however their parts are dealt to keys."""
    from factspan.llm import chat

    turns = [(c, k, f"s{k % 3}", f"t{c}-{k}") for c in (None, 1, 2) for k in range(7 if c == 2 else 90)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = lambda together: Counter(str(r) for r in chat.rotated(table, part=4, together=together).collect())
    assert rows(3) == rows(100_000) and len(rows(3)) == 3 * (23 + 23 + 2)
