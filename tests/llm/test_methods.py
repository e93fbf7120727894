"""Operators that SQL cannot express: round trips, brute force on small inputs, and accuracy on rows held out."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.llm import chat, context_mixing, licenses, pieces, quality_mil, toxicity
from tests.llm.test_exact import AZ, SPACE

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    rank = np.searchsorted(s, s, "left") + (np.searchsorted(s, s, "right") - np.searchsorted(s, s, "left") + 1) / 2
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# ---- classifiers -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("score, label, least", [(toxicity.toxicity, "toxic", 0.97), (quality_mil.quality, "quality", 0.99)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels.select("doc_id", label), "doc_id").where(f"held_out and {label} is not null").collect()
    assert len(rows) >= 400
    assert auc([r["score"] for r in rows], [r[label] for r in rows]) >= least
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= 0.95


@pytest.mark.parametrize("score, modulus, held", [(toxicity.toxicity, 4, 2), (quality_mil.quality, 5, 0)])
def test_classifiers_on_odd_rows(spark, odd, nothing, documents, labels, score, modulus, held):
    rows = score(odd.select("doc_id", "text", "label"), labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        own = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(own.encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert score(nothing, labels).count() == 0
    twice = score(documents, labels.unionByName(labels)).select("score").collect()
    assert twice == score(documents, labels).select("score").collect()  # repeated labels change nothing
    assert score(odd, labels.limit(0)).count() == odd.count()  # nothing to learn from


def test_held_out_labels_are_not_read(spark, documents, labels):
    from pyspark.sql import functions as F

    from factspan.llm.labelled import remainder

    turned = labels.withColumn("toxic", F.when(remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(documents, x).collect())) for x in (labels, turned))
    assert a == b


def test_without_toxic(spark, odd, labels):
    out = toxicity.without_toxic(odd, labels)
    assert out.columns == odd.columns and out.count() <= odd.count()


# ---- language model ----------------------------------------------------------------------------------------------

def test_language_model(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in documents.collect()]
    rows = context_mixing.scores(documents).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(got) == len(texts)
    tokens = {i: [*SPACE.findall((t or "").translate(AZ)), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    for k in (True, False):
        assert sum(r["score"] for r in rows if r["held_out"] == k) > sum(r["base_score"] for r in rows if r["held_out"] == k)


def test_spellings_are_probabilities():
    """Over the bits of one more byte, the mixed and refined predictions of both values sum to one."""
    import pyarrow as pa

    m = context_mixing.Mixer(*(np.zeros(context_mixing.ORDERS * context_mixing.SLOTS, np.float32) for _ in range(2)))
    words = [b"", *(bytes([b]) for b in range(256) if b != 32)]
    column = pa.array(words, pa.binary())
    m.prepare()
    m.learn(context_mixing.Spelling(column))
    # Every first byte, a space included (which ends the empty word), and the rest of its word summed out.
    s = context_mixing.Spelling(pa.array(words, pa.binary()))
    last = m._last(s)
    first = np.zeros(len(s.bytes), bool)
    first[s.first[:-1]] = True
    total = np.zeros(len(s.bytes))
    for depth in range(8):
        bit, slots = s.bit(depth)
        x, gate = m._inputs(slots)
        p, refined, _, _ = m._predict(x, gate * 8 + depth, last)
        p = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
        total += np.log(np.where(bit == 1, p, 1 - p))
    assert np.exp(total[first]).sum() == pytest.approx(1, abs=1e-6)


def test_language_model_on_odd_rows(spark, odd, nothing, documents):
    rows = context_mixing.scores(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] <= 0 for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    same = [(r["base_score"], r["score"]) for r in rows if r["doc_id"] == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert context_mixing.scores(nothing).count() == 0
    few, many = ({r["doc_id"]: r["score"] for r in context_mixing.scores(documents, head=h).collect()} for h in (0, 1 << 18))
    assert few == pytest.approx(many, rel=1e-6)


def test_language_model_reads_running_text(spark):
    """Known words in another order score otherwise, and contexts of different bytes never share counts."""
    import pyarrow as pa

    line = "the old mill stands by the slow river and turns all day"
    rows = [(i, line) for i in range(1, 40)] + [(100, line), (101, " ".join(reversed(line.split())))]
    got = {r["doc_id"]: r["score"] for r in context_mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > got[101] + 5
    s = context_mixing.Spelling(pa.array([line.encode() + b" "]))
    data = bytes(s.bytes)
    for k in (1, 3, 6):
        seen = {data[max(i - k, 0):i]: c for i, c in enumerate(s.contexts[k - 1].tolist())}
        assert len(set(seen.values())) == len(seen)


# ---- pieces ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


def plain_paths(model, text):
    """Scores of all segmentations of a short text, best first."""
    data = b" " + text.encode()
    into, ahead = model.edges(data), {0: [0.0]}
    for b in range(1, len(data) + 1):
        ahead[b] = [x + s for a, s, _ in into[b] for x in ahead.get(a, [])]
    return sorted(ahead[len(data)], reverse=True)


def patched(ids, patches):
    out = list(ids)
    for p in sorted(patches, key=lambda p: -p["first"]):
        out[p["first"]:p["first"] + p["pieces"]] = p["ids"]
    return out


def test_best_paths(spark, model):
    texts = ["the cat", "aa a", "größe", "漢字", "x", "  two", "a▁b", "ing ing"]
    got = {r["doc_id"]: r for r in pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=6).collect()}
    for i, text in enumerate(texts):
        want = plain_paths(model, text)[:6]
        assert [got[i]["score"], *(o["score"] for o in got[i]["others"])] == pytest.approx(want, abs=1e-6)
        ids = [got[i]["ids"], *(patched(got[i]["ids"], o["patches"]) for o in got[i]["others"])]
        assert len({tuple(x) for x in ids}) == len(want)
        for x in ids:
            data, _ = model.decode(np.array(x), np.array([0, len(x)]))
            assert data.tobytes().decode() == text


def test_round_trip(documents, odd, nothing, texts):
    out = pieces.encoded(documents)
    assert out.where("not decoded_same").count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(out).collect()} == {i: t or "" for i, t in texts}
    rows = pieces.encoded(odd).collect()
    assert len(rows) == odd.count() and all(r["decoded_same"] for r in rows)
    assert all(r["n_pieces"] == 0 and r["score"] == 0 and not r["others"] for r in rows if r["doc_id"] in (1, 2))
    assert pieces.encoded(nothing).count() == 0


# ---- licenses ----------------------------------------------------------------------------------------------------

def test_increasing():
    import random

    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        got = [x[i] for i in licenses.increasing(x)]
        longest = max((k for k in range(len(x) + 1) for c in combinations(x, k) if all(a < b for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == longest and all(a < b for a, b in zip(got, got[1:]))


def test_align_pairs_equal_words():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert licenses.align(list("abc") * 5, list("abc") * 5) == [(i, i) for i in range(15)]


def test_licenses(spark, odd, nothing):
    mit = licenses.TEMPLATES["mit"]
    torn = mit.split()
    del torn[20:24]
    torn[40:40] = ["inserted", "words"]
    filler = "lorem ipsum dolor sit amet " * 400
    rows = [(1, f"{filler}{mit}{filler}"), (2, " ".join(torn)), (3, " ".join(mit.split()[:40])), (4, f"{mit} {mit}"), (5, filler),
            (6, "// Licensed under the Apache\n// License, version 2.0."), (7, "the and of " * 500)]
    got = {r["doc_id"]: {x["license"]: x for x in r["found"]} for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["mit"]["coverage"] == 1 and got[1]["mit"]["first_word"] == 2000 and got[4]["mit"]["coverage"] == 1
    assert 0.9 < got[2]["mit"]["coverage"] < 1
    assert not got[3] and not got[5] and not got[7] and set(got[6]) == {"apache-2.0-notice"}
    assert licenses.licenses(odd).where("n_found = 0").count() == odd.count()
    assert licenses.licenses(nothing).count() == 0


def test_stretches_find_what_whole_texts_hold(documents, texts):
    """Every notice that stands word for word in a text is found."""
    from tests.llm.test_exact import ALNUM

    words = lambda t: f" {' '.join(ALNUM.findall((t or '').translate(AZ)))} "
    got = {r["doc_id"]: {x["license"] for x in r["found"]} for r in licenses.licenses(documents).collect()}
    for i, text in texts:
        w = words(text)
        assert {n for n, t in licenses.TEMPLATES.items() if words(t) in w} <= got[i]


# ---- chat --------------------------------------------------------------------------------------------------------

def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "cat", None), (1, 4, "ann", "bye"), (1, 4, "ann", "bye"), (2, 0, "system", "alone"), (None, None, None, None)]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, part string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotated(df, part=2).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "cat"), (None, "unknown")}
    for speaker in ("ann", "bob", "cat"):
        whole = "".join(got[1, speaker, p]["text"] for p in range(3))
        want = "<|system|>\nbe kind<|end|>\n"
        for _, _, role, text in turns[1:5]:
            want += ("<|assistant|>\n" if role == speaker else f"<|user|>{role}\n") + (text or "") + "<|end|>\n"
        assert whole == want
        said = [got[1, speaker, p]["text"][m["start"]:m["end"]] for p in range(3) for m in got[1, speaker, p]["masks"]]
        assert said == [(text or "") + "<|end|>" for _, _, role, text in turns[1:5] if role == speaker]
    assert chat.rotated(df.limit(0)).count() == 0


# ---- the pipeline ------------------------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline
    from factspan.llm import decontaminate, pii, simhash
    from factspan.llm.tables import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), f"test-{name}")
        before, after = ids(docs), ids(out)
        if name == "toxicity":
            toxic = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
            assert after == before - ids(toxic)
        elif name == "near_duplicates":
            assert after == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            bad = decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
            assert after == before - ids(bad)
        else:
            assert after == before
        if name == "pii":
            left = pii.personal_data(out)
            assert left.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
        assert name == "pieces" or out.columns == docs.columns
        docs = out
    assert ids(corpus_pipeline.run(spark, sf)) == ids(docs)


@pytest.mark.parametrize("module, label, modulus, held", [(toxicity, "toxic", 4, 2), (quality_mil, "quality", 5, 0)])
def test_all_labelled_texts_are_learnt_from(documents, labels, module, label, modulus, held, monkeypatch):
    from factspan.llm import labelled

    monkeypatch.setattr(labelled, "BLOCK", 1 << 16)
    many = labelled.blocks(documents)
    classes, vector, rows, values = labelled.averaged(documents, labels, label, modulus, held, many, module._fitted)
    known = labels.join(documents.select("doc_id").distinct(), "doc_id").where(f"{label} is not null").select("doc_id").distinct()
    key = F.col("doc_id").cast("string")
    want = known.where((labelled.remainder(modulus) != held) & (F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(5)) != 0)).count()
    assert many > 1 and classes.sum() == want and len(rows) == len(values) > 0
    a, b = (labelled.averaged(x, labels, label, modulus, held, many, module._fitted) for x in (documents.repartition(7), documents.repartition(3, "lang")))
    assert all((x == y).all() for x, y in zip(a, b))
