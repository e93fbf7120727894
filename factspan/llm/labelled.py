"""Networks fitted on all labelled rows: block by block in tasks, averaged, and calibrated on rows that no block has seen."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that one block is dealt, about; one of so many labelled texts calibrates, the others are learnt from.
BLOCK, FOLDS = 24 << 20, 5
#: Rows of a table of embeddings whose sums travel together; steps that sums are counted in, whole numbers of which add up
#: to the same whatever their order; steps of the outputs that are counted for calibration.
RANGE, SUM_STEPS, STEPS = 4096, float(1 << 20), 256


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def _paired(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, calibrates: bool, many: int, run: Callable, schema: str) -> DataFrame:
    """``run(texts, labels)`` over the labelled texts of every block, in the order of their ids; its record batches.

    All documents whose remainder is not ``held_out`` are used.  A document labelled more than once counts under its highest
    label, one in ``docs`` more than once under its greatest text; null labels and ids are left out.
    """
    key = F.col("doc_id").cast("string")
    fold = F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(FOLDS)) == 0
    own = F.col("doc_id").isNotNull() & (remainder(modulus) != held_out) & (fold if calibrates else ~fold)
    block = F.pmod(F.xxhash64(key), F.lit(many)).cast("int").alias("block")
    texts = docs.where(own).select(block, key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labels.where(own & F.col(label).isNotNull()).select(block, key.alias("doc_id"), F.col(label).cast("int").alias("label"))

    def pair(_, texts, marks):
        marks = marks.group_by("doc_id", use_threads=False).aggregate([("label", "max")])
        at = pc.index_in(texts["doc_id"], marks["doc_id"].combine_chunks())
        rows = texts.append_column("label", marks["label_max"].take(at)).filter(pc.is_valid(at)).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = rows["doc_id"].combine_chunks()
        if len(ids):
            rows = rows.filter(pa.array(np.append(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False), True)))
        return pa.Table.from_batches([run(rows["text"].cast(pa.large_string()), rows["label"].to_numpy().astype(np.float32))])

    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(pair, schema)


def blocks(docs: DataFrame) -> int:
    return max(1, -(-int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK))


def averaged(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, many: int, fit: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many texts of class 0 and 1 were learnt from; the average of what ``fit(texts, labels)`` gives for each block, by its
    texts: a vector, a table and how often each of its rows was used, by which the rows are averaged; the table's rows and
    their values."""
    def learnt(texts, y):
        out = []
        if len(y):
            vector, table, used = fit(texts, y)
            classes = np.array([(y == 0).sum(), (y == 1).sum()])
            out = [(-2, np.arange(2), classes, np.zeros((2, 1))), (-1, np.arange(len(vector)), np.full(len(vector), len(y)), vector[:, None])]
            rows = np.flatnonzero(used)
            for some in np.split(rows, np.flatnonzero(np.diff(rows // RANGE)) + 1):
                if len(some):
                    out.append((int(some[0]) // RANGE, some % RANGE, used[some], table[some]))
        cells = [(part, at.astype("<i4").tobytes(), n.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for part, at, n, v in out]
        return pa.record_batch([pa.array([c[i] for c in cells], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "at", "n", "v"])

    def add(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part, at, n, v in zip(*(c.to_pylist() for c in b.columns)):
                at, n = np.frombuffer(at, "<i4"), np.frombuffer(n, "<i4").astype(np.int64)
                v = np.rint(np.frombuffer(v, "<f4").reshape(len(at), -1).astype(float) * n[:, None] * SUM_STEPS).astype(np.int64)
                held = sums.setdefault(part, (np.zeros(RANGE, np.int64), np.zeros((RANGE, v.shape[1]), np.int64)))
                held[0][at] += n
                held[1][at] += v
        for part, (n, v) in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n.tobytes()]), pa.array([v.tobytes()])], names=["part", "n", "v"])

    fields = "part int, at binary, n binary, v binary"
    got = {r["part"]: (np.frombuffer(bytes(r["n"]), np.int64), np.frombuffer(bytes(r["v"]), np.int64)) for r in _paired(
        docs, labels, label, modulus, held_out, False, many, learnt, fields).repartition(8, "part").mapInArrow(add, "part int, n binary, v binary").collect()}  # bounded by the network
    if not got:
        return np.zeros(2, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 0))
    n, v = got[-1]
    vector = v[n > 0] / n[n > 0] / SUM_STEPS
    rows, values = [], []
    for part in sorted(p for p in got if p >= 0):
        n, v = got[part]
        at = np.flatnonzero(n)
        rows.append(at + part * RANGE)
        values.append(v.reshape(RANGE, -1)[at] / n[at, None] / SUM_STEPS)
    return got[-2][0][:2], vector, np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate(values) if values else np.zeros((0, 0))


def outputs(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, many: int, logits: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``logits(texts)`` gives for all texts that calibrate, outputs and groups of texts: outputs in steps, labels, groups, and
    how many texts have each of these."""
    def run(texts, y):
        z, group = logits(texts) if len(y) else (np.zeros(0), np.zeros(0))
        step = np.floor(np.clip(z, -100, 100) * STEPS).astype(np.int32)
        return pa.record_batch([pa.array(step), pa.array(y.astype(np.int32)), pa.array(group.astype(np.int32))], names=["step", "label", "part"])

    counted = _paired(docs, labels, label, modulus, held_out, True, many, run, "step int, label int, part int").groupBy("step", "label", "part").count().toArrow().sort_by([("part", "ascending"), ("step", "ascending"), ("label", "ascending")])
    step, y, group, n = (counted.column(c).to_numpy() for c in ("step", "label", "part", "count"))  # bounded by the steps
    return (step + 0.5) / STEPS, y, group, n
