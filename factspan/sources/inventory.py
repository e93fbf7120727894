"""Inventories and diffs as YAML documents, and as Parquet snapshots."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import Inventory, summarize
from ..schema import CHECKS, DIAGNOSTICS, FINDINGS
from ..shared import written
from .tree import Files

INVENTORY_VERSION = "config-inventory/v1"
DIFF_VERSION = "config-diff/v1"
RUN_VERSION = "factspan-run/v1"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _plain(row: dict) -> dict:
    def plain(x):
        if isinstance(x, dict):
            out = {camel(k): plain(v) for k, v in x.items() if v is not None}
            return {k: v for k, v in out.items() if v != {}}
        return x

    return {k: v for k, v in plain(row).items() if k not in ("scanId", "ordinal", "kind", "emitSeq")}


def list_text(name: str, rows):
    """A YAML document of one list, row by row."""
    first = next(rows, None)
    yield f"{name}:{' []' if first is None else ''}\n"
    if first is not None:
        yield dump([first])
        for r in rows:
            yield dump([r])


def compact(row: dict) -> dict:
    """A row without what is null or empty."""
    return {k: v for k, v in row.items() if v not in (None, "")}


def _rendered(frame: DataFrame, *order: str, shape=_plain, indent: str = ""):
    """The YAML text of each row, made by the executors, in order; one partition at a time reaches the driver."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [dump([shape(r)]) for r in b.to_pylist()]
            yield pa.record_batch([pa.array([re.sub("(?m)^(?=.)", indent, t) for t in texts], pa.string())], names=["text"])

    return (r["text"] for r in (frame.orderBy(*order) if order else frame).mapInArrow(run, "text string").toLocalIterator())


def inventory_text(inv: Inventory):
    """The YAML document of an inventory in parts."""
    summary = (inv.summary or summarize(inv)).drop("scan_id").first()
    counts = {k: int(v) for k, v in summary.asDict().items()} if summary else {"keys": 0, "findings": 0, "uncertain": 0, "checks": 0, "diagnostics": 0}
    yield dump({"schemaVersion": INVENTORY_VERSION, "project": inv.project, "summary": counts})
    for name, frame, order in (("items", inv.items, ["ordinal"]), ("uncertain", inv.uncertain, ["ordinal"]), ("checks", inv.checks, ["type", "message"]), ("diagnostics", inv.diagnostics, ["message"])):
        yield from part_text(name, frame, *order)


def part_text(name: str, frame: DataFrame, *order: str, shape=_plain, indent: str = "", empty: bool = True):
    """A list of a document, row by row, rendered by the executors; one without rows is left out, unless ``empty``."""
    texts = _rendered(frame, *order, shape=shape, indent=indent)
    first = next(texts, None)
    if first is not None or empty:
        yield f"{indent}{name}:{' []' if first is None else ''}\n"
    if first is not None:
        yield first
        yield from texts


def dump(document: dict | list) -> str:
    import yaml

    return yaml.safe_dump(document, sort_keys=False, allow_unicode=True, indent=4, default_flow_style=False)


def _snake(x):
    if isinstance(x, dict):
        return {"".join("_" + c.lower() if c.isupper() else c for c in k): _snake(v) for k, v in x.items()}
    return [_snake(v) for v in x] if isinstance(x, list) else x


_LAYOUTS = {"items": FINDINGS, "uncertain": FINDINGS, "checks": CHECKS, "diagnostics": DIAGNOSTICS}
_GIVEN = {"items": {"kind": "CONFIG"}, "uncertain": {"kind": "UNCERTAIN"}, "checks": {}, "diagnostics": {}}


def _row(r: dict, name: str, scan_id: str, place: int) -> str:
    """An entry of a document as JSON in the layout of its table; enumerations are read without regard to case."""
    upper = {n: str(r[n]).upper() for n in ("role", "confidence", "severity") if r.get(n) is not None}
    return json.dumps(r | upper | _GIVEN[name] | {"scan_id": scan_id} | ({"ordinal": place} if "ordinal" in _LAYOUTS[name] else {}))


def read_document(spark: SparkSession, text: str, scan_id: str) -> Inventory:
    """An inventory from its YAML text; unknown properties are ignored."""
    import yaml

    root = _snake(yaml.safe_load(text) or {})

    def frame(name: str, ddl: str) -> DataFrame:
        rows = [_row(r, name, scan_id, i) for i, r in enumerate(root.get(name) or [], 1)]
        return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl).alias("r")).select("r.*")

    return Inventory(*[frame(n, ddl) for n, ddl in _LAYOUTS.items()], None, root.get("project") or {})


#: Bytes of a document that one task reads.
RANGE = 16 << 20


def _whole_lines(file, lo: int, hi: int):
    """(place, line) of the lines that begin in a range of bytes, and of the lines after it until the reader stops."""
    file.seek(max(lo - 1, 0))
    if lo:
        file.readline()  # the rest of the line before; nothing but its end, if the range begins a line
    at = file.tell()
    while line := file.readline():
        yield at, line
        at += len(line)


def _heads(folder: str, name: str, lo: int, hi: int) -> list[tuple[int, str, str]]:
    """(place, key, text) of the lines in a range that begin a part of a block document."""
    with Files(folder).opened(name) as f:
        out = []
        for at, line in _whole_lines(f, lo, hi):
            if at >= hi:
                break
            if m := re.match(rb"([A-Za-z]\w*):(.*)", line):
                out.append((at, m[1].decode(), m[2].decode("utf-8", "replace").strip()))
        return out


def _entries(folder: str, name: str, lo: int, hi: int, end: int, indent: int):
    """(place, entry) of a block sequence, indented so far, for entries that begin in a range; it ends at ``end``."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    with Files(folder).opened(name) as f:
        held, began, mark = [], 0, b" " * indent + b"- "
        for at, line in _whole_lines(f, lo, hi):
            if at >= end:
                break
            if line.startswith(mark):
                if held:
                    yield began, yaml.load(b"".join(held), Loader=loader)[0]
                    held = []
                if at >= hi:
                    break
                began = at
                held.append(line)
            elif held:
                held.append(line)
        if held:
            yield began, yaml.load(b"".join(held), Loader=loader)[0]


def read_document_file(spark: SparkSession, path: str, scan_id: str) -> Inventory:
    """An inventory from a YAML document in blocks, of any size: ranges of bytes are read by tasks.

    One pass finds where the lists begin, which are a handful of lines at the left edge; a second one parses each range's
    entries one by one.  An entry belongs to the range it begins in, and its place in the file is its ordinal.  A document
    of any other form (flow style, several documents, tabs) is parsed whole.
    """
    import yaml

    path = path if "://" in path or path.startswith("/") else os.path.abspath(path)
    folder, _, name = path.rpartition("/")
    size = Files(folder).size(name)
    ranges = spark.createDataFrame([(lo, min(lo + RANGE, size)) for lo in range(0, size, RANGE)], "lo long, hi long").repartition(max(1, -(-size // RANGE)))

    def find(frames):
        for f in frames:
            yield pd.DataFrame([h for lo, hi in f.itertuples(index=False) for h in _heads(folder, name, lo, hi)], columns=["place", "key", "text"])

    heads = sorted(ranges.mapInPandas(find, "place long, key string, text string").collect())  # the parts of one document
    parts = [(h["place"], heads[i + 1]["place"] if i + 1 < len(heads) else size, h["key"], h["text"]) for i, h in enumerate(heads)]
    lists = [p for p in parts if p[2] in _LAYOUTS]
    with Files(folder).opened(name) as f:
        f.seek(0)
        start = f.read(min(size, heads[0]["place"] if heads else size))
        sound = not start.strip(b"-\n\r ") and len({p[2] for p in parts}) == len(parts) and all(text in ("", "[]", "null") for *_, text in lists)
        indents = {}
        for begin, end, key, text in lists if sound else []:
            f.seek(begin)
            f.readline()
            line = b""
            while f.tell() < end and not line.split(b"#")[0].strip():
                line = f.readline()
            m = re.match(rb"( *)- ", line)
            indents[key] = len(m[1]) if m else 0
            sound &= bool(text) or not line.split(b"#")[0].strip() or m is not None
        if not sound:
            f.seek(0)
            return read_document(spark, f.read().decode("utf-8"), scan_id)
        project = next((p for p in parts if p[2] == "project"), None)
        f.seek(project[0] if project else 0)
        head = _snake(yaml.safe_load(f.read(project[1] - project[0])) or {}) if project else {}

    cut = [(key, lo, min(lo + RANGE, end), end, indents[key]) for begin, end, key, text in lists if not text for lo in range(begin, end, RANGE)]
    work = spark.createDataFrame(cut, "name string, lo long, hi long, stop long, indent int").repartition(max(1, len(cut)), "name", "lo")

    def parse(frames):
        for f in frames:
            for key, lo, hi, stop, indent in f.itertuples(index=False):
                rows = []
                for place, entry in _entries(folder, name, lo, hi, stop, indent):
                    rows.append((key, _row(_snake(entry), key, scan_id, place)))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["name", "j"])
                        rows = []
                yield pd.DataFrame(rows, columns=["name", "j"])

    rows = written(work.mapInPandas(parse, "name string, j string"), "document")
    frame = lambda n, ddl: rows.where(F.col("name") == n).select(F.from_json("j", ddl).alias("r")).select("r.*")
    return Inventory(*[frame(n, ddl) for n, ddl in _LAYOUTS.items()], None, head.get("project") or {})


def write_snapshot(inv: Inventory, path: str) -> None:
    for name in ("items", "uncertain", "checks", "diagnostics"):
        getattr(inv, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> Inventory:
    return Inventory(*[spark.read.parquet(f"{path}/{n}") for n in ("items", "uncertain", "checks", "diagnostics")])
