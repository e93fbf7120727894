"""Sinks of inventories and diffs, by name.  The last one registered under a name stands."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from html import escape
from itertools import chain
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import export, report
from ..operators.diff import Diff, ordered
from ..operators.findings import Inventory
from ..schema import SCOPE_RULES
from ..shared import written
from ..sources import inventory as V

#: Heads of a manifest where the properties ``api-version`` and ``kind`` name no others.
API, KIND = "v1", "AppConfig"
#: The part of a manifest that holds secrets, where the property ``secrets-section`` names no other.
SECRETS = "secrets"

INVENTORY_CONSUMERS: dict[str, Callable] = {}
DIFF_CONSUMERS: dict[str, Callable] = {}


def inventory_consumer(name: str):
    return lambda f: INVENTORY_CONSUMERS.__setitem__(name, f) or f


def diff_consumer(name: str):
    return lambda f: DIFF_CONSUMERS.__setitem__(name, f) or f


def load_entry_points() -> None:
    """Consumers of installed packages, under the group ``factspan.consumers``."""
    from importlib.metadata import entry_points

    for e in entry_points(group="factspan.consumers"):
        e.load()


def write(folder: str, name: str, text: str | Iterable[str]) -> None:
    """Writes a text, or its parts one by one."""
    target = Path(folder, name)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.writelines([text] if isinstance(text, str) else text)


@inventory_consumer("yaml")
def yaml_inventory(inv: Inventory, properties: dict, folder: str) -> None:
    write(folder, properties.get("file", "config-inventory.yaml"), V.inventory_text(inv))


@inventory_consumer("snapshot")
def snapshot(inv: Inventory, properties: dict, folder: str) -> None:
    """Parquet tables, written by the executors; ``diff`` and ``export`` read them as they read a document."""
    V.write_snapshot(inv, folder)


@inventory_consumer("default")
def default_format(inv: Inventory, properties: dict, folder: str) -> None:
    rows = ({k: v for k, v in r.asDict().items() if v not in (None, "")} for r in export.entries(inv.items).orderBy("config_key").toLocalIterator())
    write(folder, "app-configs.yaml", V.list_text("app_configs", rows))


def diff_text(d: Diff):
    """The YAML document of a diff in parts; its lists are rendered by the executors."""
    s = d.summary().first().asDict()
    own = ordered(d)
    yield V.dump({"schemaVersion": V.DIFF_VERSION, "summary": {V.camel(k): int(v) for k, v in s.items()}})
    for name, frame, order in (("added", own.added, []), ("removed", own.removed, []), ("changed", own.changed, []), ("uncertainChanged", d.uncertain, ["ordinal"]), ("checks", d.checks, ["type", "message"])):
        yield from V.part_text(name, frame, *order)


@diff_consumer("yaml")
def yaml_diff(d: Diff, properties: dict, folder: str) -> None:
    write(folder, properties.get("file", "config-diff.yaml"), diff_text(d))


def _scopes(frame, profile: str, properties: dict):
    """Adds the scope: rules of the file in ``scope-mapping``, overrides ``scope.<profile>`` of the properties."""
    import yaml

    rules = []
    path = properties.get("scope-mapping")
    if path and Path(path).exists():
        rules = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("rules") or []
    rules = export.valid_patterns([{"profile": r.get("profile"), "profile_pattern": r.get("profilePattern"), "is_default": r.get("default") is True, "scope": r.get("scope")} for r in rules])
    spark = frame.sparkSession
    table = spark.createDataFrame([(r["profile"], r["profile_pattern"], r["is_default"], r["scope"], i) for i, r in enumerate(rules)], SCOPE_RULES)
    own = [(k.removeprefix("scope."), v) for k, v in properties.items() if k.startswith("scope.")]
    return export.scoped(frame, profile, table, spark.createDataFrame(own, "profile string, scope string"), properties.get("default-scope", export.DEFAULT_SCOPE))


def _manifest(properties: dict, name: str):
    yield V.dump({"apiVersion": properties.get("api-version", API), "kind": properties.get("kind", KIND), "metadata": {"name": name}})


def _data(properties: dict, plain, secret):
    """The part ``data`` of a manifest: entries, and secrets where there are any."""
    yield "data:\n"
    yield from V.part_text("app_configs", plain, "config_key", shape=V.compact, indent="    ")
    found = V.part_text("secrets", secret, "key", shape=V.compact, indent="        ", empty=False)
    first = next(found, None)
    if first is not None:
        yield f"    {properties.get('secrets-section', SECRETS)}:\n"
        yield first
        yield from found


@inventory_consumer("manifest")
def platform_manifest(inv: Inventory, properties: dict, folder: str) -> None:
    """Entries and references of secrets for a configuration platform.  Its words are properties: ``api-version``, ``kind``,
    ``default-scope``, ``encrypt-type`` and ``secrets-section``."""
    winners = _scopes(export.defined_winners(inv.items).withColumn("_own", F.col("environment.profile")), "_own", properties)
    named = inv.project.get("name")
    name = properties.get("name") or (named if named and named != "unknown" else "app")
    plain, secret = export.platform_artifact(winners, properties.get("encrypt-type", export.ENCRYPT_TYPE))
    write(folder, "app-configs.yaml", chain(_manifest(properties, name), _data(properties, plain, secret)))


@diff_consumer("manifest")
def platform_diff(d: Diff, properties: dict, folder: str) -> None:
    """Changed values, keys left without a value, removed keys; a file without rows is not written."""
    name = properties.get("name") or "app"
    value = K.value_or(F.col("value.raw"), F.col("default_value.raw"))
    added = d.added.select("normalized_key", value.alias("v"), F.col("environment.profile").alias("_own"))
    changed = export.first_value_changes(d.changed).select(F.col("key").alias("normalized_key"), F.col("new_value").alias("v"), F.lit(properties.get("profile")).cast("string").alias("_own"))
    rows = written(_scopes(added.unionByName(changed).where("trim(v) <> ''"), "_own", properties), "changed-values")
    hit, key = K.is_sensitive("normalized_key"), F.col("normalized_key")
    plain = rows.where(~hit).select(F.col("resolved_scope").alias("scope"), K.group_of(key).alias("group_name"), key.alias("config_key"), F.col("v").alias("config_value"))
    if not rows.isEmpty():
        write(folder, "app-configs-changed.yaml", chain(_manifest(properties, name), _data(properties, plain, export.secrets(rows.where(hit), properties.get("encrypt-type", export.ENCRYPT_TYPE)))))
    for part, frame, file in (("missing", export.missing_after(d.added, d.changed), "app-configs-missing.yaml"), ("removed", export.removed_list(d.removed), "removed.yaml")):
        texts = V.part_text(part, frame, "config_key", shape=V.compact, empty=False)
        first = next(texts, None)
        if first is not None:
            write(folder, file, chain(_manifest(properties, name), [first], texts))


def _pie(name: str, rows: list) -> str:
    """A ring of the shares of one dimension, and its legend."""
    hue = lambda i: f"hsl({i * 67 % 360} 60% 55%)"
    stops = ", ".join(f"{hue(i)} {r['cumulative'] - r['percent']:.2f}% {r['cumulative']:.2f}%" for i, r in enumerate(rows))
    legend = "".join(f'<li><i style="background:{hue(i)}"></i>{escape(str(r["value"]), quote=True)}: {r["n"]} ({r["percent"]:.1f}%)</li>' for i, r in enumerate(rows))
    return f'<figure><figcaption>{escape(name)}</figcaption><div class=pie style="background:conic-gradient({stops})"></div><ul>{legend}</ul></figure>'


@inventory_consumer("html")
def html_report(inv: Inventory, properties: dict, folder: str) -> None:
    """One self-contained page: totals, charts of the dimensions, directories, and every key with its findings.

    Rows of keys are made by the executors and pass the driver one partition at a time."""
    esc = lambda x: escape(str(x), quote=True)
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    s = report.key_stats(inv.items).first()
    dims: dict[str, list] = {}
    for r in report.shares(report.count_by_dims(inv.items)).orderBy("dim", F.col("n").desc(), "value").collect():  # one row per value of three enumerations
        dims.setdefault(r["dim"], []).append(r)
    top = [tuple(r) for r in report.top_directories(inv.items).collect()]
    most = max((r[1] for r in top), default=1)
    bars = "".join(f'<div class=bar style="width:{100 * r[1] / most:.1f}%">{esc(r[0])}: {r[1]}</div>' for r in top)
    style = "<style>.pie{width:9em;height:9em;border-radius:50%}figure{display:inline-block}i{display:inline-block;width:1em;height:1em}.bar{background:#9bd;margin:2px}</style>"
    script = "document.getElementById('q').oninput=e=>{const q=e.target.value.toLowerCase();document.querySelectorAll('details').forEach(d=>{d.hidden=![...d.querySelectorAll('[data-s]')].some(x=>x.dataset.s.includes(q))})}"

    def page():
        yield f"<!doctype html><meta charset=utf-8><title>Configuration</title>{style}<h1>{esc(inv.project.get('name', ''))}</h1>"
        yield table(["keys", "sensitive", "more than one source"], [(s["keys"], s["sensitive_keys"], s["multi_source_keys"])])
        yield from (_pie(n, rows) for n, rows in dims.items())
        yield bars + table(["directory", "findings", "keys", "sensitive"], top) + "<input id=q placeholder=search>"
        yield from (r["html"] + "\n" for r in report.key_blocks(inv.items).toLocalIterator())
        yield f"<script>{script}</script>"

    write(folder, "report.html", page())
