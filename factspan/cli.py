"""Command line: inventory, diff, export and config-diff."""

from __future__ import annotations

import argparse
import sys
from itertools import chain
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import diff as D
from .operators import export
from .plans import consumers
from .plans.scan import Pipeline
from .sources import files, git, java
from .sources import inventory as V

DEFAULT_RULES = "factspan-rules.yaml"


class Failure(Exception):
    """Input that cannot be worked on: exit code 2."""


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factspan")
    sub = top.add_subparsers(dest="command", required=True)

    def shared(p: argparse.ArgumentParser) -> None:
        p.add_argument("-o", "--output", default="out")
        p.add_argument("--consumer", default="yaml")
        p.add_argument("-D", dest="properties", action="append", default=[])
        p.add_argument("--redact-sensitive", action="store_true")
        for n in ("profile", "region", "namespace"):
            p.add_argument(f"--{n}")

    i = sub.add_parser("inventory")
    i.add_argument("root")
    shared(i)
    i.add_argument("--rules")
    i.add_argument("--include-tests", action="store_true")
    i.add_argument("--include", action="append", default=[])
    i.add_argument("--exclude", action="append", default=[])
    i.add_argument("--metrics")
    i.add_argument("--meta-annotations", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("--base", required=True)
    d.add_argument("--head", required=True)
    d.add_argument("--strategy", default="key")
    shared(d)
    e = sub.add_parser("export")
    e.add_argument("--inventory", required=True)
    e.add_argument("-o", "--output", default="app-configs.yaml")
    e.add_argument("--missing")
    e.add_argument("--merge")
    c = sub.add_parser("config-diff")
    c.add_argument("--repo", default=".")
    c.add_argument("--base-ref", required=True)
    c.add_argument("--head-ref", required=True)
    c.add_argument("--strategy", default="key")
    shared(c)
    return top


def _properties(args) -> dict[str, str]:
    out = {}
    for p in args.properties:
        k, eq, v = p.partition("=")
        if eq and k:
            out[k] = v
    return ({"profile": args.profile} if getattr(args, "profile", None) else {}) | out


def _hints(args) -> dict:
    return {n: getattr(args, n) for n in ("profile", "region", "namespace")}


def _consumer(table: dict, name: str):
    if name not in table:
        raise Failure(f"unknown consumer: {name}")
    return table[name]


def _strategy(args):
    if args.strategy not in D.STRATEGIES:
        raise Failure(f"unknown strategy: {args.strategy}")
    return D.STRATEGIES[args.strategy]


def _read(spark: SparkSession, path: str, scan_id: str):
    if Path(path, "items").is_dir():  # a snapshot in Parquet
        return V.read_snapshot(spark, path)
    if not Path(path).is_file():
        raise Failure(f"no such inventory: {path}")
    return V.read_document_file(spark, path, scan_id)


def _rules(spark: SparkSession, path: str | None, root: str) -> dict:
    import yaml

    file = Path(path) if path else Path(root, DEFAULT_RULES)
    return java.rule_tables(spark, (yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.is_file() else {})


def inventory(spark: SparkSession, args) -> None:
    consume = _consumer(consumers.INVENTORY_CONSUMERS, args.consumer)
    try:
        tree = files.read_tree(spark, args.root, "scan", args.include, args.exclude, args.include_tests)
    except NotADirectoryError:
        raise Failure(f"not a directory: {args.root}") from None
    pipeline = Pipeline()
    inv = pipeline.scan(tree, _hints(args), _rules(spark, args.rules, args.root) | {"meta_annotations": args.meta_annotations}, args.redact_sensitive, {"name": Path(args.root).resolve().name, "ref": "unknown"})
    consume(inv, _properties(args), args.output)
    if args.metrics:
        phases = [{"phase": p, "millis": ms} | ({} if rows is None else {"rows": rows}) for p, ms, rows in pipeline.metrics]
        consumers.write("", args.metrics, chain([V.dump({"schemaVersion": V.RUN_VERSION, "metrics": phases})], V.part_text("diagnostics", inv.diagnostics, "message")))


def diff(spark: SparkSession, args) -> None:
    consume = _consumer(consumers.DIFF_CONSUMERS, args.consumer)
    base, head = _read(spark, args.base, "base"), _read(spark, args.head, "head")
    out = _strategy(args)(base.items, head.items, base.uncertain, head.uncertain)
    consume(D.redacted(out) if args.redact_sensitive else out, _properties(args), args.output)


def export_entries(spark: SparkSession, args) -> None:
    import yaml

    inv = _read(spark, args.inventory, "scan")
    entries = export.entries(inv.items)
    if args.merge:
        rows = (yaml.safe_load(Path(args.merge).read_text(encoding="utf-8")) or {}).get("app_configs") or []
        names = entries.columns
        entries = export.merge(entries, spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], entries.schema))
    plain = lambda f: ({k: v for k, v in r.asDict().items() if v not in (None, "")} for r in f.orderBy("config_key").toLocalIterator())
    consumers.write("", args.output, V.list_text("app_configs", plain(entries)))
    if args.missing:
        consumers.write("", args.missing, V.list_text("app_configs", plain(export.missing(inv.items))))


def config_diff(spark: SparkSession, args) -> None:
    """Both versions are scanned in one job, and redacted after the diff, so that changed secrets show as masked changes."""
    consume = _consumer(consumers.DIFF_CONSUMERS, args.consumer)
    repo = git.root_of(args.repo)
    base, head = git.commit_of(repo, args.base_ref), git.commit_of(repo, args.head_ref)
    inv = Pipeline().scan(git.read_versions(spark, repo, {"base": base, "head": head}), _hints(args))
    side = lambda f, s: f.where(f["scan_id"] == s)
    out = _strategy(args)(side(inv.items, "base"), side(inv.items, "head"), side(inv.uncertain, "base"), side(inv.uncertain, "head"))
    out = D.only_files(out, git.changed_files(spark, repo, base, head))
    consume(D.redacted(out) if args.redact_sensitive else out, _properties(args), args.output)


COMMANDS = {"inventory": inventory, "diff": diff, "export": export_entries, "config-diff": config_diff}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    consumers.load_entry_points()
    spark = spark or SparkSession.builder.appName("factspan").getOrCreate()
    try:
        COMMANDS[args.command](spark, args)
    except (Failure, git.GitError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
