"""Versions of a project out of a git repository, object by object.

The trees of all versions are listed by tasks; a file that several versions share (one path, one blob) is one row, whose
scan id joins those of the versions, so it is fetched and parsed once.  Blobs are fetched by tasks, each through one
``cat-file --batch``; no working tree is made.  The repository must lie where all executors see it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SHARED
from . import tree as T

QUERY_SECONDS = 120


class GitError(RuntimeError):
    pass


def _git(repo: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=QUERY_SECONDS)
    if out.returncode:
        raise GitError(out.stderr.decode("utf-8", "replace").strip())
    return out.stdout.decode("utf-8", "replace").strip()


def root_of(path: str) -> str:
    return _git(path, "rev-parse", "--show-toplevel")


def commit_of(repo: str, ref: str) -> str:
    return _git(repo, "rev-parse", "--verify", "--end-of-options", f"{ref}^{{commit}}")


def _records(repo: str, *args: str) -> Iterator[bytes]:
    """Records that a command ends with a zero byte, as they come."""
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE) as made:
        held = b""
        while block := made.stdout.read(1 << 16):
            *whole, held = (held + block).split(b"\0")
            yield from whole
    if made.returncode:
        raise GitError(f"git {args[0]} failed")


def changed_files(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """``(path)`` of files that differ between two commits."""
    def run(frames):
        for _ in frames:
            yield from _frames(([p.decode("utf-8", "replace")] for p in _records(repo, "diff", "--name-only", "-z", base, head)), ["path"])

    return spark.range(1).coalesce(1).mapInPandas(run, "path string")


def _frames(rows: Iterable, names: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def listed(spark: SparkSession, repo: str, versions: dict[str, str]) -> DataFrame:
    """``(scan_id, path, oid)`` of all files of ``versions``, scan ids with commits; links and modules are no files."""
    names = ["scan_id", "path", "oid"]

    def rows(scan_id: str, commit: str) -> Iterator[list]:
        for record in _records(repo, "ls-tree", "-r", "-z", "--full-tree", commit):
            head, _, path = record.partition(b"\t")
            mode, kind, oid = head.split()
            path = path.decode("utf-8", "replace")
            if kind == b"blob" and mode != b"120000" and not set(path.split("/")[:-1]) & T.PRUNED:
                yield [scan_id, path, oid.decode()]

    def run(frames):
        for f in frames:
            for scan_id, commit in f.itertuples(index=False):
                yield from _frames(rows(scan_id, commit), names)

    return spark.createDataFrame(list(versions.items()), "scan_id string, commit string").repartition(len(versions), "scan_id").mapInPandas(run, "scan_id string, path string, oid string")


class Blobs:
    """One ``cat-file --batch``, asked for one blob after the other."""

    def __init__(self, repo: str):
        self.made = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, oid: str) -> bytes | None:
        self.made.stdin.write(oid.encode() + b"\n")
        self.made.stdin.flush()
        head = self.made.stdout.readline().split()
        if len(head) != 3:
            return None
        data = self.made.stdout.read(int(head[2]))
        self.made.stdout.read(1)
        return data

    def close(self) -> None:
        self.made.stdin.close()
        self.made.stdout.close()
        self.made.wait()


def read_versions(spark: SparkSession, repo: str, refs: dict[str, str], include_tests: bool = False) -> DataFrame:
    """Files of versions of a repository, scan ids with refs, in the layout of ``tree.SCHEMA``.

    A row stands for all versions in which its path has its blob: their scan ids are joined by ``schema.SHARED``, which
    ``scan.Pipeline`` takes apart after parsing.
    """
    versions = {scan_id: commit_of(repo, ref) for scan_id, ref in refs.items()}
    files = listed(spark, repo, versions).groupBy("path", "oid").agg(F.array_join(F.array_sort(F.collect_set("scan_id")), SHARED).alias("scan_id"))
    names = [x.split()[0] for x in T.SCHEMA.split(", ")]

    def run(frames):
        blobs = Blobs(repo)
        try:
            for f in frames:
                rows = []
                for scan_id, path, oid in f.itertuples(index=False):
                    name, scope, content, error = path.rpartition("/")[2], T.scope_of(path), None, None
                    kind = T.type_of(name)
                    if scope != "MAIN" and not include_tests:
                        continue
                    if kind != "OTHER":
                        data = blobs.read(oid)
                        content, error = (None, "no such blob") if data is None else T.decoded(data)
                    rows.append([scan_id, path, name, kind, scope, content, f"{LOCATION}{repo}#{oid}", error])
                yield pd.DataFrame(rows, columns=names)
        finally:
            blobs.close()

    return files.select("scan_id", "path", "oid").repartition("oid").mapInPandas(run, T.SCHEMA)


#: Locations of blobs begin so; the repository and the object's name follow, with a ``#`` between.
LOCATION = T.GIT


def blob(location: str) -> bytes | None:
    repo, _, oid = location.removeprefix(LOCATION).rpartition("#")
    out = subprocess.run(["git", "-C", repo, "cat-file", "blob", oid], capture_output=True, timeout=QUERY_SECONDS)
    return out.stdout if out.returncode == 0 else None
