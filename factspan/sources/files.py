"""Project trees as a table of files.

Folders are listed and files are read by the executors (``tree``).  A table of the layout ``schema.FILES`` from anywhere
else serves as well: nothing below this module touches a file system.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILES
from .tree import TEST_FOLDERS, TYPES, Files, ProjectTree

def file_type(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    out = F
    for kind, how, text in TYPES:
        out = out.when(name.startswith(text) if how == "starts" else name.endswith(text), kind)
    return out.otherwise("OTHER")


def in_tests(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def classified(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """``files(scan_id, path, content)`` with name, type and scope; files of tests go unless asked for."""
    out = files.select(
        "scan_id", "path", F.substring_index("path", "/", -1).alias("name"), file_type(F.col("path")).alias("file_type"),
        F.when(in_tests(F.col("path")), "TEST").otherwise("MAIN").alias("scope"), "content")
    return out if include_tests else out.where("scope <> 'TEST'")


def selected(files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Files under any ``include`` prefix (all, if there are none) and under no ``exclude`` prefix."""
    def under(prefixes: Iterable[str]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            p = p.rstrip("/")
            out = out | (F.col("path") == p) | F.col("path").startswith(p + "/")
        return out

    include, exclude = list(include), list(exclude)
    out = files.where(under(include)) if include else files
    return out.where(~under(exclude)) if exclude else out


def listed(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below ``root``, sorted, for a look at a small tree; scans have no use for it."""
    return sorted(r["path"] for r in read_tree(spark, root, include_tests=True).select("path").toLocalIterator())


def read_tree(spark: SparkSession, root: str, scan_id: str = "scan", include: Iterable[str] = (), exclude: Iterable[str] = (), include_tests: bool = False) -> DataFrame:
    """The files of a project tree (``tree.SCHEMA``): ``schema.FILES`` with a ``location`` and an ``error``.

    ``root`` must be a place that all executors see."""
    if not Files(root).is_folder():
        raise NotADirectoryError(root)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProjectTree)
    options = {"scan_id": scan_id, "include": "\n".join(include), "exclude": "\n".join(exclude), "tests": str(include_tests).lower()}
    return spark.read.format("projecttree").options(**options).load(root)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)
