"""Project trees as a Spark data source: folders are listed and files are read by the executors.

The planner looks into folders from the root on only until there is work for all tasks; what lies below is walked by the
tasks, so no list of a tree's files exists anywhere.  A folder with many files of its own is dealt to several tasks by a
hash of the names.  Names are never patterns: they go to the file system as they are.  Pruned folders, and those that
no prefix asked for can lead to, are not entered.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

#: Directories that hold nothing written by hand; fixed values.
PRUNED = frozenset(
    ".git .idea .gradle .svn .hg .mvn .next .nuxt .codegraph node_modules bower_components target build out dist bin venv .venv __pycache__ .cache".split())
#: File types by the lower-case name's beginning or end, the first that fits; fixed values.
TYPES = (("ENV", "starts", ".env"), ("JAVA", "ends", ".java"), ("YAML", "ends", ".yaml"), ("YAML", "ends", ".yml"), ("PROPERTIES", "ends", ".properties"),
         ("XML", "ends", ".xml"), ("JSON", "ends", ".json"), ("HOCON", "ends", ".conf"), ("DOCKERFILE", "starts", "dockerfile"))
TEST_FOLDERS = ("test", "testFixtures")
#: Locations that name a blob of a repository begin so.
GIT = "git-blob:"
SCHEMA = "scan_id string, path string, name string, file_type string, scope string, content string, location string, error string"
#: The planner opens folders until there are so many parts, and deals a folder's own files to one task for so many.
PARTS, FILES_A_PART = 64, 1000


def type_of(name: str) -> str:
    low = name.lower()
    return next((kind for kind, how, text in TYPES if (low.startswith(text) if how == "starts" else low.endswith(text))), "OTHER")


def scope_of(path: str) -> str:
    return "TEST" if set(path.split("/")) & set(TEST_FOLDERS) else "MAIN"


def decoded(data: bytes) -> tuple[str, str | None]:
    """Text of bytes, and what is wrong with them: bytes that are no UTF-8 become U+FFFD and are reported."""
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError as e:
        return data.decode("utf-8", "replace"), f"no UTF-8 at byte {e.start}"


class Files:
    """Listing and reading below ``root``: a local path as it stands, or any URI that Arrow's file systems know."""

    def __init__(self, root: str):
        if root.startswith("file:"):
            root = "/" + root.removeprefix("file:").lstrip("/")
        self.remote = None
        if "://" in root:
            from pyarrow import fs

            self.remote, root = fs.FileSystem.from_uri(root)
        self.root = root.rstrip("/") or "/"

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def is_folder(self) -> bool:
        if self.remote:
            from pyarrow import fs

            return self.remote.get_file_info(self.root).type == fs.FileType.Directory
        return os.path.isdir(self.root)

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(name, whether it is a folder) of what a folder holds; links to folders are not followed."""
        if self.remote:
            from pyarrow import fs

            for x in self.remote.get_file_info(fs.FileSelector(self.at(folder))):
                yield x.base_name, x.type == fs.FileType.Directory
        else:
            with os.scandir(self.at(folder)) as found:
                for x in found:
                    if x.is_dir(follow_symlinks=False):
                        yield x.name, True
                    elif x.is_file():
                        yield x.name, False

    def size(self, path: str) -> int:
        return self.remote.get_file_info(self.at(path)).size if self.remote else os.path.getsize(self.at(path))

    def opened(self, path: str):
        """A file to read and seek in."""
        return self.remote.open_input_file(self.at(path)) if self.remote else open(self.at(path), "rb")

    def read(self, path: str) -> bytes:
        if self.remote:
            with self.remote.open_input_stream(self.at(path)) as f:
                return f.read()
        with open(self.at(path), "rb") as f:
            return f.read()


def under(path: str, prefixes: Iterable[str]) -> bool:
    return any(path == p or path.startswith(p + "/") for p in prefixes)


@dataclass
class Part(InputPartition):
    """A whole subtree, or one of ``of`` shares of a folder's own files."""

    folder: str
    deep: bool
    share: int = 0
    of: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        lines = lambda name: [x.rstrip("/") for x in options.get(name, "").split("\n") if x.strip("/")]
        self.root, self.scan_id = options["path"], options.get("scan_id", "scan")
        self.include, self.exclude = lines("include"), lines("exclude")
        self.tests = options.get("tests", "false").lower() == "true"
        self.starts: list[str] = []
        self.wanted: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters) -> Iterator:
        """Conditions on names and places are decided before a file is opened; prefixes of the path spare folders too."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column not in ("path", "name", "file_type", "scope"):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, lambda x, v=f.value: x == v))
            elif isinstance(f, In):
                self.wanted.append((column, lambda x, v=frozenset(f.value): x in v))
            elif isinstance(f, StringEndsWith):
                self.wanted.append((column, lambda x, v=f.value: x.endswith(v)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((column, lambda x, v=f.value: x.startswith(v)))
                if column == "path":
                    self.starts.append(f.value)
            else:
                yield f

    def entered(self, folder: str) -> bool:
        """Whether files asked for can lie in a folder below the root."""
        if folder.rpartition("/")[2] in PRUNED or under(folder, self.exclude):
            return False
        if self.include and not under(folder, self.include) and not any(p.startswith(folder + "/") for p in self.include):
            return False
        return all(s.startswith(folder + "/") or (folder + "/").startswith(s) for s in self.starts)

    def taken(self, path: str) -> bool:
        if (self.include and not under(path, self.include)) or under(path, self.exclude):
            return False
        name, scope = path.rpartition("/")[2], scope_of(path)
        have = {"path": path, "name": name, "scope": scope, "file_type": type_of(name)}
        return (self.tests or scope == "MAIN") and all(f(have[c]) for c, f in self.wanted)

    def partitions(self) -> list[Part]:
        files = Files(self.root)
        todo, out = [""], []
        while todo and len(out) + len(todo) < PARTS:
            folder, own = todo.pop(0), 0
            for name, deeper in files.entries(folder):
                path = f"{folder}/{name}" if folder else name
                if not deeper:
                    own += 1
                elif self.entered(path):
                    todo.append(path)
            shares = -(-own // FILES_A_PART)
            out += [Part(folder, False, k, shares) for k in range(shares)]
        return (out + [Part(folder, True) for folder in todo]) or [Part("", False)]

    def found(self, files: Files, part: Part) -> Iterator[str]:
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            for name, deeper in files.entries(folder):
                path = f"{folder}/{name}" if folder else name
                if deeper:
                    if part.deep and self.entered(path):
                        todo.append(path)
                elif (part.of == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % part.of == part.share) and self.taken(path):
                    yield path

    def read(self, part: Part) -> Iterator[tuple]:
        files = Files(self.root)
        for path in self.found(files, part):
            name, content, error = path.rpartition("/")[2], None, None
            kind = type_of(name)
            if kind != "OTHER":  # files of other types are read only where a plan asks for them, by their location
                try:
                    content, error = decoded(files.read(path))
                except OSError as e:
                    error = f"{type(e).__name__}: {e.strerror}"
            if any("\ud800" <= c <= "\udfff" for c in path):
                error = "the name is no UTF-8"
            clean = lambda s: s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            yield self.scan_id, clean(path), clean(name), kind, scope_of(path), content, clean(f"{self.root.rstrip('/')}/{path}"), error


class ProjectTree(DataSource):
    """``spark.read.format("projecttree").option("scan_id", ...).load(root)``: one row a file, of ``SCHEMA``.

    Options: ``include`` and ``exclude``, prefixes of paths relative to the root, one a line; ``tests``, whether files of
    tests are read.  A file of an unknown type has no content.  What cannot be read or decoded is told in ``error``.
    """

    @classmethod
    def name(cls) -> str:
        return "projecttree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def contents(location: Column) -> Column:
    """The text behind a ``location`` of the source, for files whose rows have none; null where it cannot be read."""
    @F.pandas_udf("string")
    def run(places: pd.Series) -> pd.Series:
        def of(place):
            folder, _, name = (place or "").rpartition("/")
            try:
                if folder.startswith(GIT):
                    from .git import blob

                    data = blob(place)
                    return None if data is None else decoded(data)[0]
                return decoded(Files(folder).read(name))[0] if name else None
            except OSError:
                return None

        return places.map(of)

    return run(location)
