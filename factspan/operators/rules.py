"""Joins of facts with tables of rules.

A rule matches part of a name or path.  Such conditions are turned into equal keys first: a suffix rule meets the suffixes
of the distinct names, a glob meets the file name, the folders or the name's tail that it spells out.  So rules join by
hash, however many there are, and the full condition filters what has met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import shuffled


def _suffixes(text: Column) -> Column:
    """Every end of a text, the whole text first; the empty one last."""
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(text, i, F.length(text)))


#: Nearly all rows may have one name: rules of a name stand under so many keys, and a row asks for one of them.
NAME_SALTS = 64


def _by_suffix(rows: DataFrame, name: str, rules: DataFrame, suffix: str) -> DataFrame:
    """``rows`` with every rule whose ``suffix`` ends their ``name``: distinct names are cut into suffixes, met with the rules,
    and joined back by name."""
    names = rows.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    met = names.select("_name", F.explode(_suffixes(F.col("_name"))).alias("_suffix")).join(rules.withColumn("_suffix", F.col(suffix)), "_suffix").drop("_suffix")
    met = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("scan_id", "path") if {"scan_id", "path"} <= set(rows.columns) else F.xxhash64(*rows.columns), F.lit(NAME_SALTS)).cast("int"))
    return salted.join(met, (salted[name] == met["_name"]) & (salted["_salt"] == met["_salt"])).drop("_name", "_salt")


def match_methods(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls ``(owner, method, ...)`` with every rule whose owner is part of the call's and whose method ends it."""
    r = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    met = _by_suffix(calls, "method", r, "rule_method")
    return met.where(F.coalesce("rule_owner", F.lit("")).eqNullSafe("") | F.col("owner").contains(F.col("rule_owner")))


def match_annotations(uses: DataFrame, rules: DataFrame) -> DataFrame:
    r = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    return _by_suffix(uses, "annotation", r, "rule_type")


def glob_regex(pattern: Column) -> Column:
    """A path glob as an anchored regular expression: ``**`` spans directories, ``*`` and ``?`` do not."""
    p = F.regexp_replace(pattern, r"([.+()\[\]{}|^$\\])", r"\\$1")
    p = F.replace(p, F.lit("**/"), F.lit("\u0001"))
    p = F.replace(p, F.lit("**"), F.lit("\u0002"))
    p = F.replace(F.replace(p, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    p = F.replace(F.replace(p, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), p, F.lit("$"))


def _glob_key(pattern: Column) -> Column:
    """What a path that a glob matches is sure to have: the file name, else a folder above it, else a tail of the name."""
    last = F.substring_index(pattern, "/", -1)
    folder = F.regexp_extract(pattern, "^([^*?]*)/", 1)
    tail = F.regexp_extract(last, "([^*?]*)$", 1)
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    return F.when(~last.rlike("[*?]"), key("name", last)).when(folder != "", key("folder", folder)).otherwise(key("tail", tail))


def _path_keys(path: Column) -> Column:
    """The name of a path, the folders above it, and all tails of the name."""
    name, parts = F.substring_index(path, "/", -1), F.split(path, "/")
    key = lambda kind: lambda text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.concat(F.array(key("name")(name)), F.transform(above, key("folder")), F.transform(_suffixes(name), key("tail")))


#: Tails such as ``.yml`` end many names: rules of a tail stand under so many keys, and a path asks for one of them.
SALTS = 16


def first_glob(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files ``(path, ...)`` with the first rule, by rule_order, whose glob matches the path.  Distinct paths meet the rules;
    of rules with one glob only the first can count."""
    r = rules.groupBy("pattern").agg(F.min(F.struct("rule_order", "id", "format", "scope")).alias("r"))
    r = r.select(F.col("r.id").alias("rule_id"), glob_regex(F.col("pattern")).alias("rx"), "r.format", F.col("r.scope").alias("rule_scope"), "r.rule_order", _glob_key(F.col("pattern")).alias("_key"))
    often = F.col("_key.kind") == "tail"
    r = r.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    paths = files.select(F.col("path").alias("_path")).where("_path is not null").distinct().withColumn("_key", F.explode(_path_keys(F.col("_path"))))
    paths = paths.withColumn("_salt", F.when(often, F.pmod(F.xxhash64("_path"), F.lit(SALTS)).cast("int")).otherwise(0))
    hits = paths.join(r, ["_key", "_salt"]).where("_path rlike rx")
    best = hits.groupBy("_path").agg(F.min_by(F.struct("rule_id", "format", "rule_scope"), "rule_order").alias("r"))
    return files.join(best, files["path"] == best["_path"]).select(*[files[c] for c in files.columns], "r.*")


def meta_annotation_reads(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Uses ``(name, path, line)`` of annotations that ``declared(name, key)`` gives a key: one layer of meta-annotation."""
    return used.join(declared.select("name", "key"), "name")


def env_from(imports: DataFrame, data: DataFrame) -> DataFrame:
    """Keys that containers import whole: ``imports(name, prefix, path)`` with ``data(name, key, value, ordinal)`` of maps.
    Of maps of one name the last stands."""
    last = data.groupBy("name", "key").agg(F.max_by("value", "ordinal").alias("value"))
    return imports.join(shuffled(last), "name").select("name", F.concat(F.coalesce("prefix", F.lit("")), "key").alias("key"), "value", "path")


def read_minus_defined(items: DataFrame) -> DataFrame:
    return items.where("role = 'READ'").select("key").distinct().join(items.where("role = 'DEFINE'").select("key").distinct(), "key", "left_anti")


def defined_minus_read(items: DataFrame) -> DataFrame:
    return items.where("role = 'DEFINE'").select("key").distinct().join(items.where("role = 'READ'").select("key").distinct(), "key", "left_anti")
