"""What changed between two inventories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .findings import redact, sensitive_checks, uncertain_checks
from .rank import IDENTITY, identity_text, winners_by_identity


@dataclass(frozen=True)
class Diff:
    added: DataFrame
    removed: DataFrame
    changed: DataFrame
    uncertain: DataFrame
    checks: DataFrame

    def summary(self) -> DataFrame:
        """One row with the five counts."""
        parts = (("added", self.added), ("removed", self.removed), ("changed", self.changed), ("uncertain_changed", self.uncertain), ("checks", self.checks))
        rows = reduce(DataFrame.unionByName, [f.select(F.lit(n).alias("part")) for n, f in parts])
        return rows.agg(*[F.count_if(F.col("part") == n).alias(n) for n, _ in parts])


#: The compared fields and where each lies in a finding.
FIELDS = (("value", "value.raw"), ("value.type", "value.type"), ("defaultValue", "default_value.raw"), ("defaultValue.type", "default_value.type"), ("source.path", "source.path"))


def matched(base: DataFrame, head: DataFrame) -> DataFrame:
    """Full outer join of the winners of both sides on the five identity columns: structs ``b`` and ``h``, one may be null."""
    def side(items: DataFrame, name: str) -> DataFrame:
        w = winners_by_identity(items)
        return w.select(*IDENTITY, F.struct(*[F.col(c) for c in w.columns]).alias(name))

    return side(base, "b").join(side(head, "h"), list(IDENTITY), "full_outer")


def changes(pairs: DataFrame) -> DataFrame:
    """``(key, field, old_value, new_value, new_source)`` of fields that differ, nulls included."""
    both = pairs.where("b is not null and h is not null")
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"b.{p}").alias("old_value"), F.col(f"h.{p}").alias("new_value")) for n, p in FIELDS])
    out = both.select(F.col("normalized_key").alias("key"), F.explode(rows).alias("r"), F.col("h.source.path").alias("new_source"))
    return out.where(~F.col("r.old_value").eqNullSafe(F.col("r.new_value"))).select("key", "r.field", "r.old_value", "r.new_value", "new_source")


def new_uncertain(base: DataFrame, head: DataFrame) -> DataFrame:
    """Uncertain accesses of the head whose expression the base lacks anywhere; repeats stay."""
    return head.join(base.select("expression").distinct(), "expression", "left_anti")


def diff_checks(added: DataFrame, uncertain: DataFrame) -> DataFrame:
    remote = added.where(K.is_remote_in_diff("normalized_key", F.col("details.type"))).select(
        "scan_id", F.lit("remote-config-source").alias("type"), F.lit("WARNING").alias("severity"),
        F.concat(F.lit("New remote config center reference requires review: "), "key").alias("message"), "key", "source")
    return reduce(DataFrame.unionByName, [
        remote, sensitive_checks(added, "New configuration key name looks sensitive: "), uncertain_checks(uncertain, "New dynamic configuration access requires review: ")])


def diff(base_items: DataFrame, head_items: DataFrame, base_uncertain: DataFrame, head_uncertain: DataFrame) -> Diff:
    pairs = matched(base_items, head_items)
    added = pairs.where("b is null").select("h.*")
    removed = pairs.where("h is null").select("b.*")
    uncertain = new_uncertain(base_uncertain, head_uncertain)
    return Diff(added, removed, changes(pairs), uncertain, diff_checks(added, uncertain))


def no_diff(base_items: DataFrame, head_items: DataFrame, base_uncertain: DataFrame, head_uncertain: DataFrame) -> Diff:
    """A diff without rows."""
    none = lambda f: f.where(F.lit(False))
    return diff(none(base_items), none(head_items), none(base_uncertain), none(head_uncertain))


#: Ways to compare two inventories, by name: from items of both sides and uncertain accesses of both sides.
STRATEGIES = {"key": diff, "none": no_diff}


def strategy(name: str):
    """Registers a way to compare; the last one of a name stands."""
    return lambda f: STRATEGIES.__setitem__(name, f) or f


def ordered(d: Diff) -> Diff:
    """The sections in the order of a report: facts by identity, changes by key and field."""
    return Diff(d.added.orderBy(identity_text()), d.removed.orderBy(identity_text()), d.changed.orderBy("key", "field"), d.uncertain, d.checks)


def redact_changes(changed: DataFrame, mask: str = K.MASK) -> DataFrame:
    hit = K.is_sensitive("key") & F.col("field").isin("value", "defaultValue")
    masked = lambda c: F.when(hit, F.lit(mask)).otherwise(F.col(c))
    return changed.withColumns({"old_value": masked("old_value"), "new_value": masked("new_value")})


def redacted(d: Diff) -> Diff:
    return Diff(redact(d.added), redact(d.removed), redact_changes(d.changed), d.uncertain, d.checks)


def only_files(d: Diff, files: DataFrame) -> Diff:
    """The diff reduced to what lies in ``files(path)``; paths compare without case, with slashes.

    The list joins as it is; Spark broadcasts it only while its measured size allows."""
    known = files.select(K.normalize_path("path").alias("_path")).distinct()

    def keep(frame: DataFrame, path: Column) -> DataFrame:
        return frame.withColumn("_path", K.normalize_path(path)).where(path.isNotNull()).join(known, "_path", "left_semi").drop("_path")

    own = F.col("source.path")
    return Diff(keep(d.added, own), keep(d.removed, own), keep(d.changed, F.col("new_source")), keep(d.uncertain, own), keep(d.checks, own))
