"""Entries for configuration platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from .rank import winners_by_key

#: Scope of entries that no rule gives one, and how secrets are kept, where properties do not say so.
DEFAULT_SCOPE = "default"
DEFAULT_VERSION = "1.0"
ENCRYPT_TYPE = "platform"


def defined_winners(items: DataFrame) -> DataFrame:
    """The winner of every key, and whether any fact defines the key (an aggregate of its own, joined by key)."""
    defined = items.groupBy("normalized_key").agg(F.max(F.col("role") == "DEFINE").alias("defined"))
    return winners_by_key(items).join(defined, "normalized_key").withColumn("has_value", F.col("defined") | F.col("default_value").isNotNull())


def _entry(value: Column) -> list[Column]:
    key = F.col("normalized_key")
    return [F.lit(DEFAULT_SCOPE).alias("scope"), K.group_of(key).alias("group_name"), key.alias("config_key"), value.alias("config_value"),
            F.when(K.is_sensitive(key), 1).otherwise(0).alias("secret"), F.lit("").alias("sub_application_id"),
            F.lit(DEFAULT_VERSION).alias("version"), F.lit(DEFAULT_VERSION).alias("docker_version"), F.lit("").alias("remark")]


def entries(items: DataFrame) -> DataFrame:
    """One entry for each key that is defined somewhere or whose winner has a default."""
    return defined_winners(items).where("has_value").select(*_entry(K.value_or(F.col("value.raw"), F.col("default_value.raw"))))


def missing(items: DataFrame) -> DataFrame:
    """One empty entry for each key that is read but neither defined nor given a default."""
    return defined_winners(items).where("not has_value").select(*_entry(F.lit("")))


def merge(base: DataFrame, filled: DataFrame) -> DataFrame:
    """Both lists by key; where both have a key, the whole row of ``filled`` stands."""
    names = base.columns
    row = lambda f, n: f.select("config_key", F.struct(*names).alias(n))
    return row(base, "b").join(row(filled, "f"), "config_key", "full_outer").select(F.coalesce("f", "b").alias("r")).select("r.*")


def scoped(frame: DataFrame, profile: str, rules: DataFrame, overrides: DataFrame, fallback: str = DEFAULT_SCOPE) -> DataFrame:
    """Adds ``resolved_scope`` for the profile column: override, exact rule, first matching pattern, default rule, fallback.

    Profiles are few against rows: the distinct ones are resolved and joined back.  ``rules`` has
    profile, profile_pattern, is_default, scope, rule_order; ``overrides`` profile and scope.  A null pattern matches
    nothing; patterns must match the whole profile, and must be valid (see ``valid_patterns``).
    """
    named = frame.select(F.col(profile).alias("_p")).where(F.trim(F.col(profile)) != "").distinct()
    own = F.col("profile") == F.col("_p")
    exact = named.join(rules.where("not is_default"), own).groupBy("_p").agg(F.min_by("scope", "rule_order").alias("_exact"))
    pattern = named.join(rules.where("not is_default and trim(profile_pattern) <> ''"), F.expr("_p rlike concat('^(?:', profile_pattern, ')$')")).groupBy("_p").agg(F.min_by("scope", "rule_order").alias("_pattern"))
    override = named.join(overrides.where("trim(scope) <> ''"), own).groupBy("_p").agg(F.max("scope").alias("_override"))
    resolved = named.join(override, "_p", "left").join(exact, "_p", "left").join(pattern, "_p", "left").select("_p", F.coalesce("_override", "_exact", "_pattern").alias("_scope"))
    default = rules.where("is_default").agg(F.min_by("scope", "rule_order").alias("_default"))
    out = frame.join(resolved, F.col(profile) == F.col("_p"), "left").join(F.broadcast(default))  # one row
    return out.withColumn("resolved_scope", F.coalesce("_scope", "_default", F.lit(fallback))).drop("_p", "_scope", "_default")


def valid_patterns(rules: list[dict]) -> list[dict]:
    """Rules whose pattern compiles or is absent; a rule file is read on the driver."""
    import re

    def good(p: str | None) -> bool:
        try:
            return p is None or bool(re.compile(p))
        except re.error:
            return False

    return [r if good(r.get("profile_pattern")) else {**r, "profile_pattern": None} for r in rules]


def platform_artifact(winners: DataFrame, encrypt_type: str = ENCRYPT_TYPE) -> tuple[DataFrame, DataFrame]:
    """Plain entries (with a value only) and secrets (with or without) of ``defined_winners`` with ``resolved_scope``.

    A secret never carries its value, only a reference named after its key.
    """
    key, hit = F.col("normalized_key"), K.is_sensitive("normalized_key")
    plain = winners.where(~hit & F.col("has_value")).select(
        F.col("resolved_scope").alias("scope"), K.group_of(key).alias("group_name"), key.alias("config_key"), K.value_or(F.col("value.raw"), F.col("default_value.raw")).alias("config_value"))
    return plain, secrets(winners.where(hit), encrypt_type)


def secrets(rows: DataFrame, encrypt_type: str = ENCRYPT_TYPE) -> DataFrame:
    name, hint = K.to_underscore("normalized_key"), F.nullif(K.type_hint("normalized_key"), F.lit(""))
    return rows.select(name.alias("key"), hint.alias("type"), F.concat(F.lit("${"), name, F.lit("}")).alias("reference"), F.lit(encrypt_type).alias("encrypt_type"), F.col("resolved_scope").alias("scope"))


def first_value_changes(changed: DataFrame) -> DataFrame:
    """The first value change of every key in the order of (key, field, old, new, source)."""
    w = F.struct("old_value", "new_value", "new_source")
    best = changed.where("field = 'value'").groupBy("key").agg(F.min(w).alias("r"))
    return best.select("key", F.lit("value").alias("field"), "r.*")


def removed_list(removed: DataFrame) -> DataFrame:
    return removed.select(F.col("normalized_key").alias("config_key")).distinct().withColumn("group_name", K.group_of("config_key"))


def missing_after(added: DataFrame, changed: DataFrame) -> DataFrame:
    """Keys that a diff leaves without a value, and why."""
    value = K.value_or(F.col("value.raw"), F.col("default_value.raw"))
    a = added.where(F.trim(value) == "").select(F.col("normalized_key").alias("config_key"), F.col("source.path").alias("source"), F.lit("added without value").alias("reason"))
    c = first_value_changes(changed).where(F.trim(F.coalesce("new_value", F.lit(""))) == "").select(F.col("key").alias("config_key"), F.col("new_source").alias("source"), F.lit("changed to empty value").alias("reason"))
    return a.unionByName(c)
