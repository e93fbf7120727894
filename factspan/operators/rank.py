"""First-wins choices as ranked aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

IDENTITY = ("normalized_key", "role", "profile", "region", "namespace")


def priority() -> Column:
    return K.priority(F.col("source.path"), F.col("environment.profile"), F.col("source.source_kind"))


def with_identity(items: DataFrame) -> DataFrame:
    """Adds profile, region and namespace as identity columns; a null dimension is empty."""
    return items.withColumns({n: F.coalesce(F.col(f"environment.{n}"), F.lit("")) for n in ("profile", "region", "namespace")})


def identity_text() -> Column:
    return F.concat_ws("|", *IDENTITY)


def first_of(items: DataFrame, *key: str) -> DataFrame:
    """One row per key: the highest priority, then the earliest.  An aggregate, so hot keys shrink before the shuffle."""
    rank = F.struct(priority().alias("p"), (-F.col("ordinal")).alias("o"))
    best = items.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in items.columns if c not in key]), rank).alias("_row"))
    return best.select(*key, "_row.*")


def winners_by_identity(items: DataFrame) -> DataFrame:
    return first_of(with_identity(items), *IDENTITY)


def winners_by_key(items: DataFrame) -> DataFrame:
    return first_of(items, "normalized_key")
