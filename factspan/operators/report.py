"""Aggregates of a report over the facts of an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from .rank import priority

TOP_DIRECTORIES = 8


def count_by_dims(items: DataFrame) -> DataFrame:
    """Counts by confidence, by role and by kind of source, in one pass of grouping sets."""
    flat = items.select("confidence", "role", F.col("source.source_kind").alias("source_kind"))
    sets = [["confidence"], ["role"], ["source_kind"]]
    g = flat.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in ("confidence", "role", "source_kind")])
    out = g.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "confidence").when(F.col("g") == 5, "role").otherwise("source_kind")
    value = F.when(F.col("g") == 3, F.col("confidence")).when(F.col("g") == 5, F.col("role")).otherwise(F.col("source_kind"))
    return out.select(dim.alias("dim"), value.alias("value"), "n")


def shares(counts: DataFrame) -> DataFrame:
    """Percentage and running percentage of ``counts(dim, value, n)`` within each dimension, largest first: the
    segments of charts.  The counts are few rows, one per value of a dimension."""
    own = Window.partitionBy("dim")
    running = own.orderBy(F.col("n").desc(), "value").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(own)
    return counts.select("dim", "value", "n", (100 * F.col("n") / total).alias("percent"), (100 * F.sum("n").over(running) / total).alias("cumulative"))


def key_stats(items: DataFrame) -> DataFrame:
    """Distinct keys, keys that look sensitive, keys with more than one finding."""
    per = items.groupBy("normalized_key").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.count_if(K.is_sensitive("normalized_key")).alias("sensitive_keys"), F.count_if(F.col("n") > 1).alias("multi_source_keys"))


def directory_stats(items: DataFrame) -> DataFrame:
    d = items.select(K.directory_of(F.col("source.path")).alias("directory"), "normalized_key", K.is_sensitive("key").alias("hit"))
    return d.groupBy("directory").agg(F.count("*").alias("findings"), F.count_distinct("normalized_key").alias("keys"), F.count_if("hit").alias("sensitive"))


def top_directories(items: DataFrame, k: int = TOP_DIRECTORIES) -> DataFrame:
    return directory_stats(items).orderBy(F.col("findings").desc(), "directory").limit(k)


def grouped(items: DataFrame) -> DataFrame:
    """Findings of each key in the order of priority.  Rows stay rows: a key may have any number of findings."""
    return items.select("normalized_key", "ordinal", priority().alias("priority"), K.display_value(F.col("value.raw"), F.col("default_value.raw")).alias("shown"), F.col("source.path").alias("path"), "role"
                        ).orderBy("normalized_key", F.col("priority").desc(), "ordinal")


def key_blocks(items: DataFrame) -> DataFrame:
    """One row of HTML per finding in the order of ``grouped``, with the head of a block where a key begins and its end
    where it ends: ``html`` rows that follow each other are the list of keys.  No key's findings are gathered."""
    e = K.html_escape
    rows = items.select("normalized_key", "ordinal", priority().alias("priority"), K.display_value(F.col("value.raw"), F.col("default_value.raw")).alias("shown"), F.col("source.path").alias("path"), "role")
    rows = rows.withColumn("at", F.struct((-F.col("priority")).alias("p"), "ordinal"))
    per = rows.groupBy("normalized_key").agg(F.min("at").alias("least"), F.max("at").alias("most"), F.count("*").cast("string").alias("n"))
    rows = rows.join(per, "normalized_key").withColumns({"begins": F.col("at") == F.col("least"), "ends": F.col("at") == F.col("most")})
    path = F.coalesce("path", F.lit(""))
    head = F.concat(F.lit("<details><summary>"), e("normalized_key"), F.lit(" ("), "n", F.lit(")</summary><table><tr><th>role</th><th>value</th><th>source</th></tr>"))
    cells = F.concat(*[x for c in ("role", "shown") for x in (F.lit("<td>"), e(F.coalesce(c, F.lit(""))), F.lit("</td>"))], F.lit("<td>"), e(path), F.lit("</td>"))
    text = F.lower(F.concat_ws(" ", "normalized_key", "shown", "path"))
    row = F.concat(F.lit('<tr data-s="'), e(text), F.lit('">'), cells, F.lit("</tr>"))
    html = F.concat(F.when(F.col("begins"), head).otherwise(""), row, F.when(F.col("ends"), "</table></details>").otherwise(""))
    return rows.select("normalized_key", "priority", "ordinal", html.alias("html")).orderBy("normalized_key", F.col("priority").desc(), "ordinal").select("html")


def search(items: DataFrame, query: str) -> DataFrame:
    """Keys any of whose key, values or paths contain the query, without regard to case."""
    q = F.lower(F.lit(query))
    text = F.lower(F.concat_ws(" ", "normalized_key", F.col("value.raw"), F.col("default_value.raw"), F.col("source.path")))
    return items.where(text.contains(q)).select("normalized_key").distinct()
