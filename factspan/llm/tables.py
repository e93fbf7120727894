"""Connected components over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, read, written

__all__ = ["components", "dealt_join", "drop", "read", "written"]

#: Rows of one key that stay together in ``dealt_join``; those of a key with more are dealt to several.
TOGETHER = 100_000


def dealt_join(rows: DataFrame, table: DataFrame, key: str, together: int = TOGETHER) -> DataFrame:
    """``rows(key, ...)`` with the columns of ``table(key, n, ...)``, ``n`` the rows that have the key.  An entry with many rows
    stands once for each share of them; the list of such keys, one for ``together`` rows at most, is broadcast."""
    table = written(table, "dealt-keys")  # two plans read it
    many = table.where(F.col("n") > together).select(key, F.ceil(F.col("n") / together).cast("int").alias("_shares"))
    dealt = rows.join(F.broadcast(many.distinct()), key, "left")
    dealt = dealt.withColumn("_share", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_shares")), F.lit(0)).cast("int")).drop("_shares")
    each = table.withColumn("_share", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / together).cast("int") - 1)))
    return dealt.join(each, [key, "_share"]).drop("_share", "n")


def components(edges: DataFrame, prefix: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)`` of one ordered type: one row ``(node, root)`` per node,
    ``root`` the smallest node it reaches.

    Alternates two star rounds (every node sends its larger neighbours, then its smaller ones, to the least
    neighbour) until the edges stay as they are; the edges live in shared tables only.  The least neighbour is
    a grouped minimum that is joined back, so no neighbour list is ever gathered; roots of large components
    get one row per node, and such a row needs nothing but its own key.  The number of rounds is logarithmic.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(edges, prefix)

    def star(frame: DataFrame, large: bool) -> DataFrame:
        pairs = frame.select("a", "b")
        if large:
            pairs = pairs.unionByName(frame.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = pairs.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        else:
            pairs = frame.select(F.col("b").alias("n"), F.col("a").alias("s"))
            least = pairs.groupBy("n").agg(F.min("s").alias("m"))
            out = pairs.join(least, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).unionByName(
                least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        return out.where("a <> b").distinct()

    signature = None
    while True:
        then = written(star(star(now, True), False), prefix)
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = then
        if seen == signature:
            break
        signature = seen
    leaves = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return leaves.unionByName(roots)
