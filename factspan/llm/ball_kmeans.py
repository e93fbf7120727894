"""Exact k-means over integer vectors, by balls.

A cluster is the ball of its members around its centroid.  Two balls are neighbours where the distance of their
centroids is at most twice the radius of the first: no member can be nearer to another centroid.  Within a ball, members
nearer to the centroid than half the way to the nearest neighbour are its stable core and stay without a comparison; the
others lie in annuli, one more for every neighbour in order of distance, and members of annulus a are compared with the
first a neighbours only.  All of it is integer arithmetic (a distance d to the own centroid against a distance D of
centroids: 4 d <= D of the squares), so no rounding can drop a neighbour.

Clusters of the round before are carried in a table of the shared folder, one pass a round: each task takes its
rows' part of every ball, whose radius is never larger than the whole ball's, moves the members and writes them.  New
centroids come from sums per cluster and component, added in tasks first, so the driver sees k times the dimension
numbers and no vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, written

K = 40
ROUNDS = 5
SIZE = 64
SCALE = 256
SEED = "2"
#: Rows that a task compares at once.
BLOCK = 1 << 14


def most(size: int) -> int:
    """The largest component, either way: four times a squared distance of ``size`` of them stays below 2^63."""
    return 1 << min(30, (61 - (size - 1).bit_length()) // 2 - 1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2] or b"", dtype="<i4", count=len(column) * size, offset=_first(column)).reshape(-1, size)


def _first(column: pa.Array) -> int:
    return int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]) if len(column) else 0


def prepared(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the rows of ``vectors(vec_id, embedding, ...)`` that have ``size`` finite components: ``v`` packs
    floor(scale * component) as little-endian 32-bit integers."""
    def run(batches):
        for b in batches:
            column = b.column(1)
            column = column.storage if isinstance(column, pa.ExtensionArray) else column
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            ints = np.clip(np.floor(flat * scale), -most(size), most(size)).astype("<i4")
            yield pa.record_batch([b.column(0), pa.array([row.tobytes() for row in ints], pa.binary())], names=["vec_id", "v"])

    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == size) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", x.alias("x")).mapInArrow(run, f"vec_id {kind}, v binary")


def first_centroids(points: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of ``seed:vec_id`` (fewer where there are fewer), in that order; rows of
    one id follow by their bytes.  A null id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = points.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in rows], dtype=np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every point, with all centroids compared: the first round, which has no balls."""
    reach = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max()))
    kind = np.float64 if points.shape[1] * reach * reach < 1 << 53 else np.int64  # either way without rounding
    cross = (points.astype(kind) @ centroids.T.astype(kind)).astype(np.int64)
    table = (centroids * centroids).sum(axis=1) - 2 * cross
    cluster = table.argmin(axis=1)
    return cluster, table[np.arange(len(points)), cluster] + (points * points).sum(axis=1)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others in order of distance, and the squared distances."""
    between = _squared(centroids[:, None, :], centroids[None, :, :])
    others = np.array([[j for j in range(len(centroids)) if j != i] for i in range(len(centroids))], dtype=np.int64).reshape(len(centroids), -1)
    apart = np.take_along_axis(between, others, 1)
    order = np.argsort(apart, axis=1, kind="stable")
    return np.take_along_axis(others, order, 1), np.take_along_axis(apart, order, 1)


def moved(points: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of every point under ``centroids``, given its cluster of the round before; and how
    many distances were computed."""
    own = _squared(points, centroids[cluster])
    best, out, compared = own.copy(), cluster.copy(), len(points)
    order, apart = near
    for i in np.unique(cluster):
        members = np.flatnonzero(cluster == i)
        reach = 4 * own[members]
        relevant = int(np.searchsorted(apart[i], reach.max(), side="right"))
        annulus = np.searchsorted(apart[i, :relevant], reach, side="right")
        for a in range(relevant):
            outer = members[annulus > a]
            j = order[i, a]
            d = _squared(points[outer], centroids[j])
            compared += len(outer)
            won = (d < best[outer]) | ((d == best[outer]) & (j < out[outer]))
            best[outer[won]], out[outer[won]] = d[won], j
    return out, best, compared


def _assigned(points: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """``(vec_id, v, cluster, distance)``: by balls where ``points`` has clusters, by all centroids where it has none."""
    near = neighbours(centroids)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = _vectors(part.column(1), size).astype(np.int64)
                if part.num_columns == 2:
                    cluster, distance = nearest(x, centroids)
                else:
                    cluster, distance, _ = moved(x, part.column(2).to_numpy().astype(np.int64), centroids, near)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                      names=["vec_id", "v", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    have = [c for c in ("vec_id", "v", "cluster") if c in points.columns]
    return points.select(*have).mapInArrow(run, f"vec_id {kind}, v binary, cluster int, distance long")


def next_centroids(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored mean of every cluster's members, component by component; clusters without members keep theirs."""
    k, size = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, size), object), np.zeros(k, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x, cluster = _vectors(part.column(0), size).astype(np.int64), part.column(1).to_numpy()
                for i in np.unique(cluster):
                    some = cluster == i
                    sums[i] += x[some].sum(axis=0)
                    counts[i] += int(some.sum())
        have = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.repeat(have, size), pa.int32()), pa.array(np.tile(np.arange(size), len(have)), pa.int32()),
                               pa.array([str(s) for s in sums[have].ravel()], pa.string()), pa.array(np.repeat(counts[have], size), pa.int64())],
                              names=["cluster", "place", "total", "n"])

    found = points.select("v", "cluster").mapInArrow(run, "cluster int, place int, total string, n long")
    out = centroids.copy()
    for r in found.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` per row of ``vectors(vec_id, embedding, ...)`` with ``size`` finite components,
    and the final centroids.

    Components are taken as floor(scale * x), held within ``most(size)`` (2^26 for 64) either way; ``distance`` is squared.  Rows of another size,
    with a null or with no finite number are left out.  Repeated rows count as often as they occur, null ids like
    others.  Ties go to the smaller cluster number.  Fewer rows than ``k`` give as many clusters; none an empty result.
    """
    points = written(prepared(vectors, size, scale), "ball-points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.selectExpr("vec_id", "cast(null as int) cluster", "cast(null as bigint) distance"), np.zeros((0, size), np.int64)
    for _ in range(rounds):
        now = written(_assigned(points, centroids, size), "ball-members")
        drop(points)
        points, centroids = now, next_centroids(now, centroids)
    now = written(_assigned(points, centroids, size), "ball-members")
    drop(points)
    return now.select("vec_id", "cluster", "distance"), centroids


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``members`` of ``clusters`` with ``cluster_inertia``, ``inertia`` (sums of squared distances) and ``centroid_sha256``
    (of the final centroid's components as decimal integers, comma-joined)."""
    spark = members.sparkSession
    sums = {r["cluster"]: r["total"] for r in members.groupBy("cluster").agg(F.sum("distance").alias("total")).where("cluster is not null").collect()}
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(i, total, whole, digests[i]) for i, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
