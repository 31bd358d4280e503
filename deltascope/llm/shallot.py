"""Exact k-means by Shallot search: vectors keep bounds and their two nearest centroids.

A vector is looked at again only if its bounds can't rule out a change. Then the
closer one of the two centroids it remembers is the middle of a ball, whose
neighbours are met in the order of their distance from the middle; the ball
shrinks with each nearer one found. Whatever is left is compared by squared
distances of integers, so the result is that of comparing all pairs.

Each round is one pass of tasks over a written table of vectors and bounds. A task
returns, after its vectors, one row for each centroid with the change of its sum,
so nothing but sums of k centroids reaches the driver: ``k`` times the dimension,
whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from deltascope.llm.common import named
from deltascope.llm.vectors import all_finite, lists, matrix, scaled
from deltascope.session import cut_lineage

#: Bounds are widened by this part of themselves, far over the rounding of their sums.
SLACK = 1e-9
#: Vectors that a task looks at together.
CHUNK = 4096


@dataclass
class Net:
    """Centroids, the distances between them, and for each one the others by distance."""

    at: np.ndarray
    order: np.ndarray
    gap: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(at: np.ndarray) -> Net:
        k = len(at)
        dist = np.sqrt(np.array([((at - c) ** 2).sum(axis=1) for c in at], dtype=np.float64).reshape(k, k))
        np.fill_diagonal(dist, -1.0)
        order = np.argsort(dist, axis=1, kind="stable")[:, 1:]
        gap = np.take_along_axis(dist, order, axis=1)
        half = gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        return Net(at, order, gap, half)


def squared(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    diff = vectors.astype(np.int64) - to
    return np.einsum("ij,ij->i", diff, diff)


def search(vectors: np.ndarray, near: np.ndarray, other: np.ndarray, net: Net) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of each vector and their squared distances.

    ``near`` and ``other`` are two different centroids for each vector to start from.
    Of equally near centroids the one of the smaller number is nearest.
    """
    d_near, d_other = squared(vectors, net.at[near]), squared(vectors, net.at[other])
    turn = (d_other < d_near) | ((d_other == d_near) & (other < near))
    best, second = np.where(turn, other, near), np.where(turn, near, other)
    d_best, d_second = np.where(turn, d_other, d_near), np.where(turn, d_near, d_other)
    middle, reach = best.copy(), np.sqrt(d_best.astype(np.float64))
    active = np.arange(len(vectors))
    for step in range(net.order.shape[1]):
        ball = (reach[active] + np.sqrt(d_second[active].astype(np.float64))) * (1 + SLACK)
        active = active[net.gap[middle[active], step] <= ball]
        if not len(active):
            break
        j = net.order[middle[active], step]
        d = squared(vectors[active], net.at[j])
        b, s, db, ds = best[active], second[active], d_best[active], d_second[active]
        first = (d < db) | ((d == db) & (j < b))
        then = ~first & (j != s) & ((d < ds) | ((d == ds) & (j < s)))
        second[active] = np.where(first, b, np.where(then, j, s))
        d_second[active] = np.where(first, db, np.where(then, d, ds))
        best[active], d_best[active] = np.where(first, j, b), np.where(first, d, db)
    return best, second, d_best, d_second


def reassign(vectors: np.ndarray, near: np.ndarray, other: np.ndarray, upper: np.ndarray, lower: np.ndarray,
             net: Net, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    """New (near, other, upper, lower) after the centroids went as far as ``moved`` to where ``net`` has them."""
    k = len(net.at)
    if k == 1:
        return near, other, np.sqrt(squared(vectors, net.at[near]).astype(np.float64)), lower
    most = int(np.argmax(moved))
    rest = np.full(k, moved[most])
    rest[most] = np.delete(moved, most).max()
    upper = (upper + moved[near]) * (1 + SLACK)
    lower = np.maximum(lower - rest[near], net.half[near]) * (1 - SLACK)
    open_ = np.flatnonzero(upper >= lower)
    upper[open_] = np.sqrt(squared(vectors[open_], net.at[near[open_]]).astype(np.float64)) * (1 + SLACK)
    open_ = open_[upper[open_] >= lower[open_]]
    near, other = near.copy(), other.copy()
    near[open_], other[open_], d_near, d_other = search(vectors[open_], near[open_], other[open_], net)
    upper[open_] = np.sqrt(d_near.astype(np.float64)) * (1 + SLACK)
    lower[open_] = np.sqrt(d_other.astype(np.float64)) * (1 - SLACK)
    return near, other, upper, lower


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.IntegerType())),
        T.StructField("near", T.IntegerType()), T.StructField("other", T.IntegerType()),
        T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()),
        T.StructField("part", T.IntegerType()), T.StructField("joined", T.LongType()),
        T.StructField("change", T.ArrayType(T.LongType()))])


def _round(vectors: DataFrame, net: Net, moved: np.ndarray, first: bool) -> DataFrame:
    """The written table after one assignment: vectors with bounds, and changes of sums."""
    k, dim = net.at.shape
    kind = to_arrow_type(vectors.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, change = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                v = matrix(batch.column(1), dim)
                n = len(v)
                if first:
                    near = np.zeros(n, np.int32)
                    state = near, np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n)
                    near_before = np.full(n, -1, np.int32)
                else:
                    state = tuple(batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4, 5))
                    near_before = state[0]
                near, other, upper, lower = reassign(v, *state, net, moved)
                went = np.flatnonzero(near != near_before)
                np.add.at(joined, near[went], 1)
                np.add.at(change, near[went], v[went].astype(np.int64))
                if not first:
                    np.add.at(joined, near_before[went], -1)
                    np.add.at(change, near_before[went], -v[went].astype(np.int64))
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(other, pa.int32()),
                     pa.array(upper), pa.array(lower), none.cast(pa.int32()), none.cast(pa.int64()),
                     none.cast(pa.list_(pa.int64()))], names=["id", "v", "near", "other", "upper", "lower", "part", "joined", "change"])
        rows = np.flatnonzero((joined != 0) | (change != 0).any(axis=1))
        if len(rows):
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind), none.cast(pa.list_(pa.int32())), none.cast(pa.int32()), none.cast(pa.int32()),
                 none.cast(pa.float64()), none.cast(pa.float64()), pa.array(rows, pa.int32()), pa.array(joined[rows]),
                 lists(change[rows], pa.int64())], names=["id", "v", "near", "other", "upper", "lower", "part", "joined", "change"])

    return cut_lineage(vectors.mapInArrow(run, _schema(vectors.schema["id"].dataType)))


def _changes(table: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """Sums over the tasks of a round: rows joined and component sums, for each centroid."""
    parts = table.filter(F.col("part").isNotNull())
    wide = parts.select("part", F.posexplode(F.concat(F.array("joined"), "change")).alias("pos", "x"))
    joined, sums = [0] * k, [[0] * dim for _ in range(k)]
    for part, pos, x in wide.groupBy("part", "pos").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():
        if pos == 0:
            joined[part] = int(x)
        else:
            sums[part][pos - 1] = int(x)
    return joined, sums


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, scale: int = 256,
            id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Cluster of each vector after ``rounds`` of k-means over components ``floor(scale * x)``.

    Vectors of another dimension, and those with a component that is NULL, NaN or
    infinite, are left out. The first centroids are the ``k`` vectors of the smallest
    ``sha256("<seed>:<id>")``, equal ids by their components, NULL ids last; with fewer
    vectors there are fewer centroids. Rows with NULL or repeated ids are clustered
    like others and come back once each. Equal vectors and equally near centroids go
    to the smaller number; a centroid that no vector chooses stays where it is. An
    empty table gives no rows. Other columns are left out, whatever their names.
    Components of 2^27 or more after scaling are an error.

    Returns ``id_column``, ``cluster``, ``distance`` (squared), ``cluster_inertia``,
    ``inertia`` and ``centroid_sha256``.
    """
    spark = df.sparkSession
    vector = named(vector_column)
    vectors = cut_lineage(df.filter((F.size(vector) == dim) & all_finite(vector)).select(
        named(id_column).alias("id"), scaled(vector, scale).alias("v")))
    placed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = vectors.orderBy(placed.asc_nulls_last(), "v").limit(k).collect()
    at = np.array([r["v"] for r in starts], dtype=np.int64).reshape(-1, dim)
    k = len(at)
    if k == 0:
        return _named(spark, vectors.limit(0).select(
            "id", F.lit(0).alias("near"), F.lit(0).cast("long").alias("distance")), at, id_column)
    joined, sums, moved = [0] * k, [[0] * dim for _ in range(k)], np.zeros(k)
    table = vectors
    for step in range(rounds + 1):
        table = _round(table.filter("part IS NULL").select("id", "v", "near", "other", "upper", "lower") if step else table,
                       Net.of(at), moved, step == 0)
        if step == rounds:
            break
        came, change = _changes(table, k, dim)
        joined = [a + b for a, b in zip(joined, came)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, change)]
        new = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, joined, at.tolist())],
                       dtype=np.int64).reshape(k, dim)
        moved = np.sqrt(((new - at) ** 2).sum(axis=1).astype(np.float64))
        at = new
    centres = spark.createDataFrame([(i, c) for i, c in enumerate(at.tolist())], "near int, centre array<int>")
    apart = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b).cast("long") * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = table.filter("part IS NULL").join(F.broadcast(centres), "near").select("id", "near", apart.alias("distance"))
    return _named(spark, cut_lineage(rows), at, id_column)


def _named(spark: SparkSession, rows: DataFrame, at: np.ndarray, id_column: str) -> DataFrame:
    """Rows with the figures of their cluster; there is one row of figures for each of the k clusters."""
    sums = rows.groupBy("near").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    prints = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(at)], "near int, centroid_sha256 string")
    figures = prints.join(sums, "near").join(F.broadcast(whole))
    return rows.join(F.broadcast(figures), "near").select(
        F.col("id").alias(id_column), F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
