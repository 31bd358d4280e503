"""Row numbers and neighbours over groups that may hold a third of all rows.

A plain window puts a whole group into one task. Here a group is split into
buckets by a monotone function of its order; ranks are computed inside the
buckets and shifted by the row counts of the buckets before them. The results
are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.session import cut_lineage


def _renamed(per_bucket: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_bucket.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_bucket"]})


def _same(keys: Sequence[str]) -> Column:
    """One group and bucket; a NULL order value has a NULL bucket, which is a bucket as well."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_bucket"]])


def bucketed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                        bucket: Column, name: str = "row_no") -> DataFrame:
    """Add ``name`` = 1-based position of each row in its group.

    ``bucket`` must not decrease along ``order``. ``keys`` must not be NULL.
    With no keys the numbers run over the whole table; only the bucket counts,
    one row per bucket, then meet in one task.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (bucketed.withColumn("_rank", F.row_number().over(inside))
            .join(_renamed(offsets, keys), _same(keys))
            .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
            .drop("_bucket", "_rank", "_offset", *[f"_of_{k}" for k in [*keys, "_bucket"]]))


def bucketed_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                       bucket: Column, values: Sequence[str], name: str,
                       backward: bool = False) -> DataFrame:
    """Add struct ``name`` with ``values`` of the next (or previous) row of the group.

    ``order`` columns must be unique within a group; at the end of a group the
    struct is NULL.
    """
    keys, order = list(keys), list(order)
    packed = F.struct(*[F.col(v) for v in values])
    bucketed = df.withColumn("_bucket", bucket).withColumn("_packed", packed)
    position = F.struct(*[F.col(o) for o in order])
    pick = F.max_by("_packed", position) if backward else F.min_by("_packed", position)
    edges = bucketed.groupBy(*keys, "_bucket").agg(pick.alias("_edge"))
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    step = F.lag if backward else F.lead
    edges = edges.select(*keys, "_bucket", step("_edge").over(over_buckets).alias("_outer"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (bucketed.withColumn("_inner", step("_packed").over(inside))
            .join(_renamed(edges, keys), _same(keys))
            .withColumn(name, F.coalesce("_inner", "_outer"))
            .drop("_bucket", "_packed", "_inner", "_outer", *[f"_of_{k}" for k in [*keys, "_bucket"]]))


def ranged_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Add ``name`` = 1-based position of each row in the order of the columns, NULLs first.

    Spark draws the borders of the ranges from the data, so neither the width of a key nor how
    it is spread matters; the rows with their range are written, which fixes the borders. Only the
    row counts, one for each range, meet in one task. The order should have no large ties.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (dealt.withColumn("_rank", F.row_number().over(inside)).join(offsets, "_range")
            .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint")).drop("_range", "_rank", "_offset"))
