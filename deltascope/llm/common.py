"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast table of narrow rows may have.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, also one with dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of narrow rows, sent to all tasks only if it has few rows.

    Beyond ``BROADCAST_ROWS`` it is a shuffled join; a key with many rows of
    ``df`` is then split by the adaptive skew join, as ``small`` has one row
    for each key.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


#: A key with more than 1/HEAVY_SHARE of the rows is heavy; there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 2000
#: Parts into which the rows of a heavy key are dealt.
SALTS = 64


def salted_join(df: DataFrame, counted: DataFrame, on: list[str], n_column: str, total: int, part: Column,
                how: str = "inner") -> DataFrame:
    """Join with ``counted``, one row for each key with ``n_column`` = its rows in ``df``.

    The rows of a heavy key are dealt into ``SALTS`` parts by ``part``, and its
    row in ``counted`` is repeated for each. Heavy keys have over 1/HEAVY_SHARE
    of the ``total`` rows, so their list is short whatever the input, and is
    sent to all tasks.
    """
    heavy = F.col(n_column) > max(1000, total // HEAVY_SHARE)
    listed = F.broadcast(counted.filter(heavy).select(*on, F.lit(True).alias("_heavy")))
    dealt = df.join(listed, on, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_heavy")
    copies = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(heavy, SALTS - 1).otherwise(0)))).drop(n_column)
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
