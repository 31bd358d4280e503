"""Compare row collections with one aggregation instead of joins.

All sides are tagged, put together and grouped by the row. Copies collapse
before the shuffle, so a row that makes up a third of a side costs one record
per task; grouping treats NULLs as equal, as EXCEPT does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascope.functions.hashing import fingerprint


def bag_counts(sides: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct rows with ``n_<side>`` = number of copies on each side."""
    tagged = [df.select(*columns, *[F.lit(1 if name == side else 0).alias(f"_{name}") for name in sides])
              for side, df in sides.items()]
    together = tagged[0]
    for other in tagged[1:]:
        together = together.unionByName(other)
    return together.groupBy(*columns).agg(*[F.sum(f"_{name}").alias(f"n_{name}") for name in sides])


def changed_fingerprints(original: DataFrame, altered: DataFrame) -> DataFrame:
    """Fingerprints of rows whose number of copies differs.

    For wide rows: 16 bytes per row are shuffled instead of the whole row.
    """
    prints = bag_counts({"a": original.select(*fingerprint(original.columns)),
                         "b": altered.select(*fingerprint(original.columns))}, ["fp1", "fp2"])
    return prints.filter(F.col("n_a") != F.col("n_b")).select("fp1", "fp2")


def only_changed(df: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows of ``df`` whose fingerprint is listed."""
    marks = df.select("*", *fingerprint(df.columns))
    return marks.join(prints, ["fp1", "fp2"], "left_semi").drop("fp1", "fp2")
