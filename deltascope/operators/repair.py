"""Inverse alterations from a keyed diff, and scoring of the fixes of many records.

The texts of the descriptions are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repair_from_diff(diff: DataFrame, pk: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Delta that undoes a keyed diff: deleted -> insert, modified -> update, inserted -> delete."""
    op = (F.when(F.col("change") == "deleted", "insert")
          .when(F.col("change") == "modified", "update").otherwise("delete"))
    return diff.select(op.alias("op"), *pk, *[F.col(f"old_{v}").alias(v) for v in values])


def fixed_images(base: DataFrame, alterations: DataFrame, fixes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Old and new image of each key that a record's alteration or its fix touches.

    ``alterations`` and ``fixes`` are keyed deltas with record_id, op, key and
    values; a fix is applied to the altered table, so where both touch a key
    the fix has the last word. Only touched keys are multiplied by record, and
    the base is read once. Columns: record_id, key, ``old`` and ``new``
    (structs of the values, NULL where the row is not there).
    """
    pk = list(pk)
    values = [c for c in base.columns if c not in pk]

    def image(delta: DataFrame, step: int) -> DataFrame:
        new = F.when(F.col("op") != "delete", F.struct(*values))
        return delta.select("record_id", *pk, F.struct(F.lit(step).alias("step"), new.alias("new")).alias("state"))

    last = (image(alterations, 1).unionByName(image(fixes, 2)).groupBy("record_id", *pk)
            .agg(F.max_by("state", F.col("state.step")).alias("state")))
    old = base.select(*pk, F.struct(*values).alias("old"))
    return last.join(old, pk, "left").select("record_id", *pk, "old", F.col("state.new").alias("new"))


def evaluate_fixes(base: DataFrame, alterations: DataFrame, fixes: DataFrame, pk: Sequence[str], errors: DataFrame,
                   keep: str, groups: Sequence[str], total: str) -> DataFrame:
    """Scores of the fixes of many records, one row for each record.

    The gold query groups the rows with ``keep`` by ``groups`` and gives their
    number and the sum of ``total``. Both are sums, so its result on a fixed
    table is the base result plus the differences of the touched keys. The
    gold score is 1 if the result is back as a set of rows, the restore score 1
    if the whole table is back too. ``errors`` has (record_id, error) of fixes
    that could not be applied; they score 0. The description names the first
    thing that is wrong.
    """
    groups = list(groups)

    def measured(df: DataFrame, *keys: str) -> DataFrame:
        return df.filter(F.expr(keep)).groupBy(*keys, *groups).agg(
            F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col(total).cast("decimal(18,2)")).alias("total"))

    images = fixed_images(base, alterations, fixes, pk)
    sides = images.select("record_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))).alias("s"))
    moved = measured(sides.filter(F.col("s.row").isNotNull()).select("record_id", "s.sign", "s.row.*"), "record_id")
    gold = measured(base.withColumn("sign", F.lit(1)), *[]).withColumnsRenamed({"n": "gold_n", "total": "gold_total"})
    changed = moved.filter((F.col("n") != 0) | (F.col("total") != 0))
    same = [F.col(f"m.{g}").eqNullSafe(F.col(f"g.{g}")) for g in groups]
    both = changed.alias("m").join(gold.alias("g"), reduce(Column.__and__, same), "left")
    rows = both.groupBy("record_id").agg(
        F.count("gold_n").alias("missing_rows"),
        F.count_if(F.coalesce("gold_n", F.lit(0)) + F.col("n") > 0).alias("extra_rows"),
        F.sum(F.when(F.col("gold_n").isNull(), 1).otherwise(0)
              - F.when(F.coalesce("gold_n", F.lit(0)) + F.col("n") == 0, 1).otherwise(0)).alias("more_rows"))
    unrestored = images.groupBy("record_id").agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("unrestored"))
    expected = gold.count()
    out = (unrestored.join(rows, "record_id", "left").join(errors, "record_id", "left")
           .na.fill(0, ["missing_rows", "extra_rows", "more_rows"]))
    failed = F.col("error").isNotNull()
    back = ~failed & (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)
    restored = back & (F.col("unrestored") == 0)
    description = (
        F.when(failed, F.concat(F.lit("Fix SQL execution failed: "), F.col("error")))
        .when(restored, F.lit("gold_result matches and DB fully restored to original"))
        .when(back, F.lit("gold_result matches but DB not fully restored"))
        .otherwise(F.concat(F.lit("gold_sql result mismatch: expected "), F.lit(expected), F.lit(" row(s), got "),
                            F.lit(expected) + F.col("more_rows"), F.lit(" row(s). Missing: "), F.col("missing_rows"),
                            F.lit(" row(s), extra: "), F.col("extra_rows"), F.lit(" row(s)"))))
    return out.select(
        "record_id", back.cast("double").alias("gold_result_score"), restored.cast("double").alias("full_restore_score"),
        *[F.when(failed, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("missing_rows", "extra_rows", "unrestored")],
        description.alias("description"))
