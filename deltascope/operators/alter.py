"""Controlled alterations of tables, as lazy plans over the base tables.

An altered database is a set of plans: untouched tables are the same DataFrame
objects, nothing is copied, and either all statements apply or none do.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alteration:
    """One statement: ``op`` is delete, update or insert.

    ``predicate`` and the values of ``assignments`` are SQL expressions over the
    old row; ``rows`` holds the rows to insert, and ``pk`` the key they must not repeat.
    """

    table: str
    op: str
    predicate: str | None = None
    assignments: Mapping[str, str] = field(default_factory=dict)
    rows: DataFrame | None = None
    pk: Sequence[str] = ()


def _holds(predicate: str | Column) -> Column:
    """True where the predicate is true; NULL counts as not matching."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(condition, F.lit(False))


def delete_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Drop the matching rows; rows where the predicate is NULL stay."""
    return df.filter(~_holds(predicate))


def delete_keys(df: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """Drop the rows whose key is listed; Spark picks the join by the size of ``keys``."""
    return df.join(keys.select(*pk), pk, "left_anti")


def update_rows(df: DataFrame, predicate: str | Column,
                assignments: Mapping[str, str | Column]) -> DataFrame:
    """Set columns on matching rows in one projection, so all see the old row."""
    unknown = set(assignments) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    hit = _holds(predicate)

    def value(name: str) -> Column:
        if name not in assignments:
            return F.col(name)
        new = assignments[name]
        new = F.expr(new) if isinstance(new, str) else new
        return F.when(hit, new.cast(df.schema[name].dataType)).otherwise(F.col(name)).alias(name)

    return df.select(*[value(c) for c in df.columns])


def insert_rows(df: DataFrame, rows: DataFrame, pk: Sequence[str] = ()) -> DataFrame:
    """Append rows; columns they lack are NULL, column types stay those of ``df``.

    With ``pk`` the statement fails, when it runs, if a key is taken or comes
    twice among the new rows; NULL keys are never equal.
    """
    typed = rows.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in rows.columns])
    if pk:
        pk = list(pk)
        twice = typed.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        refused = key_collisions(df, typed.select(*pk).distinct(), pk).select(*pk).unionByName(twice.select(*pk)).distinct()
        checked = typed.join(refused.withColumn("_refused", F.lit(True)), pk, "left")
        fail = F.raise_error(F.concat(F.lit("key is taken: "), F.to_json(F.struct(*pk))))
        typed = checked.filter(F.when(F.col("_refused"), fail.cast("boolean")).otherwise(True)).select(*typed.columns)
    return df.unionByName(typed, allowMissingColumns=True)


def key_collisions(df: DataFrame, rows: DataFrame, pk: list[str]) -> DataFrame:
    """Rows to insert whose key is taken already; must be empty for a valid insert."""
    return rows.join(df.select(*pk), pk, "left_semi")


def apply_one(tables: Mapping[str, DataFrame], change: Alteration) -> dict[str, DataFrame]:
    if change.table not in tables:
        raise KeyError(f"no table {change.table}")
    before = tables[change.table]
    if change.op == "delete":
        after = delete_rows(before, change.predicate)
    elif change.op == "update":
        after = update_rows(before, change.predicate, change.assignments)
    elif change.op == "insert":
        after = insert_rows(before, change.rows, change.pk)
    else:
        raise ValueError(f"unknown op {change.op}")
    return {**tables, change.table: after}


def apply_sequence(tables: Mapping[str, DataFrame],
                   changes: Iterable[Alteration]) -> dict[str, DataFrame]:
    """Apply several statements in order, over any of the tables."""
    return reduce(apply_one, changes, dict(tables))


def snapshot(base: DataFrame, delta: DataFrame, pk: list[str]) -> DataFrame:
    """The altered table of one record from its keyed delta.

    ``delta`` has ``op``, the key and the new values. Base rows of touched keys
    leave, updated and inserted rows come in from the delta.
    """
    kept = base.join(delta.select(*pk), pk, "left_anti")
    incoming = delta.filter(F.col("op") != "delete").select(*base.columns)
    return kept.unionByName(incoming)


def snapshot_changes(base: DataFrame, delta: DataFrame, pk: list[str],
                     values: list[str]) -> DataFrame:
    """Old and new image of each touched key, for many records over one base.

    Only touched keys are multiplied by record; the base is read once.
    """
    old = base.select(*pk, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("had"))
    new = delta.select("record_id", "op", *pk, *[F.col(v).alias(f"new_{v}") for v in values])
    return new.join(old, pk, "left")


def snapshot_totals(base: DataFrame, delta: DataFrame, pk: list[str],
                    measure: str) -> DataFrame:
    """Row count and sum of a measure in each record's own altered copy.

    Base totals are computed once; each record adds the difference made by its
    touched keys, so no copy of the base is ever built.
    """
    money = "decimal(38,2)"
    changes = snapshot_changes(base, delta, pk, [measure])
    gone = F.when(F.col("had"), F.col(f"old_{measure}").cast(money)).otherwise(0)
    come = F.when(F.col("op") != "delete", F.col(f"new_{measure}").cast(money)).otherwise(0)
    moved = changes.groupBy("record_id").agg(
        (F.count_if(F.col("op") != "delete") - F.count_if(F.coalesce("had", F.lit(False)))).alias("d_rows"),
        F.sum(come - F.coalesce(gone, F.lit(0))).alias("d_sum"))
    totals = base.agg(F.struct(F.count(F.lit(1)).alias("n"),
                               F.sum(F.col(measure).cast(money)).alias("s")).alias("t")).scalar()
    return moved.select("record_id",
                        (totals.getField("n") + F.col("d_rows")).cast("bigint").alias("n_rows"),
                        (totals.getField("s") + F.col("d_sum")).cast("double").alias(f"sum_{measure}"))
