"""Differences of tables and databases: by set, with copies, by key, as text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions.hashing import fingerprint
from deltascope.functions.ranking import bucketed_row_number
from deltascope.operators.bags import bag_counts, changed_fingerprints, only_changed


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def diff_set(original: DataFrame, altered: DataFrame) -> DataFrame:
    """Whole rows found on one side only, copies collapsed, NULL equal to NULL."""
    counts = bag_counts({"a": original, "b": altered}, original.columns)
    side = F.when(F.col("n_b") == 0, "original").when(F.col("n_a") == 0, "altered")
    return counts.select(side.alias("side"), *original.columns).filter(F.col("side").isNotNull())


def diff_bag(original: DataFrame, altered: DataFrame, wide: bool = False) -> DataFrame:
    """Rows whose number of copies differs; ``copies`` more of them on ``side``.

    With ``wide`` the rows are compared by a 128-bit fingerprint first and only
    the differing ones are shuffled whole. That pays for long rows with few
    changes, at the price of a second scan.
    """
    if wide:
        prints = changed_fingerprints(original, altered)
        original, altered = only_changed(original, prints), only_changed(altered, prints)
    counts = bag_counts({"a": original, "b": altered}, original.columns)
    more = F.col("n_a") - F.col("n_b")
    return (counts.filter(more != 0)
            .select(F.when(more > 0, "original").otherwise("altered").alias("side"),
                    F.abs(more).cast("bigint").alias("copies"), *original.columns))


def _null_safe(pk: Sequence[str]) -> Column:
    """Keys are equal to the other side's, renamed ones; NULL is equal to NULL."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in pk])


def diff_keyed(original: DataFrame, altered: DataFrame, pk: Sequence[str],
               wide: bool = False) -> DataFrame:
    """One row per changed key: change type, changed columns, old and new values.

    ``pk`` must be unique on both sides; NULL keys meet. With ``wide`` only keys and
    fingerprints are shuffled for all rows; the values are fetched for the
    changed keys.
    """
    pk = list(pk)
    values = [c for c in original.columns if c not in pk]
    if wide:
        theirs = altered.select(*[F.col(k).alias(f"_b_{k}") for k in pk],
                                *[c.alias(n) for c, n in zip(fingerprint(values), ("gp1", "gp2"))])
        both = original.select(*pk, *fingerprint(values)).join(theirs, _null_safe(pk), "full_outer")
        # a side that lacks the key has NULL prints, the other has not
        same = F.col("fp1").eqNullSafe(F.col("gp1")) & F.col("fp2").eqNullSafe(F.col("gp2"))
        keys = both.filter(~same).select(*[F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(f"_b_{k}") for k in pk])
        original = original.join(keys, _null_safe(pk), "left_semi")
        altered = altered.join(keys, _null_safe(pk), "left_semi")
    a = original.select(*pk, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("_a"))
    b = altered.select(*pk, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_b"))
    differs = [(c, ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))) for c in values]
    kind = (F.when(F.col("_b").isNull(), "deleted")
            .when(F.col("_a").isNull(), "inserted").otherwise("modified"))
    changed = F.when(F.col("_a") & F.col("_b"),
                     F.concat_ws(",", *[F.when(d, F.lit(c)) for c, d in differs]))
    any_change = reduce(Column.__or__, [d for _, d in differs])
    joined = a.join(b.withColumnsRenamed({k: f"_b_{k}" for k in pk}), _null_safe(pk), "full_outer")
    return (joined.filter(F.col("_a").isNull() | F.col("_b").isNull() | any_change)
            .select(*[F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in pk], kind.alias("change"), changed.alias("changed_columns"),
                    *[f"old_{c}" for c in values], *[f"new_{c}" for c in values]))


def _table_counts(name: str, original: DataFrame, candidate: DataFrame) -> DataFrame:
    counts = bag_counts({"a": original, "b": candidate}, original.columns)
    more = F.col("n_a") - F.col("n_b")
    return counts.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).cast("bigint").alias("n_original"),
        F.coalesce(F.sum("n_b"), F.lit(0)).cast("bigint").alias("n_candidate"),
        F.count_if(F.col("n_b") == 0).alias("only_original"),
        F.count_if(F.col("n_a") == 0).alias("only_candidate"),
        F.coalesce(F.sum(F.greatest(more, F.lit(0))), F.lit(0)).cast("bigint").alias("copies_original"),
        F.coalesce(F.sum(F.greatest(-more, F.lit(0))), F.lit(0)).cast("bigint").alias("copies_candidate"),
    ).select(F.lit(name).alias("table_name"), "*")


def diff_counts(original: Mapping[str, DataFrame], candidate: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts and rows on one side only, per common table, as one plan.

    ``only_*`` count distinct rows as EXCEPT does, ``copies_*`` count copies.
    """
    common = sorted(set(original) & set(candidate))
    return _union([_table_counts(t, original[t], candidate[t]) for t in common])


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of a database in one plan."""
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                   for name, df in sorted(tables.items())])


def diff_table_sets(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame]) -> DataFrame:
    """Tables missing from or extra in the second database, with their row counts."""
    a = table_row_counts(first).withColumnRenamed("n_rows", "n_first")
    b = table_row_counts(second).withColumnRenamed("n_rows", "n_second")
    status = (F.when(F.col("n_second").isNull(), "missing")
              .when(F.col("n_first").isNull(), "extra").otherwise("common"))
    return a.join(b, "table_name", "full_outer").select("table_name", status.alias("status"),
                                                        "n_first", "n_second")


def with_commas(col: Column) -> Column:
    return F.format_number(col, 0)


def diff_verdict(original: Mapping[str, DataFrame], candidate: Mapping[str, DataFrame]) -> DataFrame:
    """One row: do the databases match, and a summary joined by "; ".

    Copies count: a changed number of duplicates is a difference.
    """
    counts = diff_counts(original, candidate)
    head = F.concat(F.lit("table '"), F.col("table_name"), F.lit("': "))
    message = (
        F.when(F.col("n_original") != F.col("n_candidate"),
               F.concat(head, F.lit("row count differs (original="), with_commas(F.col("n_original")),
                        F.lit(", candidate="), with_commas(F.col("n_candidate")), F.lit(")")))
        .when((F.col("copies_original") > 0) | (F.col("copies_candidate") > 0),
              F.concat(head, F.col("copies_original"), F.lit(" row(s) only in original, "),
                       F.col("copies_candidate"), F.lit(" row(s) only in candidate"))))
    missing, extra = sorted(set(original) - set(candidate)), sorted(set(candidate) - set(original))
    parts = ([f"tables missing from second db: {missing}"] if missing else []) + (
        [f"extra tables in second db: {extra}"] if extra else [])
    summary = F.concat_ws("; ", F.transform(
        F.sort_array(F.collect_list(F.when(message.isNotNull(), F.struct("table_name", message.alias("m"))))),
        lambda s: s["m"]))
    if parts:
        return counts.agg(F.lit(False).alias("matches"), F.lit("; ".join(parts)).alias("summary"))
    return counts.agg((F.count_if(message.isNotNull()) == 0).alias("matches"), summary.alias("summary"))


def restore_check(original: Mapping[str, DataFrame], fixed: Mapping[str, DataFrame]) -> DataFrame:
    """What a fix lost, per original table: message, or NULL when all rows are back."""
    parts = []
    for name in sorted(original):
        if name in fixed:
            parts.append(_table_counts(name, original[name], fixed[name])
                         .select("table_name", "n_original", F.col("n_candidate").alias("n_fixed"),
                                 F.col("only_original").alias("missing_rows")))
        else:
            parts.append(original[name].agg(F.count(F.lit(1)).alias("n_original")).select(
                F.lit(name).alias("table_name"), "n_original",
                F.lit(None).cast("bigint").alias("n_fixed"), F.lit(None).cast("bigint").alias("missing_rows")))
    head = F.concat(F.lit("table '"), F.col("table_name"), F.lit("'"))
    message = (
        F.when(F.col("n_fixed").isNull(), F.concat(head, F.lit(" missing or unreadable in fixed DB")))
        .when(F.col("n_original") != F.col("n_fixed"),
              F.concat(head, F.lit(": row count changed from "), with_commas(F.col("n_original")),
                       F.lit(" to "), with_commas(F.col("n_fixed")), F.lit(" after fix")))
        .when(F.col("missing_rows") > 0,
              F.concat(head, F.lit(": "), F.col("missing_rows"), F.lit(" original row(s) missing after fix"))))
    return _union(parts).withColumn("message", message)


def render_diff(table: str, diff: DataFrame, columns: Sequence[str], order: Sequence[str],
                bucket: Column) -> DataFrame:
    """Text table of a set diff as ordered lines (table, side, line_no, line).

    Columns are padded to the widest value of their side; NULL prints as NULL.
    ``bucket`` splits the rows of a side for numbering (see ranking).
    """
    columns = list(columns)
    text = diff.select("side", *order, *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(f"t_{c}")
                                         for c in columns])
    widths = text.groupBy("side").agg(
        *[F.greatest(F.max(F.length(f"t_{c}")), F.lit(len(c))).alias(f"w_{c}") for c in columns])

    def line(cells: list[Column], left: str, mid: str, right: str) -> Column:
        return F.concat(F.lit(left), F.concat_ws(mid, *cells), F.lit(right))

    padded = [F.expr(f"rpad(`t_{c}`, `w_{c}`, ' ')") for c in columns]
    names = [F.expr(f"rpad('{c}', `w_{c}`, ' ')") for c in columns]
    rules = [F.expr(f"repeat('-', `w_{c}`)") for c in columns]
    rows = (bucketed_row_number(text, ["side"], [F.col(o) for o in order], bucket, "row_no")
            .join(widths, "side")
            .select("side", (F.col("row_no") + 2).alias("line_no"), line(padded, "| ", " | ", " |").alias("line")))
    title = F.concat(F.initcap("side"), F.lit(" Records:"))
    heads = widths.select("side", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"), title.alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"), line(names, "| ", " | ", " |").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), line(rules, "|-", "-|-", "-|").alias("line")),
    )).alias("h")).select("side", "h.line_no", "h.line")
    return rows.unionByName(heads).select(F.lit(table).alias("table_name"), "side", "line_no", "line")
