"""Validate what an alteration did to query results, for many samples at once.

Results are held long: (sample_id, row columns). One aggregation counts each row
on every side; all rules below are filters or per-sample sums over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.functions.hashing import row_key, value_json
from deltascope.functions.ranking import bucketed_row_number
from deltascope.operators.bags import bag_counts
from deltascope.session import cut_lineage

# Messages of the validation rules.
SAME_RESULT = "Altered result is identical to gold result — INSERT had no effect"
NOT_DISPLACED = ("LIMIT query: no original rows were displaced by the insertion. "
                 "The inserted rows must rank high enough to push existing rows out of the result.")
EMPTY_RESULT = "Empty result set (gold or altered)"
INCORRECT, CORRECT = "incorrect answer", "--"
STILL_PRESENT = " targeted record(s) still present in altered result: ["
SAME_AGGREGATE = "Aggregate result did not change after alteration. Gold: "
ALTERED = " | Altered: "
COUNTS = ("Row count mismatch: original has ", " row(s), restored has ", " row(s).")
ROWS_DIFFER = " row(s) differ between original and restored:\n"
MORE = ("\n… and ", " more mismatched row(s)")


def compare_results(gold: DataFrame, altered: DataFrame, targets: DataFrame | None,
                    columns: Sequence[str]) -> DataFrame:
    """Rows per sample with their number of copies in gold, altered and targets."""
    sides = {"gold": gold, "altered": altered}
    if targets is not None:
        sides["target"] = targets
    return bag_counts(sides, ["sample_id", *columns])


def targeted(compared: DataFrame) -> DataFrame:
    """Hard rule for delete and modify: each target must be gone from the altered result."""
    status = F.when(F.col("n_altered") > 0, "still_present").otherwise("missing_targeted")
    return compared.filter(F.col("n_target") > 0).select(
        *_rows(compared), status.alias("status"), F.col("n_target").cast("bigint").alias("copies"))


def unintended(compared: DataFrame) -> DataFrame:
    """Gold rows that were no targets but vanished too."""
    gone = (F.col("n_gold") > 0) & (F.col("n_target") == 0) & (F.col("n_altered") == 0)
    return compared.filter(gone).select(*_rows(compared), F.col("n_gold").cast("bigint").alias("copies"))


def new_rows(compared: DataFrame) -> DataFrame:
    """Rows of the altered result that gold does not have."""
    return compared.filter((F.col("n_altered") > 0) & (F.col("n_gold") == 0)).select(
        *_rows(compared), F.col("n_altered").cast("bigint").alias("copies"))


def result_diff(compared: DataFrame) -> DataFrame:
    """Rows expected but not returned, and rows returned but not expected."""
    kind = F.when(F.col("n_altered") == 0, "missing").when(F.col("n_gold") == 0, "extra")
    return (compared.select(*_rows(compared), kind.alias("kind"),
                            F.greatest("n_gold", "n_altered").cast("bigint").alias("copies"))
            .filter(F.col("kind").isNotNull()))


def _rows(compared: DataFrame) -> list[str]:
    return [c for c in compared.columns if not c.startswith("n_")]


def set_equal(compared: DataFrame) -> DataFrame:
    """Per sample: are the two results equal as sets."""
    one_sided = (F.col("n_gold") == 0) | (F.col("n_altered") == 0)
    return compared.groupBy("sample_id").agg((F.count_if(one_sided) == 0).alias("equal"))


def _sum_if(condition: Column, n: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0)).cast("bigint")


def report(compared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One validation result per sample of a delete or modify.

    Side effects are counted here and listed in full by :func:`unintended` and
    :func:`new_rows`. The targets missing and the targets still present are
    listed too; their number is bounded by the maximum of targets per sample.
    """
    g, a, t = F.col("n_gold"), F.col("n_altered"), F.col("n_target")
    still = (t > 0) & (a > 0)
    per_sample = compared.withColumn("_row", row_key(compared, columns)).groupBy("sample_id").agg(
        _sum_if((t > 0) & (a == 0), "n_target").alias("n_missing_targeted"),
        _sum_if(still, "n_target").alias("n_still_present"),
        _sum_if((g > 0) & (t == 0) & (a == 0), "n_gold").alias("n_unintended_missing"),
        _sum_if((a > 0) & (g == 0), "n_altered").alias("n_new_records"),
        F.array_join(F.sort_array(F.collect_list(F.when((t > 0) & (a == 0), F.col("_row")))), ", ").alias("missing_targeted"),
        F.array_join(F.sort_array(F.collect_list(F.when(still, F.col("_row")))), ", ").alias("still_present"))
    message = F.concat(F.col("n_still_present"),
                       F.lit(STILL_PRESENT),
                       F.col("still_present"), F.lit("]"))
    valid = F.col("n_still_present") == 0
    return per_sample.select("sample_id", valid.alias("is_valid"),
                             F.when(~valid, message).alias("error_message"),
                             "missing_targeted", "still_present", "n_missing_targeted", "n_still_present",
                             "n_unintended_missing", "n_new_records")


def report_insert(compared: DataFrame, has_limit: Column) -> DataFrame:
    """Insert rule per sample: the result set changes; under LIMIT a row is displaced."""
    g, a = F.col("n_gold"), F.col("n_altered")
    per_sample = compared.withColumn("has_limit", has_limit).groupBy("sample_id", "has_limit").agg(
        _sum_if(g == 0, "n_altered").alias("n_new"),
        _sum_if(a == 0, "n_gold").alias("n_displaced"))
    changed = (F.col("n_new") > 0) | (F.col("n_displaced") > 0)
    stuck = F.col("has_limit") & (F.col("n_displaced") == 0)
    message = F.concat_ws(" | ", F.when(~changed, SAME_RESULT), F.when(stuck, NOT_DISPLACED))
    return per_sample.select("sample_id", "has_limit", "n_new", "n_displaced",
                             (message == "").alias("is_valid"),
                             F.when(message != "", message).alias("error_message"))


def report_aggregate(samples: DataFrame, gold: DataFrame, altered: DataFrame,
                     columns: Sequence[str]) -> DataFrame:
    """Scalar-aggregate rule per sample: the single row must change.

    ``gold`` and ``altered`` have at most one row per sample.
    """
    a = gold.select("sample_id", row_key(gold, columns).alias("_gold"))
    b = altered.select("sample_id", row_key(altered, columns).alias("_altered"))
    joined = samples.join(a, "sample_id", "left").join(b, "sample_id", "left")
    empty = F.col("_gold").isNull() | F.col("_altered").isNull()
    same = F.concat(F.lit(SAME_AGGREGATE), F.col("_gold"),
                    F.lit(ALTERED), F.col("_altered"))
    message = F.when(empty, F.lit(EMPTY_RESULT)).when(F.col("_gold") == F.col("_altered"), same)
    return joined.select("sample_id", message.isNull().alias("is_valid"), message.alias("error_message"))


def positional_diff(original: DataFrame, restored: DataFrame, order: Sequence[str],
                    columns: Sequence[str], bucket: Column) -> DataFrame:
    """Row-by-row comparison in the order of the query: all mismatching rows.

    ``order`` must be a total order; ``bucket`` splits it for numbering.
    """
    def numbered(df: DataFrame, prefix: str) -> DataFrame:
        ranked = bucketed_row_number(df, [], [F.col(o) for o in order], bucket)
        return ranked.select((F.col("row_no") - 1).alias("row_no"),
                             *[F.col(c).alias(f"{prefix}{c}") for c in columns])

    types = {f.name: f.dataType for f in original.schema.fields}
    joined = numbered(original, "a_").join(numbered(restored, "b_"), "row_no", "full_outer")

    def note(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        text = F.concat(F.lit(f"column '{c}': original="), value_json(a, types[c]),
                        F.lit(", restored="), value_json(b, types[c]))
        return F.when(~a.eqNullSafe(b), text)

    detail = F.concat_ws("; ", *[note(c) for c in sorted(columns)])
    return joined.select("row_no", detail.alias("detail")).filter(F.col("detail") != "")


def positional_summary(original: DataFrame, restored: DataFrame, order: Sequence[str], columns: Sequence[str],
                       bucket: Column, shown: int = 10) -> DataFrame:
    """One row: counts, verdict and a text with the first mismatches and "N more".

    The rows are counted first; positions are compared only if the numbers agree.
    """
    n_a, n_b = original.count(), restored.count()
    mismatches = positional_diff(original, restored, order, columns, bucket)
    if n_a != n_b:
        mismatches = mismatches.limit(0)
    mismatches = cut_lineage(mismatches)
    total = mismatches.agg(F.count(F.lit(1))).scalar()
    first = mismatches.orderBy("row_no").limit(shown)
    lines = first.agg(
        F.lit(n_a).cast("bigint").alias("n_original"), F.lit(n_b).cast("bigint").alias("n_restored"), total.alias("n_mismatched"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "detail"))),
                                 lambda s: F.concat(F.lit("Row "), s["row_no"], F.lit(": "), s["detail"])),
                     "\n").alias("_lines"))
    count_text = F.concat(F.lit(COUNTS[0]), F.col("n_original"), F.lit(COUNTS[1]), F.col("n_restored"), F.lit(COUNTS[2]))
    more = F.when(F.col("n_mismatched") > shown,
                  F.concat(F.lit(MORE[0]), F.col("n_mismatched") - shown, F.lit(MORE[1]))
                  ).otherwise("")
    row_text = F.concat(F.col("n_mismatched"), F.lit(ROWS_DIFFER),
                        F.col("_lines"), more)
    differs = F.col("n_original") != F.col("n_restored")
    message = F.when(differs, count_text).when(F.col("n_mismatched") > 0, row_text)
    return lines.select("n_original", "n_restored", message.isNull().alias("matches"), message.alias("message"))


def execution_match(predicted: DataFrame | None, gold: DataFrame, error: str | None = None) -> DataFrame:
    """Execution accuracy of one query: equal non-empty sets, columns by position.

    ``error`` is the reason a prediction could not run ("timeout" or the engine's text).
    """
    if error is not None:
        return gold.sparkSession.range(1).select(F.lit(0).alias("exec_res"), F.lit(error).alias("exec_err"))
    if len(predicted.columns) != len(gold.columns):
        match = F.lit(0)
        return gold.sparkSession.range(1).select(match.alias("exec_res"), F.lit(INCORRECT).alias("exec_err"))
    counts = bag_counts({"p": predicted.toDF(*gold.columns), "g": gold}, gold.columns)
    both = (F.count(F.lit(1)) > 0) & (F.count_if((F.col("n_p") == 0) | (F.col("n_g") == 0)) == 0)
    return counts.agg(F.when(both, 1).otherwise(0).alias("exec_res"),
                      F.when(both, CORRECT).otherwise(INCORRECT).alias("exec_err"))


def execution_match_batch(pairs: DataFrame, predicted: DataFrame, gold: DataFrame,
                          columns: Sequence[str]) -> DataFrame:
    """Execution accuracy of many pairs in one job.

    ``pairs`` has pair_id and ``error`` (NULL when the prediction ran); results
    are long tables (pair_id, columns).
    """
    counts = bag_counts({"p": predicted, "g": gold}, ["pair_id", *columns])
    per_pair = counts.groupBy("pair_id").agg(
        F.count_if((F.col("n_p") == 0) | (F.col("n_g") == 0)).alias("one_sided"))
    joined = pairs.join(per_pair, "pair_id", "left")
    hit = F.col("error").isNull() & F.coalesce(F.col("one_sided") == 0, F.lit(False))
    text = F.when(F.col("error").isNotNull(), F.col("error")).when(hit, CORRECT).otherwise(INCORRECT)
    ran = F.col("error").isNull() | (F.col("error") == "timeout")
    label = F.when(~hit, F.when(ran, "valid_but_incorrect").otherwise("invalid_syntax"))
    return joined.select("pair_id", F.when(hit, 1).otherwise(0).alias("exec_res"),
                         text.alias("exec_err"), label.alias("label"))
