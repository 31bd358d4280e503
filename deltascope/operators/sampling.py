"""Seeded sampling, alteration decisions, routing, resume and attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01
from deltascope.functions.ranking import bucketed_row_number

# Default probabilities, target bound and retries.
DELETE_PROB = 0.34
INSERT_PROB = 0.33
MAX_TARGETS = 5
MAX_RETRIES = 3


def normalize_samples(full: DataFrame, short: DataFrame) -> DataFrame:
    """Two sample layouts to one; the short one calls its SQL ``query`` and has no evidence."""
    lifted = short.select("db_id", "question", F.lit("").alias("evidence"), F.col("query").alias("SQL"))
    return full.select("db_id", "question", "evidence", "SQL").unionByName(lifted)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Shuffle by seed and keep the first ``n`` rows (0 = all), with the draw.

    The top n are found per task and merged, so no full sort runs.
    """
    drawn = df.withColumn("draw", hash01(seed, F.col(key)))
    ordered = drawn.orderBy("draw", key)
    return ordered.limit(n) if n else ordered


def draw_type(u: Column, delete_prob: float = DELETE_PROB, insert_prob: float = INSERT_PROB) -> Column:
    """Alteration type of a uniform draw."""
    if delete_prob + insert_prob > 1:
        raise ValueError("delete and insert probabilities exceed 1")
    return F.when(u < delete_prob, "delete").when(u < delete_prob + insert_prob, "insert").otherwise("modify")


def fallback_type(u: Column, delete_prob: float = DELETE_PROB, insert_prob: float = INSERT_PROB) -> Column:
    """Redraw between delete and modify after an insert failed, weights renormalised."""
    modify = max(0.0, 1.0 - delete_prob - insert_prob)
    total = delete_prob + modify
    threshold = delete_prob / total if total > 0 else 0.5
    return F.when(u < threshold, "delete").otherwise("modify")


def target_count(u: Column, rows: Column | None = None, max_targets: int = MAX_TARGETS) -> Column:
    """1 .. max_targets, bounded by the number of result rows where given."""
    bound = F.lit(max_targets) if rows is None else F.least(F.lit(max_targets), rows)
    return (F.lit(1) + F.floor(u * bound)).cast("bigint")


def target_pick(results: DataFrame, key: str, seed: int, max_targets: int = MAX_TARGETS) -> DataFrame:
    """Per sample_id choose k distinct result rows at random.

    The ranking keeps at most ``max_targets`` rows per sample and task before
    the shuffle, so a sample with very many rows stays cheap.
    """
    counts = results.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_rows"))
    by_draw = Window.partitionBy("sample_id").orderBy(hash01(seed, F.col(key)), key)
    best = results.withColumn("_rank", F.row_number().over(by_draw)).filter(F.col("_rank") <= max_targets)
    k = target_count(hash01(seed + 1, F.col("sample_id")), F.col("n_rows"), max_targets)
    return (best.join(counts, "sample_id").withColumn("num_targets", k)
            .filter(F.col("_rank") <= F.col("num_targets")).drop("_rank"))


def with_row_index(results: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Position of each row in its sample's result, from 0, in key order."""
    ranked = bucketed_row_number(results, ["sample_id"], [F.col(key)], bucket, "row_index")
    return ranked.withColumn("row_index", F.col("row_index") - 1)


def aggregate_targets(samples: DataFrame, u: Column, max_targets: int = MAX_TARGETS) -> DataFrame:
    """Aggregate and insert samples draw a target count without row indices; others NULL."""
    free = F.col("is_aggregate") | (F.col("alteration_type") == "insert")
    return samples.withColumn("num_targets", F.when(free, target_count(u, None, max_targets)))


def route(samples: DataFrame) -> DataFrame:
    """Where each sample goes, from has_database, query_error, n_rows, is_aggregate."""
    bad = ~F.col("has_database") | F.col("query_error").isNotNull()
    status = (F.when(bad, "skipped_error")
              .when(F.col("n_rows") == 0, "skipped_empty")
              .when(F.col("is_aggregate") & (F.col("n_rows") == 1), "aggregate")
              .otherwise("records"))
    return samples.withColumn("status", status)


def not_processed(samples: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples whose keys are in no log yet."""
    return samples.join(done.select(*keys).distinct(), list(keys), "left_anti")


def assign_ids(records: DataFrame, key: str, last_id: Column, seed: int, bucket_rows: int = 100_000) -> DataFrame:
    """Ids that continue after ``last_id``, one per record, in seeded order.

    The order is a uniform draw, so its buckets have about ``bucket_rows`` rows
    whatever the keys are; only the bucket counts meet in one task.
    """
    buckets = records.count() // bucket_rows + 1
    drawn = records.withColumn("_draw", hash01(seed, F.col(key)))
    ranked = bucketed_row_number(drawn, [], [F.col("_draw"), F.col(key)],
                                 F.floor(F.col("_draw") * buckets), "_no")
    return ranked.withColumn("record_id", (F.col("_no") + last_id).cast("bigint")).drop("_no", "_draw")


def select_attempt(attempts: DataFrame, key: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """First valid attempt per sample, with the attempt count and the last error.

    ``attempts`` has attempt (from 1), is_valid, call_failed, error. Attempts
    after the first valid one or past ``max_retries`` were never made.
    """
    tried = attempts.filter(F.col("attempt") <= max_retries)
    per_sample = tried.groupBy(key).agg(
        F.expr("min(attempt) filter (where is_valid)").alias("_first"),
        F.max("attempt").alias("_last"),
        F.sort_array(F.collect_list(F.struct("attempt", "call_failed", "error"))).alias("_tries"))
    stop = F.coalesce("_first", "_last")
    made = F.filter("_tries", lambda t: t["attempt"] <= stop)
    errors = F.filter(made, lambda t: t["error"].isNotNull())
    last_try = F.try_element_at(made, F.lit(-1))
    status = (F.when(F.col("_first").isNotNull(), "success")
              .when(last_try["call_failed"], "failed_llm").otherwise("failed_validation"))
    return per_sample.select(key, status.alias("status"), F.col("_first").cast("bigint").alias("valid_attempt"),
                             stop.cast("bigint").alias("attempts_made"),
                             F.try_element_at(errors, F.lit(-1))["error"].alias("last_error"))
