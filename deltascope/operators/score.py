"""Scoring of runs, selection of hard samples, event logs and run statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.functions.ranking import bucketed_neighbour, bucketed_row_number
from deltascope.operators.bags import bag_counts

# Penalties, budgets, type names and score bins.
EXPLANATION_QUERY_PENALTY = 0.01
FIX_QUERY_PENALTY = 0.02
QUESTION_PENALTY = 0.05
RETRY_FACTOR = 0.5
EXPLANATION_TURNS, FIX_TURNS, MAX_FIX_RETRIES = 6, 4, 1
TYPE_NAMES = {
    "delete": ("deletion", "delete"),
    "modify": ("modification", "modify", "update"),
    "insert": ("insertion", "insert"),
}
TIERS = ("strong", "middle", "weak")
SCORE_BINS = {
    "alteration_type_score": ("0", "1"),
    "explanation_score": ("0.0", "0.5", "1.0"),
    "gold_result_score": ("0", "1"),
    "full_restore_score": ("0", "1"),
}


def normal_type(name: Column) -> Column:
    """Canonical alteration type; unknown names stay as they are."""
    low = F.lower(F.trim(name))
    known = None
    for canonical, synonyms in TYPE_NAMES.items():
        known = (F if known is None else known).when(low.isin(*synonyms), canonical)
    return known.otherwise(low)


def type_score(predicted: Column, truth: Column, fallback: Column) -> Column:
    hit = ~fallback & (normal_type(predicted) == normal_type(truth))
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def snap_score(raw: Column, fallback: Column) -> Column:
    """Nearest of 0, 0.5 and 1, ties down; 0 for text that is no number and for fallbacks."""
    x = raw.try_cast("double")
    snapped = F.when(x <= 0.25, 0.0).when(x <= 0.75, 0.5).otherwise(1.0)
    return F.when(fallback | x.isNull() | F.isnan(x), 0.0).otherwise(snapped)


def final_scores(runs: DataFrame) -> DataFrame:
    """Penalties, retry multiplier and final score per run."""
    explain = F.round(F.col("explanation_query_turns") * F.lit(EXPLANATION_QUERY_PENALTY), 4)
    fix = F.round(F.col("fix_query_turns") * F.lit(FIX_QUERY_PENALTY), 4)
    ask = F.round(F.col("questions_asked") * F.lit(QUESTION_PENALTY), 4)
    priced = runs.withColumns({
        "explanation_query_penalty": explain, "fix_query_penalty": fix, "ask_question_penalty": ask,
        "tool_penalty": F.round(explain + fix + ask, 4),
        "retry_multiplier": F.pow(F.lit(RETRY_FACTOR), F.col("retry_count")),
    })
    final = F.round(F.greatest(F.lit(0.0), F.col("gold_result_score") - F.col("tool_penalty"))
                    * F.col("retry_multiplier"), 4)
    return priced.withColumn("final_score", final)


def resolve_fix_attempts(attempts: DataFrame, key: str, max_retries: int = MAX_FIX_RETRIES) -> DataFrame:
    """Final attempt per record: the first fallback or pass, else the last allowed one.

    ``attempts`` has attempt (from 0), passed, is_fallback, fix_text. At most
    ``max_retries`` + 1 attempts per record are gathered.
    """
    made = attempts.filter(F.col("attempt") <= max_retries)
    per_record = made.groupBy(key).agg(
        F.expr("min(attempt) filter (where passed or is_fallback)").alias("_stop"),
        F.max("attempt").alias("_last"),
        F.sort_array(F.collect_list(F.struct("attempt", "passed", "is_fallback", "fix_text"))).alias("_tries"))
    final = F.coalesce("_stop", "_last")
    history = F.filter("_tries", lambda t: t["attempt"] <= final)
    last = F.try_element_at(history, F.lit(-1))
    outcome = F.when(last["is_fallback"], "fallback").when(last["passed"], "passed").otherwise("exhausted")
    return per_record.select(key, final.cast("bigint").alias("retry_count"), outcome.alias("outcome"),
                             F.transform(history, lambda t: t["fix_text"]).alias("fix_attempts"))


def number_events(events: DataFrame, key: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """Turn number of each event in its record, also for records with very many events."""
    return bucketed_row_number(events, [key], [F.col(o) for o in order], bucket, "turn")


def detect_fallback(events: DataFrame, key: str, budget: int) -> DataFrame:
    """Runs that never reach a non-empty ``done`` within the turn budget.

    ``events`` has turn, action, text. A failed call or an unknown action ends a run.
    """
    known = F.col("action").isin("run_query", "ask_question")
    stop = F.struct("turn", ((F.col("action") == "done") & (F.trim("text") != "")).alias("good"))
    per_record = events.filter(F.col("turn") <= budget).groupBy(key).agg(
        F.min(F.when(~known, stop)).alias("_stop"), F.max("turn").alias("_turns"))
    return per_record.select(key, F.coalesce("_stop.turn", "_turns").cast("bigint").alias("turns_used"),
                             (~F.coalesce("_stop.good", F.lit(False))).alias("is_fallback"))


def tool_usage(events: DataFrame, key: str) -> DataFrame:
    """Queries per agent and questions per record."""
    ran = F.col("action") == "run_query"
    return events.groupBy(key).agg(
        F.count_if(ran & (F.col("agent") == "explanation")).alias("explanation_queries"),
        F.count_if(ran & (F.col("agent") == "fix")).alias("fix_queries"),
        F.count_if(F.col("action") == "ask_question").alias("questions_asked"))


def timeline(events: DataFrame, key: str, order: Sequence[str], bucket: Column, time: str) -> DataFrame:
    """Events in order with their number and the time since the one before.

    One row per event: a record's list is never gathered in one place.
    """
    numbered = bucketed_row_number(events, [key], [F.col(o) for o in order], bucket, "seq")
    linked = bucketed_neighbour(numbered, [key], order, bucket, [time], "before", backward=True)
    gap = F.timestamp_diff("MICROSECOND", F.col(f"before.{time}"), F.col(time))
    return linked.withColumn("gap_us", gap).drop("before")


def question_answers(turns: DataFrame, key: str, order: str, bucket: Column) -> DataFrame:
    """User turns with the assistant turn that follows directly."""
    linked = bucketed_neighbour(turns, [key], [order], bucket, ["role", "text"], "after")
    return (linked.filter((F.col("role") == "user") & (F.col("after.role") == "assistant"))
            .select(key, order, F.col("text").alias("question"), F.col("after.text").alias("answer")))


def pair_precision_recall(predicted: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Precision and recall of pairs per group; the order within a pair does not matter."""
    def ends(df: DataFrame) -> DataFrame:
        return df.select(group, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))

    counts = bag_counts({"p": ends(predicted), "a": ends(actual)}, [group, "lo", "hi"])
    both = F.count_if((F.col("n_p") > 0) & (F.col("n_a") > 0))
    totals = counts.groupBy(group).agg(both.alias("tp"), F.count_if(F.col("n_p") > 0).alias("np"),
                                       F.count_if(F.col("n_a") > 0).alias("na"))

    def share(n: str) -> Column:
        return F.coalesce(F.try_divide(F.col("tp"), F.col(n)), F.lit(0.0))

    return totals.select(group, share("np").alias("precision"), share("na").alias("recall"))


def pick_hard(candidates: DataFrame, key: str) -> DataFrame:
    """Per sample the first wrong candidate: best tier first, then lowest index."""
    wrong = candidates.filter("wrong")
    return (wrong.groupBy(key).agg(F.min(F.struct("tier", "candidate_idx", "label")).alias("m"))
            .select(key, F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("m.tier").cast("int")).alias("source"),
                    F.col("m.candidate_idx").alias("candidate_idx"), F.col("m.label").alias("label")))


def hard_easy_counts(samples: DataFrame, hard: DataFrame, key: str) -> DataFrame:
    """Hard and easy totals; samples that failed count as neither. ``samples`` has ``failed``."""
    marked = samples.join(hard.select(key, F.lit(True).alias("hard")), key, "left")
    is_hard = F.coalesce("hard", F.lit(False))
    return marked.agg(F.count_if(~F.col("failed") & is_hard).alias("n_hard"),
                      F.count_if(~F.col("failed") & ~is_hard).alias("n_easy"),
                      F.count_if("failed").alias("n_failed"))


AVERAGES: Mapping[str, int] = {
    "alteration_type_score": 4, "explanation_score": 4, "gold_result_score": 4, "full_restore_score": 4,
    "final_score": 4, "questions_asked": 2, "explanation_query_turns": 2, "fix_query_turns": 2, "tool_penalty": 4,
}


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals and rounded averages of a run; scores are summed as decimals, so order does not matter."""
    def average(name: str, digits: int) -> Column:
        total = F.sum(F.col(name).cast("decimal(20,4)")).cast("double")
        return F.round(F.try_divide(total, F.count(F.lit(1))), digits).alias(f"avg_{name}")

    retried = F.when(F.count(F.lit(1)) > 0, F.count_if(F.col("retry_count") > 0))
    return runs.agg(F.count(F.lit(1)).alias("total_records"), *[average(n, d) for n, d in AVERAGES.items()],
                    retried.alias("fix_retried_count"))


def score_distributions(runs: DataFrame) -> DataFrame:
    """Counts per score and bin; bins without runs are 0."""
    names = list(SCORE_BINS)
    counted = (runs.select(*[F.col(n).cast("double").alias(n) for n in names])
               .unpivot([], names, "score_name", "score")
               .groupBy("score_name", "score").agg(F.count(F.lit(1)).alias("n")))
    bins = runs.sparkSession.createDataFrame(
        [(n, b, float(b)) for n, labels in SCORE_BINS.items() for b in labels], "score_name string, bin string, score double")
    return bins.join(counted, ["score_name", "score"], "left").select(
        "score_name", F.concat(F.lit("score_"), F.col("bin")).alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))


def status_stats(log: DataFrame) -> DataFrame:
    """Counters by status and the success rate; ``log`` has status (NULL if not processed) and is_aggregate."""
    def count(status: str, name: str) -> Column:
        return F.count_if(F.col("status") == status).alias(name)

    counted = log.agg(
        F.count(F.lit(1)).alias("total_samples"), F.count("status").alias("processed"),
        count("success", "success"), count("skipped_empty", "skipped_empty_result"),
        count("skipped_error", "skipped_query_error"),
        F.count_if(F.col("status").isNotNull() & F.col("is_aggregate")).alias("processed_aggregate"),
        count("failed_validation", "failed_validation_after_retries"), count("failed_llm", "failed_llm_error"))
    rate = F.col("success") / F.greatest("processed", F.lit(1)) * 100
    return counted.withColumn("success_rate", F.format_string("%.1f%%", rate))
