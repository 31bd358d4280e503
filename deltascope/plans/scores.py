"""Queries that score runs and summarise them."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01
from deltascope.operators import sampling, score
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.registry import query
from deltascope.sources.tables import read_table

VARIANTS = ("Deletion", " delete ", "MODIFY", "update", "Modification", "insertion", "Insert", "other")
_TRUTH = (f"CASE WHEN {u(42, 'doc_id')} < {sampling.DELETE_PROB} THEN 'delete' "
          f"WHEN {u(42, 'doc_id')} < {sampling.DELETE_PROB + sampling.INSERT_PROB} THEN 'insert' ELSE 'modify' END")


def runs(spark, sf):
    """Scored runs, one per labelled document."""
    key = F.col("doc_id")

    def whole(seed, n):
        return F.floor(hash01(seed, key) * n).cast("bigint")

    raw = (F.when(hash01(11, key) < 0.1, "n/a").when(hash01(11, key) < 0.2, "0.25").when(hash01(11, key) < 0.3, "0.75")
           .otherwise(hash01(10, key).cast("decimal(6,4)").cast("string")))
    base = read_table(spark, sf, "labels").select(
        "doc_id", F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), whole(61, len(VARIANTS)).cast("int") + 1).alias("predicted_type"),
        sampling.draw_type(hash01(42, key)).alias("true_type"), raw.alias("raw_score"), (F.col("toxic") == 1).alias("is_fallback"),
        F.col("quality").cast("double").alias("gold_result_score"),
        F.when((F.col("quality") == 1) & (hash01(66, key) < 0.8), 1.0).otherwise(0.0).alias("full_restore_score"),
        whole(62, 7).alias("explanation_query_turns"), whole(63, 5).alias("fix_query_turns"),
        whole(64, 4).alias("questions_asked"), whole(65, 3).alias("retry_count"))
    scored = base.withColumns({
        "alteration_type_score": score.type_score(F.col("predicted_type"), F.col("true_type"), F.col("is_fallback")),
        "explanation_score": score.snap_score(F.col("raw_score"), F.col("is_fallback"))})
    return score.final_scores(scored)


_VARIANTS = "[" + ", ".join(f"'{v}'" for v in VARIANTS) + "]"
_NORMAL = ("CASE WHEN lower(trim(predicted_type)) IN ('deletion', 'delete') THEN 'delete' "
           "WHEN lower(trim(predicted_type)) IN ('modification', 'modify', 'update') THEN 'modify' "
           "WHEN lower(trim(predicted_type)) IN ('insertion', 'insert') THEN 'insert' ELSE lower(trim(predicted_type)) END")
# CTE runs, to follow WITH
RUNS = f"""r0 AS (SELECT doc_id, ({_VARIANTS})[CAST(floor({u(61, 'doc_id')} * 8) AS INT) + 1] AS predicted_type, {_TRUTH} AS true_type,
  CASE WHEN {u(11, 'doc_id')} < 0.1 THEN 'n/a' WHEN {u(11, 'doc_id')} < 0.2 THEN '0.25' WHEN {u(11, 'doc_id')} < 0.3 THEN '0.75'
    ELSE CAST(CAST({u(10, 'doc_id')} AS DECIMAL(6,4)) AS VARCHAR) END AS raw_score, toxic = 1 AS is_fallback, quality::DOUBLE AS gold_result_score,
  CASE WHEN quality = 1 AND {u(66, 'doc_id')} < 0.8 THEN 1.0 ELSE 0.0 END::DOUBLE AS full_restore_score,
  floor({u(62, 'doc_id')} * 7)::BIGINT AS explanation_query_turns, floor({u(63, 'doc_id')} * 5)::BIGINT AS fix_query_turns,
  floor({u(64, 'doc_id')} * 4)::BIGINT AS questions_asked, floor({u(65, 'doc_id')} * 3)::BIGINT AS retry_count FROM labels),
r1 AS (SELECT *, CASE WHEN NOT is_fallback AND {_NORMAL} = true_type THEN 1.0 ELSE 0.0 END::DOUBLE AS alteration_type_score,
  CASE WHEN is_fallback OR try_cast(raw_score AS DOUBLE) IS NULL THEN 0.0 WHEN try_cast(raw_score AS DOUBLE) <= 0.25 THEN 0.0
    WHEN try_cast(raw_score AS DOUBLE) <= 0.75 THEN 0.5 ELSE 1.0 END::DOUBLE AS explanation_score,
  round(0.01::DOUBLE * explanation_query_turns, 4) AS explanation_query_penalty, round(0.02::DOUBLE * fix_query_turns, 4) AS fix_query_penalty,
  round(0.05::DOUBLE * questions_asked, 4) AS ask_question_penalty FROM r0),
r2 AS (SELECT *, round(explanation_query_penalty + fix_query_penalty + ask_question_penalty, 4) AS tool_penalty,
  pow(0.5, retry_count) AS retry_multiplier FROM r1),
runs AS (SELECT *, round(greatest(0, gold_result_score - tool_penalty) * retry_multiplier, 4) AS final_score FROM r2)"""


@query("type_score", f"WITH {RUNS} SELECT doc_id, predicted_type, true_type, alteration_type_score FROM runs")
def type_score(spark, sf):
    return runs(spark, sf).select("doc_id", "predicted_type", "true_type", "alteration_type_score")


@query("judge_snap", f"WITH {RUNS} SELECT doc_id, raw_score, explanation_score FROM runs")
def judge_snap(spark, sf):
    return runs(spark, sf).select("doc_id", "raw_score", "explanation_score")


_FINAL = ["doc_id", "explanation_query_penalty", "fix_query_penalty", "ask_question_penalty", "tool_penalty",
          "retry_multiplier", "final_score"]


@query("final_score", f"WITH {RUNS} SELECT {', '.join(_FINAL)} FROM runs")
def final_score(spark, sf):
    return runs(spark, sf).select(*_FINAL)


@query("fix_retry_resolve", f"""
WITH a AS (SELECT c_custkey, attempt - 1 AS attempt, is_valid AS passed, call_failed AS is_fallback FROM ({fx.ATTEMPTS}) WHERE attempt <= 3),
s AS (SELECT *, min(attempt) FILTER (passed OR is_fallback) OVER (PARTITION BY c_custkey) AS stop FROM a),
h AS (SELECT * FROM s WHERE attempt <= coalesce(stop, 2))
SELECT c_custkey, max(attempt) AS retry_count, CASE WHEN max_by(is_fallback, attempt) THEN 'fallback' WHEN max_by(passed, attempt) THEN 'passed' ELSE 'exhausted' END AS outcome,
  string_agg('fix ' || attempt, ' | ' ORDER BY attempt) AS fix_attempts FROM h GROUP BY c_custkey""")
def fix_retry_resolve(spark, sf):
    attempts = fx.attempts(spark, sf).select(
        "c_custkey", (F.col("attempt") - 1).alias("attempt"), F.col("is_valid").alias("passed"),
        F.col("call_failed").alias("is_fallback"), F.concat(F.lit("fix "), F.col("attempt") - 1).alias("fix_text"))
    resolved = score.resolve_fix_attempts(attempts, "c_custkey", max_retries=2)
    return resolved.withColumn("fix_attempts", F.array_join("fix_attempts", " | "))


def agent_events(spark, sf):
    """Events as an agent log; a record is one user's day."""
    kind = F.col("event_type")
    return read_table(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("record_id"), "ts", "event_id",
        F.when(kind == "view", "explanation").otherwise("fix").alias("agent"),
        F.when(kind.isin("view", "click"), "run_query").when(kind == "purchase", "ask_question")
         .when(kind == "signup", "done").otherwise("failed").alias("action"),
        F.when(hash01(17, F.col("event_id")) < 0.1, "").otherwise(F.col("props")).alias("text"),
        (kind != "error").alias("success"))


EVENTS = f"""ev AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS record_id, ts, event_id, CASE WHEN event_type = 'view' THEN 'explanation' ELSE 'fix' END AS agent,
  CASE WHEN event_type IN ('view', 'click') THEN 'run_query' WHEN event_type = 'purchase' THEN 'ask_question' WHEN event_type = 'signup' THEN 'done' ELSE 'failed' END AS action,
  CASE WHEN {u(17, 'event_id')} < 0.1 THEN '' ELSE props END AS text, event_type <> 'error' AS success FROM events)"""


def _hour():
    return F.date_trunc("hour", "ts")


@query("fallback_detect", f"""WITH {EVENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, event_id) AS turn FROM ev),
b AS (SELECT * FROM t WHERE turn <= 4), s AS (SELECT record_id, min(turn) FILTER (action IN ('done', 'failed')) AS stop, max(turn) AS turns FROM b GROUP BY record_id)
SELECT s.record_id, coalesce(stop, turns) AS turns_used, NOT coalesce(b.action = 'done' AND trim(b.text) <> '', false) AS is_fallback
FROM s LEFT JOIN b ON s.record_id = b.record_id AND b.turn = s.stop""")
def fallback_detect(spark, sf):
    numbered = score.number_events(agent_events(spark, sf), "record_id", ["ts", "event_id"], _hour())
    return score.detect_fallback(numbered, "record_id", score.FIX_TURNS)


@query("tool_usage", f"""WITH {EVENTS} SELECT record_id, count_if(action = 'run_query' AND agent = 'explanation')::BIGINT AS explanation_queries,
  count_if(action = 'run_query' AND agent = 'fix')::BIGINT AS fix_queries, count_if(action = 'ask_question')::BIGINT AS questions_asked FROM ev GROUP BY record_id""")
def tool_usage(spark, sf):
    return score.tool_usage(agent_events(spark, sf), "record_id")


@query("event_timeline", f"""WITH {EVENTS} SELECT record_id, event_id, row_number() OVER w AS seq, action, success,
  date_diff('microsecond', lag(ts) OVER w, ts) AS gap_us FROM ev WINDOW w AS (PARTITION BY record_id ORDER BY ts, event_id)""")
def event_timeline(spark, sf):
    return score.timeline(agent_events(spark, sf), "record_id", ["ts", "event_id"], _hour(), "ts").select(
        "record_id", "event_id", "seq", "action", "success", "gap_us")


@query("conversation_pairs", """
SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def conversation_pairs(spark, sf):
    return score.question_answers(read_table(spark, sf, "conversations"), "conv_id", "turn", F.floor(F.col("turn") / 64))


@query("pair_precision_recall", f"""{fx.WITH_ORDERS},
act AS (SELECT DISTINCT o_orderpriority AS grp, least('c' || o_custkey, o_orderstatus) AS lo, greatest('c' || o_custkey, o_orderstatus) AS hi FROM base
  UNION SELECT 'none predicted', least(c_name, c_mktsegment), greatest(c_name, c_mktsegment) FROM customer),
pred AS (SELECT DISTINCT o_orderpriority AS grp, least('c' || o_custkey, o_orderstatus) AS lo, greatest('c' || o_custkey, o_orderstatus) AS hi FROM alt),
b AS (SELECT coalesce(a.grp, p.grp) AS grp, count_if(a.grp IS NOT NULL AND p.grp IS NOT NULL) AS tp, count(a.grp) AS na, count(p.grp) AS np
  FROM act a FULL JOIN pred p ON a.grp = p.grp AND a.lo = p.lo AND a.hi = p.hi GROUP BY 1)
SELECT grp, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision, CASE WHEN na = 0 THEN 0 ELSE tp / na END AS recall FROM b""")
def pair_precision_recall(spark, sf):
    def ends(df):
        left, right = F.concat(F.lit("c"), F.col("o_custkey")), F.col("o_orderstatus")
        swap = hash01(18, F.col("o_orderkey")) < 0.5
        return df.select(F.col("o_orderpriority").alias("grp"), F.when(swap, right).otherwise(left).alias("a"),
                         F.when(swap, left).otherwise(right).alias("b"))

    unmatched = read_table(spark, sf, "customer").select(
        F.lit("none predicted").alias("grp"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    return score.pair_precision_recall(ends(fx.orders_altered(spark, sf)),
                                       ends(fx.orders_base(spark, sf)).unionByName(unmatched), "grp")


def candidates(spark, sf):
    """Three tiers of five candidates per customer."""
    tried = read_table(spark, sf, "customer").select("c_custkey", F.explode(F.expr("sequence(0L, 2L)")).alias("tier")).select(
        "c_custkey", "tier", F.explode(F.expr("sequence(0L, 4L)")).alias("candidate_idx"))
    draw = hash01(9, F.concat_ws("-", *[F.col(c).cast("string") for c in ("c_custkey", "tier", "candidate_idx")]))
    return tried.withColumn("wrong", draw < 0.1).withColumn(
        "label", F.when(draw < 0.02, "invalid_syntax").otherwise("valid_but_incorrect"))


CANDIDATES = f"""cand AS (SELECT *, {u(9, "c_custkey || '-' || tier || '-' || candidate_idx")} AS d FROM (
  SELECT c_custkey, tier, unnest(range(0, 5)) AS candidate_idx FROM (SELECT c_custkey, unnest(range(0, 3)) AS tier FROM customer))),
hard AS (SELECT c_custkey, ['strong', 'middle', 'weak'][tier + 1] AS source, candidate_idx, CASE WHEN d < 0.02 THEN 'invalid_syntax' ELSE 'valid_but_incorrect' END AS label
  FROM cand WHERE d < 0.1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY tier, candidate_idx) = 1)"""


@query("hard_sample_pick", f"WITH {CANDIDATES} SELECT * FROM hard")
def hard_sample_pick(spark, sf):
    return score.pick_hard(candidates(spark, sf), "c_custkey")


@query("easy_hard_counts", f"""WITH {CANDIDATES}, s AS (SELECT c.c_custkey, {u(19, 'c.c_custkey')} < 0.03 AS failed, h.c_custkey IS NOT NULL AS hard
  FROM customer c LEFT JOIN hard h ON c.c_custkey = h.c_custkey)
SELECT count_if(NOT failed AND hard)::BIGINT AS n_hard, count_if(NOT failed AND NOT hard)::BIGINT AS n_easy, count_if(failed)::BIGINT AS n_failed FROM s""")
def easy_hard_counts(spark, sf):
    samples = read_table(spark, sf, "customer").select("c_custkey", (hash01(19, F.col("c_custkey")) < 0.03).alias("failed"))
    return score.hard_easy_counts(samples, score.pick_hard(candidates(spark, sf), "c_custkey"), "c_custkey")


_AVG = ", ".join(f"round(sum({n}::DECIMAL(20,4))::DOUBLE / count(*), {d}) AS avg_{n}" for n, d in score.AVERAGES.items())


@query("run_stats", f"WITH {RUNS} SELECT count(*) AS total_records, {_AVG}, count_if(retry_count > 0)::BIGINT AS fix_retried_count FROM runs")
def run_stats(spark, sf):
    return score.run_stats(runs(spark, sf))


@query("score_distributions", f"WITH {RUNS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS score_name, 'score_{b}' AS bin, count_if({n} = {b})::BIGINT AS n FROM runs"
    for n, labels in score.SCORE_BINS.items() for b in labels))
def score_distributions(spark, sf):
    return score.score_distributions(runs(spark, sf))


def run_log(spark, sf):
    """Status per customer: skipped by draw, not yet processed, or the attempt outcome."""
    key = F.col("c_custkey")
    outcome = sampling.select_attempt(fx.attempts(spark, sf), "c_custkey")
    status = (F.when(hash01(71, key) < 0.1, F.lit(None)).when(hash01(72, key) < 0.05, "skipped_error")
              .when(hash01(73, key) < 0.1, "skipped_empty").otherwise(F.col("status")))
    return outcome.select("c_custkey", status.alias("status"), (hash01(74, key) < 0.2).alias("is_aggregate"))


@query("pipeline_stats", f"""
WITH a AS (SELECT * FROM ({fx.ATTEMPTS}) WHERE attempt <= 3),
o AS (SELECT c_custkey, CASE WHEN bool_or(is_valid) THEN 'success' WHEN max_by(call_failed, attempt) THEN 'failed_llm' ELSE 'failed_validation' END AS outcome FROM a GROUP BY c_custkey),
s AS (SELECT CASE WHEN {u(71, 'c_custkey')} < 0.1 THEN NULL WHEN {u(72, 'c_custkey')} < 0.05 THEN 'skipped_error' WHEN {u(73, 'c_custkey')} < 0.1 THEN 'skipped_empty' ELSE outcome END AS status,
  {u(74, 'c_custkey')} < 0.2 AS is_aggregate FROM o),
c AS (SELECT count(*) AS total_samples, count(status) AS processed, count_if(status = 'success')::BIGINT AS success, count_if(status = 'skipped_empty')::BIGINT AS skipped_empty_result,
  count_if(status = 'skipped_error')::BIGINT AS skipped_query_error, count_if(status IS NOT NULL AND is_aggregate)::BIGINT AS processed_aggregate,
  count_if(status = 'failed_validation')::BIGINT AS failed_validation_after_retries, count_if(status = 'failed_llm')::BIGINT AS failed_llm_error FROM s)
SELECT *, printf('%.1f%%', success / greatest(processed, 1) * 100) AS success_rate FROM c""")
def pipeline_stats(spark, sf):
    return score.status_stats(run_log(spark, sf))
