"""Queries that turn samples into a seeded work plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions import text
from deltascope.functions.hashing import hash01
from deltascope.operators import sampling
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.registry import query
from deltascope.sources.tables import read_table

D, I = sampling.DELETE_PROB, sampling.INSERT_PROB


@query("dataset_normalize", f"""
SELECT db_id, question, evidence, 'SELECT text FROM documents WHERE doc_id = ' || doc_id AS "SQL" FROM ({fx.SAMPLES})
UNION ALL SELECT 'pages', url, '', 'SELECT html FROM pages WHERE page_id = ' || page_id FROM pages""")
def dataset_normalize(spark, sf):
    full = fx.samples(spark, sf).withColumn(
        "SQL", F.concat(F.lit("SELECT text FROM documents WHERE doc_id = "), F.col("doc_id")))
    short = read_table(spark, sf, "pages").select(
        F.lit("pages").alias("db_id"), F.col("url").alias("question"),
        F.concat(F.lit("SELECT html FROM pages WHERE page_id = "), F.col("page_id")).alias("query"))
    return sampling.normalize_samples(full, short)


@query("seeded_sample", f"""
SELECT doc_id, db_id, question, round({u(42, 'doc_id')}, 6) AS draw FROM ({fx.SAMPLES})
ORDER BY {u(42, 'doc_id')}, doc_id LIMIT 10""")
def seeded_sample(spark, sf):
    picked = sampling.seeded_sample(fx.samples(spark, sf), "doc_id", 42, 10)
    return picked.select("doc_id", "db_id", "question", F.round("draw", 6).alias("draw"))


_TYPE = f"CASE WHEN {{0}} < {D} THEN 'delete' WHEN {{0}} < {D + I} THEN 'insert' ELSE 'modify' END"


@query("alteration_type_draw", f"""
SELECT doc_id, {_TYPE.format(u(42, 'doc_id'))} AS alteration_type, round({u(42, 'doc_id')}, 6) AS random_draw FROM documents""")
def alteration_type_draw(spark, sf):
    draw = hash01(42, F.col("doc_id"))
    return fx.samples(spark, sf).select("doc_id", sampling.draw_type(draw).alias("alteration_type"),
                                        F.round(draw, 6).alias("random_draw"))


@query("alteration_type_fallback", f"""
SELECT doc_id, CASE WHEN {u(43, 'doc_id')} < {D / (D + 1 - D - I)!r} THEN 'delete' ELSE 'modify' END AS alteration_type
FROM documents WHERE {_TYPE.format(u(42, 'doc_id'))} = 'insert' AND {u(44, 'doc_id')} < 0.3""")
def alteration_type_fallback(spark, sf):
    key = F.col("doc_id")
    failed = fx.samples(spark, sf).filter(
        (sampling.draw_type(hash01(42, key)) == "insert") & (hash01(44, key) < 0.3))
    return failed.select("doc_id", sampling.fallback_type(hash01(43, key)).alias("alteration_type"))


@query("target_pick", f"""
WITH r AS (SELECT o_custkey AS sample_id, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {u(21, 'o_orderkey')}, o_orderkey) AS rank_,
  count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM orders)
SELECT sample_id, o_orderkey, row_index, n_rows, num_targets FROM (
  SELECT *, 1 + CAST(floor({u(22, 'sample_id')} * least(5, n_rows)) AS BIGINT) AS num_targets FROM r) WHERE rank_ <= num_targets""")
def target_pick(spark, sf):
    results = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderkey")
    indexed = sampling.with_row_index(results, "o_orderkey", F.floor(F.col("o_orderkey") / fx.ORDER_BUCKET))
    return sampling.target_pick(indexed, "o_orderkey", 21)


@query("aggregate_target", f"""{"WITH " + fx.QUERY_LOG}, s AS (SELECT query_id, {_TYPE.format(u(42, 'query_id'))} AS alteration_type,
  upper(query) SIMILAR TO '.*(COUNT|SUM|AVG|MIN|MAX)\\(.*' AND NOT contains(upper(query), 'GROUP BY') AS is_aggregate FROM qlog)
SELECT *, CASE WHEN is_aggregate OR alteration_type = 'insert' THEN 1 + CAST(floor({u(45, 'query_id')} * 5) AS BIGINT) END AS num_targets FROM s""")
def aggregate_target(spark, sf):
    samples = fx.query_log(spark, sf).select(
        "query_id", sampling.draw_type(hash01(42, F.col("query_id"))).alias("alteration_type"),
        text.is_aggregate(F.col("query")).alias("is_aggregate"))
    return sampling.aggregate_targets(samples, hash01(45, F.col("query_id")))


@query("skip_routing", f"""{"WITH " + fx.QUERY_LOG}, agg AS (SELECT user_id, count(*) AS n,
  bool_or(upper(query) SIMILAR TO '.*(COUNT|SUM|AVG|MIN|MAX)\\(.*' AND NOT contains(upper(query), 'GROUP BY')) AS is_aggregate FROM qlog GROUP BY user_id),
s AS (SELECT c_custkey, n_nationkey IS NOT NULL AS has_database, CASE WHEN {u(15, 'c_custkey')} < 0.05 THEN 'no such column' END AS query_error,
  CASE WHEN coalesce(is_aggregate, false) THEN 1 ELSE coalesce(n, 0) END AS n_rows, coalesce(is_aggregate, false) AS is_aggregate
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey LEFT JOIN agg ON c_custkey = user_id)
SELECT c_custkey, n_rows, is_aggregate, CASE WHEN NOT has_database OR query_error IS NOT NULL THEN 'skipped_error'
  WHEN n_rows = 0 THEN 'skipped_empty' WHEN is_aggregate AND n_rows = 1 THEN 'aggregate' ELSE 'records' END AS status FROM s""")
def skip_routing(spark, sf):
    known = read_table(spark, sf, "nation").filter(F.col("n_regionkey") != 4).select(
        F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("known"))
    results = fx.query_log(spark, sf).groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(text.is_aggregate(F.col("query"))).alias("agg"))
    joined = (read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
              .join(known, "c_nationkey", "left").join(results, "c_custkey", "left"))
    is_aggregate = F.coalesce("agg", F.lit(False))
    samples = joined.select(
        "c_custkey", F.col("known").isNotNull().alias("has_database"),
        F.when(hash01(15, F.col("c_custkey")) < 0.05, "no such column").alias("query_error"),
        F.when(is_aggregate, 1).otherwise(F.coalesce("n", F.lit(0))).alias("n_rows"),
        is_aggregate.alias("is_aggregate"))
    return sampling.route(samples).drop("has_database", "query_error")


@query("resume_antijoin", f"""
SELECT s.* FROM ({fx.SAMPLES}) s WHERE (db_id, question) NOT IN (
  SELECT (db_id, question) FROM ({fx.SAMPLES}) WHERE {u(6, 'doc_id')} < 0.3)""")
def resume_antijoin(spark, sf):
    samples = fx.samples(spark, sf)
    done = samples.filter(hash01(6, F.col("doc_id")) < 0.3)
    return sampling.not_processed(samples, done, ["db_id", "question"]).select("doc_id", "db_id", "question", "evidence")


@query("record_id_assign", f"""
SELECT conv_id, turn, (SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY {u(46, "conv_id || '-' || turn")}, conv_id || '-' || turn) AS record_id
FROM conversations""")
def record_id_assign(spark, sf):
    records = read_table(spark, sf, "conversations").select("conv_id", "turn").withColumn(
        "key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    last = read_table(spark, sf, "labels").agg(F.max("doc_id")).scalar()
    return sampling.assign_ids(records, "key", last, 46).drop("key")


@query("attempt_select", f"""
WITH a AS (SELECT * FROM ({fx.ATTEMPTS}) WHERE attempt <= 3),
f AS (SELECT *, min(attempt) FILTER (is_valid) OVER (PARTITION BY c_custkey) AS first_valid FROM a),
made AS (SELECT * FROM f WHERE attempt <= coalesce(first_valid, 3))
SELECT c_custkey, CASE WHEN min(first_valid) IS NOT NULL THEN 'success' WHEN max_by(call_failed, attempt) THEN 'failed_llm' ELSE 'failed_validation' END AS status,
  min(first_valid) AS valid_attempt, max(attempt) AS attempts_made, max_by(error, attempt) FILTER (error IS NOT NULL) AS last_error
FROM made GROUP BY c_custkey""")
def attempt_select(spark, sf):
    return sampling.select_attempt(fx.attempts(spark, sf), "c_custkey")
