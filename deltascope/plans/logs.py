"""Queries that write and read logs, descriptions, databases and signature stores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.functions.hashing import hash01
from deltascope.operators import similar
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.profiles import value_dictionary_of
from deltascope.plans.registry import query
from deltascope.plans.scores import RUNS, runs
from deltascope.plans.similarity import BANDS, LOOKUP, ROWS, keywords
from deltascope.session import work_dir
from deltascope.sources import descriptions, logs, signatures
from deltascope.sources.tables import read_database, read_table

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                      T.StructField("status", T.StringType()), T.StructField("value", T.DoubleType())])
STATUS = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' ELSE 'failed_' || event_type END"


def status_events(spark, sf):
    """Events as log records: purchases and sign-ups are successes."""
    return read_table(spark, sf, "events").select("event_id", "user_id", F.expr(STATUS).alias("status"), "value")


@query("read_json_array", f"SELECT event_id, user_id, {STATUS} AS status, value FROM events")
def read_json_array(spark, sf):
    """Events written as arrays of at most 1000 records, one record per line."""
    path = work_dir(spark, "array")
    events = status_events(spark, sf)
    arrays = events.groupBy(F.floor(F.col("event_id") / 1000)).agg(
        F.array_join(F.collect_list(F.to_json(F.struct(*events.columns))), ",\n").alias("body"))
    arrays.select(F.concat(F.lit("[\n"), F.col("body"), F.lit("\n]"))).write.text(path)
    return logs.read_json_array(spark, path, EVENT, record_per_line=True)


def json_lines(spark, sf):
    """Events as JSON lines with blank and cut-off lines; the folder they lie in."""
    path = work_dir(spark, "lines")
    draw = hash01(81, F.col("event_id"))
    lines = status_events(spark, sf).select("event_id", F.to_json(F.struct(*EVENT.names)).alias("line"))
    lines.select(F.when(draw < 0.03, "").when(draw < 0.06, F.expr("left(line, length(line) - 5)"))
                 .otherwise(F.col("line")).alias("value")).write.text(path)
    return path


@query("read_jsonl_tolerant", f"""
SELECT 'record' AS kind, event_id, user_id, {STATUS} AS status, value FROM events WHERE {u(81, 'event_id')} >= 0.06
UNION ALL SELECT 'corrupt', NULL, NULL, NULL, NULL FROM events WHERE {u(81, 'event_id')} >= 0.03 AND {u(81, 'event_id')} < 0.06""")
def read_jsonl_tolerant(spark, sf):
    good, bad = logs.read_json_lines(spark, json_lines(spark, sf), EVENT)
    return good.select(F.lit("record").alias("kind"), "*").unionByName(
        bad.select(F.lit("corrupt").alias("kind")), allowMissingColumns=True)


@query("write_routed", f"""
SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' ELSE 'failure' END AS bucket, event_id, user_id, {STATUS} AS status, value FROM events""")
def write_routed(spark, sf):
    path = work_dir(spark, "routed")
    logs.write_routed(status_events(spark, sf), path)
    return logs.read_routed(spark, path, EVENT)


@query("consolidate", f"SELECT event_id, user_id, {STATUS} AS status, value FROM events WHERE event_type IN ('purchase', 'signup')")
def consolidate(spark, sf):
    path = work_dir(spark, "log")
    logs.write_routed(status_events(spark, sf), path)
    success = logs.read_routed(spark, path, EVENT).filter(F.col("bucket") == "success").drop("bucket")
    return logs.consolidate(success, work_dir(spark, "export"), "event_id")


_RECORD = ["doc_id", "true_type"]
_EVALUATION = ["alteration_type_score", "explanation_score", "gold_result_score", "full_restore_score", "final_score"]
_PENALTIES = ["explanation_query_penalty", "fix_query_penalty", "ask_question_penalty"]


@query("results_flatten", f"WITH {RUNS} SELECT {', '.join(_RECORD + _EVALUATION + _PENALTIES)} FROM runs")
def results_flatten(spark, sf):
    nested = logs.nest_results(runs(spark, sf), _RECORD, _EVALUATION, _PENALTIES)
    return logs.flatten_results(nested, _PENALTIES)


@query("read_description_csv", f"""
SELECT lang AS table_name, 'doc_' || doc_id AS original_column_name, text AS column_description,
  CASE lang WHEN 'fr' THEN 'cp1252' WHEN 'en' THEN 'UTF-8' ELSE 'UTF-16' END AS encoding FROM documents""")
def read_description_csv(spark, sf):
    """Documents as description files: one folder and encoding per language."""
    path = work_dir(spark, "csv")
    docs = read_table(spark, sf, "documents").select(
        "lang", F.concat(F.lit("doc_"), F.col("doc_id")).alias("original_column_name"), F.lit("c").alias("column_name"),
        F.col("text").alias("column_description"), F.lit("text").alias("data_format"), F.lit("v").alias("value_description"))
    charsets = {"fr": "ISO-8859-1", "en": "UTF-8"}
    for (lang,) in read_table(spark, sf, "documents").select("lang").distinct().collect():
        (docs.filter(F.col("lang") == lang).drop("lang").write.option("header", True).option("quoteAll", True)
         .option("escape", '"').option("encoding", charsets.get(lang, "UTF-16")).csv(f"{path}/{lang}.csv"))
    return descriptions.read_descriptions(spark, f"{path}/*.csv").select(
        "table_name", "original_column_name", "column_description", "encoding")


@query("read_database", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {c.count(',') + 1} AS n_columns, count(*) AS n_rows FROM {t}" for t, c in fx.SCHEMA.items()))
def read_whole_database(spark, sf):
    from deltascope.operators.diff import table_row_counts
    tables = read_database(spark, sf)
    widths = F.create_map(*[x for t, df in tables.items() for x in (F.lit(t), F.lit(len(df.columns)))])
    return table_row_counts(tables).select("table_name", widths[F.col("table_name")].alias("n_columns"), "n_rows")


@query("signature_store", f"WITH {LOOKUP} SELECT * REPLACE (CAST(similarity AS DOUBLE) AS similarity) FROM top")
def signature_store(spark, sf):
    path = work_dir(spark, "signatures")
    signatures.save_store(value_dictionary_of(spark, sf), path, BANDS, ROWS)
    store = signatures.load_store(spark, path)
    return similar.lsh_lookup(similar.expand_keywords(keywords(spark, sf)), store.dictionary, store.signatures,
                              store.index, BANDS, ROWS)
