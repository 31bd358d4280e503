"""Queries over the catalog: selections, connections, descriptions, schema text."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01
from deltascope.operators import catalog as cat
from deltascope.operators import profile, querylog
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.profiles import EXAMPLES, declared_catalog, examples_of, fk_edges
from deltascope.plans.registry import query
from deltascope.session import cut_lineage
from deltascope.sources.tables import read_table

# CTEs cat, qlog, tok, used(query_id, table_name), usedcol(query_id, table_name, column_name)
WITH_USAGE = f"""WITH cat AS ({fx.CATALOG}), {fx.QUERY_LOG},
tok AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '([\\p{{L}}\\p{{N}}_]+)', 1)) AS token FROM qlog),
used AS (SELECT DISTINCT query_id, table_name FROM tok JOIN (SELECT DISTINCT table_name FROM cat) ON token = lower(table_name)),
usedcol AS (SELECT DISTINCT query_id, table_name, column_name FROM tok JOIN cat ON token = lower(column_name)
  JOIN used USING (query_id, table_name))"""


def _selection(spark, sf):
    """Selections in upper case, with one unknown column per table."""
    log = fx.query_log(spark, sf).select("query_id", "user_id", "query")
    used = querylog.column_usage(log, declared_catalog(spark, sf))
    rows = used.select("query_id", F.upper("table_name").alias("table_name"),
                       F.explode(F.array(F.upper("column_name"), F.lit("NO_SUCH"))).alias("column_name")).distinct()
    return rows


@query("schema_subselect", f"{WITH_USAGE} SELECT * FROM usedcol")
def schema_subselect(spark, sf):
    return cat.subselect(_selection(spark, sf), declared_catalog(spark, sf))


@query("schema_union", f"""{WITH_USAGE}
SELECT DISTINCT user_id, table_name, column_name FROM usedcol JOIN (SELECT query_id, user_id FROM qlog) USING (query_id)""")
def schema_union(spark, sf):
    log = fx.query_log(spark, sf).select("query_id", F.col("user_id").alias("user_id"), "query")
    # the union is over the queries of a user, so the user is the group of the log
    used = querylog.column_usage(log, declared_catalog(spark, sf), ["user_id"])
    return cat.union_selections(used, declared_catalog(spark, sf), ["user_id"])


@query("schema_enrich", f"""{WITH_USAGE}
SELECT query_id, upper(table_name) AS table_name, upper(column_name) AS column_name, type, is_key FROM usedcol JOIN cat USING (table_name, column_name)
UNION ALL SELECT DISTINCT query_id, upper(table_name), 'NO_SUCH', '', false FROM usedcol""")
def schema_enrich(spark, sf):
    return cat.enrich(_selection(spark, sf), declared_catalog(spark, sf), ["type", "is_key"],
                      {"type": "", "is_key": False})


@query("connections", f"""{WITH_USAGE}, fk AS ({fx.FK_EDGES})
SELECT query_id, table_name, column_name FROM used JOIN cat USING (table_name) WHERE is_key
UNION SELECT a.query_id, a.table_name, fk.column_name FROM used a JOIN fk ON a.table_name = fk.table_name JOIN used b ON a.query_id = b.query_id AND b.table_name = fk.ref_table
UNION SELECT a.query_id, a.table_name, fk.ref_column FROM used a JOIN fk ON a.table_name = fk.ref_table JOIN used b ON a.query_id = b.query_id AND b.table_name = fk.table_name
UNION SELECT a.query_id, a.table_name, c.column_name FROM used a JOIN cat c ON a.table_name = c.table_name
  JOIN cat k ON k.is_key AND lower(k.column_name) = lower(c.column_name) AND k.table_name <> c.table_name
  JOIN used b ON a.query_id = b.query_id AND b.table_name = k.table_name""")
def connections(spark, sf):
    used = querylog.table_usage(fx.query_log(spark, sf).select("query_id", "query"), declared_catalog(spark, sf))
    used = cut_lineage(used.select("query_id", "table_name"))  # five joins read it
    return cat.connections(used, declared_catalog(spark, sf), fk_edges(spark))


def raw_descriptions(spark, sf):
    """Untidy description rows made from documents: odd case, spaces, newlines, marks, NULLs."""
    key = F.col("doc_id")
    docs = read_table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit(" "), F.upper("source"), F.lit(" ")).alias("table_name"),
        F.concat(F.lit(" Doc_"), key, F.lit(" ")).alias("original_column_name"),
        F.when(hash01(51, key) >= 0.1, F.concat(F.lit(" "), F.col("lang"), F.lit("\n"))).alias("column_name"),
        F.when(hash01(52, key) >= 0.1, F.concat(F.lit("commonsense evidence:\n"), F.col("text"))).alias("column_description"),
        F.when(hash01(53, key) >= 0.5, " text ").alias("data_format"),
        F.when(hash01(54, key) >= 0.6, F.concat(F.lit("Not useful\n "), F.col("source")))
         .when(hash01(54, key) >= 0.1, F.concat(F.lit("commonsense evidence: "), F.col("lang"), F.lit("\nwords"))).alias("value_description"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("description_clean", f"""
WITH r AS (SELECT lower(source) AS table_name, 'doc_' || doc_id AS column_key, ' Doc_' || doc_id || ' ' AS original_column_name,
  CASE WHEN {u(51, 'doc_id')} >= 0.1 THEN lang ELSE '' END AS column_name,
  {_TRIM.format(f"CASE WHEN {u(52, 'doc_id')} >= 0.1 THEN replace(replace('commonsense evidence:' || chr(10) || text, chr(10), ' '), 'commonsense evidence:', '') ELSE '' END")} AS column_description,
  CASE WHEN {u(53, 'doc_id')} >= 0.5 THEN 'text' ELSE '' END AS data_format,
  CASE WHEN {u(54, 'doc_id')} >= 0.6 THEN source WHEN {u(54, 'doc_id')} >= 0.1 THEN lang || ' words' ELSE '' END AS value_description
  FROM documents) SELECT * FROM r""")
def description_clean(spark, sf):
    return cat.clean_descriptions(raw_descriptions(spark, sf))


def column_descriptions(stats):
    """Descriptions of all columns: a spelled-out name, and a note on columns with few values."""
    return stats.select(
        "table_name", "column_name", F.replace("column_name", F.lit("_"), F.lit(" ")).alias("expanded_name"),
        F.when(profile.is_categorical(), "one of a fixed list").alias("column_description"),
        F.when(F.col("null_count") == 0, "never NULL").alias("value_description"),
        profile.statistics_text().alias("value_statics"))


_DESCRIBED = """d AS (SELECT table_name, column_name, replace(column_name, '_', ' ') AS expanded_name,
  CASE WHEN distinct_count + CASE WHEN null_count > 0 THEN 1 ELSE 0 END < 20 THEN 'one of a fixed list' END AS column_description,
  CASE WHEN null_count = 0 THEN 'never NULL' END AS value_description,
  'Total count ' || non_null || ' - Distinct count ' || distinct_count || ' - Null count ' || null_count AS value_statics FROM s_)"""
_REFS = """ref AS (SELECT table_name, column_name, string_agg(l, '' ORDER BY l) AS refers FROM (
  SELECT table_name, column_name, '    Table: `' || ref_table || '`, Column: `' || ref_column || '`' || chr(10) AS l FROM fk) GROUP BY ALL),
bak AS (SELECT table_name, column_name, string_agg(l, '' ORDER BY l) AS referred FROM (
  SELECT ref_table AS table_name, ref_column AS column_name, '    Table: `' || table_name || '`, Column: `' || column_name || '`' || chr(10) AS l FROM fk) GROUP BY ALL)"""
_TICKED = "'`' || array_to_string(examples, '`, `') || '`'"


@query("column_profile_text", f"""
WITH cat AS ({fx.CATALOG}), fk AS ({fx.FK_EDGES}), {EXAMPLES}, {_DESCRIBED}, {_REFS}
SELECT table_name, column_name, 'Table name: `' || table_name || '`' || chr(10) || 'Original column name: `' || column_name || '`' || chr(10)
  || CASE WHEN lower(trim(expanded_name)) <> lower(column_name) THEN 'Expanded column name: `' || expanded_name || '`' || chr(10) ELSE '' END
  || 'Data type: ' || type || chr(10)
  || coalesce('Description: ' || column_description || chr(10), '') || coalesce('Value description: ' || value_description || chr(10), '')
  || coalesce('Example of values in the column: ' || {_TICKED} || chr(10), '')
  || CASE WHEN is_key THEN 'This column is a primary key.' || chr(10) ELSE '' END
  || coalesce('This column references the following columns:' || chr(10) || refers, '')
  || coalesce('This column is referenced by the following columns:' || chr(10) || referred, '') AS profile
FROM cat LEFT JOIN ex USING (table_name, column_name) LEFT JOIN d USING (table_name, column_name)
LEFT JOIN ref USING (table_name, column_name) LEFT JOIN bak USING (table_name, column_name)""")
def column_profile_text(spark, sf):
    examples, stats = examples_of(spark, sf)
    return cat.column_profiles(declared_catalog(spark, sf), examples, column_descriptions(stats), fk_edges(spark),
                               with_keys=True, with_references=True)


@query("schema_text", f"""
WITH cat AS ({fx.CATALOG}), fk AS ({fx.FK_EDGES}), {EXAMPLES}, {_DESCRIBED},
con AS (SELECT table_name, column_name FROM cat WHERE is_key UNION SELECT table_name, column_name FROM fk UNION SELECT ref_table, ref_column FROM fk
  UNION SELECT c.table_name, c.column_name FROM cat c JOIN cat k ON k.is_key AND k.column_name = c.column_name AND k.table_name <> c.table_name),
sel AS (SELECT cat.*, examples, d.* EXCLUDE (table_name, column_name) FROM cat JOIN d USING (table_name, column_name) LEFT JOIN ex USING (table_name, column_name)
  WHERE {u(47, "(table_name || '.' || column_name)")} < 0.5 OR (table_name, column_name) IN (SELECT (table_name, column_name) FROM con)),
w AS (SELECT *, CASE WHEN lower(expanded_name) <> lower(column_name) THEN '| Column Name Meaning: ' || expanded_name ELSE '' END
  || ' ' || coalesce('| Column Description: ' || column_description, '') || ' ' || coalesce('| Value Description: ' || value_description, '') AS descr FROM sel),
l AS (SELECT table_name, ordinal AS pos, chr(9) || column_name || ' ' || type || ',' || CASE WHEN examples IS NOT NULL
    THEN ' -- Example Values: ' || {_TICKED} || ' | Value Statics: ' || value_statics || ' ' || descr ELSE ' --' || descr END AS line FROM w
  UNION ALL SELECT table_name, 1000000, chr(9) || 'PRIMARY KEY (' || string_agg(column_name, ', ' ORDER BY ordinal) || '),' FROM sel WHERE is_key GROUP BY table_name
  UNION ALL SELECT table_name, 1000001, chr(9) || 'FOREIGN KEY (' || column_name || ') REFERENCES ' || ref_table || ' (' || ref_column || '),' FROM fk
    WHERE table_name IN (SELECT table_name FROM sel) AND ref_table IN (SELECT table_name FROM sel))
SELECT table_name, 'CREATE TABLE ' || table_name || chr(10) || '(' || chr(10) || string_agg(line, chr(10) ORDER BY pos, line) || chr(10) || ');' AS schema_text
FROM l GROUP BY table_name""")
def schema_text(spark, sf):
    catalog = declared_catalog(spark, sf)
    every = catalog.select(F.lit(1).alias("query_id"), "table_name").distinct()
    linked = cat.connections(every, catalog, fk_edges(spark)).select("table_name", "column_name", F.lit(True).alias("linked"))
    on = ["table_name", "column_name"]
    picked = catalog.join(linked, on, "left").filter(
        F.col("linked") | (hash01(47, F.concat_ws(".", "table_name", "column_name")) < 0.5)).drop("linked")
    examples, stats = examples_of(spark, sf)
    columns = picked.join(column_descriptions(stats), on).join(examples, on, "left")
    return cat.schema_text(cut_lineage(columns), fk_edges(spark))
