"""Queries over a log of query texts and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions import text
from deltascope.functions.hashing import hash01
from deltascope.operators import querylog
from deltascope.plans import fixtures as fx
from deltascope.plans.catalogs import WITH_USAGE
from deltascope.plans.fixtures import u
from deltascope.plans.profiles import VALUE_DICTIONARY, declared_catalog, value_dictionary_of
from deltascope.plans.registry import query
from deltascope.session import cut_lineage
from deltascope.sources.tables import read_table

LOG = "WITH " + fx.QUERY_LOG


@query("query_shape_flags", f"""{LOG}
SELECT query_id, upper(query) SIMILAR TO '(.|\\n)*(COUNT|SUM|AVG|MIN|MAX)\\((.|\\n)*' AND NOT contains(upper(query), 'GROUP BY') AS is_aggregate,
  contains(upper(regexp_replace(query, '--[^\\n]*', '', 'g')), 'LIMIT') AS has_limit,
  regexp_matches(upper(regexp_replace(query, '--[^\\n]*', '', 'g')), '\\bLIMIT\\b') AS has_limit_word FROM qlog""")
def query_shape_flags(spark, sf):
    q = F.col("query")
    return fx.query_log(spark, sf).select("query_id", text.is_aggregate(q).alias("is_aggregate"),
                                          text.has_limit(q).alias("has_limit"),
                                          text.has_limit(q, whole_word=True).alias("has_limit_word"))


@query("extract_sql_block", f"""{LOG}, b AS (SELECT query_id, coalesce(regexp_extract_all(response, '(?s)```sql\\s*(.*?)\\s*```', 1)[-1], response) AS s FROM qlog)
SELECT query_id, regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS sql FROM b""")
def extract_sql_block(spark, sf):
    return fx.query_log(spark, sf).select("query_id", text.extract_sql_block(F.col("response")).alias("sql"))


_CLEAN = """regexp_replace(replace(replace(query, chr(10), ' '), '"', ''''), '\\\\+([''"])', '\\1', 'g')"""


@query("clean_query", f"{LOG} SELECT query_id, {_CLEAN} AS cleaned FROM qlog")
def clean_query(spark, sf):
    return fx.query_log(spark, sf).select("query_id", text.clean_query(F.col("query")).alias("cleaned"))


@query("query_cluster", f"{LOG} SELECT {_CLEAN} AS cleaned, min(query_id) AS first_query_id, count(*) AS n_queries FROM qlog GROUP BY 1")
def query_cluster(spark, sf):
    return querylog.cluster(fx.query_log(spark, sf))


# A word that is no alias gets a mark in front, which the pattern of an alias does not take.
_REF = "'\\b(?:from|join)\\s+([\\p{L}\\p{N}_]+)(?:\\s+as)?\\s+([\\p{L}\\p{N}_]+)'"


def _marked(low: str) -> str:
    stop = "|".join(w for w in text.NOT_ALIAS if w != "as")
    return f"regexp_replace({low}, '\\b({stop})\\b', '~\\1', 'g')"


def _words(column: str) -> str:
    low = f"lower({column})"
    alias = (f"list_concat(regexp_extract_all({low}, '\\bas\\s+([\\p{{L}}\\p{{N}}_]+)', 1), "
             f"regexp_extract_all({_marked(low)}, {_REF}, 2))")
    return (f"list_filter(regexp_extract_all({low}, '([\\p{{L}}\\p{{N}}_]+)', 1), "
            f"lambda w: w <> 'as' AND NOT list_contains({alias}, w))")


@query("token_ngrams", f"""{LOG}, t AS (SELECT query_id, {_words('query')} AS words FROM qlog)
SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(words), 1)),
  lambda i: words[i] || ' ' || words[i + 1]))), '|') AS bigrams, len(list_distinct(words))::BIGINT AS n_words FROM t""")
def token_ngrams(spark, sf):
    q = F.col("query")
    return fx.query_log(spark, sf).select(
        "query_id", F.array_join(F.sort_array(text.ngrams(q, 2)), "|").alias("bigrams"),
        F.size(text.ngrams(q, 1)).cast("bigint").alias("n_words"))


@query("ngram_jaccard", f"""{LOG}, t AS (SELECT query_id, list_distinct({_words('query')}) AS g, list_distinct({_words('predicted')}) AS p FROM qlog)
SELECT query_id, CASE WHEN len(g) + len(p) = 0 THEN 0 ELSE round(len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))), 6) END AS similarity FROM t""")
def ngram_jaccard(spark, sf):
    return fx.query_log(spark, sf).select("query_id", F.round(
        text.jaccard(text.ngrams(F.col("predicted")), text.ngrams(F.col("query"))), 6).alias("similarity"))


def _schema_names() -> list[str]:
    return sorted({n for t, c, *_ in fx.schema_columns() for n in (t, c)})


_NAMES = "[" + ", ".join(f"'{n}'" for n in _schema_names()) + "]"
_TOKENS = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1)"


@query("schema_linking_recall", f"""{LOG}, t AS (SELECT query_id, list_intersect(list_distinct({_TOKENS.format('query')}), {_NAMES}) AS g,
  list_intersect(list_distinct({_TOKENS.format('predicted')}), {_NAMES}) AS p FROM qlog)
SELECT query_id, CASE WHEN len(g) = 0 THEN 0 ELSE round(len(list_intersect(g, p)) / len(g), 6) END AS recall FROM t""")
def schema_linking_recall(spark, sf):
    names = F.array(*[F.lit(n) for n in _schema_names()])  # as many as the schema has tables and columns

    def identifiers(column):
        return F.array_intersect(text.tokens(F.col(column)), names)

    return fx.query_log(spark, sf).select("query_id", F.round(
        text.share_found(identifiers("query"), identifiers("predicted")), 6).alias("recall"))


def raw_responses(spark, sf):
    """Event properties as raw replies: plain, fenced, in an array, incomplete or unreadable."""
    key = F.col("event_id")
    draw = hash01(33, key)
    body = F.concat(F.lit('"k": '), F.regexp_extract("props", r"(\d+)", 1), F.lit("}"))
    full = F.concat(F.lit('{"action": "'), F.col("event_type"), F.lit('", '), body)
    raw = (F.when(draw < 0.5, full)
           .when(draw < 0.7, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
           .when(draw < 0.8, F.concat(F.lit("["), full, F.lit("]")))
           .when(draw < 0.9, F.concat(F.lit("{"), body))
           .otherwise(F.concat(F.lit("I think: "), F.col("event_type"))))
    return read_table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query("response_parse", f"""
SELECT event_id, CASE WHEN {u(33, 'event_id')} < 0.8 THEN event_type END AS action,
  CASE WHEN {u(33, 'event_id')} < 0.9 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN {u(33, 'event_id')} < 0.8 THEN 'ok' WHEN {u(33, 'event_id')} < 0.9 THEN 'missing_field' ELSE 'unreadable' END AS status FROM events""")
def response_parse(spark, sf):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("action", T.StringType()), T.StructField("k", T.LongType())])
    parsed = raw_responses(spark, sf).select("event_id", text.parse_response(F.col("raw"), schema).alias("r"))
    status = (F.when(F.col("action").isNotNull(), "ok")
              .when(F.col("k").isNotNull(), "missing_field").otherwise("unreadable"))
    return parsed.select("event_id", "r.action", "r.k").withColumn("status", status)


@query("query_table_usage", f"""{WITH_USAGE}
SELECT used.query_id, used.table_name, coalesce(string_agg(column_name, ',' ORDER BY column_name), '') AS columns
FROM used LEFT JOIN usedcol USING (query_id, table_name) GROUP BY ALL""")
def query_table_usage(spark, sf):
    used = querylog.table_usage(fx.query_log(spark, sf).select("query_id", "query"), declared_catalog(spark, sf))
    return used.withColumn("columns", F.array_join("columns", ","))


_CHAIN = ("'(?i)\\bon\\b\\s*\\(*\\s*(\\w+\\.\\w+\\s*=\\s*\\w+\\.\\w+(?:\\s+and\\s+[\\w.]+\\s*(?:<=|>=|<>|=|<|>)\\s*(?:''[^'']*''|[\\w.]+))*)'")
_EQ = "'(\\w+)\\.(\\w+)\\s*=\\s*(\\w+)\\.(\\w+)'"


@query("join_pairs", f"""{LOG},
refs AS (SELECT query_id, unnest(regexp_extract_all({_marked('lower(query)')}, {_REF}, 1)) AS t, unnest(regexp_extract_all({_marked('lower(query)')}, {_REF}, 2)) AS a FROM qlog),
chains AS (SELECT query_id, unnest(regexp_extract_all(lower(query), {_CHAIN}, 1)) AS c FROM qlog),
eq AS (SELECT query_id, {", ".join(f"unnest(regexp_extract_all(c, {_EQ}, {i})) AS {n}" for i, n in enumerate(("lt", "lc", "rt", "rc"), 1))} FROM chains)
SELECT coalesce(l.t, lt) || '.' || lc AS left_column, coalesce(r.t, rt) || '.' || rc AS right_column, count(*) AS n_joins
FROM eq LEFT JOIN refs l ON eq.query_id = l.query_id AND l.a = lt LEFT JOIN refs r ON eq.query_id = r.query_id AND r.a = rt GROUP BY 1, 2""")
def join_pairs(spark, sf):
    return querylog.join_mining(fx.query_log(spark, sf))


_COND = "'(?i)(\\w+\\()?(?:\\w+\\.)?(\\w+)\\)?\\s*(<=|>=|<>|!=|=|<|>|\\blike\\b)\\s*(?:''((?:[^'']|'''')*)''|(-?(?:\\d+(?:\\.\\d+)?|\\.\\d+)(?:e[+-]?\\d+)?\\b))'"


@query("condition_literals", f"""{WITH_USAGE}, {VALUE_DICTIONARY},
c AS (SELECT query_id, {", ".join(f"unnest(regexp_extract_all(query, {_COND}, {i})) AS g{i}" for i in range(1, 6))} FROM qlog),
f AS (SELECT query_id, coalesce(g1, '') <> '' AS in_call, lower(g2) AS col, lower(g3) = 'like' AS is_like,
  CASE WHEN g5 <> '' THEN g5 WHEN lower(g3) = 'like' THEN replace(replace(g4, '%', ''), '''''', '''') ELSE replace(g4, '''''', '''') END AS literal FROM c),
p AS (SELECT table_name, column_name, literal, in_call, is_like, count(DISTINCT f.query_id) AS n FROM f
  JOIN usedcol ON f.query_id = usedcol.query_id AND col = lower(column_name) GROUP BY ALL),
m AS (SELECT p.*, (SELECT min(value) FROM dict d WHERE d.table_name = p.table_name AND d.column_name = p.column_name
  AND contains(lower(value), lower(literal))) AS match FROM p)
SELECT table_name, column_name, CASE WHEN in_call AND NOT is_like THEN match ELSE literal END AS example, sum(n)::BIGINT AS n_queries
FROM m WHERE NOT (in_call OR is_like) OR match IS NOT NULL GROUP BY ALL""")
def condition_literals(spark, sf):
    return querylog.condition_literals(fx.query_log(spark, sf).select("query_id", "query"),
                                       declared_catalog(spark, sf), cut_lineage(value_dictionary_of(spark, sf)))


_WRITES = ", ".join(f"'{w}'" for w in text.WRITE_KEYWORDS)


@query("readonly_guard", f"""{LOG}, p AS (SELECT list_filter(string_split(query, ';'), lambda s: trim(s) <> '') AS parts FROM qlog),
f AS (SELECT upper(regexp_extract(trim(parts[1]), '^(\\S+)', 1)) AS first_word, len(parts) > 1 AS multi FROM p)
SELECT first_word, first_word IN ({_WRITES}) AS blocked, multi, count(*) AS n_queries FROM f GROUP BY ALL""")
def readonly_guard(spark, sf):
    return querylog.guard_audit(fx.query_log(spark, sf))


@query("rows_context", """
WITH r AS (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS rn,
  count(*) OVER (PARTITION BY c_nationkey) AS n, '{"c_name": "' || c_name || '", "o_orderkey": ' || o_orderkey || ', "o_orderstatus": "' || o_orderstatus || '"}' AS j
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000 AND c_nationkey <> 7)
SELECT n_nationkey, CASE WHEN max(n) IS NULL THEN '(empty result set)' ELSE string_agg(j, chr(10) ORDER BY rn) FILTER (rn <= 30)
  || CASE WHEN max(n) > 30 THEN chr(10) || '... (' || (max(n) - 30) || ' more rows omitted)' ELSE '' END END AS context
FROM nation LEFT JOIN r ON n_nationkey = c_nationkey GROUP BY n_nationkey""")
def rows_context(spark, sf):
    rows = (read_table(spark, sf, "orders").filter(F.col("o_totalprice") > 480000)
            .join(read_table(spark, sf, "customer").filter(F.col("c_nationkey") != 7), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_nationkey").alias("n_nationkey"), "o_orderkey", "c_name", "o_orderstatus"))
    return querylog.rows_context(read_table(spark, sf, "nation"), rows, "n_nationkey", ["o_orderkey"],
                                 ["o_orderkey", "c_name", "o_orderstatus"])
