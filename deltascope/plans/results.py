"""Queries that compare the results of one query over two snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01, hash01_sql, row_key
from deltascope.operators import alter, sampling, validate
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.registry import query
from deltascope.sources.tables import read_table

COLUMNS = ["o_orderkey", "c_name", "o_orderstatus", "o_totalprice"]
TARGET_SEED = 21


def large_orders(orders, customer):
    """Result of one query template, one sample per nation."""
    return (orders.filter(F.col("o_totalprice") > 300000)
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_nationkey").cast("bigint").alias("sample_id"), *COLUMNS))


def _results(spark, sf):
    customer = read_table(spark, sf, "customer")
    gold = large_orders(fx.orders_base(spark, sf), customer)
    return gold, large_orders(fx.orders_altered(spark, sf), customer)


def _compared(spark, sf):
    gold, altered = _results(spark, sf)
    targets = sampling.target_pick(gold, "o_orderkey", TARGET_SEED).select("sample_id", *COLUMNS)
    return validate.compare_results(gold, altered, targets, COLUMNS)


_RESULT = """SELECT CAST(c_nationkey AS BIGINT) AS sample_id, o_orderkey, c_name, o_orderstatus, o_totalprice
  FROM {} JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000"""
WITH_RESULTS = f"""{fx.WITH_ORDERS}, gold AS ({_RESULT.format('base')}), altered AS ({_RESULT.format('alt')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {u(TARGET_SEED, 'o_orderkey')}, o_orderkey) AS r,
  count(*) OVER (PARTITION BY sample_id) AS n_rows FROM gold),
target AS (SELECT * FROM (SELECT *, 1 + CAST(floor({u(TARGET_SEED + 1, 'sample_id')} * least(5, n_rows)) AS BIGINT) AS num_targets
  FROM ranked) WHERE r <= num_targets),
cmp AS (SELECT sample_id, o_orderkey, c_name, o_orderstatus, o_totalprice,
  count_if(side = 'g') AS n_gold, count_if(side = 'a') AS n_altered, count_if(side = 't') AS n_target
  FROM (SELECT 'g' AS side, * FROM gold UNION ALL SELECT 'a', * FROM altered
        UNION ALL SELECT 't', sample_id, o_orderkey, c_name, o_orderstatus, o_totalprice FROM target) GROUP BY ALL)"""
_COLS = "sample_id, " + ", ".join(COLUMNS)


def _json_number(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@query("row_key", f"""
SELECT p_partkey, '{{"p_name": "' || p_name || '", "p_retailprice": ' || {_json_number('p_retailprice')}
  || ', "p_size": ' || p_size || ', "p_type": ' || coalesce('"' || nullif(p_type, 'PROMO') || '"', 'null') || '}}' AS row_key
FROM part""")
def part_row_key(spark, sf):
    part = read_table(spark, sf, "part").withColumn("p_type", F.expr("nullif(p_type, 'PROMO')")).withColumn(
        "p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    return part.select("p_partkey", row_key(part, ["p_name", "p_retailprice", "p_size", "p_type"]).alias("row_key"))


@query("row_key_equality", """
SELECT l_quantity, count(*) AS n_rows FROM lineitem GROUP BY l_quantity""")
def row_key_equality(spark, sf):
    """The same number as double and as integer must give one key."""
    lineitem = read_table(spark, sf, "lineitem").select("l_quantity")
    whole = lineitem.select(F.col("l_quantity").cast("int").alias("l_quantity"))
    keys = (lineitem.withColumn("k", row_key(lineitem)).select("k", F.lit(1).alias("n"))
            .unionByName(whole.withColumn("k", row_key(whole)).select("k", F.lit(0).alias("n"))))
    return keys.groupBy("k").agg(F.sum("n").alias("n_rows")).select(
        F.get_json_object("k", "$.l_quantity").cast("double").alias("l_quantity"), "n_rows")


@query("validate_targeted", f"""{WITH_RESULTS}
SELECT {_COLS}, CASE WHEN n_altered > 0 THEN 'still_present' ELSE 'missing_targeted' END AS status, n_target AS copies
FROM cmp WHERE n_target > 0""")
def validate_targeted(spark, sf):
    return validate.targeted(_compared(spark, sf))


@query("validate_unintended", f"""{WITH_RESULTS}
SELECT {_COLS}, n_gold AS copies FROM cmp WHERE n_gold > 0 AND n_target = 0 AND n_altered = 0""")
def validate_unintended(spark, sf):
    return validate.unintended(_compared(spark, sf))


@query("validate_new_rows", f"""{WITH_RESULTS}
SELECT {_COLS}, n_altered AS copies FROM cmp WHERE n_gold = 0 AND n_altered > 0""")
def validate_new_rows(spark, sf):
    gold, altered = _results(spark, sf)
    return validate.new_rows(validate.compare_results(gold, altered, None, COLUMNS))


@query("validation_report", f"""{WITH_RESULTS}, s AS (SELECT sample_id,
  coalesce(sum(CASE WHEN n_altered = 0 THEN n_target END), 0)::BIGINT AS n_missing_targeted,
  coalesce(sum(CASE WHEN n_altered > 0 THEN n_target END), 0)::BIGINT AS n_still_present,
  coalesce(sum(CASE WHEN n_target = 0 AND n_altered = 0 THEN n_gold END), 0)::BIGINT AS n_unintended_missing,
  coalesce(sum(CASE WHEN n_gold = 0 THEN n_altered END), 0)::BIGINT AS n_new_records,
  coalesce(string_agg(k, ', ' ORDER BY k) FILTER (n_target > 0 AND n_altered = 0), '') AS missing_targeted,
  coalesce(string_agg(k, ', ' ORDER BY k) FILTER (n_target > 0 AND n_altered > 0), '') AS still_present
  FROM (SELECT *, '{{"c_name": "' || c_name || '", "o_orderkey": ' || o_orderkey || ', "o_orderstatus": "' || o_orderstatus
    || '", "o_totalprice": ' || {_json_number('o_totalprice')} || '}}' AS k FROM cmp) GROUP BY sample_id)
SELECT sample_id, n_still_present = 0 AS is_valid,
  CASE WHEN n_still_present > 0 THEN n_still_present || ' targeted record(s) still present in altered result: [' || still_present || ']' END
    AS error_message, missing_targeted, still_present, n_missing_targeted, n_still_present, n_unintended_missing, n_new_records FROM s""")
def validation_report(spark, sf):
    compared = _compared(spark, sf).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return validate.report(compared, COLUMNS)


def _top(df, n=10):
    best = Window.partitionBy("sample_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return df.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).drop("_r")


_TOP = """SELECT {cols} FROM {t} QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY o_totalprice DESC, o_orderkey) <= 10"""


@query("validate_insert", f"""WITH base AS ({fx.ORDERS_BASE}),
more AS (SELECT * FROM base UNION ALL SELECT * REPLACE ({fx.copy_key_sql('o_orderkey')} AS o_orderkey) FROM base WHERE {u(3, 'o_orderkey')} < 0.01),
gold AS ({_RESULT.format('base')}), altered AS ({_RESULT.format('more')}),
cmp AS (SELECT has_limit, {_COLS}, count_if(side = 'g') AS n_gold, count_if(side = 'a') AS n_altered FROM (
  SELECT 'g' AS side, false AS has_limit, {_COLS} FROM gold UNION ALL SELECT 'a', false, {_COLS} FROM altered
  UNION ALL SELECT 'g', true, * FROM ({_TOP.format(cols=_COLS, t='gold')})
  UNION ALL SELECT 'a', true, * FROM ({_TOP.format(cols=_COLS, t='altered')})) GROUP BY ALL),
s AS (SELECT sample_id, has_limit, coalesce(sum(n_altered) FILTER (n_gold = 0), 0)::BIGINT AS n_new,
  coalesce(sum(n_gold) FILTER (n_altered = 0), 0)::BIGINT AS n_displaced FROM cmp GROUP BY ALL),
m AS (SELECT *, concat_ws(' | ', CASE WHEN n_new + n_displaced = 0 THEN '{validate.SAME_RESULT}' END,
  CASE WHEN has_limit AND n_displaced = 0 THEN '{validate.NOT_DISPLACED}' END) AS msg FROM s)
SELECT sample_id, has_limit, n_new, n_displaced, msg = '' AS is_valid, nullif(msg, '') AS error_message FROM m""")
def validate_insert(spark, sf):
    base, customer = fx.orders_base(spark, sf), read_table(spark, sf, "customer")
    copies = base.filter(hash01(3, F.col("o_orderkey")) < 0.01).withColumn(
        "o_orderkey", fx.copy_key(F.col("o_orderkey")))
    gold = large_orders(base, customer)
    altered = large_orders(alter.insert_rows(base, copies), customer)

    def both(df):
        return df.withColumn("has_limit", F.lit(False)).unionByName(_top(df).withColumn("has_limit", F.lit(True)))

    compared = validate.compare_results(both(gold), both(altered), None, ["has_limit", *COLUMNS])
    return validate.report_insert(compared, F.col("has_limit"))


_AGG = """SELECT CAST(c_nationkey AS BIGINT) AS sample_id, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM {} JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 497000 AND o_totalprice < 520000 GROUP BY c_nationkey"""
_AGG_KEY = "'{\"n\": ' || n || ', \"total\": ' || rtrim(rtrim(CAST(total AS VARCHAR), '0'), '.') || '}'"


@query("validate_aggregate", f"""{fx.WITH_ORDERS},
gold AS (SELECT sample_id, {_AGG_KEY} AS g FROM ({_AGG.format('base')})),
altered AS (SELECT sample_id, {_AGG_KEY} AS a FROM ({_AGG.format('alt')})),
m AS (SELECT CAST(n_nationkey AS BIGINT) AS sample_id, CASE WHEN g IS NULL OR a IS NULL THEN '{validate.EMPTY_RESULT}'
  WHEN g = a THEN 'Aggregate result did not change after alteration. Gold: ' || g || ' | Altered: ' || a END AS error_message
  FROM nation LEFT JOIN gold ON n_nationkey = gold.sample_id LEFT JOIN altered ON n_nationkey = altered.sample_id)
SELECT sample_id, error_message IS NULL AS is_valid, error_message FROM m""")
def validate_aggregate(spark, sf):
    customer = read_table(spark, sf, "customer")

    def totals(orders):
        return (orders.filter((F.col("o_totalprice") > 497000) & (F.col("o_totalprice") < 520000))
                .join(customer, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(F.col("c_nationkey").cast("bigint").alias("sample_id"))
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")))

    samples = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("sample_id"))
    return validate.report_aggregate(samples, totals(fx.orders_base(spark, sf)),
                                     totals(fx.orders_altered(spark, sf)), ["n", "total"])


_PAIR = ["o_orderstatus", "o_orderpriority"]


def _customer_results(spark, sf):
    def rows(df):
        return df.select(F.col("o_custkey").alias("sample_id"), *_PAIR)
    return validate.compare_results(rows(fx.orders_base(spark, sf)), rows(fx.orders_altered(spark, sf)), None, _PAIR)


_CUST = f"""{fx.WITH_ORDERS}, cmp AS (SELECT o_custkey AS sample_id, o_orderstatus, o_orderpriority,
  count_if(side = 'g') AS n_gold, count_if(side = 'a') AS n_altered
  FROM (SELECT 'g' AS side, * FROM base UNION ALL SELECT 'a', * FROM alt) GROUP BY ALL)"""


@query("result_set_equal", f"""{_CUST}
SELECT sample_id, count_if(n_gold = 0 OR n_altered = 0) = 0 AS equal FROM cmp GROUP BY sample_id""")
def result_set_equal(spark, sf):
    return validate.set_equal(_customer_results(spark, sf))


@query("result_diff", f"""{_CUST}
SELECT sample_id, o_orderstatus, o_orderpriority, CASE WHEN n_altered = 0 THEN 'missing' ELSE 'extra' END AS kind,
  greatest(n_gold, n_altered) AS copies FROM cmp WHERE n_gold = 0 OR n_altered = 0""")
def result_diff(spark, sf):
    return validate.result_diff(_customer_results(spark, sf))


_POS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_POS_SIDE = ("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey, o_orderstatus, o_totalprice FROM {}")


def _pos_sql(case: str, b: str) -> str:
    def note(c, text):
        return (f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN 'column ''{c}'': original=' || {text.format('a.' + c)} "
                f"|| ', restored=' || {text.format('b.' + c)} END")
    number = "coalesce(CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END, 'null')"
    detail = "concat_ws('; ', " + ", ".join([
        note("o_orderkey", "coalesce(CAST({0} AS VARCHAR), 'null')"),
        note("o_orderstatus", "coalesce('\"' || {0} || '\"', 'null')"), note("o_totalprice", number)]) + ")"
    return f"""SELECT '{case}' AS case_name, (SELECT count(*) FROM base) AS n_original, (SELECT count(*) FROM {b}) AS n_restored,
  count(*) AS n, string_agg('Row ' || row_no || ': ' || detail, chr(10) ORDER BY row_no) FILTER (r <= 10) AS lines
  FROM (SELECT *, row_number() OVER (ORDER BY row_no) AS r FROM (
    SELECT coalesce(a.row_no, b.row_no) AS row_no, {detail} AS detail
    FROM ({_POS_SIDE.format('base')}) a FULL JOIN ({_POS_SIDE.format(b)}) b ON a.row_no = b.row_no) WHERE detail <> '')"""


@query("result_positional_diff", f"""{fx.WITH_ORDERS},
upd AS (SELECT * REPLACE (CASE WHEN {u(2, 'o_orderkey')} < 0.02 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN {u(2, 'o_orderkey')} < 0.02 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM base),
del AS (SELECT * FROM base WHERE NOT ({u(1, 'o_orderkey')} < 0.01)),
s AS ({_pos_sql('updated', 'upd')} UNION ALL {_pos_sql('deleted', 'del')} UNION ALL {_pos_sql('same', 'base')}),
m AS (SELECT *, CASE WHEN n_original <> n_restored THEN 'Row count mismatch: original has ' || n_original || ' row(s), restored has ' || n_restored || ' row(s).'
  WHEN n > 0 THEN n || ' row(s) differ between original and restored:' || chr(10) || lines
    || CASE WHEN n > 10 THEN chr(10) || '… and ' || (n - 10) || ' more mismatched row(s)' ELSE '' END END AS message FROM s)
SELECT case_name, n_original, n_restored, message IS NULL AS matches, message FROM m""")
def result_positional_diff(spark, sf):
    def shown(df):
        return df.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))

    base = fx.orders_base(spark, sf)
    cases = {"updated": alter.update_rows(base, hash01_sql(2, "o_orderkey") + " < 0.02",
                                          {"o_totalprice": "o_totalprice * 2", "o_orderstatus": "'X'"}),
             "deleted": alter.delete_rows(base, hash01_sql(1, "o_orderkey") + " < 0.01"),
             "same": base}
    out = None
    for name, changed in cases.items():
        a, b = shown(base), shown(changed)
        row = validate.positional_summary(a, b, ["o_orderkey"], _POS, F.floor(F.col("o_orderkey") / fx.ORDER_BUCKET)).select(
            F.lit(name).alias("case_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out




def _match_sql(name: str, p: str, g: str) -> str:
    return f"""SELECT '{name}' AS case_name, (SELECT count(*) FROM ({p})) > 0 AND (SELECT count(*) FROM ({g})) > 0
  AND NOT EXISTS (SELECT * FROM ({p} EXCEPT {g})) AND NOT EXISTS (SELECT * FROM ({g} EXCEPT {p})) AS hit"""


_CK = "SELECT o_custkey, o_orderstatus FROM {} WHERE o_totalprice > {}"


@query("execution_match", f"""{fx.WITH_ORDERS}, m AS (
{_match_sql('reordered', _CK.format('base', 250000).replace('SELECT ', 'SELECT DISTINCT '), _CK.format('base', 250000))}
UNION ALL {_match_sql('changed', _CK.format('alt', 250000), _CK.format('base', 250000))}
UNION ALL {_match_sql('both_empty', _CK.format('base', 1e12), _CK.format('base', 1e12))})
SELECT case_name, CASE WHEN hit THEN 1 ELSE 0 END AS exec_res, CASE WHEN hit THEN '--' ELSE 'incorrect answer' END AS exec_err FROM m
UNION ALL VALUES ('column_count', 0, 'incorrect answer'), ('timeout', 0, 'timeout')""")
def execution_match(spark, sf):
    def rows(df, floor=250000):
        return df.filter(F.col("o_totalprice") > floor).select("o_custkey", "o_orderstatus")

    base, altered = fx.orders_base(spark, sf), fx.orders_altered(spark, sf)
    gold = rows(base)
    cases = {"reordered": validate.execution_match(gold.distinct().toDF("customer", "state"), gold),
             "changed": validate.execution_match(rows(altered), gold),
             "both_empty": validate.execution_match(rows(base, 1e12), rows(base, 1e12)),
             "column_count": validate.execution_match(gold.select("o_custkey"), gold),
             "timeout": validate.execution_match(None, gold, "timeout")}
    out = None
    for name, row in cases.items():
        row = row.select(F.lit(name).alias("case_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out




def prediction_pairs(spark, sf):
    """One (predicted, gold) result pair per customer: pairs, predicted rows, gold rows."""
    draw = hash01(22, F.col("pair_id"))
    rows = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("pair_id"), "o_orderkey", *_PAIR)
    gold = rows.filter((draw < 0.6) | (draw >= 0.7))
    predicted = rows.filter((draw < 0.4) | ((draw < 0.6) & (hash01(23, F.col("o_orderkey")) >= 0.3)))
    predicted = predicted.unionByName(rows.filter((draw >= 0.2) & (draw < 0.4)))
    pairs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("pair_id"))
    error = F.when(draw >= 0.85, "no such column: o_totl").when(draw >= 0.8, "timeout")
    return pairs.withColumn("error", error), predicted.select("pair_id", *_PAIR), gold.select("pair_id", *_PAIR)


WITH_PAIRS = f"""WITH rows_ AS (SELECT o_custkey AS pair_id, o_orderkey, o_orderstatus, o_orderpriority, {u(22, 'o_custkey')} AS d FROM orders),
gold AS (SELECT pair_id, o_orderstatus, o_orderpriority FROM rows_ WHERE d < 0.6 OR d >= 0.7),
pred AS (SELECT pair_id, o_orderstatus, o_orderpriority FROM rows_ WHERE d < 0.4 OR (d < 0.6 AND {u(23, 'o_orderkey')} >= 0.3)
  UNION ALL SELECT pair_id, o_orderstatus, o_orderpriority FROM rows_ WHERE d >= 0.2 AND d < 0.4),
pairs AS (SELECT c_custkey AS pair_id, CASE WHEN {u(22, 'c_custkey')} >= 0.85 THEN 'no such column: o_totl'
  WHEN {u(22, 'c_custkey')} >= 0.8 THEN 'timeout' END AS error FROM customer),
onesided AS (SELECT pair_id FROM (SELECT * FROM gold EXCEPT SELECT * FROM pred) UNION SELECT pair_id FROM (SELECT * FROM pred EXCEPT SELECT * FROM gold)),
matched AS (SELECT pair_id, error, error IS NULL AND pair_id IN (SELECT pair_id FROM gold) AND pair_id IN (SELECT pair_id FROM pred)
  AND pair_id NOT IN (SELECT pair_id FROM onesided) AS hit FROM pairs)"""


@query("execution_match_batch", f"""{WITH_PAIRS}
SELECT pair_id, CASE WHEN hit THEN 1 ELSE 0 END AS exec_res,
  coalesce(error, CASE WHEN hit THEN '--' ELSE 'incorrect answer' END) AS exec_err,
  CASE WHEN NOT hit THEN CASE WHEN error IS NULL OR error = 'timeout' THEN 'valid_but_incorrect' ELSE 'invalid_syntax' END END AS label
FROM matched""")
def execution_match_batch(spark, sf):
    return validate.execution_match_batch(*prediction_pairs(spark, sf), _PAIR)
