"""The workload whose results are compared: typical SELECT shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.plans.registry import query
from deltascope.sources.tables import read_table


@query("gold_filter_topk", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def gold_filter_topk(spark, sf):
    orders = read_table(spark, sf, "orders")
    return (orders.filter(F.col("o_orderstatus") == "O")
            .select("o_orderkey", "o_totalprice", "o_orderpriority")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20))


@query("gold_join_filter", """
SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 400000""")
def gold_join_filter(spark, sf):
    orders = read_table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000)
    customers = read_table(spark, sf, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice"))


@query("gold_scalar_agg", """
SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
  round(avg(o_totalprice), 4) AS average, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
FROM orders WHERE o_orderpriority = '1-URGENT'""")
def gold_scalar_agg(spark, sf):
    return read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.round(F.avg("o_totalprice"), 4).alias("average"),
        F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"))


@query("gold_group_having", """
SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey HAVING count(*) > 12 ORDER BY total DESC""")
def gold_group_having(spark, sf):
    return (read_table(spark, sf, "orders").groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
            .filter(F.col("n_orders") > 12).orderBy(F.desc("total")))


@query("gold_distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_quantity >= 45")
def gold_distinct(spark, sf):
    return (read_table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 45)
            .select("l_partkey", "l_returnflag").distinct())


@query("gold_subquery_condagg", """
SELECT n_name, count(*) AS n_orders,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_finished,
  CAST(sum(CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 1 ELSE 0 END) AS BIGINT) AS n_large
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY n_name""")
def gold_subquery_condagg(spark, sf):
    orders, customer = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    solvent = customer.filter(F.col("c_acctbal") > 0)
    average = orders.agg(F.avg("o_totalprice")).scalar()
    return (orders.join(solvent, F.col("o_custkey") == F.col("c_custkey"))
            .join(read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(
                F.count(F.lit(1)).alias("n_orders"),
                F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
                F.count_if(F.col("o_totalprice") > average).alias("n_large")))


@query("gold_date_part", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, count(*) AS n_orders FROM orders
WHERE year(o_orderdate) >= 1997 GROUP BY year(o_orderdate)""")
def gold_date_part(spark, sf):
    return (read_table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
            .groupBy(F.year("o_orderdate").cast("bigint").alias("order_year"))
            .agg(F.count(F.lit(1)).alias("n_orders")))


@query("gold_null_filter", """
SELECT d.lang, count(*) AS n_labelled, CAST(sum(quality) AS BIGINT) AS n_good
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL GROUP BY d.lang""")
def gold_null_filter(spark, sf):
    documents = read_table(spark, sf, "documents").select("doc_id", "lang")
    labels = read_table(spark, sf, "labels").filter(F.col("quality").isNotNull())
    return documents.join(labels, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_labelled"), F.sum("quality").cast("bigint").alias("n_good"))
