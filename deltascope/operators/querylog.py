"""Mining of a query log: clusters, table usage, joins, literals, audit, row contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltascope.functions import text
from deltascope.functions.hashing import row_key
from deltascope.operators.profile import value_exists
from deltascope.session import cut_lineage


def cluster(log: DataFrame) -> DataFrame:
    """One row per cleaned query text: first query of the cluster and its size."""
    cleaned = log.select(text.clean_query(F.col("query")).alias("cleaned"), "query_id")
    return cleaned.groupBy("cleaned").agg(F.min("query_id").alias("first_query_id"),
                                          F.count(F.lit(1)).alias("n_queries"))


def table_usage(log: DataFrame, catalog: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Tables a query names, with the columns of these tables it names.

    Tokens meet the catalog once; a table's columns count only if the table
    itself is named in the same query. ``carry`` names further columns of the
    log to keep.
    """
    own = ["query_id", *carry]
    words = log.select(*own, F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("token"))
    tables = catalog.select(F.lower("table_name").alias("token"), "table_name",
                            F.lit(None).cast("string").alias("column_name")).distinct()
    columns = catalog.select(F.lower("column_name").alias("token"), "table_name", "column_name")
    # the names, as many as the schema has, go to the tasks: Spark takes the words of a log for fewer than they are
    hits = words.join(F.broadcast(tables.unionByName(columns)), "token")
    per_table = hits.groupBy(*own, "table_name").agg(
        F.bool_or(F.col("column_name").isNull()).alias("named"),
        F.sort_array(F.collect_set("column_name")).alias("columns"))
    return per_table.filter("named").select(*own, "table_name", "columns")


def column_usage(log: DataFrame, catalog: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, carried columns, table_name, column_name) of the columns a query names."""
    used = table_usage(log, catalog, carry)
    return used.select("query_id", *carry, "table_name", F.explode("columns").alias("column_name"))


def join_mining(log: DataFrame) -> DataFrame:
    """Column pairs equated in ON clauses, with the number of times they occur."""
    pairs = log.select(F.explode(text.join_pairs(F.col("query"))).alias("p"))
    return pairs.groupBy(F.col("p.left").alias("left_column"), F.col("p.right").alias("right_column")).agg(
        F.count(F.lit(1)).alias("n_joins"))


def condition_literals(log: DataFrame, catalog: DataFrame, values: DataFrame) -> DataFrame:
    """Literals compared with columns, per table and column.

    Literals of LIKE and of function calls are kept only if the data has them;
    a call reports the value found, LIKE the literal without %.
    """
    found = log.select("query_id", "query", F.explode(text.conditions(F.col("query"))).alias("c")).select(
        "query_id", F.col("c.in_call").alias("in_call"), F.col("c.column").alias("_column"),
        (F.col("c.op") == "like").alias("is_like"),
        F.when(F.col("c.op") == "like", F.replace("c.literal", F.lit("%"), F.lit(""))).otherwise(F.col("c.literal")).alias("literal"))
    used = column_usage(log, catalog).withColumn("_column", F.lower("column_name"))
    placed = cut_lineage(found.join(used.hint("merge"), ["query_id", "_column"])
                         .groupBy("table_name", "column_name", "literal", "in_call", "is_like")
                         .agg(F.countDistinct("query_id").alias("n_queries")))  # read five times
    checked = placed.filter(F.col("in_call") | F.col("is_like"))
    matched = value_exists(values, checked).filter(F.col("match").isNotNull()).withColumn(
        "example", F.when(F.col("is_like"), F.col("literal")).otherwise(F.col("match")))
    plain = placed.filter(~(F.col("in_call") | F.col("is_like"))).withColumn("example", F.col("literal"))
    both = matched.select("table_name", "column_name", "example", "n_queries").unionByName(
        plain.select("table_name", "column_name", "example", "n_queries"))
    return both.groupBy("table_name", "column_name", "example").agg(F.sum("n_queries").alias("n_queries"))


def guard_audit(log: DataFrame) -> DataFrame:
    """Per first statement kind: how many queries are writes by their first token."""
    first = F.coalesce(text.first_statement(F.col("query")), F.col("query"))
    return log.select(text.is_write(first).alias("blocked"),
                      F.upper(F.regexp_extract(first, r"^(\S+)", 1)).alias("first_word"),
                      (F.size(F.filter(F.split("query", ";"), lambda p: F.trim(p) != "")) > 1).alias("multi")
                      ).groupBy("first_word", "blocked", "multi").agg(F.count(F.lit(1)).alias("n_queries"))


def rows_context(groups: DataFrame, rows: DataFrame, key: str, order: Sequence[str | Column],
                 columns: Sequence[str], max_rows: int = 30) -> DataFrame:
    """Up to ``max_rows`` rows per group as JSON lines, with a note on the rest."""
    first = Window.partitionBy(key).orderBy(*order)
    shown = (rows.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= max_rows)
             .select(key, "_rank", row_key(rows, columns).alias("_json")))
    lines = shown.groupBy(key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_rank", "_json"))), lambda s: s["_json"]), "\n").alias("_text"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = groups.select(key).join(lines, key, "left").join(counts, key, "left")
    rest = F.when(F.col("_n") > max_rows, F.concat(F.lit("\n... ("), F.col("_n") - max_rows, F.lit(" more rows omitted)"))
                  ).otherwise("")
    return joined.select(key, F.when(F.col("_n").isNull(), "(empty result set)").otherwise(
        F.concat("_text", rest)).alias("context"))
