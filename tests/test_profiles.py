from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from deltascope.operators import catalog as cat
from deltascope.operators import profile, querylog
from deltascope.plans import fixtures as fx


def test_statistics_count_nulls_copies_and_long_texts(spark):
    long_a, long_b = "a" * 500, "a" * 499 + "b"
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, long_a), (5, long_b), (6, long_a)], "k int, s string")
    r = {x["column_name"]: x for x in profile.column_statistics(profile.column_values({"t": t})).collect()}
    s = r["s"]
    assert (s["row_count"], s["non_null"], s["distinct_count"], s["null_count"], s["sum_lengths"]) == (6, 5, 3, 1, 1001)
    assert r["k"]["distinct_count"] == 6


def test_doubles_are_profiled_exactly(spark):
    t = spark.createDataFrame([(1.00001,), (1.00002,), (1.00003,), (1e16,), (0.0,), (-0.0,)], "d double")
    r = profile.column_statistics(profile.column_values({"t": t})).first()
    assert (r["distinct_count"], r["row_count"]) == (5, 6)


def test_dictionary_keeps_large_columns(spark):
    stats = spark.createDataFrame([("t", "c_name", 10**12, 10**10), ("t", "code", 10**12, 10**11), ("t", "body", 10**12, 10**6)],
                                  "table_name string, column_name string, sum_lengths long, distinct_count long")
    kept = stats.filter(profile.dictionary_column()).select("column_name")
    assert {r[0] for r in kept.collect()} == {"c_name", "code"}
    assert stats.filter(profile.dictionary_column(10**6)).count() == 0


def test_text_columns_by_name():
    rows_ = [("t", c, "TEXT", i, c == "code") for i, c in enumerate(
        ["code", "Code", "user_id", "homepage_url", "birthdate", "userId", "title"])] + [("u", "n", "INTEGER", 0, False)]
    assert profile.text_columns(rows_) == {"t": ["title"]}


def test_categorical_counts_null_as_a_value(spark):
    t = spark.range(40).select((F.col("id") % 19).cast("string").alias("a"),
                               F.when(F.col("id") >= 1, (F.col("id") % 19).cast("string")).alias("b"))
    stats = profile.column_statistics(profile.column_values({"t": t}))
    flags = dict(rows(stats.select("column_name", profile.is_categorical())))
    assert flags == {"a": True, "b": False}


def test_value_exists_equals_brute_force(spark):
    words = ["Red ring", "blue RING", "ring", "zz", "Straße 5", "a", "", "100% wool", "ab_c"]
    asked = ["RIN", "ring", "r", "zz", "zzz", "straße", "%", "b_", "xyz", "g", "100% w"]
    values = spark.createDataFrame([("t", "c", w) for w in words] + [("t", "d", "ring of d")], "table_name string, column_name string, value string")
    probes = spark.createDataFrame([("t", "c", a) for a in asked], "table_name string, column_name string, literal string")
    got = {r["literal"]: r["match"] for r in profile.value_exists(values, probes).collect()}
    for a in asked:
        assert got[a] == min((w for w in words if a.lower() in w.lower()), default=None), a


def test_orphans_are_counted_per_row(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "k long")
    r = profile.orphan_counts({"c": child, "p": parent}, [("c", "k", "p", "k")]).first()
    assert (r["n_rows"], r["n_orphans"]) == (4, 2)


def catalog_of(spark):
    return spark.createDataFrame(fx.schema_columns(), "table_name string, column_name string, type string, ordinal int, is_key boolean")


def test_selections_use_actual_names(spark):
    asked = spark.createDataFrame([(1, "ORDERS", "O_ORDERKEY"), (1, "orders", "nope"), (2, "Part", "p_NAME"), (1, "orders", "o_orderkey")],
                                  "q int, table_name string, column_name string")
    out = cat.union_selections(asked, catalog_of(spark), ["q"])
    assert rows(out) == [(1, "orders", "o_orderkey"), (2, "part", "p_name")]


def test_enrich_refuses_unknown_fields(spark):
    with pytest.raises(ValueError):
        cat.enrich(catalog_of(spark), catalog_of(spark), ["colour"], {"colour": ""})


def test_descriptions_are_cleaned(spark):
    raw = spark.createDataFrame([(" T ", " Col ", None, "a\nb commonsense evidence: c", None, "Not Useful  x")],
                                "table_name string, original_column_name string, column_name string, column_description string, data_format string, value_description string")
    r = cat.clean_descriptions(raw).first()
    assert (r["table_name"], r["column_key"], r["column_name"], r["column_description"], r["value_description"]) == (
        "t", "col", "", "a b  c", "x")


def test_clusters_and_audit(spark):
    log = spark.createDataFrame([(1, 'SELECT "a"'), (2, "SELECT 'a'"), (3, " ; drop table x; select 1"), (4, "with t as (select 1) delete from t")],
                                "query_id long, query string")
    assert Counter(r["n_queries"] for r in querylog.cluster(log).collect()) == {2: 1, 1: 2}
    blocked = {r["first_word"]: r["blocked"] for r in querylog.guard_audit(log).collect()}
    assert blocked == {"SELECT": False, "DROP": True, "WITH": False}


def test_rows_context_limits_and_counts(spark):
    groups = spark.createDataFrame([(1,), (2,)], "g int")
    data = spark.range(35).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    out = dict(rows(querylog.rows_context(groups, data, "g", ["k"], ["k"])))
    assert out[2] == "(empty result set)"
    assert out[1].splitlines()[0] == '{"k": 0}' and out[1].splitlines()[-1] == "... (5 more rows omitted)"
    assert len(out[1].splitlines()) == 31


def test_examples_do_not_depend_on_the_rows_that_bound_them(spark):
    """Any part of the values may bound the search, also an empty one or one with few values."""
    data = ([("t", "many", f"{i:03d}") for i in range(40)] + [("t", "few", v) for v in ("b", "a", None, "a")]
            + [("t", "date", v) for v in "edcba"] + [("t", "long", "x" * 60 + str(i)) for i in range(30)])
    values = spark.createDataFrame(data, "table_name string, column_name string, value string")
    stats = profile.column_statistics(values)
    whole = rows(profile.example_values(values, stats, [("t", "date")]))
    assert ("t", "many", ["000", "001", "002"]) in whole and ("t", "few", ["a", "b"]) in whole
    for part in ("value > '020'", "false", "value < '003'", "true"):
        assert rows(profile.example_values(values, stats, [("t", "date")], values.filter(part))) == whole
