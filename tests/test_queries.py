import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import difference, open_views


@pytest.fixture(scope="module")
def views(sf):
    return open_views(sf)


# the training-data queries have tests of their own
OWN = [n for n in queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf, views, name):
    wrong, n = difference(spark, views, sf, name)
    assert wrong is None, wrong
    assert n >= 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert "change" in df.columns
    assert df.count() > 0


def test_plans_join_on_keys_only(spark, sf):
    """No cross or nested-loop join in the core queries."""
    for name in ("diff_keyed", "diff_bag", "validation_report", "execution_match_batch", "value_exists",
                 "cosine_topk", "lsh_lookup", "connections", "event_timeline"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
