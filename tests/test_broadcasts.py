"""What grows with the tables is not broadcast, however small Spark takes it for."""

import re

import pytest

from __spark_entry__ import queries


def broadcast_files(frame):
    """Lines of the plan that read files below a broadcast."""
    found, depth = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = re.search(r"[A-Za-z]", line)
        if not at or not re.match(r"[ :|]*(\+- |:- )", line):
            continue  # a line of a long text
        if depth is not None and at.start() <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at.start()
        if depth is not None and "FileScan" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["query_table_usage", "schema_subselect", "schema_union", "schema_enrich", "connections",
                                  "value_exists", "condition_literals", "lsh_index"])
def test_only_the_schema_is_broadcast(spark, sf, name):
    assert broadcast_files(queries()[name](spark, sf)) == []
