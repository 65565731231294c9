"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from catalog import ORACLES as SQL
from catalog import QUERIES
from catalog.compare import connect, difference

@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    assert difference(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert slow not in plan, slow


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"publication_rank", "processing_batch", "related_count"} <= set(df.columns)


def test_routing_moves_no_page_text(spark, sf):
    """Between reading and checking the pages nothing is shuffled."""
    plan = QUERIES["qc_route"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not any("main_content" in line or "content#" in line for line in moved)
