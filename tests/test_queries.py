"""Every registered query against its SQL check, and the shape of its plan."""

import pytest

from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from cohortspan.plans.registry import REGISTRY
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
# the text operators' queries are checked in tests/llm
BASE = sorted(n for n in entry.queries() if n in REGISTRY)


@pytest.fixture
def stored(monkeypatch):
    """Plans of the frames that a query stores on its way."""
    plans = []
    checkpoint = DataFrame.checkpoint

    def record(self, eager=True):
        out = checkpoint(self, eager)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", record)
    return plans


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", BASE)
def test_query(spark, con, stored, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = df.toPandas()
    # nothing pairs all rows of two inputs, before or after adaptive planning
    for plan in [*stored, df._jdf.queryExecution().executedPlan().toString()]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_check():
    assert set(BASE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["did_results", "did_sample_all", "high_users", "period_utilisation", "did_binary", "did_ols_panel"])
def test_line_items_are_read_twice_at_most(spark, stored, name):
    """Once for the clock stops and once for the activity, whatever else follows from them."""
    df = entry.queries()[name](spark, SF_DIR)
    df.collect()
    plans = [*stored, df._jdf.queryExecution().executedPlan().toString()]
    finals = [p.split("== Initial Plan ==")[0] for p in plans]
    assert sum(p.count("lineitem.parquet") for p in finals) <= 2


def test_long_rows_of_the_estimate_do_not_move(spark):
    """The rows per activity and comparison are made after the last shuffle by entity."""
    from cohortspan.operators import did
    from cohortspan.plans import use

    cells = did.entity_cells(use.panel(spark, SF_DIR), use.MEASURES)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    grown = plan.index("Generate inline")
    assert "Exchange" not in plan[:grown]


def test_filters_and_columns_reach_the_scan(spark):
    df = entry.queries()["time_to_first_event"](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)" in plan
    assert "l_extendedprice" not in plan
