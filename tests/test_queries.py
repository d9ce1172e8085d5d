"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    problem = oracle.compare(spark, con, FOLDER, entry_module.queries()[name], entry_module.oracle_sql().get(name))
    # An empty result is right where the small tables have nothing to report.
    assert problem in (None, "no rows"), problem


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    df = entry_module.queries()["class_series"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


def test_events_are_aggregated_before_they_meet_the_units(spark):
    df = entry_module.queries()["history_snapshot"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate [unit")


@pytest.mark.parametrize("name, laid_out", [("annual_series", "explode(__cells"), ("type_breakdown", "Generate explode(")])
def test_dense_grids_are_laid_out_after_the_joins(spark, name, laid_out):
    plan = entry_module.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(laid_out) < plan.index("Join LeftOuter")
