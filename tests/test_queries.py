"""Every query against its SQL on the smallest tables, and those without SQL for plain sanity."""

import pytest

from volreg import evidence_queries, more_queries, register_queries, site_queries, solid_queries, sql_queries, survey_queries  # noqa: F401
from volreg.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(QUERIES[name], ORACLE_SQL[name], spark, duck)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows_and_one_schema(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert QUERIES[name](spark, SMALL).schema == df.schema


def test_plans_have_no_nested_loops_but_over_one_row(spark):
    for name in ("volumetric_overlap", "clearance_band", "point_in_volume", "best_plan_iou", "radius_neighbours"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        # the parcels' count is a single row that the fixture joins
        assert plan.count("BroadcastNestedLoopJoin") == plan.count("BroadcastNestedLoopJoin BuildRight, Cross")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
