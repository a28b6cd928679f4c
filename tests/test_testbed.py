import pytest

from gridloom.operators.validate import filled_columns, profile_columns
from gridloom.plans.testbed import GRID, Grid

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("filled", ["", "in_service"])
def test_lines_in_one_pass(spark, filled):
    """The lines are those of the SQL twin's text, by one window over the orders and two scans of them."""
    g = Grid(spark, SF)
    plain, once = g._made("line", GRID["line"]), g.line
    if filled:
        plain, once = plain.where(filled), once.where(filled)
    assert plain.exceptAll(once).count() == 0 and once.exceptAll(plain).count() == 0 and once.count() > 0
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.count("o_orderkey#") and plan.count("Aggregate [") <= 2


def test_columns_filled_without_their_values(spark):
    """As the whole profile counts, but with no row expanded or dealt by its values."""
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (None, "", None)], "k long, name string, none string")
    few, all_ = filled_columns(df, "t"), profile_columns(df, "t")
    want = all_.select("table", "column", "rows", "non_null")
    assert sorted(few.collect()) == sorted(want.collect()) and few.count() == 3
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning" not in plan
