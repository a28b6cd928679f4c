"""What one task holds follows the rows given to it, not the packed size of what is shuffled."""

import os

import pytest

from gridloom.operators import connect
from gridloom.plans import joins, testbed

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_lines_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(testbed, "DEALT_ROWS", 10)
    g = testbed.Grid(spark, SF)
    tasks = -(-g.table("orders").count() // 10)
    assert g.tasks("orders") == tasks
    assert f"hashpartitioning(o_custkey#" in plan(g.line) and f", {tasks}), REPARTITION_BY_NUM" in plan(g.line)


def test_feeders_are_dealt_by_rows(spark):
    points = spark.createDataFrame([(f, f"p{i}", i, x, 0.0) for f in ("F1", "F2", "F3") for i, x in enumerate((0.0, 0.0, 0.0, 5e-7, 1.2e-6, 30.0, 30.0))], "feeder string, id string, seq int, x double, y double")
    found = connect.chain(points, 3)
    assert ", 3), REPARTITION_BY_NUM" in plan(found) and plan(found).count("Sort ") == 1
    assert sorted((r["feeder"], r["place"], r["id"]) for r in found.collect()) == [(f, n, i) for f in ("F1", "F2", "F3") for n, i in enumerate(("p0", "p4", "p5"))]


@needs_tables
@pytest.mark.parametrize("name", ["join_missing_endpoints", "join_placeholder_buses", "join_sections_found"])
def test_ids_are_dealt_by_rows(spark, monkeypatch, name):
    monkeypatch.setattr(testbed, "DEALT_ROWS", 10)
    found = joins.QUERIES[name](spark, SF)
    ids = plan(found).split("Union")[0]
    assert "Join" not in ids and "REPARTITION_BY_NUM" in ids


def test_unheld(spark):
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", None), (None, 9.0)], "id string, kv double")
    held = spark.createDataFrame([("a",), ("d",), (None,)], "id string")
    for tasks in (None, 3):
        assert {tuple(r) for r in connect.unheld(asked, held, F.max("kv"), tasks).collect()} == {("b", 3.0), ("c", None)}


def test_held_of(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    held = spark.createDataFrame([("a",), ("d",), (None,)], "k string")
    for tasks in (None, 3):
        assert {tuple(r) for r in connect.held_of(asked, held, "k", tasks).collect()} == {("a", True), ("b", False), (None, False)}


@needs_tables
def test_sections_are_worked_out_once(spark):
    from gridloom.plans import enrich

    assert "Window" not in plan(enrich.enrich_section_networks(spark, SF))
