"""Nearest buses where they are dense, and feeders of large components."""

import random

from pyspark.sql import functions as F

from gridloom.operators import components, connect, topology

rng = random.Random(3)


def test_nearest_two_of_dense_buses(spark):
    """Against all pairs: dense and lone places, equal distances, a bus on the radius, points with one bus or none."""
    place = lambda w: (float(rng.randrange(w)), float(rng.randrange(w)))
    buses = [(f"b{i}", *place(60)) for i in range(700)] + [(f"c{i}", *place(4000)) for i in range(60)] + [("edge", 9000.0, 60.0), ("null", None, 1.0)]
    points = [(f"p{i}", *place(90)) for i in range(150)] + [(f"q{i}", *place(4000)) for i in range(150)] + [("on", 9000.0, 0.0), ("none", -500.0, -500.0)]
    got = connect.nearest_two(spark.createDataFrame(points, "id string, x double, y double"), spark.createDataFrame(buses, "id string, x double, y double"), 60.0, ["id"])
    want = {}
    for p, x, y in points:
        near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, b) for b, u, v in buses if u is not None)
        near = [n for n in near if n[0] <= 60]
        if near:
            want[p] = (near[0][1], round(near[0][0], 6), round(near[1][0], 6) if len(near) > 1 else None)
    rows = got.collect()
    assert {r["id"]: (r["bus_id"], round(r["distance"], 6), None if r["second"] is None else round(r["second"], 6)) for r in rows} == want and len(rows) == len(want)
    assert want["on"] == ("edge", 60.0, None)


def test_candidates_do_not_grow_with_density(spark):
    """200 points among 40 000 buses: with the tolerance alone each would be compared with all of them."""
    bus = spark.range(40000).select(F.concat(F.lit("b"), "id").alias("id"), (F.col("id") % 200 * 0.3).alias("x"), (F.floor(F.col("id") / 200) * 0.3).alias("y"))
    points = spark.range(200).select("id", (F.col("id") * 0.29).alias("x"), (F.col("id") * 0.17).alias("y"))
    pairs, cells = [], connect._cells

    def counted(*args):
        at, placed = cells(*args)
        pairs.append(at.join(placed, ["_i", "_j"]).count())
        return at, placed

    connect._cells = counted
    try:
        assert connect.nearest_two(points, bus, 60.0, ["id"]).count() == 200
    finally:
        connect._cells = cells
    assert sum(pairs) < 200 * 100


def test_buses_of_a_large_component_are_not_joined_in_one_task(spark, monkeypatch):
    """The feeders of a component that holds most buses go to the buses by a broadcast."""
    monkeypatch.setattr(components, "LEAST_HUB", 5)
    bus = spark.createDataFrame([(f"b{i}",) for i in range(60)], "id string")
    edge = spark.createDataFrame([(f"line:{i}", "line", f"b{i}", f"b{i + 1}", True) for i in range(50)], "key string, object_type string, src string, dst string, conductive boolean")
    sources = spark.createDataFrame([("s0", "b0"), ("s30", "b30")], "source_id string, bus string")
    found = topology.Feeders(bus, edge, sources).buses()
    assert "hub" in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r["feeder"], r["bus"]) for r in found.collect()) == sorted({("s0|line:0", f"b{i}") for i in range(31)} | {("s30|line:29", f"b{i}") for i in range(31)} | {("s30|line:30", f"b{i}") for i in range(30, 51)})
