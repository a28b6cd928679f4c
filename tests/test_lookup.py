"""Repairs counted while mapping, and lookup tables found by their values."""

import pytest

from gridloom.operators import connect, lookup
from gridloom.operators.mapping import LayerMapping, judge_layer, map_layer, observed


def test_counters_without_a_pass_of_their_own(spark):
    raw = spark.createDataFrame([(1, "a", "B1", "5", "x"), (2, "b", "B1", None, "1"), (3, "c", "", "bad", "2"), (4, "d", "B1", "-5", None), (5, "e", "B2", "bad", "bad")], "n int, cod string, nodo string, kw string, kvar string")
    mapping = LayerMapping("load", {"id": "cod", "bus_id": "nodo", "active_power_mw": "kw", "reactive_power_mvar": "kvar"}, {"active_power_mw": "kW", "reactive_power_mvar": "kvar"}, {"active_power_mw": 0.0, "reactive_power_mvar": 0.0, "in_service": True}, ("active_power_mw", "reactive_power_mvar"))
    rows, seen = observed(judge_layer(raw, mapping, "n"), mapping)
    got = {r["id"]: (r["outcome"], r["repairs"]) for r in rows.collect()}
    p, q = "active_power_mw", "reactive_power_mvar"
    assert got == {"a": ("accepted", [f"{q}: unreadable"]), "b": ("accepted", [f"{p}: missing"]), "c": ("skipped", []), "d": ("rejected", []), "e": ("accepted", [f"{p}: unreadable", f"{q}: unreadable"])}
    assert seen.get == {"accepted": 3, "skipped": 1, "rejected": 1, f"{p}: missing": 1, f"{p}: unreadable": 1, f"{q}: missing": 0, f"{q}: unreadable": 2}


def test_lengths_of_paths_and_nameless_sources(spark):
    raw = spark.createDataFrame([(1, "L1", "a", "b", "LINESTRING (0 0, 30 40)"), (2, "L2", "a", "b", None)], "n int, cod string, x string, y string, forma string")
    lines, bad = map_layer(raw, LayerMapping("line", {"id": "cod", "from_bus": "x", "to_bus": "y"}, defaults={"nominal_voltage_kv": 10.0, "in_service": True}, path="forma"), "n")
    assert [(r["id"], r["length_km"]) for r in lines.collect()] == [("L1", 0.05)] and [r["reason"] for r in bad.collect()] == ["length_km: missing or unreadable"]
    raw = spark.createDataFrame([(1, "G1", "N", "10"), (2, "G2", " ", "10"), (3, "G3", None, "10")], "n int, cod string, nombre string, kv string")
    named = LayerMapping("source", {"id": "cod", "name": "nombre", "bus_id": "cod", "nominal_voltage_kv": "kv"}, defaults={"in_service": True})
    assert [(r["id"], r["outcome"], r["reason"]) for r in judge_layer(raw, named, "n").orderBy("id").collect()] == [("G1", "accepted", None), ("G2", "skipped", "name: missing"), ("G3", "skipped", "name: missing")]
    plain = LayerMapping("source", {"id": "cod", "bus_id": "cod", "nominal_voltage_kv": "kv"}, defaults={"in_service": True})
    assert map_layer(raw, plain, "n")[0].count() == 3
    with pytest.raises(ValueError, match="gone"):
        map_layer(raw, LayerMapping("source", {"id": "gone"}), "n")


def test_lookup_tables(spark):
    rows = spark.createDataFrame([(1, "G"), (2, "D"), (3, "13.2"), (4, "Z"), (5, None)], "k int, code string")
    tables = {
        "volts": spark.createDataFrame([(1, "G", 20.0), (2, "G", 22.9), (3, "D", 10.0), (4, None, 5.0)], "row int, cod string, kv double"),
        "words": spark.createDataFrame([(1, "G", "x"), (2, "D", "y"), (3, "Z", "z")], "row int, cod string, text string"),
        "sales": spark.createDataFrame([(i, "GDZ"[i % 3], float(i)) for i in range(300)], "row int, cod string, amount double"),
        "other": spark.createDataFrame([(1, "A", 1.0), (2, "B", 2.0)], "row int, cod string, kv double"),
    }
    first = lookup.ranked_lookups(rows.select("code"), {n: t.drop("row") for n, t in tables.items()}).first()
    assert (first["table"], first["code"], first["value"]) == ("volts", "cod", "kv") and first["contained"] == pytest.approx(2 / 3)
    got = {r["k"]: r["found"] for r in lookup.looked_up(rows, "code", tables, "row").collect()}
    assert got == {1: 22.9, 2: 10.0, 3: 13.2, 4: None, 5: None}
    assert {r["found"] for r in lookup.looked_up(rows, "code", {"words": tables["words"]}, "row").collect()} == {13.2, None}


def test_span_lines(spark):
    ends = spark.createDataFrame([("P1", "from", 1.5, 0.0, "N1"), ("P1", "to", 98.5, 0.0, "N2"), ("P2", "from", 0.0, 0.0, "N1"), ("P2", "to", 1.0, 0.0, "N1"), ("P3", "from", 0.0, 0.0, "N1"), ("P3", "to", 9.0, 0.0, "N3")], "id string, side string, x double, y double, bus_id string")
    line = spark.createDataFrame([("P3",)], "id string")
    assert [tuple(r) for r in connect.span_lines(ends, line, 0.05).collect()] == [("P1", "N1", "N2", 0.097)]
    assert connect.span_lines(ends, line, 0.2).first()["length_km"] == 0.2


def test_many_points_of_one_cell(spark):
    """A tenth of all points in one place: the same candidates as by brute force."""
    places = [(f"b{i}", float(i % 40) * 7, float(i // 40) * 7) for i in range(400)] + [(f"c{i}", 70.0, 70.0) for i in range(40)]
    bus = spark.createDataFrame(places, "id string, x double, y double")
    points = spark.createDataFrame([("p", -3.0, -3.0), ("q", 70.5, 70.0), ("r", 60.0, 50.0), ("s", -100.0, 0.0)], "id string, x double, y double")
    got = sorted((r["id"], r["bus_id"]) for r in connect.within_radius(points, bus, 10.0).collect())
    want = sorted((p, b) for p, x, y in (("p", -3, -3), ("q", 70.5, 70), ("r", 60, 50), ("s", -100, 0)) for b, u, v in places if (x - u) ** 2 + (y - v) ** 2 <= 100)
    assert got == want
