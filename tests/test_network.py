import inspect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import connect, objects, ranking, topology, validate
from gridloom.operators.components import connected_components
from gridloom.operators.mapping import LayerMapping, map_layer
from gridloom.sources import sectioned
from gridloom.sources.readers import Catalog, read_csv, read_geojson

EDGE = "key string, object_type string, object_id string, src string, dst string, conductive boolean"


def edges(spark, rows):
    return spark.createDataFrame([(f"{t}:{i}", t, i, a, b, True) for i, (t, a, b) in enumerate(rows) for i in [str(i)]], EDGE)


def network(spark, buses, rows, sources):
    bus = spark.createDataFrame([(b,) for b in buses], "id string")
    return bus, edges(spark, rows), spark.createDataFrame(sources, "source_id string, bus string")


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for p in pairs for x in p if p[0] != p[1]}
    for contract in (True, False):
        got = {r[0]: r[1] for r in connected_components(spark.createDataFrame([*pairs, (None, 1), (7, None)], "src long, dst long"), contract=contract).collect()}
        assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_islands(spark):
    bus, edge, sources = network(spark, ["B1", "B2", "B3"], [("line", "B1", "B2")], [("G", "B1")])
    facts = {r["component"]: r for r in topology.island_facts(topology.islands_of_buses(bus, edge), edge, sources).collect()}
    assert (facts["B1"]["bus_count"], facts["B1"]["energized"], facts["B1"]["radial"]) == (2, True, True)
    assert (facts["B3"]["bus_count"], facts["B3"]["energized"]) == (1, False)
    bus, edge, sources = network(spark, ["A", "B", "C"], [("line", "A", "B"), ("line", "B", "C"), ("line", "C", "A")], [])
    assert topology.island_facts(topology.islands_of_buses(bus, edge), edge, sources).first()["loop_count"] == 1


def test_parallel(spark):
    _, edge, _ = network(spark, ["A", "B"], [("line", "A", "B"), ("line", "B", "A")], [])
    assert topology.parallel_groups(edge).first()["keys"] == "line:0,line:1"


def test_feeder_stops(spark):
    bus, edge, sources = network(spark, ["B0", "B1", "B2", "B3"], [("line", "B0", "B1"), ("line", "B1", "B2"), ("transformer", "B2", "B3")], [("G", "B0")])
    f = topology.Feeders(bus, edge, sources)
    assert sorted(r["bus"] for r in f.buses().collect()) == ["B0", "B1", "B2"]
    assert "B2" in {r["bus"] for r in f.boundaries().collect()}
    bus, edge, sources = network(spark, ["B0", "B1", "B2", "B3"], [("line", "B0", "B1"), ("line", "B1", "B2"), ("line", "B2", "B3")], [("G", "B0"), ("H", "B2")])
    got = defaultdict(set)
    for r in topology.Feeders(bus, edge, sources).buses().collect():
        got[r["feeder"]].add(r["bus"])
    assert got["G|line:0"] == {"B0", "B1", "B2"}


def test_feeders_against_a_walk(spark):
    rng = random.Random(3)
    buses = [f"b{i}" for i in range(24)]
    rows = [(rng.choice(["line", "line", "transformer"]), *rng.sample(buses, 2)) for _ in range(30)]
    sources = [(f"s{i}", b) for i, b in enumerate(rng.sample(buses, 4))]
    bus, edge, src = network(spark, buses, rows, sources)
    f = topology.Feeders(bus, edge, src)
    stop = {b for _, b in sources}
    side = defaultdict(list)
    for i, (t, a, b) in enumerate(rows):
        if t == "line":
            side[a].append((b, f"{t}:{i}"))
            side[b].append((a, f"{t}:{i}"))
    want_bus, want_edge = set(), set()
    for s, at in sources:
        for root, key in side[at]:
            name, seen, todo = f"{s}|{key}", {root}, [root]
            want_edge.add((name, key))
            while todo:
                x = todo.pop()
                if x in stop:
                    continue
                for y, k in side[x]:
                    if y != at:
                        want_edge.add((name, k))
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
            want_bus |= {(name, b) for b in {*seen, at}}
    assert {(r["feeder"], r["bus"]) for r in f.buses().collect()} == want_bus
    assert {(r["feeder"], r["key"]) for r in f.edges().collect()} == want_edge


def test_branches(spark):
    bus, edge, _ = network(spark, list("ABCDEF"), [("line", "A", "B"), ("line", "B", "C"), ("line", "C", "D"), ("line", "C", "E")], [])
    none = spark.createDataFrame([], "bus string")
    found = topology.branches(edge, none)
    facts = topology.branch_facts(edge, found, none).collect()
    assert sorted((r["edge_count"], r["start_bus"], r["end_bus"]) for r in facts) == [(1, "C", "D"), (1, "C", "E"), (2, "A", "C")]
    ring = edges(spark, [("line", "A", "B"), ("line", "B", "C"), ("line", "C", "A")])
    loop = topology.branch_facts(ring, topology.branches(ring, none), none).collect()
    assert [(r["edge_count"], r["closed"]) for r in loop] == [(3, True)]


def test_labels_go_to_the_nearest(spark):
    edge = edges(spark, [("line", "a", "b"), ("line", "b", "c"), ("line", "c", "d"), ("line", "x", "y")])
    got = {r["bus"]: r["label"] for r in topology.propagate_labels(edge, spark.createDataFrame([("a", "F2"), ("d", "F1"), ("x", "F9")], "bus string, label string")).collect()}
    assert got == {"a": "F2", "b": "F2", "c": "F1", "d": "F1", "x": "F9", "y": "F9"}


def test_labels_have_no_last_round():
    assert "rounds" not in inspect.signature(topology.propagate_labels).parameters


def test_mapping(spark):
    raw = spark.createDataFrame([(1, "1", "A", "B", "120,5", None), (2, "1.0", "A", "B", "10", None), (3, "3", "A", "A", "10", None), (4, "4", None, "B", "10", None), (5, "5", "A", "B", "x", None), (6, "1", "Z", "B", "1", None)], "n int, cod string, desde string, hasta string, m string, extra string")
    mapping = LayerMapping("line", {"id": "cod", "from_bus": "desde", "to_bus": "hasta", "length_km": "m"}, {"length_km": "m"}, {"nominal_voltage_kv": 10.0, "in_service": True})
    good, bad = map_layer(raw, mapping, "n")
    row = good.collect()
    assert [(r["id"], r["from_bus"], r["length_km"], r["name"]) for r in row] == [("1", "A", pytest.approx(0.1205), "1")]
    assert {(r["row_id"], r["reason"]) for r in bad.collect()} == {("2", "id: duplicate"), ("3", "self_loop"), ("4", "from_bus: missing or unreadable"), ("5", "length_km: missing or unreadable")}
    with pytest.raises(ValueError, match="unknown fields"):
        LayerMapping("line", {"color": "c"})
    with pytest.raises(ValueError, match="not in the layer"):
        map_layer(raw, LayerMapping("bus", {"id": "nope"}), "n")


def test_spatial(spark):
    bus = spark.createDataFrame([("N1", 0.0, 0.0), ("N2", 100.0, 0.0), ("N3", 100.0, 1.0)], "id string, x double, y double")
    ends = spark.createDataFrame([("L", "from", 1.5, 0.0), ("L", "to", 100.0, 0.5), ("M", "from", 50.0, 50.0)], "id string, side string, x double, y double")
    near = connect.within_radius(ends, bus, 2.0)
    assert {(r["id"], r["side"]): r["bus_id"] for r in connect.resolve(near, ["id", "side"], 0.1).collect()} == {("L", "from"): "N1", ("L", "to"): None}
    snapped, made = connect.snap_spans(ends, bus, 2.0)
    assert {(r["id"], r["side"]): r["bus_id"] for r in snapped.collect()} == {("L", "from"): "N1", ("L", "to"): "N2", ("M", "from"): "GEO_50_50"}
    assert [r["id"] for r in made.collect()] == ["GEO_50_50"]


def test_chain(spark):
    points = spark.createDataFrame([("F1", "P1", 1, 0.0, 0.0), ("F1", "P2", 2, 100.0, 0.0), ("F1", "P2b", 3, 100.0, 0.0), ("F1", "P3", 4, 200.0, 0.0), ("F2", "Q", 1, 0.0, 0.0)], "feeder string, id string, seq int, x double, y double")
    chains = connect.chain(points)
    assert [(r["feeder"], r["id"], r["at"]) for r in chains.orderBy("place").collect()] == [("F1", "P1", 0.0), ("F1", "P2", 100.0), ("F1", "P3", 200.0)]
    creeping = spark.createDataFrame([("F", f"p{i}", i, i * 4e-7, 0.0) for i in range(9)], "feeder string, id string, seq int, x double, y double")
    assert [r["id"] for r in connect.chain(creeping).orderBy("place").collect()] == ["p0", "p3", "p6"]
    tree = connect.preorder(spark.createDataFrame([("F1", "T2", "T1"), ("F1", "T1", None), ("F1", "X", "Y"), ("F1", "Y", "X")], "feeder string, id string, parent string"))
    assert [r["id"] for r in tree.orderBy("place").collect()] == ["T1", "T2", "X", "Y"]
    segments = spark.createDataFrame([("F1", "T1", 1, 100.0), ("F1", "T2", 2, 100.0)], "feeder string, id string, place int, length double")
    assert {r["id"]: (r["from_bus"], r["to_bus"]) for r in connect.assign_to_chain(chains, segments).collect()} == {"T1": ("P1", "P2"), "T2": ("P2", "P3")}


def test_unique_names(spark):
    rows = spark.createDataFrame([("L", "p", "1", "n"), ("L", "p", "2", "n"), ("L", "p", "3", "2"), ("L", "q", "4", "n"), ("L", "p", "5", "1_2"), ("L", "p", "6", "a:b")], "class string, parent string, id string, name string")
    got = {(r["parent"], r["id"]): r["name"] for r in objects.unique_names(rows).collect()}
    assert got == {("p", "1"): "1", ("p", "2"): "2", ("p", "3"): "3", ("q", "4"): "n", ("p", "5"): "1_2", ("p", "6"): "a_b"}


def test_reports(spark):
    rows = spark.createDataFrame([("A2", "WARNING", "x", "t", "1", ""), ("A1", "ERROR", "x", "t", "1", ""), ("A1", "ERROR", "x", "t", "2", "")], ", ".join(f"{c} string" for c in validate.ISSUE))
    assert [r["code"] for r in validate.in_order(rows, 2).collect()] == ["A1", "A1"]
    assert {(r["by"], r["value"]): r["n"] for r in validate.counts(rows).collect()}[("severity", "ERROR")] == 2


def test_pareto_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, *(float(rng.randrange(12)) for _ in range(3))) for i in range(400)]
    want = {r[0] for r in rows if not any(all(o >= m for o, m in zip(q[1:], r[1:], strict=True)) and q[1:] != r[1:] for q in rows)}
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    assert {r["k"] for r in ranking.pareto_front(df, "k", ["a", "b", "c"]).collect()} == want
    ranks = {r["k"]: r["front"] for r in ranking.front_ranks(df.where("k < 60"), "k", ["a", "b"]).collect()}
    assert len(ranks) == 60 and min(ranks.values()) == 1


def test_greedy(spark):
    rng = random.Random(6)
    rows = [(f"l{i}", f"r{j}", float(rng.randrange(9))) for i in range(8) for j in range(7)]
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = ranking.greedy_assignment(spark.createDataFrame(rows, "l string, r string, score double"), "l", "r").collect()
    assert {(r["l"], r["r"]) for r in got} == want


def test_sectioned_text(spark, tmp_path):
    text = ["[GENERAL]", "DATE=2026", "[HEADNODES]", "FORMAT_HEADNODES=NodeID,NetworkID", "NODE_A,NET_A", "NODE_D,NET_B", "[SECTION]", "FEEDER=NET_A", "FORMAT_SECTION=SectionID,FromNodeID", "SEC_AB,NODE_A,long", "FEEDER=NET_B", "FORMAT_SECTION=FromNodeID,SectionID", "NODE_D", "[LOST]", "no,format"]
    (tmp_path / "net.txt").write_text("\n".join(text))
    lines = sectioned.read_lines(spark, str(tmp_path))
    context = sectioned.in_context(lines)
    parsed = sectioned.rows(context)
    got = {(r["feeder"], r["SectionID"], r["FromNodeID"]) for r in sectioned.section(parsed, "SECTION", ["SectionID", "FromNodeID"]).collect()}
    assert got == {("NET_A", "SEC_AB", "NODE_A"), ("NET_B", None, "NODE_D")}
    assert sectioned.section(parsed, "LOST", ["no"]).count() == 0
    assert sectioned.header(context).first()["entries"] == {"DATE": "2026"}
    assert {r["value"] for r in sectioned.column_values(parsed, "HEADNODES", "NetworkID").collect()} == {"NET_A", "NET_B"}


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert read_csv(spark, str(tmp_path / "t.tsv")).collect()[0]["b"] == "x"
    (tmp_path / "f.geojson").write_text('{"features": [{"properties": {"id": "1"}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}}, {"properties": {"id": "2"}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}')
    got = {r["properties"]["id"]: [tuple(p) for p in r["points"]] for r in read_geojson(spark, str(tmp_path / "f.geojson")).collect()}
    assert got == {"1": [(0.0, 1.0), (2.0, 3.0)], "2": [(5.0, 6.0)]}
    c = Catalog()
    c.add("t", spark.range(1))
    with pytest.raises(ValueError, match="there already"):
        c.add("t", spark.range(2))
    assert c.merge(Catalog({"t": spark.range(3)}), "union")["t"].agg(F.count("*")).first()[0] == 4


def test_resolve_within_is_resolve(spark):
    rng = random.Random(5)
    at = lambda n, c: spark.createDataFrame([(f"{c}{i}", float(rng.randrange(60)), float(rng.randrange(60))) for i in range(n)], "id string, x double, y double")
    bus, points = at(150, "b"), at(200, "p").unionAll(spark.createDataFrame([("far", 900.0, 900.0)], "id string, x double, y double"))
    want = connect.resolve(connect.within_radius(points, bus, 6.0), ["id"], 0.5).collect()
    got = connect.resolve_within(points, bus, 6.0, ["id"], 0.5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and any(r["bus_id"] is None for r in got) and any(r["bus_id"] for r in got)


def test_radius_queries_run_on_one_field(spark):
    """Buses past the first field lie among the others, so that they have them as candidates."""
    from gridloom.plans.testbed import _dense_place, _place

    far = spark.range(20000, 20001)
    x = lambda place: far.selectExpr(place("id", "0").split(" AS x")[0] + " AS x").first()[0]
    assert x(_dense_place) < 10007 <= x(_place)


def test_unstopped_feeders_lay_out_no_more_than_they_reach(spark, monkeypatch):
    """Five stars that only transformers join: a source's feeders are laid out on its own star, not on the island."""
    rows = [("line", f"s{i}", f"a{i}{j}") for i in range(5) for j in range(4)] + [("transformer", "n", f"s{i}") for i in range(5)]
    bus, edge, sources = network(spark, [], rows, [(f"g{i}", f"s{i}") for i in range(5)])
    labels = spark.createDataFrame([(b, "a") for b in {x for r in rows for x in r[1:]}], "bus string, component string")
    seen = []
    whole = topology.joined
    monkeypatch.setattr(topology, "joined", lambda e, *a, **k: seen.append(e.count()) or whole(e, *a, **k))
    got = {tuple(r) for r in topology.unstopped_feeders(labels, edge, sources).collect()}
    assert got == {(f"g{i}|line:{i * 4 + j}", b) for i in range(5) for j in range(4) for b in (f"s{i}", f"a{i}{j}")}
    assert sum(seen) <= 20


def test_feeder_buses_are_not_shuffled_again(spark):
    rows = [("line", "s", "a"), ("line", "a", "b"), ("line", "s", "t"), ("line", "b", "t"), ("line", "b", "s")]
    bus, edge, sources = network(spark, "sabt", rows, [("g", "s"), ("h", "t")])
    found = topology.Feeders(bus, edge, sources.unionAll(sources)).buses()
    assert "Aggregate [feeder" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and {b for f, b in got if f == "g|line:0"} == set("sabt")
