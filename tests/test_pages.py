import random
from collections import defaultdict

import pytest

from gridloom.operators import diagrams, matching, packages
from gridloom.streaming import apply_to_stream


def test_positions(spark):
    bus = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, None), ("c", 10.0, 4.0), ("lost", None, None)], "id string, x double, y double")
    side = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "bus string, other string")
    got = {r["id"]: (r["x"], r["y"]) for r in diagrams.fill_positions(bus, side).collect()}
    assert got["b"] == (5.0, 2.0) and got["lost"][0] == 10.0 + diagrams.STEP_X and len(got) == 4


def test_positions_of_a_long_feeder(spark):
    bus = spark.createDataFrame([("b00", 3.0, 4.0), *((f"b{i:02}", None, None) for i in range(1, 56))], "id string, x double, y double")
    side = spark.createDataFrame([p for i in range(55) for p in ((f"b{i:02}", f"b{i + 1:02}"), (f"b{i + 1:02}", f"b{i:02}"))], "bus string, other string")
    got = {(r["x"], r["y"]) for r in diagrams.fill_positions(bus, side).collect()}
    assert got == {(3.0, 4.0)}


def test_lost_buses_have_their_own_spots(spark):
    bus = spark.createDataFrame([("a", 10.0, 4.0), *((f"z{i:04}", None, None) for i in range(1500))], "id string, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in diagrams.fill_positions(bus, spark.createDataFrame([], "bus string, other string")).collect()}
    assert len(got) == 1501 and all(got[f"z{i:04}"] == (10.0 + (i + 1) * diagrams.STEP_X, 4.0) for i in range(1500))


def test_levels(spark):
    side = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("a", "d"), ("d", "a")], "bus string, other string")
    depth = diagrams.levels(side, spark.createDataFrame([("p", "a")], "page string, bus string"))
    assert {r["bus"]: r["depth"] for r in depth.collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert {r["bus"]: (r["x"], r["y"]) for r in diagrams.level_layout(depth).collect()}["d"] == (80.0, 40.0)


def test_symbols(spark):
    bus = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 4.0)], "id string, x double, y double")
    line = spark.createDataFrame([("L", "a", "b")], "id string, from_bus string, to_bus string")
    load = spark.createDataFrame([("D", "b")], "id string, bus_id string")
    got = {(r["object_id"], r["part"]): (r["x"], r["y"]) for r in diagrams.symbols(bus, line, load).collect()}
    assert got["L", "middle"] == (1.0, 2.0) and got["D", "symbol"] == (2.0, 4.0) and len(got) == 6


@pytest.mark.parametrize(("names", "want"), [(["red_20240101.txt", "red_20240301.txt"], "red_20240301.txt"), (["red_20240101.txt", "red.txt"], "red.txt")])
def test_newest(spark, names, want):
    files = packages.with_tokens(spark.createDataFrame([(n,) for n in names], "name string"))
    assert [r["name"] for r in packages.newest_copies(files).collect()] == [want]


def test_packages(spark):
    files = packages.with_tokens(spark.createDataFrame([("p", "network", "red_20240101.txt"), ("p", "loads", "carga_20240101.txt"), ("q", "loads", "carga_20240101.txt"), ("q", "loads", "carga_20240201.txt")], "package string, role string, name string"))
    got = {r["package"]: (r["dates_agree"], r["score"]) for r in packages.assess(files).collect()}
    assert got == {"p": (True, 1.0), "q": (False, 0.2)}
    assert {r["name"] for r in packages.relevant(files, ("red",), ("foto",)).collect()} == {"red_20240101.txt"}


def test_roles(spark):
    tables = spark.createDataFrame([("Tramos_BT",), ("zzz",)], '"table" string'.replace('"', "`"))
    markers = spark.createDataFrame([("lines", "tramo"), ("buses", "nodo")], "role string, marker string")
    got = {r["table"]: r["role"] for r in matching.table_roles(tables, markers).collect()}
    assert got == {"Tramos_BT": "lines", "zzz": "unassigned"}


def test_precision(spark):
    rows = [("bus", "id", "t", "a"), ("bus", "name", "t", "b")]
    schema = "entity string, field string, `table` string, `column` string"
    got = matching.precision(spark.createDataFrame(rows[:1], schema), spark.createDataFrame(rows, schema)).first()
    assert (got["hits"], got["total"], got["precision"]) == (1, 2, 0.5)


def test_stream(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    apply_to_stream(stream, lambda df: df.where("id > 2"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_filters_on_tokens_read_a_name_once(spark):
    """Terms of a filter don't repeat the search for dates."""
    names = ["red_20241301.txt", "red_20240229.txt", "tramo 01.02.2024 b.csv", "carga_2024-13-01.txt", "foto_red_2024-01-01"]
    files = packages.with_tokens(spark.createDataFrame([(n,) for n in names], "name string"))
    assert [(r["stem"], r["token"]) for r in files.collect()] == [("red_20241301", None), ("red", "20240229"), ("tramo b", "20240201"), ("carga_2024-13-01", None), ("foto_red", "20240101")]
    plan = packages.relevant(files, ("red", "tramo"), ("foto",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\.[a-z]+[0-9]?$") == 1


def test_unmapped_reads_the_model_once(spark):
    from gridloom.operators import model

    rows = spark.sql("SELECT 'A' AS class, map('x', '1', 'y', '2') AS attributes, map('r', 'k') AS references UNION ALL SELECT 'B', map('z', '1'), map()")
    found = model.unmapped(rows, [model.ClassTable("A", "A", "FID(a:40)", "loc_name(a:40)", None, {"x": model.Value("x(r)")})])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("A", "attribute", "y", 1), ("A", "reference", "r", 1), ("B", "class", "", 1)}


def test_levels_of_many_pages(spark):
    """More pages than a number has bits, some with one root, against a plain search; a level of a block is one row for each bus."""
    rng = random.Random(7)
    pairs = [(f"b{rng.randrange(60):02}", f"b{rng.randrange(60):02}") for _ in range(70)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    roots = {f"p{i}": f"b{rng.randrange(60):02}" for i in range(140)}
    want = {}
    for page, root in roots.items():
        depth, now = {root: 0}, [root]
        while now:
            fresh = sorted({o for b in now for o in near[b]} - set(depth))
            depth |= {b: depth[now[0]] + 1 for b in fresh}
            now = fresh
        want |= {(page, b): (d, d * 80.0, sorted(o for o in depth if depth[o] == d).index(b) * 40.0) for b, d in depth.items()}
    side = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "bus string, other string")
    root = spark.createDataFrame(list(roots.items()), "page string, bus string")
    got = diagrams.placed_levels(side, root).collect()
    assert {(r["page"], r["bus"]): (r["depth"], r["x"], r["y"]) for r in got} == want and len(got) == len(want)
    reached, blocks = diagrams.level_blocks(side, root)
    assert blocks.count() == 140 and blocks.select("block").distinct().count() == 3
    assert reached.count() == reached.select("bus", "block", "depth").distinct().count() < len(want) / 3
