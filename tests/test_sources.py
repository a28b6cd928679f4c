"""Readers, kinds of input, reports, libraries, coordinates and proposals on small files."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gridloom.functions import coordinates, normalize
from gridloom.operators import library, model, objects, proposal, topology, validate
from gridloom.sources import readers


def test_geojson_of_many_parts(spark, tmp_path):
    shapes = {"a": ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), "b": ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), "c": ("Point", [5, 6]), "d": ("MultiPolygon", [[[[0, 0], [1, 0], [0, 0]]], [[[7, 7], [8, 7], [7, 7]]]])}
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [{"properties": {"id": k}, "geometry": {"type": t, "coordinates": c}} for k, (t, c) in shapes.items()] + [{"properties": {"id": "e"}, "geometry": None}]}))
    got = {r["properties"]["id"]: r for r in readers.read_geojson(spark, str(tmp_path / "f.geojson")).collect()}
    assert {k: [len(p) for p in r["parts"]] for k, r in got.items() if r["parts"]} == {"a": [2, 2], "b": [4], "c": [1], "d": [3, 3]}
    assert got["e"]["parts"] is None and len(got["d"]["points"]) == 6
    layers = readers.read_layers(spark, {"one": str(tmp_path / "f.geojson"), "two": str(tmp_path / "f.geojson")})
    assert list(layers) == ["one", "two"] and layers["two"].count() == 5


def test_xml_layers(spark, tmp_path):
    (tmp_path / "f.kml").write_text("<kml><Document><Placemark><name>P</name><Point><coordinates>1,2,0</coordinates></Point></Placemark><Placemark><name>L</name><LineString><coordinates> 0,0 3,4 </coordinates></LineString></Placemark></Document></kml>")
    got = {r["name"]: [tuple(p) for p in r["points"]] for r in readers.read_kml(spark, str(tmp_path / "f.kml")).collect()}
    assert got == {"P": [(1.0, 2.0)], "L": [(0.0, 0.0), (3.0, 4.0)]}
    (tmp_path / "f.gml").write_text("<set xmlns:g='x'><g:row><g:id>7</g:id><g:geom><g:LineString><g:posList>0 0 3 4</g:posList></g:LineString></g:geom></g:row></set>")
    row = readers.read_gml(spark, str(tmp_path / "f.gml"), "row", "geom", "id string").first()
    assert row["id"] == "7" and [tuple(p) for p in row["points"]] == [(0.0, 0.0), (3.0, 4.0)]


def test_kinds_of_input(spark, tmp_path):
    rows = [("postgresql://h/db", ""), ("mssql+pyodbc://h", ""), ("a/b.GeoJSON", ""), ("x.pq", ""), ("n.txt", "[GENERAL] CYMDIST_VERSION=4"), ("n.txt", "[IMPORT MODE]"), ("n.txt", "hello"), ("noname", "SQLite format 3"), ("noname", "TAPE.."), ("q.sql", "")]
    df = spark.createDataFrame(rows, "uri string, head string").select(readers.input_kind(F.col("uri"), F.col("head")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["database", "database", "vector", "parquet", "text", "settings", "unknown", "database", "backup", "script"]
    for name, text in (("b.csv", "a"), ("A.tsv", "a"), ("net.txt", "[GENERAL]\nVERSION=1"), ("notes.txt", "x"), ("output/c.csv", "a")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = readers.detectable(readers.manifest(spark, str(tmp_path)))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["A.tsv", "b.csv", "net.txt"]


def test_database(spark):
    """An embedded database, where the session has its driver."""
    url = "jdbc:derby:memory:grid;create=true"
    try:
        spark.range(10).select(F.col("id").cast("int").alias("K"), F.lit("LINESTRING (0 0, 3 4)").alias("G")).write.format("jdbc").option("url", url).option("dbtable", "T").save()
    except Exception as error:  # noqa: BLE001
        pytest.skip(f"no embedded database: {type(error).__name__}")
    assert readers.read_jdbc(spark, url, "T", split=("K", 0, 10, 3)).agg(F.sum("K")).first()[0] == 45
    row = readers.read_jdbc_geometry(spark, url, "SELECT K, G FROM T WHERE K = 3", "G").first()
    assert [tuple(p) for p in row["points"]] == [(0.0, 0.0), (3.0, 4.0)]
    with pytest.raises(ValueError, match="a table or a query"):
        readers.read_jdbc(spark, url)


def test_points(spark):
    good, bad = readers.read_points(spark.createDataFrame([("1", "2"), ("x", "2"), (None, "1")], "x string, y string"))
    assert [tuple(r) for r in good.collect()] == [(1.0, 2.0)] and bad.count() == 2
    with pytest.raises(ValueError, match="no column"):
        readers.read_points(spark.range(1))


def test_written_reports(spark, tmp_path):
    rows = spark.createDataFrame([(f"A{i}", "ERROR", "x", "t", str(i), "") for i in range(7)], ", ".join(f"{c} string" for c in validate.ISSUE))
    readers.write_issues(rows, str(tmp_path), 5)
    assert spark.read.json(f"{tmp_path}/report").count() == 5 and spark.read.parquet(f"{tmp_path}/issues").count() == 7
    assert spark.read.json(f"{tmp_path}/summary").first()["truncated"] is True
    objects.write_tables({"A": spark.range(2), "General": model.general(spark, "6.0")}, str(tmp_path), known=("A", "General"))
    assert spark.read.csv(f"{tmp_path}/General", header=True).first()["Val(a:40)"] == "6.0"
    with pytest.raises(ValueError, match="no table"):
        objects.write_tables({"B": spark.range(2)}, str(tmp_path), known=("A",))


def test_library(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps({"line_types": [{"id": "T", "name": "n", "nominal_voltage_kv": 10, "r1_ohm_per_km": 1, "x1_ohm_per_km": 0, "rated_current_a": 5}, {"id": "U", "name": "n", "nominal_voltage_kv": 10, "r1_ohm_per_km": 1, "x1_ohm_per_km": 0, "rated_current_a": 5, "r0_ohm_per_km": 1}]}))
    line, trafo = library.read_library(spark, str(tmp_path / "lib.json"))
    assert [tuple(r) for r in library.bad_line_types(line).collect()] == [("U", "zero_sequence")] and trafo.count() == 0
    (tmp_path / "bad.json").write_text(json.dumps({"line_types": [{"id": "T", "colour": 1}]}))
    with pytest.raises(ValueError, match="colour"):
        library.read_library(spark, str(tmp_path / "bad.json"))


def test_column_names(spark):
    tables = {"a": ["x", "CodTramoBTPadre", "Padre", "CodSalidaBT", "Salida2"], "b": ["a"], "c": ["mi_origen", "su_origen", "Alimentador"], "d": ["Bus 1", "Segmento Padre"]}
    catalog = spark.createDataFrame([(t, c, i) for t, names in tables.items() for i, c in enumerate(names)], "table string, column string, position int")
    got = {r[0]: r[1:] for r in coordinates.column_roles(catalog).collect()}
    assert got == {"a": ("CodTramoBTPadre", "CodSalidaBT"), "b": (None, None), "c": ("su_origen", "Alimentador"), "d": ("Bus 1", None)}
    names = spark.createDataFrame([("t", "A", 0), ("t", "Distrito", 1), ("t", "Nodo", 2)], "table string, column string, position int")
    fields = spark.createDataFrame([("t", "from_bus", "Distrito"), ("t", "to_bus", "gone"), ("t", "id", "A"), ("u", "from_bus", "Nodo"), ("t", "to_bus", "Nodo")], "table string, field string, column string")
    assert sorted(map(tuple, coordinates.sound_endpoints(fields, names).collect())) == [("t", "id", "A"), ("t", "to_bus", "Nodo")]
    assert coordinates.span_columns(["X 1", "y1", "X2", "Y-2", "z"]) == ("X 1", "y1", "X2", "Y-2") and coordinates.span_columns(["x1"]) is None


def test_numbers_and_names(spark):
    values = ["12d", "7f", "1,5", " 1 234.5 ", "1e3", "-.5", "nan", "inf", "0x1", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(normalize.number(F.col("v")).alias("n"))
    assert [r["n"] for r in df.collect()] == [None, None, 1.5, 1234.5, 1000.0, -0.5, None, float("inf"), None, None]


def test_similarity(spark):
    pairs = [("tramo", "tramos"), ("nodo", "barra"), ("abc", "abd"), ("key", "xkeyy")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", proposal.lexical_score(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r["a"]: r["s"] for r in got} == pytest.approx({"tramo": 0.72 + 0.2 * 5 / 6, "nodo": SequenceMatcher(None, "nodo", "barra").ratio(), "abc": SequenceMatcher(None, "abc", "abd").ratio(), "key": 0.68 + 0.24 * 3 / 5})


def test_compact_lines(spark):
    mapping = spark.createDataFrame([("lines", "id", "big_tramo", "id"), ("lines", "name", "big_tramo", "label"), ("loads", "id", "c", "id"), ("buses", "id", "b", "id")], "entity string, field string, `table` string, `column` string")
    catalog = lambda rows: spark.createDataFrame(rows, "`table` string, `column` string, `rows` long, non_null long")
    big = [("big_tramo", "id", 60_000, 1), ("big_tramo", "label", 60_000, 1)]
    run = lambda rows: {tuple(r) for r in proposal.apply_strategy(mapping, catalog(rows), "compact_lines").collect()}
    assert run([*big, ("line_mt", "id", 10, 1)]) == {("lines", "id", "line_mt", "id"), ("buses", "id", "b", "id")}
    assert run(big) == {("lines", "id", "big_tramo", "id"), ("lines", "name", "big_tramo", "label"), ("buses", "id", "b", "id")}
    assert len(run([("big_tramo", "id", 6, 1)])) == 4
    with pytest.raises(ValueError, match="unknown strategy"):
        proposal.apply_strategy(mapping, catalog(big), "none")


def test_models_of_two_parts(spark):
    row = ("ElmNet", "k", "n", None, "network", "k", {}, {})
    one = spark.createDataFrame([row], "class string, key string, name string, parent string, source_kind string, source_id string, attributes map<string,string>, references map<string,string>")
    with pytest.raises(ValueError, match="key k"):
        model.union_of([one, one])
    with pytest.raises(ValueError, match="no table takes"):
        model.tables(one, [model.ClassTable("ElmLne", "ElmLne", "a", "b")])


def test_islands_past_four_digits(spark):
    bus = spark.range(10_050).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("bus")).withColumn("component", F.col("bus"))
    edge = spark.createDataFrame([], "key string, object_type string, object_id string, src string, dst string, conductive boolean")
    ids = [r["island_id"] for r in topology.island_facts(bus, edge, spark.createDataFrame([], "source_id string, bus string")).orderBy("component").collect()]
    assert ids[0] == "ISLAND_0001" and ids[9_999] == "ISLAND_10000" and len(set(ids)) == 10_050


def test_feeder_heads_fall_back(spark):
    bus = spark.createDataFrame([("b", None), ("a", None), ("c", None)], "id string, feeder_id string")
    line = spark.createDataFrame([("b", "c")], "from_bus string, to_bus string")
    none = spark.createDataFrame([], "id string, bus_id string")
    assert [r["bus"] for r in topology.feeder_heads(bus, line, none).collect()] == ["b"]
    assert [r["bus"] for r in topology.feeder_heads(bus, line.where("false"), none).collect()] == ["a"]
    trafo = spark.createDataFrame([], "hv_bus string, lv_bus string")
    assert {r["bus"]: r["feeder"] for r in topology.feeder_membership(bus, line, trafo, none).collect()} == {"a": topology.ORPHAN, "b": "b", "c": "b"}
    made = spark.createDataFrame([("GEO_1_1", None, 10.0), ("x", None, 10.0)], "id string, feeder_id string, nominal_voltage_kv double")
    assert [r["id"] for r in topology.equivalent_sources(made, line, none).collect()] == ["x"]


def test_whole_database(spark):
    url = "jdbc:derby:memory:whole;create=true"
    try:
        for name, n in (("NODES", 10), ("SPANS", 25), ("BLANK", 0)):
            spark.range(n).select(F.col("id").cast("int").alias("K"), (F.col("id") * 2).alias("V")).write.format("jdbc").option("url", url).option("dbtable", name).mode("overwrite").save()
    except Exception as error:
        if "driver" not in str(error).lower() and "ClassNotFound" not in str(error):
            raise
        pytest.skip("no embedded database")
    assert readers.database_tables(spark, url, "APP") == ["BLANK", "NODES", "SPANS"]
    whole = readers.read_database(spark, url, "APP", split={"SPANS": ("K", 4), "BLANK": ("K", 4)})
    assert {t: whole[t].count() for t in whole} == {"SPANS": 25, "NODES": 10, "BLANK": 0}
    assert whole["SPANS"].rdd.getNumPartitions() == 4 and whole["SPANS"].agg(F.sum("V")).first()[0] == 600
    some = readers.read_database(spark, url, "APP", ["NODES"], {"NODES": "buses"})
    assert list(some) == ["buses"]
    with pytest.raises(ValueError, match="WIRES"):
        readers.read_database(spark, url, "APP", ["WIRES"])
