"""Shapes of columns, columns held in columns, and scores by them."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import scores, shapes


def _by_column(rows):
    return {r["column"]: r for r in rows.collect()}


def test_shapes_of_odd_columns(spark):
    df = spark.sql("SELECT * FROM VALUES (1, '1,5', DATE '2020-01-01', array(1)), (NULL, ' 2 ', NULL, NULL), (1, 'x', NULL, array()) AS t(`a b`, `c.d`, e, f)")
    got = _by_column(shapes.facts(shapes.shapes(df, "t")))
    facts = lambda c: tuple(got[c][k] for k in ("rows", "non_null", "figures", "low", "high", "distinct", "numeric", "dated"))
    assert facts("a b") == (3, 2, 2, 1.0, 1.0, 1, True, False)
    assert facts("c.d") == (3, 3, 2, 1.5, 2.0, 3, False, False)
    assert facts("e") == (3, 1, 0, None, None, 1, False, True)
    assert facts("f") == (3, 2, 0, None, None, 2, False, False)
    empty = _by_column(shapes.facts(shapes.shapes(df.where("false"), "t")))
    assert {(r["rows"], r["non_null"], r["distinct"]) for r in empty.values()} == {(0, 0, 0)}


def test_text_of_figures_is_numeric(spark):
    df = spark.sql("SELECT * FROM VALUES ('1', NULL), ('2,5', NULL) AS t(a, b)")
    got = _by_column(shapes.facts(shapes.shapes(df.withColumn("b", F.col("b").cast("string")), "t")))
    assert got["a"]["numeric"] and not got["b"]["numeric"]


def test_merged_parts_are_the_whole(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("t"), F.when(F.col("id") % 3 == 0, F.col("id") / 2).alias("v"))
    parts = [shapes.shapes(df.where(F.col("k") % 4 == i), "t") for i in range(4)]
    whole = shapes.merged(parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]))
    assert sorted(shapes.facts(whole).collect()) == sorted(shapes.facts(shapes.shapes(df, "t")).collect())


def test_sketch_error(spark):
    n = 300_000
    big = spark.range(n).select(F.col("id").alias("k"))
    part = spark.range(n // 3, n + n // 3).select(F.col("id").cast("string").alias("r"))  # two thirds of it lie in k
    both = shapes.shapes(big, "big").unionAll(shapes.shapes(part, "part")).cache()
    assert all(abs(r["distinct"] - n) < 0.02 * n for r in shapes.facts(both).collect())
    share = {(r["table"], r["in_table"]): r["share"] for r in shapes.contained(both, 0.5).collect()}
    assert share[("part", "big")] == pytest.approx(2 / 3, abs=0.02)
    assert shapes.contained(both, 0.9).isEmpty()


def test_contained_by_value_not_by_type(spark):
    a = spark.sql("SELECT * FROM VALUES ('1'), ('2.0'), ('x') AS t(ref)")
    b = spark.sql("SELECT * FROM VALUES (1, 'x', NULL), (2, 'y', NULL), (3, 'z', NULL) AS t(k, name, nothing)")
    rows = shapes.shapes(a, "a").unionAll(shapes.shapes(b, "b").drop("nothing"))
    got = {(r["column"], r["in_column"]): r["share"] for r in shapes.contained(rows, 0.3).where("table = 'a'").collect()}
    assert got == {("ref", "k"): pytest.approx(2 / 3), ("ref", "name"): pytest.approx(1 / 3)}


def test_exact_beyond_the_sketch(spark):
    """Counts and shares of more values than a sketch holds, and of equal values in other types."""
    n = 200_000
    big = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id") % 70_001).alias("t"))
    part = spark.range(n // 2, n + n // 20).select(F.col("id").cast("string").alias("r"), F.lit(None).cast("double").alias("nothing"))
    got = {(r["table"], r["column"]): r["distinct"] for r in shapes.facts(shapes.counted(big, "big").unionAll(shapes.counted(part, "part"))).collect()}
    assert got == {("big", "k"): n, ("big", "t"): 70_001, ("part", "r"): n // 2 + n // 20, ("part", "nothing"): 0}
    share = {(r["column"], r["in_column"]): r["share"] for r in shapes.contained_exactly({"big": big, "part": part}, 0.5).collect()}
    assert share == {("k", "r"): 0.5, ("r", "k"): (n // 2) / (n // 2 + n // 20)}
    wide = {f"w{i}": spark.range(50).select(*((F.col("id") + i).alias(f"c{j}") for j in range(40))) for i in range(2)}
    assert {r["share"] for r in shapes.contained_exactly(wide, 0.98).collect()} == {0.98, 1.0} and shapes.contained_exactly(wide, 0.98).count() == 80 * 79


def _facts(spark, tables):
    """Facts of tables given as {table: (rows, {column: (type, non_null, distinct)})}."""
    rows = [(t, c, i, kind, n, held, 0, None, None, distinct, kind == "double", kind == "date") for t, (n, cs) in tables.items() for i, (c, (kind, held, distinct)) in enumerate(cs.items())]
    return spark.createDataFrame(rows, "table string, column string, position int, type string, rows long, non_null long, figures long, low double, high double, distinct long, numeric boolean, dated boolean")


def test_field_scores(spark):
    facts = _facts(spark, {"t": (10, {"voltage_kv": ("double", 10, 2), "Tensión": ("string", 10, 2), "fecha": ("date", 9, 9), "nombre": ("string", 10, 4), "nodo_i": ("string", 0, 0), "este": ("double", 10, 10), "estado": ("string", 10, 2)})})
    got = {(r["entity"], r["field"], r["column"]): r["score"] for r in scores.field_scores(facts).collect()}
    assert got["lines", "nominal_voltage_kv", "voltage_kv"] == 1.0
    assert got["lines", "nominal_voltage_kv", "Tensión"] == pytest.approx(0.85)  # a text where figures are wanted
    assert got["lines", "name", "nombre"] == pytest.approx(0.4)  # names that repeat
    assert got["lines", "from_bus", "nodo_i"] == pytest.approx(0.05)  # empty
    assert got["buses", "x", "este"] == 1.0
    assert got["lines", "in_service", "estado"] == 1.0
    assert got["lines", "name", "fecha"] <= 0.05


def test_tables_and_mapping(spark):
    facts = _facts(spark, {
        "nodos": (100, {"codigo": ("string", 100, 100), "este": ("double", 100, 90), "norte": ("double", 100, 90), "kv": ("double", 100, 2)}),
        "puntos_x": (2, {"codigo": ("string", 2, 2), "este": ("double", 2, 2), "norte": ("double", 2, 2)}),
        "tramo_bt": (200_000, {"codtramo": ("string", 10, 10), "nodo_i": ("string", 10, 9), "nodo_f": ("string", 10, 9), "longitud": ("double", 10, 9), "kv": ("double", 10, 1)}),
        "generadores_nodo": (50, {"codigo": ("string", 50, 50)}),
    })
    found = scores.field_scores(facts)
    tables = scores.table_scores(facts, found)
    got = {(r["entity"], r["table"]): r for r in tables.collect()}
    assert got["buses", "nodos"]["fit"] and got["buses", "nodos"]["score"] == 1.0
    assert not got["buses", "generadores_nodo"]["fit"]
    assert got["buses", "puntos_x"]["score"] == pytest.approx(max(got["buses", "puntos_x"]["named"], 0.98))
    assert got["lines", "tramo_bt"]["fit"] and not got["lines", "nodos"]["fit"]
    ranked = scores.ranked_tables(tables)
    mapped = scores.mappings(ranked, found, 2)
    assert {r["column"] for r in mapped.where("entity = 'lines' AND candidate = 1").collect()} == {"codtramo", "nodo_i", "nodo_f", "longitud", "kv"}
    first = scores.objectives(mapped, facts, ranked).where("candidate = 1").first()
    assert first["types"] == 1.0 and first["compactness"] == pytest.approx(0.25)  # four times what is compact
    assert first["connectivity"] == pytest.approx(0.8)  # no feeder
    kept = {r["strategy"]: r for r in scores.strategy_scores(mapped.where("candidate = 1").select("entity", "field", "table", "column"), facts).collect()}
    assert set(kept) == {"full", "network_core", "compact_lines"}
    assert kept["network_core"]["compactness"] >= kept["full"]["compactness"] == pytest.approx(0.3)
