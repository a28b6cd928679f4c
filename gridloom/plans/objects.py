"""Queries over the object model, class tables, electrical quantities and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import electrical, geometry
from gridloom.operators import objects as O
from gridloom.operators import validate as V
from gridloom.plans.testbed import Grid, with_grid


def obj_folders(spark, sf_dir):
    return O.network_folders(Grid(spark, sf_dir).bus)


def obj_terminals(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return O.terminals(g.bus, g.substation)


def obj_lines(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return O.element_folders(g.line, g.bus, "from_bus").select(O.object_key("line", F.col("id")).alias("key"), "parent", O.object_key("type", F.col("type_id")).alias("type"), F.round("length_km", 6).alias("length_km"), (~F.col("in_service")).cast("int").alias("outserv"))


def obj_cubicles(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return O.cubicles({"line": (g.line, "from_bus", "to_bus"), "transformer": (g.transformer, "hv_bus", "lv_bus"), "switch": (g.switch, "from_bus", "to_bus")}, {"load": (g.load, "bus_id"), "source": (g.source, "bus_id"), "generator": (g.generator, "bus_id")})


def _named(g):
    """Loads under the segment of their customer as parent, with names that many share."""
    o = g.table("orders")
    return o.select(F.lit("ElmLod").alias("class"), F.concat(F.lit("P"), (F.col("o_custkey") % 20).cast("string")).alias("parent"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0").alias("id"), F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("Own "), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderpriority")).alias("name"))


def obj_unique_names(spark, sf_dir):
    return O.unique_names(_named(Grid(spark, sf_dir)))


def rule_pfm(spark, sf_dir):
    """Names that stand twice in (class, parent) before they are made unique."""
    return V.duplicate_keys(_named(Grid(spark, sf_dir)), ["class", "parent", "name"], "PFM003", "object")


def rule_tables(spark, sf_dir):
    """References of cubicles to terminals that are not in the terminals' table."""
    g = Grid(spark, sf_dir)
    cub = obj_cubicles(spark, sf_dir)
    return V.issue(cub.join(O.terminals(g.bus, g.substation).select(F.col("key").alias("parent")), "parent", "left_anti"), "DGS004", "ERROR", "objects", "cubicle", "key", F.col("parent"))


def table_lines(spark, sf_dir):
    g = Grid(spark, sf_dir)
    rows = O.element_folders(g.line, g.bus, "from_bus")
    return O.class_table(rows, [("FID(a:40)", O.object_key("line", F.col("id"))), ("loc_name(a:40)", O.safe_name(F.col("name"))), ("fold_id(p)", F.col("parent")), ("dline(r)", F.round("length_km", 6)), ("outserv(i)", (~F.col("in_service")).cast("int"))])


def summary_objects(spark, sf_dir):
    return obj_cubicles(spark, sf_dir).groupBy("object_type").agg(F.count("*").alias("n"))


def elec_line_impedance(spark, sf_dir):
    g = Grid(spark, sf_dir)
    lt = g.line_type.select(F.col("id").alias("type_id"), "r1_ohm_per_km", "x1_ohm_per_km", "c1_nf_per_km")
    z = electrical.line_impedance(F.col("r1_ohm_per_km"), F.col("x1_ohm_per_km"), F.col("length_km"))
    return g.line.join(lt, "type_id").select("id", F.round(z["r"], 6).alias("r_ohm"), F.round(z["x"], 6).alias("x_ohm"), F.round(electrical.line_capacitance(F.col("c1_nf_per_km"), F.col("length_km")), 6).alias("c_nf"))


def elec_transformer_sc(spark, sf_dir):
    g = Grid(spark, sf_dir)
    tt = g.transformer_type.select(F.col("id").alias("type_id"), "uk_percent", "copper_loss_kw", F.col("rated_power_mva").alias("s"))
    r = electrical.resistance_percent(F.col("copper_loss_kw"), F.col("s"))
    rows = g.transformer.join(tt, "type_id").withColumn("r", r).withColumn("x", electrical.reactance_percent(F.col("uk_percent"), F.col("r")))
    return rows.select("id", F.round("r", 6).alias("r_percent"), F.round("x", 6).alias("x_percent"), F.round(electrical.base_impedance(F.col("hv_voltage_kv"), F.col("s")), 6).alias("z_base_hv"), F.round(electrical.short_circuit_impedance(F.col("uk_percent"), F.col("lv_voltage_kv"), F.col("s")), 6).alias("z_sc_lv"))


def _pages(g):
    bus = g.bus
    return bus.withColumn("page", F.coalesce("system_id", F.lit("ORPHAN")))


def diagram_fit(spark, sf_dir):
    fitted = O.fit_to_page(_pages(Grid(spark, sf_dir)).select("page", "id", "x", "y"))
    return fitted.select("page", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def diagram_layout_choice(spark, sf_dir):
    g = Grid(spark, sf_dir)
    a = _pages(g).select("page", F.col("id").alias("from_bus"), "x", "y")
    b = g.bus.select(F.col("id").alias("to_bus"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    edge = g.line.join(a, "from_bus").join(b, "to_bus").select("page", geometry.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("length"))
    return O.layout_choice(edge).select("page", F.round("median", 6).alias("median"), "layout")


def diagram_parents(spark, sf_dir):
    g = Grid(spark, sf_dir)
    member = g.line.select(F.col("type_id").alias("page"), F.col("from_bus").alias("bus"))
    return O.diagram_parents(member, g.bus)


QUERIES = {f.__name__: f for f in (obj_folders, obj_terminals, obj_lines, obj_cubicles, obj_unique_names, rule_pfm, rule_tables, table_lines, summary_objects, elec_line_impedance, elec_transformer_sc, diagram_fit, diagram_layout_choice, diagram_parents)}

_FOLD = "CASE WHEN system_id IS NULL THEN 'GRID:net:GRID' ELSE 'GRID:net:' || system_id END"
_CUB = "cub AS (" + " UNION ALL ".join(f"SELECT '{k}' AS object_type, id AS object_id, {i} AS index, {r} AS bus FROM {k}" for k, rs in (("line", ("from_bus", "to_bus")), ("transformer", ("hv_bus", "lv_bus")), ("switch", ("from_bus", "to_bus")), ("load", ("bus_id",)), ("source", ("bus_id",)), ("generator", ("bus_id",))) for i, r in enumerate(rs)) + "), cubs AS (SELECT 'GRID:cub:' || object_type || '_' || object_id || '_' || index AS key, 'GRID:bus:' || bus AS parent, object_type, object_id, index FROM cub)"
_ELS = ("line", "transformer", "switch", "load", "source", "generator")
_NAMED = "obj AS (SELECT 'ElmLod' AS class, concat('P', o_custkey % 20) AS parent, lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS id, CASE WHEN o_totalprice > 400000 THEN 'Own ' || o_orderkey ELSE o_orderpriority END AS name FROM orders)"
_PAGE = "pg AS (SELECT *, coalesce(system_id, 'ORPHAN') AS page FROM bus)"
SQL = {
    "obj_folders": with_grid("SELECT DISTINCT 'GRID:net:' || system_id AS key, system_id AS name FROM bus WHERE system_id IS NOT NULL UNION ALL SELECT 'GRID:net:GRID', 'GRID'", "bus"),
    "obj_terminals": with_grid(f"SELECT 'GRID:bus:' || b.id AS key, b.id, b.name, CASE WHEN s.id IS NOT NULL THEN 'GRID:sub:' || s.id ELSE {_FOLD} END AS parent, nominal_voltage_kv FROM bus b LEFT JOIN substation s ON s.id = substation_id", "bus", "substation"),
    "obj_lines": with_grid(f"SELECT 'GRID:line:' || l.id AS key, {_FOLD} AS parent, 'GRID:type:' || type_id AS type, round(length_km, 6) AS length_km, CAST(NOT in_service AS INTEGER) AS outserv FROM line l LEFT JOIN bus b ON b.id = from_bus", "bus", "line"),
    "obj_cubicles": with_grid("+" + _CUB + " SELECT * FROM cubs", *_ELS),
    "obj_unique_names": f"WITH {_NAMED} SELECT class, parent, id, CASE WHEN count(*) OVER (PARTITION BY class, parent, name) > 1 THEN id ELSE name END AS name FROM obj",
    "rule_pfm": f"WITH {_NAMED} SELECT 'PFM003' AS code, 'ERROR' AS severity, 'objects' AS category, 'object' AS object_type, class || '/' || parent || '/' || name AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM obj GROUP BY class, parent, name HAVING count(*) > 1",
    "rule_tables": with_grid("+" + _CUB + " SELECT 'DGS004' AS code, 'ERROR' AS severity, 'objects' AS category, 'cubicle' AS object_type, key AS object_id, parent AS detail FROM cubs WHERE parent NOT IN (SELECT 'GRID:bus:' || id FROM bus)", "bus", *_ELS),
    "table_lines": with_grid(f"SELECT 'GRID:line:' || l.id AS \"FID(a:40)\", l.name AS \"loc_name(a:40)\", {_FOLD} AS \"fold_id(p)\", round(length_km, 6) AS \"dline(r)\", CAST(NOT in_service AS INTEGER) AS \"outserv(i)\" FROM line l LEFT JOIN bus b ON b.id = from_bus", "bus", "line"),
    "summary_objects": with_grid("+" + _CUB + " SELECT object_type, count(*) AS n FROM cubs GROUP BY 1", *_ELS),
    "elec_line_impedance": with_grid("SELECT l.id, round(r1_ohm_per_km * length_km, 6) AS r_ohm, round(x1_ohm_per_km * length_km, 6) AS x_ohm, round(c1_nf_per_km * length_km, 6) AS c_nf FROM line l JOIN line_type t ON t.id = l.type_id", "line", "line_type"),
    "elec_transformer_sc": with_grid("SELECT id, round(r, 6) AS r_percent, round(sqrt(uk_percent * uk_percent - r * r), 6) AS x_percent, round(hv * hv / s, 6) AS z_base_hv, round(uk_percent / 100 * lv * lv / s, 6) AS z_sc_lv FROM (SELECT e.id, t.copper_loss_kw / (t.rated_power_mva * 1000) * 100 AS r, uk_percent, e.hv_voltage_kv AS hv, e.lv_voltage_kv AS lv, t.rated_power_mva AS s FROM transformer e JOIN transformer_type t ON t.id = e.type_id)", "transformer", "transformer_type"),
    "diagram_fit": with_grid(f"+{_PAGE}, box AS (SELECT page, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM pg GROUP BY 1) SELECT page, id, round((x - x0) * CASE WHEN s > 4000 THEN 4000 / s ELSE 1 END, 6) AS x, round((y - y0) * CASE WHEN s > 4000 THEN 4000 / s ELSE 1 END, 6) AS y FROM pg JOIN box USING (page)", "bus"),
    "diagram_layout_choice": with_grid(f"+{_PAGE}, e AS (SELECT a.page, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM line JOIN pg a ON a.id = from_bus JOIN bus b ON b.id = to_bus), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM e) SELECT page, round(d, 6) AS median, CASE WHEN d < 20 THEN 'topology' ELSE 'gis' END AS layout FROM r WHERE i = n // 2", "bus", "line"),
    "diagram_parents": with_grid("SELECT type_id AS page, CASE WHEN count(DISTINCT system_id) = 1 THEN 'GRID:net:' || min(system_id) ELSE 'GRID:net:GRID' END AS parent FROM line JOIN bus b ON b.id = from_bus GROUP BY 1", "bus", "line"),
}
