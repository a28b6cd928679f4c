"""Queries over coordinates of raw rows, spans, detected columns, and the network's reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import coordinates as P
from gridloom.functions import geometry
from gridloom.operators import connect
from gridloom.operators import topology as T
from gridloom.plans.graph import _ALL, _C, _LIVE, _S, _W, SQL as GRAPH_SQL, Net, _feeder
from gridloom.plans.joins import TOLERANCE, _SPAN, _spans
from gridloom.plans.testbed import Grid, with_grid

_RAW = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat(CAST(o_orderkey AS VARCHAR(20)), ',25') WHEN 2 THEN concat('Nodo: X- ', CAST(o_orderkey AS VARCHAR(20)), ' Y- 8') WHEN 3 THEN 'abc' WHEN 5 THEN '7' END AS x,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN concat('x: ', CAST(o_orderkey AS VARCHAR(20)), '; y: 9.5') WHEN 2 THEN concat('Nodo: X- ', CAST(o_orderkey AS VARCHAR(20)), ' Y- 8') WHEN 3 THEN '5' END AS y,
 CASE WHEN o_orderkey % 12 = 4 THEN 'POINT (1 2)' END AS wkt, CASE WHEN o_orderkey % 24 = 10 THEN 'X: 3, Y: 4' END AS geometria,
 CAST(o_orderkey % 50 AS VARCHAR(20)) AS x_1, CAST(o_custkey % 70 AS VARCHAR(20)) AS y_1, CASE WHEN o_orderkey % 9 = 0 THEN 'n/d' ELSE concat(CAST(o_orderkey % 30 AS VARCHAR(20)), ',5') END AS x_2, '12' AS y_2,
 CAST(o_orderkey AS VARCHAR(20)) AS codtramo, CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN concat(CAST(o_custkey AS VARCHAR(20)), ' - RAMAL') ELSE CAST(o_custkey AS VARCHAR(20)) END AS codtramopadre, concat('A', CAST(o_custkey % 9 AS VARCHAR(20))) AS alimentador, 'x' AS zona FROM {orders}"""


def _raw(spark, sf_dir):
    return spark.sql(_RAW, orders=Grid(spark, sf_dir).table("orders"))


def place_resolved(spark, sf_dir):
    """The point of every row, by the order of what it may come from, and why there is none."""
    raw = _raw(spark, sf_dir)
    path = geometry.path_from_wkt(F.col("wkt"))
    point = F.when(F.size(path) > 0, F.struct(path[0]["x"].alias("x"), path[0]["y"].alias("y")))
    at, problem = P.resolve_point(F.col("x"), F.col("y"), point, [F.col(c) for c in P.place_columns(raw.columns)])
    return raw.select("k", at.alias("p"), problem.alias("problem")).select("k", "p.x", "p.y", "problem")


def place_mapped(spark, sf_dir):
    rows = P.with_points(_raw(spark, sf_dir), "x", "y")
    return rows.select("k", "point.x", "point.y")


def place_spans(spark, sf_dir):
    rows = P.with_spans(_raw(spark, sf_dir))
    return rows.where("points IS NOT NULL").select("k", F.round(geometry.path_length(F.col("points")), 6).alias("length"))


def place_layers(spark, sf_dir):
    """Both kinds of layers at once: how many rows of each have got a place."""
    raw = _raw(spark, sf_dir)
    out = P.materialise({"nodes": raw.select("k", "x", "y"), "lines": raw.select("k", "x_1", "y_1", "x_2", "y_2"), "other": raw.select("k")}, buses=("nodes", "x", "y"), lines="lines")
    return out["nodes"].agg(F.count("*").alias("n"), F.count("point").alias("placed")).select(F.lit("nodes").alias("layer"), "*").unionAll(out["lines"].agg(F.count("*"), F.count("points")).select(F.lit("lines"), "*"))


def place_metric(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return P.in_metres(g.bus, "x", "y", "id").select(F.lit("bus").alias("layer"), "metric").unionAll(P.in_metres(g.bus.select("id", (F.col("x") / 1e6).alias("x"), "y").withColumn("y", F.col("x")), "x", "y", "id").select(F.lit("small"), "metric"))


def hierarchy_detected(spark, sf_dir):
    """Ends of segments by the parent and feeder columns that the layer's column names give away."""
    raw = _raw(spark, sf_dir)
    catalog = spark.createDataFrame([("raw", c, i) for i, c in enumerate(raw.columns)], "table string, column string, position int")
    mapping = spark.createDataFrame([("raw", "from_bus", "zona"), ("raw", "to_bus", "nowhere"), ("raw", "id", "codtramo")], "table string, field string, column string")
    fields = {r["field"]: r["column"] for r in P.sound_endpoints(mapping, catalog).collect()}  # a row for each mapped column
    _, parent, feeder = P.column_roles(catalog).first()
    from gridloom.functions.normalize import parent_reference

    none = F.lit(None).cast("string")
    start, end = connect.hierarchical_ends(F.col(fields["id"]), parent_reference(F.col(parent)), F.col(feeder), *(F.col(fields[r]) if r in fields else none for r in ("from_bus", "to_bus")))
    return raw.select("k", start.alias("from_bus"), end.alias("to_bus"))


def report_connectivity(spark, sf_dir):
    """What each unresolved end of a line may be: its candidates by distance."""
    g = Grid(spark, sf_dir)
    return connect.suggestions(connect.within_radius(_spans(g), g.bus, TOLERANCE), ["id", "side"], 2.0).select("id", "side", "n", F.to_json("candidates").alias("candidates"))


def graph_report(spark, sf_dir):
    """How many rows each part of the whole topology report has."""
    g = Grid(spark, sf_dir)
    out = None
    for name, df in T.report(g.bus, g.line, g.transformer, g.switch, g.source).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionAll(part)
    return out


def graph_radial(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.is_radial(T.island_sums(n.labels, n.edge, n.sources))


def graph_edges_within(spark, sf_dir):
    """Edges inside the energised part, also those that don't conduct."""
    n = Net(spark, sf_dir)
    return T.edges_within(n.edge, T.energized(n.labels, n.sources))


def graph_edges_all(spark, sf_dir):
    """All branch elements, those out of service too."""
    g = Grid(spark, sf_dir)
    return T.edges(g.line, g.transformer, g.switch, out_of_service=True).groupBy("object_type", "conductive").agg(F.count("*").alias("n"))


def graph_feeder_facts(spark, sf_dir):
    n = Net(spark, sf_dir)
    return T.Feeders(n.bus, n.edge, n.sources).facts(n.bus)


def graph_feeder_unstopped(spark, sf_dir):
    """Feeders that other sources don't stop."""
    n = Net(spark, sf_dir)
    return T.unstopped_feeders(None, n.edge, n.sources)


def graph_inventory(spark, sf_dir):
    """Whether the grid, and the grid with a bus made from geometry and no feeders, is a geometry inventory."""
    bus = Grid(spark, sf_dir).bus
    made = bus.select(F.concat(F.lit("GEO_"), "id").alias("id"), F.lit(None).cast("string").alias("feeder_id"))
    return T.geometry_inventory(bus).select(F.lit("grid").alias("name"), "inventory").unionAll(T.geometry_inventory(made).select(F.lit("made"), "inventory"))


QUERIES = {f.__name__: f for f in (place_resolved, place_mapped, place_spans, place_layers, place_metric, hierarchy_detected, report_connectivity, graph_report, graph_radial, graph_edges_within, graph_edges_all, graph_feeder_facts, graph_feeder_unstopped, graph_inventory)}

_R = "WITH raw_ AS (" + _RAW.replace("{", "").replace("}", "") + ") "
_X = "CASE k % 6 WHEN 0 THEN k + 0.25 WHEN 1 THEN k WHEN 2 THEN k ELSE {0} END::DOUBLE"
_Y = "CASE k % 6 WHEN 0 THEN y::DOUBLE WHEN 1 THEN 9.5 WHEN 2 THEN 8 ELSE {0} END::DOUBLE"
_ELSE = "CASE WHEN wkt IS NOT NULL THEN {0} WHEN geometria IS NOT NULL THEN {1} END"
_parts = {
    "islands": "(SELECT DISTINCT component FROM lab)", "traces": "src", "feeders": "root", "branches": "brn", "parallel": "(SELECT 1 FROM wire GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) > 1)", "boundaries": "(SELECT 1 FROM switch WHERE in_service AND NOT closed)",
    "overlaps": "(SELECT bus FROM fbus WHERE bus NOT IN (SELECT bus FROM stop) GROUP BY 1 HAVING count(*) > 1)", "energized": "live", "deenergized": "(SELECT id FROM bus WHERE id NOT IN (SELECT bus FROM live))",
}
_BRN = GRAPH_SQL["graph_branches"].split("shape AS", 1)[1].rsplit("SELECT branch", 1)[0]
_FEED = _feeder(False).split(", src AS", 1)[1].split("), ", 1)[1]
SQL = {
    "place_resolved": _R + f"SELECT k, {_X.format(_ELSE.format(1, 3))} AS x, {_Y.format(_ELSE.format(2, 4))} AS y, CASE k % 6 WHEN 3 THEN 'unreadable' WHEN 5 THEN 'one-sided' END AS problem FROM raw_",
    "place_mapped": _R + f"SELECT k, {_X.format('NULL')} AS x, {_Y.format('NULL')} AS y FROM raw_",
    "place_spans": _R + "SELECT k, round(sqrt((k % 50 - (k % 30 + 0.5)) ** 2 + (y_1::DOUBLE - 12) ** 2), 6) AS length FROM raw_ WHERE k % 9 <> 0",
    "place_layers": _R + "SELECT 'nodes' AS layer, count(*) AS n, count(CASE WHEN k % 6 < 3 THEN 1 END) AS placed FROM raw_ UNION ALL SELECT 'lines', count(*), count(CASE WHEN k % 9 <> 0 THEN 1 END) FROM raw_",
    "place_metric": with_grid("SELECT 'bus' AS layer, max(greatest(abs(x), abs(y))) > 1000 AS metric FROM (SELECT * FROM bus ORDER BY id LIMIT 25) UNION ALL SELECT 'small', FALSE", "bus"),
    "hierarchy_detected": _R + "SELECT k, CASE WHEN p IN ('0', codtramo) THEN alimentador ELSE p END AS from_bus, codtramo AS to_bus FROM (SELECT *, regexp_replace(codtramopadre, ' - .*', '') AS p FROM raw_)",
    "report_connectivity": with_grid("+" + _SPAN + """, many AS (SELECT id, side FROM near GROUP BY 1, 2 HAVING count(*) > 1 AND min(CASE WHEN r = 2 THEN distance END) - min(distance) <= 2)
SELECT id, side, count(*) AS n, '[' || string_agg('{"bus_id":"' || bus_id || '","distance_m":' || printf('%.3f', round(distance, 3)) || '}', ',' ORDER BY r) || ']' AS candidates FROM near JOIN many USING (id, side) GROUP BY 1, 2""", "bus", "line"),
    "graph_report": with_grid("+" + _C + _S + _LIVE + ", " + _FEED + ", shape AS" + _BRN.replace("inner_", "plain_") + ", brn AS (SELECT DISTINCT branch FROM mem) " + " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n FROM {v}" for k, v in _parts.items()), *_ALL),
    "graph_radial": with_grid("+" + _C + _S + ", isl AS (" + "SELECT component, count(*) AS n FROM lab GROUP BY 1), ne AS (SELECT component, count(*) AS e FROM wire JOIN lab ON bus = src GROUP BY 1) SELECT coalesce(bool_and(coalesce(e, 0) = n - 1), FALSE) AS radial FROM isl LEFT JOIN ne USING (component) WHERE component IN (SELECT component FROM lab JOIN src USING (bus))", *_ALL),
    "graph_edges_within": with_grid("+" + _C + _S + _LIVE + " SELECT object_type, object_id, key FROM edge WHERE src IN (SELECT bus FROM live) AND dst IN (SELECT bus FROM live)", *_ALL),
    "graph_edges_all": with_grid("SELECT 'line' AS object_type, in_service AS conductive, count(*) AS n FROM line GROUP BY 2 UNION ALL SELECT 'transformer', in_service, count(*) FROM transformer GROUP BY 2 UNION ALL SELECT 'switch', in_service AND closed, count(*) FROM switch GROUP BY 2", "line", "transformer", "switch"),
    "graph_feeder_facts": with_grid("+" + _feeder(False) + " SELECT feeder, n_buses, n_edges, n_edges >= n_buses AS has_cycle, feeder_id AS label FROM (SELECT feeder, count(*) AS n_buses FROM fbus GROUP BY 1) JOIN (SELECT feeder, count(*) AS n_edges FROM fedge GROUP BY 1) USING (feeder) JOIN root USING (feeder) LEFT JOIN bus ON id = root", *_ALL),
    "graph_feeder_unstopped": with_grid("+" + _feeder(False).replace("w.bus NOT IN (SELECT bus FROM stop) AND a.other <> r.source_bus", "a.other <> r.source_bus") + " SELECT feeder, bus FROM fbus", *_ALL),
    "graph_inventory": with_grid("SELECT 'grid' AS name, FALSE AS inventory FROM (SELECT count(*) FROM bus) UNION ALL SELECT 'made', TRUE", "bus"),
}
