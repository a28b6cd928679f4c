"""Queries that join assets: missing buses, codes, types, places, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import connect, lookup, model
from gridloom.plans.testbed import DENSE_BUS, GRID, Grid, with_grid

TOLERANCE, TIE = 60.0, 2.0
DEFAULT_KV = 22.9


def _spans(g: Grid, bus=None):
    """Ends of spans: each line's ends near, but not on, the places of its buses."""
    b = (g.bus if bus is None else bus).select(F.col("id").alias("bus"), "x", "y")
    shift = (F.substring("id", 2, 18).cast("long") % 7).cast("double") * 25.0 - 75.0
    line = g.line.withColumn("shift", shift)
    a = line.select("id", F.lit("from").alias("side"), F.col("from_bus").alias("bus"), "shift").unionAll(line.select("id", F.lit("to"), F.col("to_bus"), -F.col("shift")))
    return a.join(b, "bus").select("id", "side", (F.col("x") + F.col("shift")).alias("x"), "y")


def join_missing_endpoints(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return connect.missing_ends(g.line, g.bus, DEFAULT_KV, g.tasks("orders", "customer"))


def join_placeholder_buses(spark, sf_dir):
    """Buses for every id that an element refers to and no bus has, with the largest voltage that refers to it."""
    g = Grid(spark, sf_dir)
    kv = lambda c: F.col(c) if isinstance(c, str) else F.lit(c)
    asked = lambda df, *ends: df.select(F.explode(F.array(*(F.struct(F.col(bus).alias("id"), kv(c).alias("kv")) for bus, c in ends))).alias("e")).select("e.id", "e.kv")
    line, transformer = (("from_bus", "nominal_voltage_kv"), ("to_bus", "nominal_voltage_kv")), (("hv_bus", "hv_voltage_kv"), ("lv_bus", "lv_voltage_kv"))
    refs = asked(g.line, *line).unionAll(asked(g.transformer, *transformer)).unionAll(asked(g.switch, ("from_bus", DEFAULT_KV), ("to_bus", DEFAULT_KV)))
    refs = refs.unionAll(asked(g.load, ("bus_id", DEFAULT_KV))).unionAll(asked(g.source, ("bus_id", "nominal_voltage_kv"))).unionAll(asked(g.generator, ("bus_id", DEFAULT_KV)))
    return connect.unheld(refs, g.bus, F.max("kv"), g.tasks("orders", "customer", "supplier")).withColumnRenamed("value", "nominal_voltage_kv")


def join_voltage_code(spark, sf_dir):
    """Codes looked up in a table of voltage codes derived from the nations; later rows of a code win."""
    g = Grid(spark, sf_dir)
    codes = g.table("nation").select(F.concat(F.lit("K"), (F.col("n_nationkey") % 10).cast("string")).alias("code"), (F.col("n_nationkey") * 1.5 + 6).alias("kv"), F.col("n_nationkey").alias("row"))
    codes = codes.groupBy("code").agg(F.max_by("kv", "row").alias("kv"))
    rows = g.table("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.lit("13.2")).otherwise(F.concat(F.lit("K"), (F.col("c_custkey") % 12).cast("string"))).alias("code"))
    return rows.join(codes, "code", "left").select("k", F.round(F.coalesce(F.col("code").try_cast("double"), "kv"), 6).alias("kv"))


def join_voltage_detected(spark, sf_dir):
    """Codes looked up in the table that explains them best, among others that hold the codes or figures too."""
    g = Grid(spark, sf_dir)
    code = lambda c, n: F.concat(F.lit("K"), (F.col(c) % n).cast("string"))
    tables = {
        "tensiones": g.table("nation").select(F.col("n_nationkey").alias("row"), code("n_nationkey", 10).alias("cod"), (F.col("n_nationkey") * 1.5 + 6).alias("valor"), F.col("n_name").alias("nombre")),
        "zonas": g.table("nation").select(F.col("n_nationkey").alias("row"), code("n_nationkey", 12).alias("cod"), F.col("n_name").alias("nombre")),
        "saldos": g.table("supplier").select(F.col("s_suppkey").alias("row"), code("s_suppkey", 12).alias("cod"), F.col("s_acctbal").alias("saldo")),
        "partes": g.table("part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("marca"), F.col("p_size").alias("kv")),
    }
    rows = g.table("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.lit("13.2")).otherwise(code("c_custkey", 12)).alias("code"))
    return lookup.looked_up(rows, "code", tables, "row").select("k", F.round("found", 6).alias("kv"))


def join_nearest_line_type(spark, sf_dir):
    """Type of every line: its own if known, else the nearest voltage within 0.5 kV, else a synthetic type."""
    g = Grid(spark, sf_dir)
    kv = F.when(F.substring("id", 2, 18).cast("long") % 3 == 0, 10.3).when(F.substring("id", 2, 18).cast("long") % 7 == 0, 33.0).otherwise(F.col("nominal_voltage_kv"))
    return model.line_types(g.line.withColumn("nominal_voltage_kv", kv), g.line_type).select("id", "type_id")


def join_spatial_radius(spark, sf_dir):
    """All buses around each end, in a field that gets denser with the tables: the rows grow with their square."""
    g = Grid(spark, sf_dir)
    return connect.within_radius(_spans(g, g.dense_bus), g.dense_bus, TOLERANCE).select("id", "side", "bus_id", F.round("distance", 6).alias("distance"))


def join_spatial_resolved(spark, sf_dir):
    g = Grid(spark, sf_dir)
    found = connect.resolve_within(_spans(g, g.dense_bus), g.dense_bus, TOLERANCE, ["id", "side"], TIE)
    bare = g.line.select("id", F.lit(None).cast("string").alias("from_bus"), F.lit(None).cast("string").alias("to_bus"))
    return connect.apply_ends(bare, found)


def join_span_snap(spark, sf_dir):
    g = Grid(spark, sf_dir)
    ends, _ = connect.snap_spans(_spans(g), g.bus, TOLERANCE)
    return ends.select("id", "side", "bus_id", "created")


def join_span_lines(spark, sf_dir):
    """Lines for the spans of those lines that are out of service, beside the lines in service."""
    g = Grid(spark, sf_dir)
    ends, _ = connect.snap_spans(_spans(g), g.bus, TOLERANCE)
    return connect.span_lines(ends, g.line.where("in_service"), 0.05).withColumn("length_km", F.round("length_km", 6))


def join_snapped_buses(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return connect.snap_spans(_spans(g), g.bus, TOLERANCE)[1]


_SEGMENTS = """SELECT concat('F', CAST(o_custkey AS VARCHAR(20))) AS feeder, lpad(CAST(o_orderkey AS VARCHAR(20)), 15, '0') AS id, CASE WHEN up IS NULL THEN '0' ELSE lpad(CAST(up AS VARCHAR(20)), 15, '0') END AS parent, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 40 + 10 AS DOUBLE) END AS length
 FROM (SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS up FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) b ON b.o_custkey = a.o_custkey AND b.n = a.n DIV 2)"""
_POINTS = """SELECT concat('F', CAST(o_custkey AS VARCHAR(20))) AS feeder, concat(lpad(CAST(o_orderkey AS VARCHAR(20)), 15, '0'), '-', CAST(l_linenumber AS VARCHAR(5))) AS id, n * 10 + l_linenumber AS seq, CAST(n * 30 AS DOUBLE) AS x, CAST(n % 2 * 40 AS DOUBLE) AS y
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem}) ON l_orderkey = o_orderkey"""


def _segments(g: Grid):
    """A hierarchy of segments for each customer, whose orders make a binary tree."""
    return g.spark.sql(_SEGMENTS, orders=g.table("orders"))


def hierarchy_endpoints(spark, sf_dir):
    g = Grid(spark, sf_dir)
    s = _segments(g)
    start, end = connect.hierarchical_ends(F.col("id"), F.col("parent"), F.col("feeder"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return s.select("id", start.alias("from_bus"), end.alias("to_bus"))


def hierarchy_order(spark, sf_dir):
    return connect.preorder(_segments(Grid(spark, sf_dir)))


def _points(g: Grid):
    """Points of a customer's chain: the items of an order stand at one place."""
    return g.spark.sql(_POINTS, orders=g.dealt("orders", "o_custkey"), lineitem=g.dealt("lineitem", "l_orderkey"))


def chain_points(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return connect.chain(_points(g), g.tasks("lineitem")).select("feeder", "place", "id", F.round("at", 6).alias("run_at"))


def _assigned(g):
    segment = connect.settle(_segments(g).join(connect.preorder(_segments(g)).select("feeder", "id", "place"), ["feeder", "id"]))
    chains = connect.settle(connect.chain(_points(g), g.tasks("lineitem")))
    return chains, segment, connect.assign_to_chain(chains, segment)


def chain_assign(spark, sf_dir):
    return _assigned(Grid(spark, sf_dir))[2]


def chain_totals(spark, sf_dir):
    return connect.chain_counts(*_assigned(Grid(spark, sf_dir)))


def join_sections_found(spark, sf_dir):
    """How many of the loads' buses are buses of the lines."""
    g = Grid(spark, sf_dir)
    held = g.line.select(F.explode(F.array("to_bus", "from_bus")).alias("bus_id"))
    both = connect.held_of(g.load.select("bus_id"), held, "bus_id", g.tasks("orders", "customer"))
    found = F.count(F.when(F.col("hit"), 1))
    return both.agg(F.count("*").alias("n_asked"), found.alias("n_found"), F.round(found / F.count("*"), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (join_missing_endpoints, join_placeholder_buses, join_voltage_code, join_voltage_detected, join_nearest_line_type, join_spatial_radius, join_spatial_resolved, join_span_snap, join_snapped_buses, join_span_lines, hierarchy_endpoints, hierarchy_order, chain_points, chain_assign, chain_totals, join_sections_found)}

_SPAN = """shifted AS (SELECT *, CAST(CAST(substr(id, 2) AS BIGINT) % 7 AS DOUBLE) * 25 - 75 AS shift FROM line),
span AS (SELECT s.id, 'from' AS side, x + shift AS x, y FROM shifted s JOIN bus b ON b.id = from_bus UNION ALL SELECT s.id, 'to', x - shift, y FROM shifted s JOIN bus b ON b.id = to_bus),
tile AS (SELECT id, x, y, unnest([floor(x / 60) - 1, floor(x / 60), floor(x / 60) + 1]) AS i FROM bus), tiles AS (SELECT *, unnest([floor(y / 60) - 1, floor(y / 60), floor(y / 60) + 1]) AS j FROM tile),
cand AS (SELECT s.id, side, b.id AS bus_id, sqrt((s.x - b.x) * (s.x - b.x) + (s.y - b.y) * (s.y - b.y)) AS distance FROM span s JOIN tiles b ON floor(s.x / 60) = b.i AND floor(s.y / 60) = b.j),
near AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second FROM cand WHERE distance <= 60 WINDOW w AS (PARTITION BY id, side ORDER BY distance, bus_id))"""
_SNAP = _SPAN + ", snap AS (SELECT s.id, s.side, s.x, s.y, coalesce(bus_id, 'GEO_' || CAST(CAST(round_even(s.x, 0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(round_even(s.y, 0) AS BIGINT) AS VARCHAR)) AS bus_id, bus_id IS NULL AS created FROM span s LEFT JOIN (SELECT * FROM near WHERE r = 1) n ON n.id = s.id AND n.side = s.side)"
_SEG = "seg AS (" + _SEGMENTS.replace("{orders}", "orders").replace("a.n DIV 2", "a.n // 2") + ")"
_ORD = _SEG + ", pre(feeder, id, path) AS (SELECT feeder, id, [id] FROM seg WHERE parent = id OR parent NOT IN (SELECT id FROM seg) UNION ALL SELECT s.feeder, s.id, list_append(p.path, s.id) FROM pre p JOIN seg s ON s.parent = p.id AND s.feeder = p.feeder AND s.parent <> s.id), ord AS (SELECT feeder, id, row_number() OVER (PARTITION BY feeder ORDER BY path) AS place, len(path) - 1 AS depth FROM pre)"
_CHAIN = "pt AS (" + _POINTS.replace("{orders}", "orders").replace("{lineitem}", "lineitem") + """),
kept AS (SELECT feeder, min(id) AS id, min(seq) AS seq, x, y FROM pt GROUP BY feeder, x, y),
step AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM kept WINDOW w AS (PARTITION BY feeder ORDER BY seq)),
chain AS (SELECT feeder, place, id, sum(d) OVER (PARTITION BY feeder ORDER BY place) AS run_at, count(*) OVER (PARTITION BY feeder) AS n FROM step)"""
SQL = {
    "join_missing_endpoints": with_grid("SELECT id, CAST(22.9 AS DOUBLE) AS nominal_voltage_kv FROM (SELECT from_bus AS id FROM line UNION SELECT to_bus FROM line) WHERE id NOT IN (SELECT id FROM bus)", "bus", "line"),
    "join_placeholder_buses": with_grid("""SELECT id, max(kv) AS nominal_voltage_kv FROM (SELECT from_bus AS id, nominal_voltage_kv AS kv FROM line UNION ALL SELECT to_bus, nominal_voltage_kv FROM line UNION ALL SELECT hv_bus, hv_voltage_kv FROM transformer UNION ALL SELECT lv_bus, lv_voltage_kv FROM transformer
UNION ALL SELECT from_bus, 22.9 FROM switch UNION ALL SELECT to_bus, 22.9 FROM switch UNION ALL SELECT bus_id, 22.9 FROM load UNION ALL SELECT bus_id, nominal_voltage_kv FROM source UNION ALL SELECT bus_id, 22.9 FROM generator) WHERE id NOT IN (SELECT id FROM bus) GROUP BY id""", "bus", "line", "transformer", "switch", "load", "source", "generator"),
    "join_voltage_code": "SELECT k, round(coalesce(try_cast(code AS DOUBLE), kv), 6) AS kv FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '13.2' ELSE concat('K', c_custkey % 12) END AS code FROM customer) LEFT JOIN (SELECT concat('K', n_nationkey % 10) AS code, arg_max(n_nationkey * 1.5 + 6, n_nationkey) AS kv FROM nation GROUP BY 1) USING (code)",
    "join_voltage_detected": "SELECT k, round(coalesce(try_cast(code AS DOUBLE), kv), 6) AS kv FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '13.2' ELSE concat('K', c_custkey % 12) END AS code FROM customer) LEFT JOIN (SELECT concat('K', n_nationkey % 10) AS code, arg_max(n_nationkey * 1.5 + 6, n_nationkey) AS kv FROM nation GROUP BY 1) USING (code)",
    "join_nearest_line_type": with_grid("""SELECT l.id, coalesce((SELECT t.id FROM line_type t WHERE t.id = l.type_id), (SELECT arg_min(t.id, (abs(t.nominal_voltage_kv - l.kv), t.id)) FROM line_type t WHERE abs(t.nominal_voltage_kv - l.kv) <= 0.5), 'FALLBACK_33kV') AS type_id
FROM (SELECT id, type_id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN 10.3::DOUBLE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 0 THEN 33.0::DOUBLE ELSE nominal_voltage_kv END AS kv FROM line) l""", "line", "line_type"),
    "join_spatial_radius": with_grid("+" + _SPAN + " SELECT id, side, bus_id, round(distance, 6) AS distance FROM near", "bus", "line").replace(GRID["bus"], DENSE_BUS),
    "join_spatial_resolved": with_grid("+" + _SPAN + ", ok AS (SELECT id, side, bus_id FROM near WHERE r = 1 AND (second IS NULL OR second - distance > 2)) SELECT id, max(CASE WHEN side = 'from' THEN bus_id END) AS from_bus, max(CASE WHEN side = 'to' THEN bus_id END) AS to_bus FROM line LEFT JOIN ok USING (id) GROUP BY id", "bus", "line").replace(GRID["bus"], DENSE_BUS),
    "join_span_snap": with_grid("+" + _SNAP + " SELECT id, side, bus_id, created FROM snap", "bus", "line"),
    "join_span_lines": with_grid("+" + _SNAP + " SELECT a.id, a.bus_id AS from_bus, b.bus_id AS to_bus, round(greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1000, 0.05), 6) AS length_km FROM snap a JOIN snap b USING (id) JOIN line l USING (id) WHERE a.side = 'from' AND b.side = 'to' AND a.bus_id <> b.bus_id AND NOT l.in_service", "bus", "line"),
    "join_snapped_buses": with_grid("+" + _SNAP + " SELECT bus_id AS id, min((x, y))[1] AS x, min((x, y))[2] AS y FROM snap WHERE created GROUP BY 1", "bus", "line"),
    "hierarchy_endpoints": f"WITH {_SEG} SELECT id, CASE WHEN parent IN ('0', '') OR parent = id THEN feeder ELSE parent END AS from_bus, id AS to_bus FROM seg",
    "hierarchy_order": f"WITH RECURSIVE {_ORD} SELECT feeder, id, place::INTEGER AS place, depth::INTEGER AS depth FROM ord",
    "chain_points": f"WITH {_CHAIN} SELECT feeder, place::INTEGER AS place, id, round(run_at, 6) AS run_at FROM chain WHERE n >= 2",
    "chain_assign": f"""WITH RECURSIVE {_ORD}, {_CHAIN}, tot AS (SELECT feeder, max(run_at) AS path, max(n) - 1 AS last FROM chain WHERE n >= 2 GROUP BY 1),
len_ AS (SELECT s.feeder, s.id, o.place, path, last, coalesce(length, path / count(*) OVER (PARTITION BY s.feeder)) AS l FROM seg s JOIN ord o USING (feeder, id) JOIN tot USING (feeder)),
run AS (SELECT *, sum(l) OVER (PARTITION BY feeder ORDER BY place ROWS UNBOUNDED PRECEDING) AS r FROM len_), ft AS (SELECT feeder, id, place, path, last, least(path, r) AS t, least(path, r - l) AS f FROM run),
n1 AS (SELECT ft.*, CASE WHEN f <= 0 THEN 0 WHEN f >= path THEN last ELSE (SELECT arg_min(c.place, (abs(c.run_at - f), c.place)) FROM chain c WHERE c.feeder = ft.feeder) END AS i, CASE WHEN t <= 0 THEN 0 WHEN t >= path THEN last ELSE (SELECT arg_min(c.place, (abs(c.run_at - t), c.place)) FROM chain c WHERE c.feeder = ft.feeder) END AS j0 FROM ft),
n2 AS (SELECT *, CASE WHEN j0 <= i AND i < last THEN i + 1 ELSE j0 END AS j FROM n1), n3 AS (SELECT * REPLACE (CASE WHEN j = i AND i > 0 THEN i - 1 ELSE i END AS i) FROM n2)
SELECT n3.feeder, n3.id, n3.place::INTEGER AS place, a.id AS from_bus, b.id AS to_bus, round(f, 6) AS from_at, round(t, 6) AS to_at FROM n3 JOIN chain a ON a.feeder = n3.feeder AND a.place = i JOIN chain b ON b.feeder = n3.feeder AND b.place = j""",
    "chain_totals": f"WITH {_SEG}, {_CHAIN}, ok AS (SELECT DISTINCT feeder FROM chain WHERE n >= 2) SELECT (SELECT count(*) FROM ok WHERE feeder IN (SELECT feeder FROM seg)) AS feeders_linked, count(*) FILTER (feeder IN (SELECT feeder FROM ok)) AS lines_updated, count(*) FILTER (feeder NOT IN (SELECT feeder FROM ok)) AS lines_skipped FROM seg",
    "join_sections_found": with_grid("SELECT count(*) AS n_asked, count(h.bus_id) AS n_found, round(count(h.bus_id) / count(*), 6) AS ratio FROM (SELECT DISTINCT bus_id FROM load) a LEFT JOIN (SELECT to_bus AS bus_id FROM line UNION SELECT from_bus FROM line) h USING (bus_id)", "load", "line"),
}
