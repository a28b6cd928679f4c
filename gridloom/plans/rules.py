"""Queries over the validation rules, profiles and summaries."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from gridloom.operators import topology as T
from gridloom.operators import validate as V
from gridloom.plans.graph import _ALL, _C, _LIVE, _S, SQL as GRAPH_SQL, Net, _feeder
from gridloom.plans.testbed import GRID, Grid, with_grid


def rule_net(spark, sf_dir):
    return V.references(Grid(spark, sf_dir))


def rule_dat(spark, sf_dir):
    g = Grid(spark, sf_dir)
    number = F.substring("id", 2, 18).try_cast("long")
    bus = g.bus.withColumn("x", F.when(number % 9 == 0, None).when(number % 10 == 0, float("nan")).otherwise(F.col("x"))).withColumn("y", F.when(number % 6 == 0, None).otherwise(F.col("y")))
    line = g.line.withColumn("length_km", F.when(number % 200 == 0, float("inf")).otherwise(F.col("length_km")))
    return V.data_quality({"bus": bus, "line": line, "load": g.load, "source": g.source, "transformer": g.transformer, "generator": g.generator}, coordinates=True)


def rule_ele(spark, sf_dir):
    return V.voltages(Grid(spark, sf_dir))


def rule_lib(spark, sf_dir):
    return V.library(Grid(spark, sf_dir), V.PROFILES["short_circuit"], unknown="ERROR")


def rule_empty(spark, sf_dir):
    """What a network without a type library, and one whose buses were all left out, is told: the lines of the grid, no bus."""
    g = Grid(spark, sf_dir)
    bare = SimpleNamespace(bus=g.bus.where("nominal_voltage_kv < 0"), line=g.line, transformer=g.transformer, switch=g.switch, load=g.load, source=g.source, generator=g.generator, substation=g.substation, line_type=None, transformer_type=None)
    return V.references(bare).unionAll(V.library(bare, V.PROFILES["power_flow"])).groupBy("code", "severity", "object_type").agg(F.count("*").alias("n"))


def _overlaps(n):
    return T.Feeders(n.bus, n.edge, n.sources).overlaps()


def rule_top(spark, sf_dir):
    n = Net(spark, sf_dir)
    return V.topology(n.grid, n.labels, n.edge, n.sources, _overlaps(n))


def rule_rdy(spark, sf_dir):
    n = Net(spark, sf_dir)
    return V.readiness(n.grid, n.labels, n.edge, n.sources, _overlaps(n), radial=True)


def _static(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return V.references(g).unionAll(V.voltages(g)).unionAll(V.library(g, V.PROFILES["short_circuit"], unknown="ERROR"))


def summary_issues(spark, sf_dir):
    return V.counts(_static(spark, sf_dir))


def report_issues(spark, sf_dir):
    return V.in_order(_static(spark, sf_dir), 5000)


def summary_network(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return V.union([getattr(g, e).agg(F.count("*").alias("n")).select(F.lit(e).alias("entity"), "n") for e in GRID if e != "raw"])


def profile_columns(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return V.union([V.profile_columns(g.table(t), t).drop("type") for t in ("customer", "supplier", "orders", "lineitem")])


QUERIES = {f.__name__: f for f in (rule_net, rule_dat, rule_ele, rule_lib, rule_empty, rule_top, rule_rdy, summary_issues, report_issues, summary_network, profile_columns)}

_I = "SELECT '{0}' AS code, '{1}' AS severity, '{2}' AS category, {3} AS object_type, {4} AS object_id, {5} AS detail FROM "


def _i(code, severity, category, kind, ident, detail="''"):
    return _I.format(code, severity, category, f"'{kind}'", ident, detail)


_REFS = (("NET001", "line", "from_bus"), ("NET001", "line", "to_bus"), ("NET002", "transformer", "hv_bus"), ("NET002", "transformer", "lv_bus"), ("NET003", "switch", "from_bus"), ("NET003", "switch", "to_bus"), ("NET004", "load", "bus_id"), ("NET005", "source", "bus_id"), ("NET007", "generator", "bus_id"))
_NET = " UNION ALL ".join(_i(c, "ERROR", "reference", k, "id", f"'{r}'") + f"{k} WHERE {r} NOT IN (SELECT id FROM bus)" for c, k, r in _REFS) + " UNION ALL " + _i("NET008", "ERROR", "reference", "bus", "id", "'substation_id'") + "bus WHERE substation_id NOT IN (SELECT id FROM substation)"
_ELE = " UNION ALL ".join(_i(c, "ERROR", "electrical", k, "e.id", f"'{r}'") + f"{k} e JOIN bus b ON b.id = e.{r} WHERE abs(e.{f} - b.nominal_voltage_kv) > 1e-6" for c, k, r, f in (("ELE001", "line", "from_bus", "nominal_voltage_kv"), ("ELE001", "line", "to_bus", "nominal_voltage_kv"), ("ELE002", "source", "bus_id", "nominal_voltage_kv"), ("ELE003", "transformer", "hv_bus", "hv_voltage_kv"), ("ELE004", "transformer", "lv_bus", "lv_voltage_kv")))
_ELE += " UNION ALL " + _i("ELE005", "ERROR", "electrical", "switch", "e.id") + "switch e JOIN bus a ON a.id = from_bus JOIN bus b ON b.id = to_bus WHERE abs(a.nominal_voltage_kv - b.nominal_voltage_kv) > 1e-6"
_LL, _TT = "line e LEFT JOIN line_type t ON t.id = e.type_id WHERE in_service AND e.type_id <> '' AND ", "transformer e LEFT JOIN transformer_type t ON t.id = e.type_id WHERE in_service AND e.type_id <> '' AND "
_LIB = " UNION ALL ".join(_i(c, "ERROR", "library", k, "e.id", "e.type_id") + (_LL if k == "line" else _TT) + w for c, k, w in (
    ("LIB101", "line", "t.id IS NULL"), ("LIB102", "line", "abs(e.nominal_voltage_kv - t.nominal_voltage_kv) > 1e-6"), ("LIB103", "line", "t.id IS NOT NULL AND r0_ohm_per_km IS NULL"), ("LIB201", "transformer", "t.id IS NULL"),
    ("LIB202", "transformer", "abs(e.hv_voltage_kv - t.hv_voltage_kv) > 1e-6"), ("LIB203", "transformer", "abs(e.lv_voltage_kv - t.lv_voltage_kv) > 1e-6"), ("LIB204", "transformer", "abs(e.rated_power_mva - t.rated_power_mva) > 1e-6 * greatest(e.rated_power_mva, t.rated_power_mva)"), ("LIB205", "transformer", "t.id IS NOT NULL AND uk0_percent IS NULL")))
_NUM = "try_cast(substr(id, 2) AS BIGINT)"
_NAMES = ("bus", "substation", "line", "transformer", "switch", "load", "source", "generator", "line_type", "transformer_type")
_STATIC = f"+issues AS ({_NET} UNION ALL {_ELE} UNION ALL {_LIB}) "
_ISL = ", isl AS (" + GRAPH_SQL["graph_islands"].rsplit("SELECT 'ISLAND_'", 1)[1].join(["SELECT 'ISLAND_'", ")"])
_FEED = _feeder(False).split(", src AS", 1)[1].split("), ", 1)[1]
_OVER = ", over_ AS (SELECT bus, count(*) AS n_feeders FROM fbus WHERE bus NOT IN (SELECT bus FROM stop) GROUP BY 1 HAVING count(*) > 1)"
_NBS = GRAPH_SQL["graph_islands"].rsplit("nb AS", 1)[1].rsplit("SELECT 'ISLAND_'", 1)[0]
_TOPO = "+" + _C + _S + _LIVE + ", nb AS" + _NBS + _ISL + ", " + _FEED + _OVER + " "
SQL = {
    "rule_net": with_grid(_NET, "bus", "substation", "line", "transformer", "switch", "load", "source", "generator"),
    "rule_dat": with_grid(
        f"+b2 AS (SELECT id, nominal_voltage_kv, CASE WHEN {_NUM} % 9 = 0 THEN NULL WHEN {_NUM} % 10 = 0 THEN 'nan'::DOUBLE ELSE x END AS x, CASE WHEN {_NUM} % 6 = 0 THEN NULL ELSE y END AS y FROM bus), l2 AS (SELECT id, CASE WHEN {_NUM} % 200 = 0 THEN 'inf'::DOUBLE ELSE length_km END AS length_km FROM line) "
        + _i("DAT001", "ERROR", "data", "bus", "id", "'x'") + "b2 WHERE isnan(x) UNION ALL " + _i("DAT001", "ERROR", "data", "line", "id", "'length_km'") + "l2 WHERE isinf(length_km) UNION ALL "
        + _i("DAT002", "ERROR", "data", "bus", "id", "CASE WHEN x IS NULL THEN 'x' ELSE 'y' END") + "b2 WHERE (x IS NULL) <> (y IS NULL) UNION ALL " + _i("DAT003", "ERROR", "data", "bus", "id") + "b2 WHERE x IS NULL AND y IS NULL", "bus", "line"),
    "rule_ele": with_grid(_ELE, "bus", "line", "transformer", "switch", "source"),
    "rule_empty": with_grid(" UNION ALL ".join(f"SELECT '{c}' AS code, 'ERROR' AS severity, '{k}' AS object_type, {' + '.join(f'count({r})' for c2, k2, r in _REFS if k2 == k)} AS n FROM {k}" for c, k in dict.fromkeys((c, k) for c, k, _ in _REFS)) + " UNION ALL SELECT 'NET006', 'ERROR', 'network', 1 UNION ALL SELECT 'LIB001', 'ERROR', 'library', 1", "line", "transformer", "switch", "load", "source", "generator"),
    "rule_lib": with_grid(_LIB, "line", "transformer", "line_type", "transformer_type"),
    "rule_top": with_grid(
        _TOPO + _i("TOP001", "WARNING", "topology", "bus", "id") + "bus WHERE id NOT IN (SELECT bus FROM side) UNION ALL " + _i("TOP002", "WARNING", "topology", "bus", "id") + "bus WHERE id NOT IN (SELECT bus FROM live) AND EXISTS (SELECT 1 FROM source) UNION ALL "
        + _i("TOP003", "WARNING", "topology", "loop", "concat(component, '#', CAST(number AS VARCHAR))") + "(SELECT component, unnest(range(1, loop_count + 1)) AS number FROM isl) UNION ALL " + _i("TOP006", "INFO", "topology", "island", "component", "source_ids") + "isl WHERE source_count > 1 UNION ALL "
        + _i("TOP004", "INFO", "topology", "bus", "least(src, dst)", "string_agg(key, ',' ORDER BY key)") + "wire GROUP BY least(src, dst), greatest(src, dst) HAVING count(*) > 1 UNION ALL "
        + _i("TOP007", "INFO", "topology", "switch", "id") + "switch WHERE in_service AND NOT closed AND (from_bus IN (SELECT bus FROM live)) <> (to_bus IN (SELECT bus FROM live)) UNION ALL " + _i("TOP005", "WARNING", "topology", "bus", "bus", "CAST(n_feeders AS VARCHAR)") + "over_", *_ALL),
    "rule_rdy": with_grid(
        _TOPO + ", f AS (SELECT count(*) FILTER (NOT energized) AS dead, count(*) FILTER (energized) AS live_, count(*) FILTER (energized AND NOT radial) AS meshed FROM isl) ".lstrip()
        + _i("RDY001", "ERROR", "readiness", "network", "'network'") + "(SELECT count(*) AS n FROM source WHERE in_service) WHERE n = 0 UNION ALL " + _i("RDY002", "ERROR", "readiness", "line", "id") + "line WHERE in_service AND type_id IS NULL UNION ALL " + _i("RDY003", "ERROR", "readiness", "transformer", "id") + "transformer WHERE in_service AND type_id IS NULL UNION ALL "
        + _i("RDY004", "ERROR", "readiness", "network", "'network'", "CAST(dead AS VARCHAR)") + "f WHERE dead > 0 UNION ALL " + _i("RDY005", "ERROR", "readiness", "network", "'network'", "CAST(meshed AS VARCHAR)") + "f WHERE meshed > 0 OR live_ = 0 UNION ALL " + _i("RDY006", "ERROR", "readiness", "network", "'network'", "CAST(n AS VARCHAR)") + "(SELECT count(*) AS n FROM over_) WHERE n > 0", *_ALL),
    "summary_issues": with_grid(_STATIC + "SELECT 'severity' AS by, severity AS value, count(*) AS n FROM issues GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'code', code, count(*) FROM issues GROUP BY 2", *_NAMES),
    "report_issues": with_grid(_STATIC + "SELECT * FROM issues ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, category, code, object_type, object_id, detail LIMIT 5000", *_NAMES),
    "summary_network": with_grid(" UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n FROM {e}" for e in _NAMES), *_NAMES),
    "profile_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS \"rows\", count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", count({c}) < count(*) AS nullable FROM {t}"
        for t, cs in (("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"), ("supplier", "s_suppkey s_name s_nationkey s_acctbal"), ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"), ("lineitem", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate")) for c in cs.split()),
}
