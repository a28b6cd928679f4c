"""Queries that map raw layers, dirty on purpose, to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators.mapping import LayerMapping, judge_layer, map_layer
from gridloom.plans.testbed import Grid

_RAW = {
    "bus": ("customer", """SELECT c_custkey AS row_no, CASE WHEN c_custkey % 20 = 19 THEN concat(CAST(c_custkey - 1 AS VARCHAR(20)), '.0') WHEN c_custkey % 62 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN ' ' ELSE CAST(c_custkey AS VARCHAR(20)) END AS cod, c_name AS nombre,
 CASE c_custkey % 6 WHEN 0 THEN '22,9 kV' WHEN 1 THEN '10000 V' WHEN 2 THEN '0' WHEN 3 THEN NULL WHEN 4 THEN 'n/d' ELSE '10' END AS tension FROM {t}"""),
    "line": ("orders", """SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR(20)) AS cod, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR(20)) END AS desde, CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_custkey ELSE o_orderkey % 977 + 100000000 END AS VARCHAR(20)) AS hasta,
 CASE o_orderkey % 5 WHEN 0 THEN '120,5' WHEN 1 THEN '0' WHEN 2 THEN 'x' ELSE CAST(o_orderkey % 400 + 1 AS VARCHAR(20)) END AS metros, CASE o_orderkey % 4 WHEN 0 THEN 'EXISTENTE' WHEN 1 THEN 'retirado' WHEN 2 THEN NULL ELSE 'ACTIVO' END AS estado FROM {t}"""),
    "load": ("orders", """SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR(20)) AS cod, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR(20)) END AS nodo, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'mal' WHEN 2 THEN '-5' ELSE CAST(o_orderkey % 300 AS VARCHAR(20)) END AS kw, CASE o_orderkey % 3 WHEN 0 THEN '12,5' WHEN 1 THEN 'mal' ELSE NULL END AS kvar FROM {t}"""),
    "switch": ("customer", """SELECT c_custkey AS row_no, CAST(c_custkey AS VARCHAR(20)) AS cod, CAST(c_custkey AS VARCHAR(20)) AS desde, CAST(c_custkey + c_custkey % 5 AS VARCHAR(20)) AS hasta, CASE c_custkey % 4 WHEN 0 THEN 'ABIERTO' WHEN 1 THEN 'c' WHEN 2 THEN '' ELSE 'medio' END AS posicion FROM {t}"""),
    "transformer": ("supplier", """SELECT s_suppkey AS row_no, CAST(s_suppkey AS VARCHAR(20)) AS cod, CAST(s_nationkey AS VARCHAR(20)) AS alta, concat('S', CAST(s_suppkey AS VARCHAR(20))) AS baja, CASE WHEN s_suppkey % 7 = 0 THEN '10 kV' ELSE '60 KV' END AS kv_alta, '22.9' AS kv_baja, CAST(s_suppkey % 4 * 500 AS VARCHAR(20)) AS kva FROM {t}"""),
    "source": ("supplier", """SELECT s_suppkey AS row_no, CAST(s_suppkey AS VARCHAR(20)) AS cod, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE CAST(s_suppkey AS VARCHAR(20)) END AS nodo, CASE WHEN s_suppkey % 3 = 0 THEN '-1' ELSE '22,9 kV' END AS kv, CASE WHEN s_suppkey % 6 = 1 THEN ' ' WHEN s_suppkey % 6 = 2 THEN NULL ELSE s_name END AS nombre FROM {t}"""),
    "generator": ("supplier", """SELECT s_suppkey AS row_no, CAST(s_suppkey AS VARCHAR(20)) AS cod, CAST(s_suppkey AS VARCHAR(20)) AS nodo, CASE WHEN s_acctbal < 0 THEN '-1' ELSE CAST(s_suppkey % 90 AS VARCHAR(20)) END AS kw, CASE WHEN s_suppkey % 2 = 0 THEN 'PV' END AS tec FROM {t}"""),
}

MAPPINGS = {
    "bus": LayerMapping("bus", {"id": "cod", "name": "nombre", "nominal_voltage_kv": "tension"}, defaults={"nominal_voltage_kv": 22.9}),
    "line": LayerMapping("line", {"id": "cod", "from_bus": "desde", "to_bus": "hasta", "length_km": "metros", "in_service": "estado"}, {"length_km": "m"}, {"nominal_voltage_kv": 22.9, "in_service": True}),
    "load": LayerMapping("load", {"id": "cod", "bus_id": "nodo", "active_power_mw": "kw", "reactive_power_mvar": "kvar"}, {"active_power_mw": "kW", "reactive_power_mvar": "kvar"}, {"active_power_mw": 0.0, "reactive_power_mvar": 0.0, "in_service": True}, ("active_power_mw", "reactive_power_mvar")),
    "switch": LayerMapping("switch", {"id": "cod", "from_bus": "desde", "to_bus": "hasta", "closed": "posicion"}, defaults={"closed": True, "in_service": True}),
    "transformer": LayerMapping("transformer", {"id": "cod", "hv_bus": "alta", "lv_bus": "baja", "hv_voltage_kv": "kv_alta", "lv_voltage_kv": "kv_baja", "rated_power_mva": "kva"}, {"rated_power_mva": "kVA"}, {"in_service": True}),
    "source": LayerMapping("source", {"id": "cod", "name": "nombre", "bus_id": "nodo", "nominal_voltage_kv": "kv"}, defaults={"in_service": True}),
    "generator": LayerMapping("generator", {"id": "cod", "bus_id": "nodo", "active_power_mw": "kw", "technology": "tec"}, {"active_power_mw": "kW"}, {"reactive_power_mvar": 0.0, "in_service": True}),
}


def _layer(spark, sf_dir, entity):
    table, text = _RAW[entity]
    return map_layer(spark.sql(text, t=Grid(spark, sf_dir).table(table)), MAPPINGS[entity], "row_no")


def _judged(spark, sf_dir, entity):
    table, text = _RAW[entity]
    return judge_layer(spark.sql(text, t=Grid(spark, sf_dir).table(table)), MAPPINGS[entity], "row_no")


def map_repairs(spark, sf_dir):
    """How often each layer's rows were skipped or rejected, and for what, and how often a field was repaired."""
    out = None
    for entity in MAPPINGS:
        rows = _judged(spark, sf_dir, entity)
        kinds = F.array_append(F.transform("repairs", lambda r: F.struct(F.lit("repaired").alias("kind"), r.alias("reason"))), F.struct(F.col("outcome").alias("kind"), F.coalesce("reason", F.lit("")).alias("reason")))
        part = rows.select(F.lit(entity).alias("layer"), F.explode(kinds).alias("k")).select("layer", "k.kind", "k.reason")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("layer", "kind", "reason").agg(F.count("*").alias("n"))


def map_line_paths(spark, sf_dir):
    """Lines whose lengths come from their paths."""
    text = """SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR(20)) AS cod, CAST(o_custkey AS VARCHAR(20)) AS desde, concat('o', CAST(o_orderkey AS VARCHAR(20))) AS hasta,
 CASE WHEN o_orderkey % 8 = 0 THEN 'POINT (3 4)' WHEN o_orderkey % 8 = 1 THEN NULL ELSE concat('LINESTRING (0 0, ', CAST(o_orderkey % 700 AS VARCHAR(20)), ' 0, ', CAST(o_orderkey % 700 AS VARCHAR(20)), ' 50)') END AS forma FROM {t}"""
    mapping = LayerMapping("line", {"id": "cod", "from_bus": "desde", "to_bus": "hasta"}, defaults={"nominal_voltage_kv": 22.9, "in_service": True}, path="forma")
    accepted, _ = map_layer(spark.sql(text, t=Grid(spark, sf_dir).table("orders")), mapping, "row_no")
    return accepted.select("id", F.round("length_km", 9).alias("length_km"))


def map_buses(spark, sf_dir):
    return _layer(spark, sf_dir, "bus")[0].select("id", "name", F.round("nominal_voltage_kv", 6).alias("nominal_voltage_kv"))


def map_lines(spark, sf_dir):
    return _layer(spark, sf_dir, "line")[0].select("id", "name", "from_bus", "to_bus", F.round("length_km", 9).alias("length_km"), "nominal_voltage_kv", "in_service")


def map_loads(spark, sf_dir):
    return _layer(spark, sf_dir, "load")[0].select("id", "bus_id", F.round("active_power_mw", 9).alias("active_power_mw"), F.round("reactive_power_mvar", 9).alias("reactive_power_mvar"))


def map_switches(spark, sf_dir):
    return _layer(spark, sf_dir, "switch")[0].select("id", "from_bus", "to_bus", "closed")


def map_transformers(spark, sf_dir):
    return _layer(spark, sf_dir, "transformer")[0].select("id", "hv_bus", "lv_bus", "hv_voltage_kv", F.round("rated_power_mva", 6).alias("rated_power_mva"))


def map_sources(spark, sf_dir):
    return _layer(spark, sf_dir, "source")[0].select("id", "bus_id", "nominal_voltage_kv")


def map_generators(spark, sf_dir):
    return _layer(spark, sf_dir, "generator")[0].select("id", "bus_id", F.round("active_power_mw", 9).alias("active_power_mw"), F.coalesce("technology", "id").alias("technology"))


def map_rejects(spark, sf_dir):
    out = None
    for entity in MAPPINGS:
        part = _layer(spark, sf_dir, entity)[1]
        out = part if out is None else out.unionAll(part)
    return out.groupBy("layer", "reason").agg(F.count("*").alias("n"), F.min(F.col("row_id").cast("long")).alias("first_row"))


QUERIES = {f.__name__: f for f in (map_buses, map_lines, map_loads, map_switches, map_transformers, map_sources, map_generators, map_rejects, map_repairs, map_line_paths)}

_D = {e: f"{e}_raw AS ({text.replace('{t}', table)})" for e, (table, text) in _RAW.items()}
_B = {
    "bus": "SELECT row_no, CASE WHEN trim(cod) <> '' THEN regexp_replace(trim(cod), '\\.0$', '') END AS id, nombre AS name, CASE tension WHEN '22,9 kV' THEN 22.9 WHEN '10000 V' THEN 10.0 WHEN 'n/d' THEN 22.9 WHEN '10' THEN 10.0 ELSE 22.9 END::DOUBLE AS nominal_voltage_kv FROM (SELECT *, row_number() OVER (PARTITION BY cod, CASE WHEN cod IS NULL THEN row_no END ORDER BY row_no) AS k FROM bus_raw) WHERE k = 1",
    "line": "SELECT row_no, cod AS id, desde, hasta, try_cast(replace(metros, ',', '.') AS DOUBLE) / 1000 AS km, CASE estado WHEN 'retirado' THEN FALSE ELSE TRUE END AS in_service FROM line_raw",
    "load": "SELECT row_no, cod AS id, nullif(nodo, '') AS bus_id, coalesce(try_cast(kw AS DOUBLE), 0) / 1000 AS p, coalesce(try_cast(replace(kvar, ',', '.') AS DOUBLE), 0) / 1000 AS q FROM load_raw",
    "switch": "SELECT row_no, cod AS id, desde, hasta, CASE posicion WHEN 'ABIERTO' THEN FALSE WHEN 'c' THEN TRUE WHEN '' THEN TRUE END AS closed FROM switch_raw",
    "transformer": "SELECT row_no, cod AS id, alta, baja, CASE kv_alta WHEN '10 kV' THEN 10.0 ELSE 60.0 END::DOUBLE AS hv, try_cast(kva AS DOUBLE) / 1000 AS mva FROM transformer_raw",
    "source": "SELECT row_no, cod AS id, nombre, nodo, CASE kv WHEN '-1' THEN -1.0 ELSE 22.9 END::DOUBLE AS kv FROM source_raw",
    "generator": "SELECT row_no, cod AS id, nodo, try_cast(kw AS DOUBLE) / 1000 AS p, tec FROM generator_raw",
}
_J = {
    "bus": "CASE WHEN id IS NULL THEN 'id: missing or unreadable' WHEN row_number() OVER (PARTITION BY id ORDER BY row_no) > 1 THEN 'id: duplicate' END",
    "line": "CASE WHEN desde IS NULL THEN 'from_bus: missing or unreadable' WHEN km IS NULL THEN 'length_km: missing or unreadable' WHEN desde = hasta THEN 'self_loop' WHEN km <= 0 THEN 'length' END",
    "load": "CASE WHEN bus_id IS NULL THEN 'bus_id: missing or unreadable' WHEN p < 0 THEN 'power' END",
    "switch": "CASE WHEN closed IS NULL THEN 'closed: missing or unreadable' WHEN desde = hasta THEN 'self_loop' END",
    "transformer": "CASE WHEN hv <= 22.9 THEN 'voltage' WHEN mva <= 0 THEN 'rating' END",
    "source": "CASE WHEN trim(coalesce(nombre, '')) = '' THEN 'name: missing' WHEN nodo IS NULL THEN 'bus_id: missing or unreadable' WHEN kv <= 0 THEN 'voltage' END",
    "generator": "CASE WHEN p < 0 THEN 'power' END",
}
_JUDGED = {e: f"{_D[e]}, {e}_j AS (SELECT *, {_J[e]} AS reason FROM ({_B[e]}))" for e in _RAW}
_m = lambda e, cols: f"WITH {_JUDGED[e]} SELECT {cols} FROM {e}_j WHERE reason IS NULL"
_SKIP = {"line": "reason LIKE '%_bus: missing%' OR reason = 'self_loop'", "load": "reason LIKE 'bus_id: missing%'", "source": "reason = 'name: missing'"}
SQL = {
    "map_buses": _m("bus", "id, name, nominal_voltage_kv"),
    "map_lines": _m("line", "id, id AS name, desde AS from_bus, hasta AS to_bus, round(km, 9) AS length_km, 22.9::DOUBLE AS nominal_voltage_kv, in_service"),
    "map_loads": _m("load", "id, bus_id, round(p, 9) AS active_power_mw, round(q, 9) AS reactive_power_mvar"),
    "map_switches": _m("switch", "id, desde AS from_bus, hasta AS to_bus, closed"),
    "map_transformers": _m("transformer", "id, alta AS hv_bus, baja AS lv_bus, hv AS hv_voltage_kv, round(mva, 6) AS rated_power_mva"),
    "map_sources": _m("source", "id, nodo AS bus_id, kv AS nominal_voltage_kv"),
    "map_generators": _m("generator", "id, nodo AS bus_id, round(p, 9) AS active_power_mw, coalesce(tec, id) AS technology"),
    "map_line_paths": "SELECT CAST(o_orderkey AS VARCHAR) AS id, round((o_orderkey % 700 + 50) / 1000, 9) AS length_km FROM orders WHERE o_orderkey % 8 > 1",
    "map_repairs": "WITH " + ", ".join(_JUDGED.values()) + " SELECT layer, kind, reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS layer, CASE WHEN reason IS NULL THEN 'accepted' WHEN {_SKIP.get(e, 'FALSE')} THEN 'skipped' ELSE 'rejected' END AS kind, coalesce(reason, '') AS reason FROM {e}_j" for e in _RAW)
    + """ UNION ALL SELECT 'load', 'repaired', CASE WHEN kw IS NULL THEN 'active_power_mw: missing' ELSE 'active_power_mw: unreadable' END FROM load_raw WHERE nodo <> '' AND (kw IS NULL OR kw = 'mal')
 UNION ALL SELECT 'load', 'repaired', 'reactive_power_mvar: unreadable' FROM load_raw WHERE nodo <> '' AND kvar = 'mal') GROUP BY 1, 2, 3""",
    "map_rejects": "WITH " + ", ".join(_JUDGED.values()) + " SELECT layer, reason, count(*) AS n, min(row_no) AS first_row FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS layer, row_no, reason FROM {e}_j" for e in _RAW) + ") WHERE reason IS NOT NULL GROUP BY 1, 2",
}
