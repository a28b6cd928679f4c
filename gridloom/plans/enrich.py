"""Queries that put sectioned exports together; the sections are the orders, their loads and configurations the items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import enrich as E
from gridloom.operators.components import store
from gridloom.plans.testbed import Grid

#: Name: (SELECT, tables). Section ids repeat now and then, and so do nodes of sources and networks.
_TABLES = {
    "section": ("""SELECT o_orderkey AS ord, concat('S', CAST(o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR(20))) AS SectionID, CASE WHEN before IS NULL THEN concat('C', CAST(o_custkey AS VARCHAR(20))) ELSE concat('O', CAST(before AS VARCHAR(20))) END AS FromNodeID, concat('O', CAST(o_orderkey AS VARCHAR(20))) AS ToNodeID,
 CASE WHEN o_orderpriority = '1-URGENT' THEN concat('K', CAST(o_custkey % 40 AS VARCHAR(20))) END AS NetworkID, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 AS DOUBLE) END AS Length FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM {orders}) o""", ("orders",)),
    "node": ("""SELECT c_custkey AS ord, concat('C', CAST(c_custkey AS VARCHAR(20))) AS NodeID, CASE WHEN c_custkey % 6 = 0 THEN CAST(60 AS DOUBLE) END AS DesiredVoltage, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('K', CAST(c_custkey % 40 AS VARCHAR(20))) END AS NetworkID FROM {customer}
 UNION ALL SELECT 1000000000 + o_orderkey, concat('O', CAST(o_orderkey AS VARCHAR(20))), CASE WHEN o_orderkey % 6 = 0 THEN 60.0 END, NULL FROM {orders}""", ("customer", "orders")),
    "source": ("SELECT s_suppkey AS ord, concat('C', CAST(s_suppkey - s_suppkey % 2 AS VARCHAR(20))) AS NodeID, CAST(10 + s_suppkey % 5 AS DOUBLE) AS DesiredVoltage, CASE WHEN s_suppkey % 7 <> 0 THEN concat('K', CAST(s_suppkey % 40 AS VARCHAR(20))) END AS NetworkID FROM {supplier}", ("supplier",)),
    "loads": ("SELECT l_orderkey, l_linenumber, l_partkey, concat('S', CAST(l_orderkey AS VARCHAR(20))) AS SectionID, CAST(l_linenumber % 4 AS VARCHAR(5)) AS ValueType, l_quantity AS Value1, CAST(l_partkey % 230 - 114.5 AS DOUBLE) AS Value2 FROM {lineitem}", ("lineitem",)),
    "config": ("SELECT l_linenumber AS o1, l_partkey AS o2, concat('S', CAST(l_orderkey AS VARCHAR(20))) AS SectionID, l_quantity AS Length, l_returnflag AS Overhead FROM {lineitem}", ("lineitem",)),
}


def _t(spark, sf_dir, name):
    text, tables = _TABLES[name]
    return spark.sql(text, **{t: Grid(spark, sf_dir).table(t) for t in tables})


def enrich_load_nodes(spark, sf_dir):
    rows = E.loads_with_nodes(_t(spark, sf_dir, "loads"), _t(spark, sf_dir, "section"), ["ord"])
    return rows.groupBy("ToNodeID").agg(F.count("*").alias("n"), F.sum("Value1").alias("value"))


def enrich_load_power(spark, sf_dir):
    rows = E.loads_with_power(_t(spark, sf_dir, "loads"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "Value1", F.round("ActivePower_kW", 3).alias("kw"), F.round("ReactivePower_kvar", 3).alias("kvar"))


def enrich_node_sources(spark, sf_dir):
    return E.nodes_with_sources(_t(spark, sf_dir, "node"), _t(spark, sf_dir, "source"), ["ord"]).select("NodeID", "DesiredVoltage", "NetworkID")


def enrich_section_voltage(spark, sf_dir):
    return E.sections_with_voltage(_t(spark, sf_dir, "section"), _t(spark, sf_dir, "source"), ["ord"]).select("ord", "SectionID", "NetworkID", "DesiredVoltage")


def enrich_node_voltage(spark, sf_dir):
    sections = E.sections_with_voltage(_t(spark, sf_dir, "section"), _t(spark, sf_dir, "source"), ["ord"])
    return E.nodes_with_voltage(_t(spark, sf_dir, "node"), sections, ["ord"]).select("NodeID", "DesiredVoltage")


def enrich_section_configuration(spark, sf_dir):
    rows = E.sections_with_configuration(_t(spark, sf_dir, "section"), _t(spark, sf_dir, "config"), ["o1", "o2"])
    return rows.select("ord", "SectionID", "Length", "Length_linecfg", "Overhead")


def _stamped(spark, sf_dir, heads):
    head = _t(spark, sf_dir, "source").where("NetworkID IS NOT NULL").select("ord", "NodeID", "NetworkID") if heads else None
    sections = store(_t(spark, sf_dir, "section").select("ord", "SectionID", "FromNodeID", "ToNodeID", "NetworkID"))  # read by each step
    return E.stamp_networks(_t(spark, sf_dir, "node"), sections, _t(spark, sf_dir, "source"), head, ["ord"])


def enrich_node_networks(spark, sf_dir):
    return _stamped(spark, sf_dir, False)[0].select("NodeID", "NetworkID")


def enrich_head_networks(spark, sf_dir):
    return _stamped(spark, sf_dir, True)[0].select("NodeID", "NetworkID")


def enrich_section_networks(spark, sf_dir):
    return _stamped(spark, sf_dir, True)[1].select("ord", "SectionID", "NetworkID")


QUERIES = {f.__name__: f for f in (enrich_load_nodes, enrich_load_power, enrich_node_sources, enrich_section_voltage, enrich_node_voltage, enrich_section_configuration, enrich_node_networks, enrich_head_networks, enrich_section_networks)}

_RAW = {n: "(" + text.replace("{", "").replace("}", "") + ")" for n, (text, _) in _TABLES.items()}
_first = lambda t, key, order, where="TRUE": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {t} WHERE {key} IS NOT NULL AND {where}) WHERE rn = 1)"
_W = "WITH RECURSIVE " + ", ".join(f"{n}_ AS {text}" for n, text in _RAW.items())


def _networks(heads: bool) -> str:
    start = f"SELECT n.NodeID, h.NetworkID FROM node_ n LEFT JOIN {_first('source_', 'NodeID', 'ord', 'NetworkID IS NOT NULL')} h USING (NodeID)" if heads else "SELECT NodeID, NetworkID FROM node_"
    return f"""{_W}, n0 AS ({start}), own AS (SELECT * FROM n0 WHERE NetworkID IS NOT NULL), lab AS (SELECT * FROM own UNION ALL SELECT NodeID, NetworkID FROM {_first('source_', 'NodeID', 'ord', 'NetworkID IS NOT NULL')} s WHERE NodeID NOT IN (SELECT NodeID FROM own)),
side AS (SELECT FromNodeID AS a, ToNodeID AS b FROM section_ UNION SELECT ToNodeID, FromNodeID FROM section_),
near(NodeID, label, d) AS (SELECT NodeID, NetworkID, 0 FROM lab UNION SELECT b, label, d + 1 FROM near JOIN side ON a = NodeID WHERE d < 40),
best AS (SELECT NodeID, min(label) AS label FROM near JOIN (SELECT NodeID, min(d) AS d FROM near GROUP BY 1) USING (NodeID, d) GROUP BY 1),
out_ AS (SELECT n.NodeID, label AS NetworkID FROM n0 n LEFT JOIN best USING (NodeID))"""


SQL = {
    "enrich_load_nodes": f"{_W} SELECT ToNodeID, count(*) AS n, sum(Value1) AS value FROM loads_ LEFT JOIN {_first('section_', 'SectionID', 'ord')} s USING (SectionID) GROUP BY 1",
    "enrich_load_power": f"""{_W} SELECT l_orderkey, l_linenumber, l_partkey, Value1, round(CASE ValueType WHEN '1' THEN Value1 * pf ELSE Value1 END, 3) AS kw, round(CASE ValueType WHEN '1' THEN Value1 * sign(pf) * sqrt(1 - pf * pf) WHEN '2' THEN Value1 * sign(pf) * sqrt(1 - pf * pf) / abs(pf) ELSE Value2 END, 3) AS kvar
FROM (SELECT *, greatest(-1.0, least(1.0, Value2 / 100)) AS pf FROM loads_)""",
    "enrich_node_sources": f"{_W} SELECT n.NodeID, s.DesiredVoltage, coalesce(n.NetworkID, s.NetworkID) AS NetworkID FROM node_ n LEFT JOIN {_first('source_', 'NodeID', 'ord')} s USING (NodeID)",
    "enrich_section_voltage": f"{_W} SELECT c.ord, SectionID, NetworkID, s.DesiredVoltage FROM section_ c LEFT JOIN {_first('source_', 'NetworkID', 'ord')} s USING (NetworkID)",
    "enrich_node_voltage": f"{_W}, sv AS (SELECT c.ord, FromNodeID, ToNodeID, s.DesiredVoltage FROM section_ c JOIN {_first('source_', 'NetworkID', 'ord')} s USING (NetworkID)), e AS (SELECT FromNodeID AS NodeID, 0 AS side, ord, DesiredVoltage FROM sv UNION ALL SELECT ToNodeID, 1, ord, DesiredVoltage FROM sv) SELECT NodeID, coalesce(n.DesiredVoltage, e.DesiredVoltage) AS DesiredVoltage FROM node_ n LEFT JOIN {_first('e', 'NodeID', 'side, ord')} e USING (NodeID)",
    "enrich_section_configuration": f"{_W} SELECT c.ord, SectionID, c.Length, f.Length AS Length_linecfg, f.Overhead FROM section_ c LEFT JOIN {_first('config_', 'SectionID', 'o1, o2, Length, Overhead')} f USING (SectionID)",
    "enrich_node_networks": _networks(False) + " SELECT * FROM out_",
    "enrich_head_networks": _networks(True) + " SELECT * FROM out_",
    "enrich_section_networks": _networks(True) + " SELECT ord, SectionID, coalesce(c.NetworkID, a.NetworkID, b.NetworkID) AS NetworkID FROM section_ c LEFT JOIN out_ a ON a.NodeID = FromNodeID LEFT JOIN out_ b ON b.NodeID = ToNodeID",
}
