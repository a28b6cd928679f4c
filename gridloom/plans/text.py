"""Queries over a sectioned text export derived from the orders: a file for each region, a feeder for each nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.sources import sectioned as S
from gridloom.plans.testbed import Grid

# Lines with (file, block, place): headers, formats, feeders, then rows; the format of SECTION changes after nation 12.
_LINES = """
SELECT concat('r', CAST(r_regionkey AS VARCHAR(5))) AS file, 0 AS block, CAST(o AS BIGINT) AS ord, value FROM {region} CROSS JOIN (
  SELECT 0 AS o, '[GENERAL]' AS value UNION ALL SELECT 1, 'Date=2026-03-08' UNION ALL SELECT 2, 'version = 4.7' UNION ALL SELECT 3, '[NODE]' UNION ALL SELECT 4, 'FORMAT_NODE=NodeID,CoordX,CoordY') h
UNION ALL SELECT concat('r', CAST(n_regionkey AS VARCHAR(5))), 1, c_custkey, concat('N', CAST(c_custkey AS VARCHAR(20)), ', ', CAST(c_custkey % 100 AS VARCHAR(20)), CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ',7' END) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(5))), 2, 0, '[SECTION DATA]' FROM {region}
UNION ALL SELECT concat('r', CAST(n_regionkey AS VARCHAR(5))), 3, CAST(n_nationkey AS BIGINT) * 1000000000, concat('FEEDER=', n_name, ',x') FROM {nation}
UNION ALL SELECT concat('r', CAST(n_regionkey AS VARCHAR(5))), 3, CAST(n_nationkey AS BIGINT) * 1000000000 + 1, CASE WHEN n_nationkey <= 12 THEN 'FORMAT_SECTION=SectionID,FromNodeID,Length' ELSE 'FORMAT_SECTION=SectionID,Length,FromNodeID' END FROM {nation}
UNION ALL SELECT concat('r', CAST(n_regionkey AS VARCHAR(5))), 3, CAST(n_nationkey AS BIGINT) * 1000000000 + 2 + o_orderkey,
  CASE WHEN n_nationkey <= 12 THEN concat('S', CAST(o_orderkey AS VARCHAR(20)), ',N', CAST(o_custkey AS VARCHAR(20)), ',', CAST(o_orderkey % 50 AS VARCHAR(20)), CASE WHEN o_orderkey % 4 = 0 THEN ',extra' ELSE '' END) ELSE concat('S', CAST(o_orderkey AS VARCHAR(20)), ',', CAST(o_orderkey % 50 AS VARCHAR(20)), ',N', CAST(o_custkey AS VARCHAR(20))) END
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""


def _lines(spark, sf_dir):
    g = Grid(spark, sf_dir)
    return spark.sql(_LINES, **{t: g.table(t) for t in ("region", "nation", "customer", "orders")})


def text_sections(spark, sf_dir):
    parsed = S.rows(S.in_context(_lines(spark, sf_dir)))
    return S.section(parsed, "SECTION_DATA", ["SectionID", "FromNodeID", "Length"]).select("file", "feeder", "SectionID", "FromNodeID", "Length")


def text_nodes(spark, sf_dir):
    parsed = S.rows(S.in_context(_lines(spark, sf_dir)))
    return S.section(parsed, "NODE", ["NodeID", "CoordX", "CoordY"]).select("file", "NodeID", "CoordX", F.coalesce("CoordY", F.lit("")).alias("CoordY"))


def text_values(spark, sf_dir):
    return S.column_values(S.rows(S.in_context(_lines(spark, sf_dir))), "SECTION_DATA", "FromNodeID")


def text_header(spark, sf_dir):
    return S.header(S.in_context(_lines(spark, sf_dir))).select("file", F.col("entries")["DATE"].alias("date"), F.col("entries")["VERSION"].alias("version"))


# A file for each customer: what it holds follows from the segment and the nation.
_FILES = """SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS file, value FROM {customer} CROSS JOIN (SELECT 0 AS o, '[GENERAL]' AS value UNION ALL SELECT 1, 'VERSION = 4.7' UNION ALL SELECT 2, '[Node]' UNION ALL SELECT 3, '[CUSTOMER LOADS]' UNION ALL SELECT 4, '[Import Mode]' UNION ALL SELECT 5, 'a,b') h
 WHERE o = 5 OR (o = 0 AND c_nationkey % 5 <> 1) OR (o = 1 AND c_nationkey % 5 <> 2) OR (o = 2 AND c_mktsegment = 'BUILDING') OR (o = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) OR (o = 4 AND c_mktsegment = 'FURNITURE')"""


def text_roles(spark, sf_dir):
    return S.roles(spark.sql(_FILES, customer=Grid(spark, sf_dir).table("customer")))


def text_networks(spark, sf_dir):
    """NetworkID of every section, from head nodes at either end."""
    parsed = S.rows(S.in_context(_lines(spark, sf_dir)))
    none = F.lit(None).cast("string").alias("NetworkID")
    node = S.section(parsed, "NODE", ["NodeID"]).select("NodeID", none)
    sections = S.section(parsed, "SECTION_DATA", ["SectionID", "FromNodeID", "Length"]).select("SectionID", "FromNodeID", F.concat(F.lit("N"), "Length").alias("ToNodeID"), none)
    head = node.where(F.substring("NodeID", 2, 12).cast("long") % 3 == 0).select("NodeID", F.concat(F.lit("NET_"), "NodeID").alias("NetworkID"))
    return S.fill_networks(node, sections, head)[1].select("SectionID", F.coalesce("NetworkID", F.lit("")).alias("NetworkID"))


QUERIES = {f.__name__: f for f in (text_sections, text_nodes, text_values, text_header, text_roles, text_networks)}

_J = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
SQL = {
    "text_sections": f"SELECT concat('r', n_regionkey) AS file, n_name AS feeder, concat('S', o_orderkey) AS SectionID, concat('N', o_custkey) AS FromNodeID, CAST(o_orderkey % 50 AS VARCHAR) AS Length FROM {_J}",
    "text_nodes": "SELECT concat('r', n_regionkey) AS file, concat('N', c_custkey) AS NodeID, CAST(c_custkey % 100 AS VARCHAR) AS CoordX, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE '7' END AS CoordY FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "text_values": f"SELECT DISTINCT concat('N', o_custkey) AS value FROM {_J}",
    "text_header": "SELECT concat('r', r_regionkey) AS file, '2026-03-08' AS date, '4.7' AS version FROM region",
    "text_roles": "SELECT concat('c', c_custkey) AS file, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'equipment_import_config' WHEN c_nationkey % 5 IN (1, 2) THEN 'unknown' WHEN c_mktsegment = 'BUILDING' THEN 'network' WHEN c_mktsegment = 'MACHINERY' THEN 'loads' ELSE 'network' END AS role FROM customer",
    "text_networks": f"SELECT concat('S', o_orderkey) AS SectionID, CASE WHEN o_custkey % 3 = 0 THEN concat('NET_N', o_custkey) WHEN (o_orderkey % 50) % 3 = 0 AND EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey = o_orderkey % 50) THEN concat('NET_N', o_orderkey % 50) ELSE '' END AS NetworkID FROM {_J}",
}
