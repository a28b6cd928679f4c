"""Sectioned network exports put together: nodes, sections, sources, loads and line configurations.

``order`` names the columns that tell which of several rows with one key came first; the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import load_power
from gridloom.operators.topology import propagate_labels


def first_rows(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns) of the first row of each key, by one aggregation; a null key has none."""
    value = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("row"))
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_first"))
    return least.select(key, *(F.col(f"_first.row.{c}").alias(c) for c in columns))


def loads_with_nodes(loads: DataFrame, sections: DataFrame, order: list[str]) -> DataFrame:
    """Loads with the end node of their section."""
    return loads.join(first_rows(sections, "SectionID", order, ["ToNodeID"]), "SectionID", "left")


def loads_with_power(loads: DataFrame) -> DataFrame:
    """Adds ActivePower_kW and ReactivePower_kvar by the type of the value pair."""
    p, q = load_power(F.col("ValueType").cast("string"), F.col("Value1").cast("string"), F.col("Value2").cast("string"))
    return loads.withColumn("ActivePower_kW", p).withColumn("ReactivePower_kvar", q)


def nodes_with_sources(nodes: DataFrame, sources: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their source's voltage in place of their own, and its network where they have none."""
    first = first_rows(sources, "NodeID", order, ["DesiredVoltage", "NetworkID"]).withColumnRenamed("NetworkID", "_net")
    joined = nodes.drop("DesiredVoltage").join(first, "NodeID", "left")
    return joined.withColumn("NetworkID", F.coalesce("NetworkID", "_net")).drop("_net")


def sections_with_voltage(sections: DataFrame, sources: DataFrame, order: list[str]) -> DataFrame:
    """Sections with the voltage of their network's first source, in place of their own."""
    return sections.drop("DesiredVoltage").join(first_rows(sources, "NetworkID", order, ["DesiredVoltage"]), "NetworkID", "left")


def nodes_with_voltage(nodes: DataFrame, sections: DataFrame, order: list[str]) -> DataFrame:
    """Nodes without a voltage take that of the first section at them, those that begin there before those that end there."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("FromNodeID").alias("NodeID")), F.struct(F.lit(1).alias("side"), F.col("ToNodeID").alias("NodeID")))).alias("e")
    at = sections.where("DesiredVoltage IS NOT NULL").select("DesiredVoltage", *order, ends).select("DesiredVoltage", *order, "e.side", "e.NodeID")
    found = first_rows(at, "NodeID", ["side", *order], ["DesiredVoltage"]).withColumnRenamed("DesiredVoltage", "_kv")
    return nodes.join(found, "NodeID", "left").withColumn("DesiredVoltage", F.coalesce("DesiredVoltage", "_kv")).drop("_kv")


def sections_with_configuration(sections: DataFrame, configuration: DataFrame, order: list[str]) -> DataFrame:
    """Sections with the columns of their first line configuration; names that both have get the suffix ``_linecfg``."""
    columns = [c for c in configuration.columns if c != "SectionID"]
    first = first_rows(configuration, "SectionID", order, columns)
    return sections.join(first.withColumnsRenamed({c: f"{c}_linecfg" for c in columns if c in sections.columns}), "SectionID", "left")


def stamp_networks(nodes: DataFrame, sections: DataFrame, sources: DataFrame, heads: DataFrame | None, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """NetworkID of nodes and sections.

    A node's comes from the head nodes (which replace what the nodes say), else from its source, else over sections
    from the nearest node that has one, the smaller of equally near ones, as far as sections lead. A section without
    one takes that of its first end, else of its last.
    """
    if heads is not None:
        nodes = nodes.drop("NetworkID").join(first_rows(heads, "NodeID", order, ["NetworkID"]), "NodeID", "left")
    own = nodes.where("NodeID IS NOT NULL AND trim(NetworkID) <> ''").select(F.col("NodeID").alias("bus"), F.trim("NetworkID").alias("label"))
    fed = first_rows(sources.where("trim(NetworkID) <> ''"), "NodeID", order, ["NetworkID"]).select(F.col("NodeID").alias("bus"), F.trim("NetworkID").alias("label"))
    start = own.unionAll(fed.join(own, "bus", "left_anti"))
    wires = sections.where("FromNodeID <> '' AND ToNodeID <> ''").select(F.col("FromNodeID").alias("src"), F.col("ToNodeID").alias("dst"))
    reached = propagate_labels(wires, start).withColumnsRenamed({"bus": "NodeID", "label": "_net"})
    stamped = nodes.join(reached, "NodeID", "left").withColumn("NetworkID", F.coalesce("_net", "NetworkID")).drop("_net")
    of = stamped.select("NodeID", "NetworkID").where("NetworkID IS NOT NULL").distinct()
    a, b = of.toDF("FromNodeID", "_a"), of.toDF("ToNodeID", "_b")
    filled = sections.join(a, "FromNodeID", "left").join(b, "ToNodeID", "left").withColumn("NetworkID", F.coalesce("NetworkID", "_a", "_b")).drop("_a", "_b")
    return stamped, filled
