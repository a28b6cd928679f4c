"""Node-breaker objects: terminals, elements, cubicles, unique names, class tables, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.normalize import object_key, safe_name
from gridloom.operators.components import settle

DEFAULT_NETWORK = "GRID"


def network_folders(bus: DataFrame) -> DataFrame:
    """One folder for each system, and the default one."""
    named = bus.where("system_id IS NOT NULL").select("system_id").distinct()
    rows = named.select(object_key("net", F.col("system_id")).alias("key"), safe_name(F.col("system_id"), length=80).alias("name"))
    return rows.unionAll(bus.sparkSession.range(1).select(F.lit(f"GRID:net:{DEFAULT_NETWORK}").alias("key"), F.lit(DEFAULT_NETWORK).alias("name")))


def folder_of(system) -> F.Column:
    return F.coalesce(object_key("net", system), F.lit(f"GRID:net:{DEFAULT_NETWORK}"))


def terminals(bus: DataFrame, substation: DataFrame) -> DataFrame:
    """Terminals below their substation if it is known, else below their network."""
    known = substation.select(F.col("id").alias("substation_id"), F.lit(True).alias("_known"))
    rows = bus.join(known, "substation_id", "left")
    parent = F.when(F.col("_known"), object_key("sub", F.col("substation_id"))).otherwise(folder_of(F.col("system_id")))
    return rows.select(object_key("bus", F.col("id")).alias("key"), "id", safe_name(F.col("name")).alias("name"), parent.alias("parent"), "nominal_voltage_kv")


def element_folders(df: DataFrame, bus: DataFrame, role: str) -> DataFrame:
    """Elements with the network folder of the system of the bus they hang on."""
    of = bus.select(F.col("id").alias(role), "system_id")
    return df.join(of, role, "left").withColumn("parent", folder_of(F.col("system_id"))).drop("system_id")


def cubicles(branches: dict[str, tuple[DataFrame, str, str]], shunts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Two cubicles for each branch element and one for each shunt element, below the terminal."""
    out = None
    for kind, (df, *roles) in {**branches, **shunts}.items():
        side = F.explode(F.array(*(F.struct(F.lit(i).alias("index"), F.col(r).alias("bus")) for i, r in enumerate(roles)))).alias("s")
        rows = df.select("id", side).select(F.lit(kind).alias("object_type"), F.col("id").alias("object_id"), F.col("s.index").alias("index"), F.col("s.bus").alias("bus"))
        out = rows if out is None else out.unionAll(rows)
    name = F.concat("object_type", F.lit("_"), "object_id", F.lit("_"), F.col("index").cast("string"))
    return out.select(object_key("cub", name).alias("key"), object_key("bus", F.col("bus")).alias("parent"), "object_type", "object_id", "index")


def unique_names(objects: DataFrame) -> DataFrame:
    """Names made unique within (class, parent): every member of a group of equal names takes its source id.

    Where a name is taken already, the later object (by ``id``) takes its source id, then that with 2, 3 and so on.
    ``objects``: class, parent, id, name.
    """
    scope = Window.partitionBy("class", "parent", "name")
    own = objects.withColumn("name", safe_name(F.col("name"))).withColumn("_n", F.count("*").over(scope))
    step = F.when(F.col("_n") > 1, 1).otherwise(0)  # 0: the name, 1: the source id, more: with a number
    rows = settle(own.select("class", "parent", "id", "name", step.alias("_step")))
    place = Window.partitionBy("class", "parent", "_name").orderBy("id")
    while True:
        fallback = safe_name(F.col("id"))
        name = F.when(F.col("_step") == 0, F.col("name")).when(F.col("_step") == 1, fallback).otherwise(safe_name(F.concat(fallback, F.lit("_"), F.col("_step").cast("string"))))
        ranked = settle(rows.withColumn("_name", name).withColumn("_late", F.row_number().over(place) > 1))
        if ranked.where("_late").isEmpty():
            return ranked.select("class", "parent", "id", F.col("_name").alias("name"))
        rows = ranked.withColumn("_step", F.col("_step") + F.col("_late").cast("int")).drop("_name", "_late")


def class_table(df: DataFrame, columns: list[tuple[str, F.Column]]) -> DataFrame:
    """A class table with exact header names; a header named twice is an error."""
    heads = [h for h, _ in columns]
    if len(set(heads)) != len(heads):
        raise ValueError("a header stands twice in a class table")
    return df.select(*(c.alias(h) for h, c in columns))


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "csv", strict: bool = True, known: tuple[str, ...] | None = None) -> None:
    """One folder for each class; a class that ``known`` doesn't hold is an error, or left out unless ``strict``."""
    for name, df in tables.items():
        if known is not None and name not in known:
            if strict:
                raise ValueError(f"no table for class {name}")
            continue
        df.write.mode("overwrite").option("header", True).format(form).save(f"{folder}/{name}")


def fit_to_page(points: DataFrame, extent: float = 4000.0) -> DataFrame:
    """Coordinates of each page (page, id, x, y) moved to the origin and shrunk to the extent if larger."""
    box = points.groupBy("page").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("size"))
    scale = F.when(F.col("size") > extent, extent / F.col("size")).otherwise(1.0)
    return points.join(box, "page").select("page", "id", ((F.col("x") - F.col("x0")) * scale).alias("x"), ((F.col("y") - F.col("y0")) * scale).alias("y"))


def layout_choice(edges: DataFrame, least: float = 20.0) -> DataFrame:
    """For each page (page, length of an edge): the upper median length, and the layout it leads to."""
    order = Window.partitionBy("page").orderBy("length")
    ranked = edges.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("page")))
    mid = ranked.where(F.col("_i") == F.floor(F.col("_n") / 2))
    return mid.select("page", F.col("length").alias("median"), F.when(F.col("length") < least, "topology").otherwise("gis").alias("layout"))


def diagram_parents(member: DataFrame, bus: DataFrame) -> DataFrame:
    """The folder of each page (page, bus): the network of its buses' only system, else the default."""
    systems = member.join(bus.select(F.col("id").alias("bus"), "system_id"), "bus").groupBy("page").agg(F.countDistinct("system_id").alias("n"), F.min("system_id").alias("system_id"))
    return systems.select("page", F.when(F.col("n") == 1, object_key("net", F.col("system_id"))).otherwise(F.lit(f"GRID:net:{DEFAULT_NETWORK}")).alias("parent"))
