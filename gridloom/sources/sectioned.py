"""Sectioned text exports: ``[SECTION]`` headers, ``FORMAT_x=`` column lists, rows, and ``FEEDER=`` context lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ord, value) of every line; block and ord together follow the order of lines in a file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return text.withColumn("ord", F.monotonically_increasing_id())


def in_context(lines: DataFrame) -> DataFrame:
    """Rows (file, block, ord, section, format, feeder, value): each line with the section, columns and feeder in force.

    A section header ends the format and the feeder before it. Within a block of a file the context runs by a window;
    what a block ends with is carried to the next blocks through one row for each block.
    """
    v = F.trim("value")
    head = F.regexp_extract(v, r"^\[([^\]]+)\]$", 1)
    form = F.regexp_extract(v, r"(?i)^FORMAT_\w+\s*=\s*(.*)$", 1)
    feeder = F.regexp_extract(v, r"(?i)^FEEDER\s*=\s*([^,]*)", 1)
    named = lines.select("file", "block", "ord", v.alias("value"), F.when(head != "", F.upper(F.regexp_replace(head, "[^A-Za-z0-9]+", "_"))).alias("head"), F.when(form != "", form).alias("form"), F.when(v.rlike("(?i)^FEEDER\\s*="), feeder).alias("feed"))
    run = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    # each mark is kept with the place of its line, so that a header can end what came before it
    place = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct("block", "ord", F.col(c).alias("v"))), ignorenulls=True)
    near = named.select("*", place("head").over(run).alias("h"), place("form").over(run).alias("f"), place("feed").over(run).alias("e"))
    ends = named.groupBy("file", "block").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct("block", "ord", F.col(c).alias("v")))).alias(a) for c, a in (("head", "h"), ("form", "f"), ("feed", "e"))))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", *(F.last(a, ignorenulls=True).over(before).alias(f"{a}0") for a in "hfe"))
    full = near.join(carried, ["file", "block"]).select("file", "block", "ord", "value", "head", "form", "feed", *(F.coalesce(a, f"{a}0").alias(a) for a in "hfe"))
    since = lambda a: F.when(F.col("h").isNull() | (F.struct(F.col(f"{a}.block"), F.col(f"{a}.ord")) > F.struct(F.col("h.block"), F.col("h.ord"))), F.col(f"{a}.v"))
    return full.select("file", "block", "ord", F.col("h.v").alias("section"), since("f").alias("format"), since("e").alias("feeder"), "value", (F.col("head").isNotNull() | F.col("form").isNotNull() | F.col("feed").isNotNull()).alias("marker"))


def rows(context: DataFrame) -> DataFrame:
    """(file, block, ord, section, feeder, cells): data rows as a map from column name to text. Short rows lack cells, long ones lose them."""
    data = context.where("NOT marker AND format IS NOT NULL AND section IS NOT NULL AND value <> ''")
    names = F.transform(F.split("format", ","), lambda c: F.trim(c))
    values = F.transform(F.split("value", ","), lambda c: F.trim(c))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != "") & p["v"].isNotNull())
    return data.select("file", "block", "ord", "section", "feeder", F.map_from_entries(pairs).alias("cells"))


def section(parsed: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One section as a table; its order columns come first."""
    return parsed.where(F.col("section") == name).select("file", "block", "ord", "feeder", *(F.col("cells")[c].alias(c) for c in columns))


def column_values(parsed: DataFrame, name: str, column: str) -> DataFrame:
    """The distinct filled values of one column of a section."""
    return parsed.where(F.col("section") == name).select(F.col("cells")[column].alias("value")).where("value <> ''").distinct()


def header(context: DataFrame, name: str = "GENERAL") -> DataFrame:
    """(file, entries): the key=value lines of a section, keys in upper case."""
    pair = context.where((F.col("section") == name) & F.col("value").contains("=") & ~F.col("marker"))
    entry = F.struct(F.upper(F.trim(F.substring_index("value", "=", 1))).alias("k"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("v"))
    return pair.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("entries"))


def roles(lines: DataFrame) -> DataFrame:
    """(file, role) by the sections that a file holds: an import configuration, network or loads; network also for an export with a version and none of these, else unknown."""
    v = F.upper(F.trim("value"))
    has = lambda *names: F.bool_or(v.isin(*(f"[{n}]" for n in names)))
    export = has("GENERAL") & F.bool_or(v.rlike(r"^(CYMDIST_)?VERSION\s*="))
    role = F.when(has("IMPORT MODE"), "equipment_import_config").when(~export, "unknown").when(has("NODE", "SECTION"), "network").when(has("LOADS", "CUSTOMER LOADS"), "loads").otherwise("network")
    return lines.groupBy("file").agg(role.alias("role"))


def fill_networks(node: DataFrame, sections: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """NetworkID of nodes from head nodes, and of sections from either of their ends."""
    named = node.join(head.select("NodeID", F.col("NetworkID").alias("_head")), "NodeID", "left").withColumn("NetworkID", F.coalesce("_head", "NetworkID")).drop("_head")
    of = named.select("NodeID", "NetworkID").where("NetworkID IS NOT NULL")
    a, b = of.toDF("FromNodeID", "_a"), of.toDF("ToNodeID", "_b")
    filled = sections.join(a, "FromNodeID", "left").join(b, "ToNodeID", "left").withColumn("NetworkID", F.coalesce("NetworkID", "_a", "_b")).drop("_a", "_b")
    return named, filled
