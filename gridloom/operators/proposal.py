"""Mapping proposals over a catalog of profiled columns: likeness, choices, strategies, warnings.

A catalog has a row for each column (table, column, rows, non_null, distinct), a mapping a row for each mapped field
(entity, field, table, column).
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.functions.normalize import token
from gridloom.operators.ranking import prefix_score

# How many tables and columns a proposal looks at, the row count above which lines are taken from a smaller table, what core strategies drop, and marks in names.
TABLES, COLUMNS, PER_TABLE = 6, 8, 2
COMPACT = 50_000
CORE_DROPS = ("loads", "generators", "switches")
LINE_MARKS = ("tramo", "line", "section")


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The share of two texts that matching blocks make up."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def lexical_score(name: Column, alias: Column) -> Column:
    """Likeness of two normal tokens: by beginning or containing each other, else by similarity."""
    contained = prefix_score(name, alias)
    return F.when((contained > 0) | (name == "") | (alias == ""), contained).otherwise(similarity(name, alias))


def field_scores(catalog: DataFrame, aliases: DataFrame, similar: bool = True) -> DataFrame:
    """(table, column, entity, field, score) of every column for every field, with its filled share as a factor below one half.

    ``aliases``: entity, field, alias, part of the program; ``similar``: whether unlike names are compared as texts.
    """
    left = catalog.select("table", "column", "rows", "non_null", token(F.col("column")).alias("_c"))
    right = F.broadcast(aliases.select("entity", "field", token(F.col("alias")).alias("_a")))
    likeness = lexical_score(F.col("_c"), F.col("_a")) if similar else prefix_score(F.col("_c"), F.col("_a"))
    filled = F.col("non_null") / F.greatest("rows", F.lit(1))
    scored = left.join(right).withColumn("score", likeness * F.when(filled <= 0, 0.2).when(filled < 0.5, 0.7).otherwise(1.0))
    return scored.groupBy("table", "column", "entity", "field").agg(F.max("score").alias("score")).where("score > 0")


def candidate_columns(scores: DataFrame, most: int = COLUMNS, per_table: int = PER_TABLE) -> DataFrame:
    """The best columns of each field: the first of all, and the first of each table."""
    order = [F.desc("score"), "table", "column"]
    whole, own = Window.partitionBy("entity", "field").orderBy(*order), Window.partitionBy("entity", "field", "table").orderBy(*order)
    ranked = scores.withColumn("_all", F.row_number().over(whole)).withColumn("_own", F.row_number().over(own))
    return ranked.where((F.col("_all") <= most) | (F.col("_own") <= per_table)).drop("_all", "_own")


def candidate_tables(scores: DataFrame, most: int = TABLES) -> DataFrame:
    """The best tables of each entity, by the mean of their best columns' scores over the entity's fields."""
    best = scores.groupBy("entity", "field", "table").agg(F.max("score").alias("score"))
    fields = scores.groupBy("entity").agg(F.countDistinct("field").alias("n"))
    worth = best.groupBy("entity", "table").agg(F.sum("score").alias("_sum")).join(fields, "entity").select("entity", "table", (F.col("_sum") / F.col("n")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "table"))
    return worth.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def sound(proposed: DataFrame, catalog: DataFrame, fields: DataFrame) -> DataFrame:
    """The proposed fields that exist, in tables and columns that exist and hold a value."""
    there = catalog.where("non_null > 0").select("table", "column")
    return proposed.join(F.broadcast(fields.select("entity", "field").distinct()), ["entity", "field"], "left_semi").join(there, ["table", "column"], "left_semi")  # the field list is part of the program


def modality(tables: DataFrame) -> DataFrame:
    """One row (modality) from the tables' names and how many are spatial. ``tables``: table, spatial, source."""
    name = F.lower("table")
    facts = tables.agg(F.count("*").alias("n"), F.count(F.when(F.col("spatial"), 1)).alias("s"), F.bool_or(name.contains("section")).alias("sections"), F.bool_or(name.contains("dbo.") | (F.col("source") == "network_db")).alias("db"))
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    return facts.select(F.when(F.col("sections"), "sectioned_text").when((F.col("s") > 0) & (F.col("s") >= half), "spatial").when(F.col("db"), "database").when((F.col("s") > 0) & (F.col("s") < F.col("n")), "mixed").otherwise("tabular").alias("modality"))


def apply_strategy(mapping: DataFrame, catalog: DataFrame, strategy: str) -> DataFrame:
    """The mapping for a strategy: ``full`` keeps all, ``network_core`` drops loads, generators and switches, ``compact_lines`` takes lines from the smallest line table where theirs is large.

    Compact lines keep the fields whose column the smaller table has, if the id is among them, and loads go; without a
    smaller table only the loads go.
    """
    if strategy == "full":
        return mapping
    if strategy == "network_core":
        return mapping.where(~F.col("entity").isin(*CORE_DROPS))
    if strategy != "compact_lines":
        raise ValueError(f"unknown strategy: {strategy}")
    rows = catalog.groupBy("table").agg(F.max("rows").alias("rows"))
    lines = mapping.where("entity = 'lines'")
    large = lines.join(rows, "table").where(F.col("rows") > COMPACT).select("table").distinct()
    name = F.lower("table")
    marked = name.contains(LINE_MARKS[0])
    for mark in LINE_MARKS[1:]:
        marked = marked | name.contains(mark)
    small = rows.where(marked & (F.col("rows") <= COMPACT)).join(lines.select("table"), "table", "left_anti").agg(F.min_by("table", F.struct("rows", name)).alias("smaller")).where("smaller IS NOT NULL")
    pick = small.crossJoin(large).select("smaller")  # one row at most
    held = lines.drop("table").crossJoin(F.broadcast(pick)).join(catalog.select(F.col("table").alias("smaller"), "column"), ["smaller", "column"]).select("entity", "field", F.col("smaller").alias("table"), "column")
    named = held.where("field = 'id'").select("table").distinct()
    moved = held.join(named, "table", "left_semi")
    is_large = F.broadcast(large.agg((F.count("*") > 0).alias("large")))  # one row
    did, stuck = F.broadcast(named.agg((F.count("*") > 0).alias("did"))), F.broadcast(pick.agg((F.count("*") > 0).alias("found")))
    rest = mapping.crossJoin(is_large).crossJoin(did).crossJoin(stuck)
    drop_loads = F.col("large") & (F.col("did") | ~F.col("found"))
    kept = rest.where(~((F.col("entity") == "lines") & F.col("did")) & ~((F.col("entity") == "loads") & drop_loads)).select("entity", "field", "table", "column")
    return kept.unionAll(moved.select("entity", "field", "table", "column"))


def warnings(mapping: DataFrame, catalog: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """(kind, detail): buses or lines without a mapping, placeholder voltages, lines without ends, and tables that nothing uses. ``placeholders``: entity, field with a default."""
    one = mapping.agg(*(F.bool_or(F.col("entity") == e).alias(e) for e in ("buses", "lines")), *(F.bool_or((F.col("entity") == "lines") & (F.col("field") == f)).alias(f) for f in ("from_bus", "to_bus")))
    has = lambda c: F.coalesce(c, F.lit(False))
    found = F.array(
        F.when(~has("buses"), F.struct(F.lit("no_buses").alias("kind"), F.lit("").alias("detail"))), F.when(~has("lines"), F.struct(F.lit("no_lines").alias("kind"), F.lit("").alias("detail"))),
        F.when(has("lines") & ~has("from_bus"), F.struct(F.lit("no_end").alias("kind"), F.lit("from_bus").alias("detail"))), F.when(has("lines") & ~has("to_bus"), F.struct(F.lit("no_end").alias("kind"), F.lit("to_bus").alias("detail"))),
    )
    out = one.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("w")).select("w.*")
    unused = catalog.select("table").distinct().join(mapping.select("table"), "table", "left_anti").select(F.lit("unused_table"), "table")
    out = out.unionAll(unused)
    if placeholders is not None:
        out = out.unionAll(placeholders.where("entity = 'buses' AND field = 'nominal_voltage_kv'").select(F.lit("placeholder"), "field").distinct())
    return out
