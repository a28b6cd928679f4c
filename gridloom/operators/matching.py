"""Roles of tables and worth of mappings, from a catalog of columns (table, column, rows, non_null, distinct, numeric)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import token
from gridloom.operators.ranking import prefix_score

#: A table gets a role from this score on, and may serve an entity whose score is this near to its best.
LEAST_ROLE, MARGIN = 0.45, 0.12


def table_roles(tables: DataFrame, markers: DataFrame) -> DataFrame:
    """(table, role, score): the role whose marker the table's name is most like; ``tables``: table; ``markers``: role, marker."""
    scored = role_scores(tables, markers)
    best = scored.groupBy("table").agg(F.max(F.struct("score", F.col("role"))).alias("b"))
    return best.select("table", F.when(F.col("b.score") >= LEAST_ROLE, F.col("b.role")).otherwise("unassigned").alias("role"), F.col("b.score").alias("score"))


def role_scores(tables: DataFrame, markers: DataFrame) -> DataFrame:
    left = tables.select("table", token(F.col("table")).alias("_t"))
    right = F.broadcast(markers.select("role", token(F.col("marker")).alias("_m")))  # the marker list is part of the program
    return left.join(right).select("table", "role", prefix_score(F.col("_t"), F.col("_m")).alias("score")).groupBy("table", "role").agg(F.max("score").alias("score"))


def allowed(scores: DataFrame) -> DataFrame:
    """Roles of each table whose score is within the margin of its best."""
    best = scores.groupBy("table").agg(F.max("score").alias("_best"))
    return scores.join(best, "table").where((F.col("score") > 0) & (F.col("score") >= F.col("_best") - MARGIN)).drop("_best")


def field_score(lexical: Column, numeric: Column, wants_number: Column, filled: Column, is_endpoint: Column, names_unit: Column) -> Column:
    """Lexical likeness lowered for a wrong type, emptiness, and endpoint or unit words where none is wanted."""
    out = lexical * F.when(wants_number & ~numeric, 0.55).otherwise(1.0)
    out = out * F.when(filled <= 0, 0.2).when(filled < 0.5, 0.7).otherwise(1.0)
    return out * F.when(~is_endpoint & names_unit & ~wants_number, 0.5).otherwise(1.0)


def objectives(chosen: DataFrame, required: DataFrame) -> DataFrame:
    """(candidate, coverage, lexical, uniqueness, compactness) of mappings.

    ``chosen``: candidate, entity, field, table, column, score; ``required``: entity, field.
    """
    need = required.distinct()
    total = need.agg(F.count("*").alias("total"))  # one row
    hit = chosen.join(need, ["entity", "field"]).groupBy("candidate").agg(F.countDistinct("entity", "field").alias("hit"))
    whole = chosen.groupBy("candidate").agg(F.avg("score").alias("lexical"), F.count("*").alias("n"), F.countDistinct("table", "column").alias("columns"), F.countDistinct("table").alias("tables"))
    rows = whole.join(hit, "candidate", "left").crossJoin(F.broadcast(total))
    return rows.select("candidate", (F.coalesce("hit", F.lit(0)) / F.col("total")).alias("coverage"), "lexical", (F.col("columns") / F.col("n")).alias("uniqueness"), (1.0 / F.col("tables")).alias("compactness"))


def precision(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits, total and share of an expected mapping (entity, field, table, column)."""
    keys = ["entity", "field", "table", "column"]
    both = expected.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return both.agg(F.count("hit").alias("hits"), F.count("*").alias("total"), F.round(F.count("hit") / F.count("*"), 6).alias("precision"))
