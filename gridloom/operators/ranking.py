"""Multi-criteria ranking of alternatives, and schema matching over a catalog of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.normalize import token
from gridloom.operators.components import Frontiers, settle

#: Points that others are held against at once.
BLOCK = 4096


def _apart(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points none of ``others`` dominates."""
    keep = np.ones(len(points), bool)
    step = max(1, (1 << 24) // max(1, others.size))
    for i in range(0, len(points), step):
        p = points[i : i + step, None, :]
        keep[i : i + step] = ~((others >= p).all(2) & (others > p).any(2)).any(1)
    return keep


def pareto_front(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Rows that no other row dominates: at least as high in every objective and higher in one. Nulls are never in the front.

    Rows are thinned to one per distinct point, each task keeps what its own points don't dominate, and the points left
    are then held against each other in blocks of BLOCK, one pass each: what is broadcast never grows.
    """
    points = df.select(*(F.col(o).cast("double").alias(o) for o in objectives)).dropna().distinct()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(objectives)))
        for batch in batches:
            mine = np.stack([np.asarray(c) for c in batch.columns], 1)
            mine = mine[np.argsort(-mine.sum(1), kind="stable")]
            for i in range(0, len(mine), BLOCK):
                part = mine[i : i + BLOCK]
                part = part[_apart(part, best)]
                best = np.concatenate([best, part[_apart(part, part)]])
            if len(best) > BLOCK:  # what is found later may dominate what was found before
                yield pa.RecordBatch.from_arrays([pa.array(best[:, j]) for j in range(len(objectives))], objectives)
                best = best[:BLOCK]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, j]) for j in range(len(objectives))], objectives)

    left = settle(points.mapInArrow(local, points.schema).distinct())
    blocks = -(-left.count() // BLOCK)
    for b in range(blocks):
        rows = left.where(F.pmod(F.xxhash64(*objectives), F.lit(blocks)) == b).toArrow()  # about BLOCK rows
        shared = df.sparkSession.sparkContext.broadcast(np.stack([np.asarray(c) for c in rows.columns], 1) if len(rows) else np.zeros((0, len(objectives))))

        def against(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_apart(np.stack([np.asarray(c) for c in batch.columns], 1), shared.value)))

        left = settle(left.mapInArrow(against, left.schema))
    return df.join(left, [df[o].cast("double") == left[o] for o in objectives], "left_semi").select(key, *objectives)


def front_ranks(df: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """(key, objectives, front): front 1 is the Pareto front, front 2 that of the rest, and so on to the last."""
    rounds, rest, rank, schema = Frontiers(df.sparkSession), settle(df.select(key, *objectives).dropna(subset=objectives)), 0, None
    while not rest.isEmpty():
        rank += 1
        front = rounds.add(pareto_front(rest, key, objectives).withColumn("front", F.lit(rank)))
        schema, rest = front.schema, settle(rest.join(front.select(key), key, "left_anti"))
    return rounds.all(schema) if rank else rest.withColumn("front", F.lit(0))


def crowding(df: DataFrame, key: str, objectives: list[str], front: str = "front") -> DataFrame:
    """Crowding distance of each row in its front; the ends of an objective are at infinity, given as null."""
    total, ends = F.lit(0.0), F.lit(False)
    rows = df
    for o in objectives:
        w, whole = Window.partitionBy(front).orderBy(o, key), Window.partitionBy(front)
        span = F.max(o).over(whole) - F.min(o).over(whole)
        rows = rows.withColumn(f"_lo_{o}", F.lag(o).over(w)).withColumn(f"_hi_{o}", F.lead(o).over(w)).withColumn(f"_span_{o}", span)
        total = total + F.when(F.col(f"_span_{o}") > 0, (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) / F.col(f"_span_{o}")).otherwise(0.0)
        ends = ends | F.col(f"_lo_{o}").isNull() | F.col(f"_hi_{o}").isNull()
    return rows.select(key, front, F.when(~ends, total).alias("crowding"))


def topsis(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, closeness): closeness to the ideal point, with vector-normed objectives; all objectives count upwards."""
    whole = sum(weights.values())
    norms = df.agg(*(F.sqrt(F.sum(F.col(o) * F.col(o))).alias(f"_n_{o}") for o in weights))  # one row
    scaled = df.crossJoin(F.broadcast(norms)).select(key, *(F.when(F.col(f"_n_{o}") > 0, F.col(o) / F.col(f"_n_{o}") * (w / whole)).otherwise(0.0).alias(o) for o, w in weights.items()))
    bounds = scaled.agg(*(F.max(o).alias(f"_max_{o}") for o in weights), *(F.min(o).alias(f"_min_{o}") for o in weights))
    rows = scaled.crossJoin(F.broadcast(bounds))
    far = lambda side: F.sqrt(sum(((F.col(o) - F.col(f"_{side}_{o}")) * (F.col(o) - F.col(f"_{side}_{o}")) for o in weights), F.lit(0.0)))
    best, worst = far("max"), far("min")
    return rows.select(key, F.when(best + worst > 0, worst / (best + worst)).otherwise(0.0).alias("closeness"))


def prefix_score(name: Column, alias: Column) -> Column:
    """Likeness of two normal tokens: 1 if equal, else by how much of the longer the shorter begins or lies in."""
    n, a = F.length(name), F.length(alias)
    return (
        F.when((n == 0) | (a == 0), 0.0)
        .when(name == alias, 1.0)
        .when(name.startswith(alias) | alias.startswith(name), 0.72 + 0.20 * F.least(n, a) / F.greatest(n, a))
        .when((a >= 3) & name.contains(alias), 0.68 + 0.24 * a / n)
        .when((n >= 3) & alias.contains(name), 0.68 + 0.24 * n / a)
        .otherwise(0.0)
    )


def match_fields(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best score of every column (table, column) for every field (entity, field, alias): a catalog against a fixed list."""
    left = columns.withColumn("_c", token(F.col("column")))
    right = F.broadcast(aliases.withColumn("_a", token(F.col("alias"))))  # the field list is part of the program
    scored = left.join(right).withColumn("score", prefix_score(F.col("_c"), F.col("_a"))).where("score > 0")
    return scored.groupBy("table", "column", "entity", "field").agg(F.max("score").alias("score"))


def greedy_assignment(scores: DataFrame, left: str, right: str, score: str = "score") -> DataFrame:
    """One-to-one pairs, the best score first, ties by names: rounds of mutual best choices, which give the same pairs."""
    rest, out = settle(scores.select(left, right, score)), None
    while not rest.isEmpty():
        order = [F.desc(score), left, right]
        mine = F.row_number().over(Window.partitionBy(left).orderBy(*order))
        yours = F.row_number().over(Window.partitionBy(right).orderBy(*order))
        chosen = settle(rest.withColumn("_l", mine).withColumn("_r", yours).where("_l = 1 AND _r = 1").select(left, right, score))
        out = chosen if out is None else out.unionAll(chosen)
        rest = settle(rest.join(chosen.select(left), left, "left_anti").join(chosen.select(right), right, "left_anti").select(left, right, score))
    return out if out is not None else rest
