"""Operator 13, nearest neighbours by inner product in vantage-point trees, one for each shard.

The largest inner product is made the smallest angle: a vector shorter than the longest one, M, gets one more component
that brings it to length M, a query gets none, and then the inner product falls as the angle grows. Angles obey the
triangle inequality, so what a tree node knows of its rows (their least and largest angle to its vantage point) bounds
the angle between them and a query from below. A node is left out if ``factor`` times its bound is no better than the
query's k-th neighbour so far: with a factor of one nothing near is ever left out, with a larger one more is. How much
a factor loses depends on how the vectors lie, so unless it is given each shard's tree has its own, the largest at which
some of the queries at hand, compared with all of the shard's rows, keep RECALL of their neighbours.

The top of the tree is fitted on a bounded sample (SAMPLE rows, of the least hashes), and every row goes down it to a
shard of some SHARD_ROWS rows; a shard that has far more, such as one vector that a third of all rows hold, is split
by a hash of the id. Each shard has a tree of its own, down to leaves of LEAF rows. A query searches its own shard
first; the k-th neighbour found there rules out other shards by the exact bounds of the top tree (most of them where
vectors lie in groups; where they lie evenly in many dimensions no bound rules out much), and the rest are searched in a
second round.
Queries go to shards in blocks, so a task holds one shard and one block. In a task all vantage points of a tree are
compared with all queries at once, and then each query visits the leaves by ascending bound.

Every neighbour's score is summed in one fixed order in double precision, so that equal vectors tie exactly.

Cases: vectors that are null or zero, or hold a null, NaN or infinity, take no part, nor do rows without an id; a shorter
vector counts as having zeros at its end; rows alike in id and vector count as one; rows of one id with different vectors
are queries and candidates of their own, but no row finds one with its own id; ties go to the smaller id; fewer candidates
than asked for are all returned; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle, table

#: Share of a shard's neighbours that its factor is chosen to find, queries that it is measured on (one in so many, and so many at least), and neighbours that it takes to measure it.
RECALL = 0.97
MEASURED = 8
LEAST_MEASURED = 64
LEAST_FOUND = 20
#: Rows of the sample that the top of the tree is fitted on, and bytes that it has at most.
SAMPLE = 1 << 16
SAMPLE_BYTES = 1 << 25
#: Rows that a shard is meant to have, and at most; rows of a leaf; queries of a block.
SHARD_ROWS = 1 << 12
MOST_ROWS = 1 << 13
LEAF = 128
BLOCK_QUERIES = 1 << 11
#: Pairs whose scores are summed together.
PAIRS = 1 << 13
#: What rounding may take from an angle.
SLACK = 1e-6


@dataclass
class Tree:
    """Leaves in order, and of each leaf the vantage points above it with the least and largest angle of its rows to each."""

    points: np.ndarray  # the vantage points
    leaves: list[np.ndarray]  # the rows of each leaf
    path: np.ndarray  # (leaf, depth): vantage point, -1 where the leaf lies higher
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, leaf): a lower bound of the angle between the query and any row of the leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if len(self.points):
            angle = np.arccos(np.clip(queries @ self.points.T, -1, 1))
            for depth in range(self.path.shape[1]):
                at = np.flatnonzero(self.path[:, depth] >= 0)
                there = angle[:, self.path[at, depth]]
                out[:, at] = np.maximum(out[:, at], np.maximum(self.low[at, depth] - there, there - self.high[at, depth]))
        return np.maximum(out - SLACK, 0)


def grow(rows: np.ndarray, size: int, open_ended: bool = False) -> Tree:
    """A tree over unit vectors with leaves of ``size`` rows at most, or of equal rows.

    Where it is ``open_ended``, its leaves take in other rows too (see ``route``): bounds are the medians, not the rows' own.
    """
    points: list[np.ndarray] = []
    leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
    todo: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = [(np.arange(len(rows)), [])]
    while todo:
        held, path = todo.pop()
        if len(held) > size:
            # the row farthest from the first one stands at the edge, where angles differ most
            vantage = rows[held[int(np.argmin(rows[held] @ rows[held[0]]))]]
            angle = np.arccos(np.clip(_dots(rows[held], vantage), -1, 1))
            middle = float(np.median(angle))
            inside = angle <= middle
            if not inside.all():
                points.append(vantage)
                for side in (~inside, inside):
                    low, high = (angle[side].min(), angle[side].max()) if not open_ended else ((0.0, middle) if side is inside else (middle, math.pi))
                    todo.append((held[side], [*path, (len(points) - 1, low, high)]))
                continue
        leaves.append((held, path))
    depth = max((len(p) for _, p in leaves), default=0)
    path, low, high = np.full((len(leaves), depth), -1), np.zeros((len(leaves), depth)), np.zeros((len(leaves), depth))
    for i, (_, p) in enumerate(leaves):
        for j, (v, a, b) in enumerate(p):
            path[i, j], low[i, j], high[i, j] = v, a, b
    return Tree(np.array(points) if points else np.zeros((0, rows.shape[1] if rows.ndim == 2 else 0)), [h for h, _ in leaves], path, low, high)


def _dots(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows (or one row), summed in the order of the components: equal vectors give equal sums."""
    other = np.broadcast_to(other, rows.shape)
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out += rows[:, i] * other[:, i]
    return out


def route(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of an open-ended tree that each row belongs to."""
    out = np.zeros(len(rows), np.int64)
    todo = [(np.arange(len(rows)), np.arange(len(tree.leaves)), 0)]
    while todo:
        held, leaves, depth = todo.pop()
        if len(leaves) == 1 or not len(held):
            out[held] = leaves[0]
            continue
        vantage = tree.path[leaves[0], depth]
        inner = tree.low[leaves, depth] == 0.0
        edge = tree.high[leaves[inner][0], depth]
        near = np.arccos(np.clip(_dots(rows[held], tree.points[vantage]), -1, 1)) <= edge
        todo += [(held[near], leaves[inner], depth + 1), (held[~near], leaves[~inner], depth + 1)]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten().cast(pa.float64()))
    return out


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, for candidates."""
    scaled = rows / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])


def _asking(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors with one more component, for queries, and their lengths."""
    scale = np.abs(rows).max(axis=1, keepdims=True)
    norms = np.sqrt(((rows / scale) ** 2).sum(axis=1, keepdims=True)) * scale
    return np.column_stack([rows / norms, np.zeros(len(rows))]), norms[:, 0]


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, longest: float, k: int, factor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row's id, score) of the k nearest rows of each query, by one tree over ``rows``; only scores of ``least`` or more matter. Without a factor it is measured."""
    order = np.lexsort((ids, *rows.T[::-1]))
    rows, ids = rows[order], ids[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    again = ~fresh
    again[1:] &= ids[1:] == ids[:-1]
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1  # equal vectors share a score; only the k + 1 smallest of their ids can be wanted
    alike = np.arange(len(rows)) - first[group] - (np.cumsum(again) - np.cumsum(again)[first[group]] + again[first[group]])
    kept = ~again & (alike <= k)
    tree = grow(_lifted(rows[first], longest), LEAF)
    unit, norms = _asking(queries)
    owner = np.empty(len(first), np.int64)
    for i, leaf in enumerate(tree.leaves):
        owner[leaf] = i
    usable = np.flatnonzero(kept)
    usable = usable[np.argsort(owner[group[usable]], kind="stable")]
    each = np.split(usable, np.cumsum(np.bincount(owner[group[usable]], minlength=len(tree.leaves)))[:-1])  # all rows of each leaf
    bounds = tree.bounds(unit)
    if factor is None:
        some = np.unique(np.linspace(0, len(queries) - 1, max(LEAST_MEASURED, len(queries) // MEASURED)).astype(np.int64))
        rough = queries[some] @ rows[usable].T
        rough[ids[usable][None, :] == own[some][:, None]] = -np.inf
        bar = np.partition(rough, len(usable) - k, axis=1)[:, len(usable) - k] if len(usable) > k else np.full(len(some), -np.inf)
        bar = np.maximum(bar, least[some])
        i, j = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
        reach = np.arccos(np.clip(bar / (norms[some] * longest), -1, 1))
        allowed = reach[i] / np.maximum(bounds[some[i], owner[group[usable[j]]]], 1e-12)
        factor = max(1.0, float(np.quantile(allowed, 1 - RECALL, method="lower"))) if len(allowed) >= LEAST_FOUND else 1.0
    bounds *= factor
    visit = np.argsort(bounds, axis=1, kind="stable")
    worst = least.astype(float)
    best = (np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0))
    allowance = 1e-12 * norms * longest * max(1, rows.shape[1])
    for step in range(len(tree.leaves)):
        leaf = visit[:, step]
        limit = np.arccos(np.clip(worst / (norms * longest), -1, 1)) + SLACK
        asking = np.flatnonzero(bounds[np.arange(len(queries)), leaf] <= limit)
        if not len(asking):
            break
        pairs = []
        for at in np.unique(leaf[asking]):
            q = asking[leaf[asking] == at]
            members = each[at]
            rough = queries[q] @ rows[members].T
            rough[ids[members][None, :] == own[q][:, None]] = -np.inf
            bar = worst[q]
            if len(members) > k:  # no more than the leaf's own k nearest, and what ties with them
                bar = np.maximum(bar, np.partition(rough, len(members) - k, axis=1)[:, len(members) - k])
            i, j = np.nonzero((rough >= (bar - allowance[q])[:, None]) & (rough > -np.inf))
            pairs.append((q[i], members[j]))
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        if len(i):
            found = [best, (i, ids[j], np.concatenate([_dots(queries[i[x : x + PAIRS]], rows[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS)]))]
            who, what, score = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            begin = np.searchsorted(who, np.arange(len(queries)))
            rank = np.arange(len(who)) - begin[who]
            full = np.flatnonzero(rank == k - 1)
            worst[who[full]] = np.maximum(worst[who[full]], score[full])
            keep = rank < k
            best = (who[keep], what[keep], score[keep])
    keep = best[2] >= least[best[0]]
    return tuple(c[keep] for c in best)


def nearest(vectors: DataFrame, asked: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", factor: float | None = None) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows of ``vectors`` of each row of ``asked``, a table of the same kind.

    ``factor``: 1 for exact search, more for less work; without it each shard measures its own.
    """
    spark = vectors.sparkSession
    good = lambda df: _usable(df, key, vector)
    base, queries = good(vectors), good(asked).dropDuplicates(["_id", "_mark"])
    total, width, longest = base.agg(F.count("*"), F.max(F.size("_vector")), F.max("_norm")).first()
    kind = base.schema["_id"].dataType.simpleString()
    columns = f"query_id {kind}, mark long, id {kind}, score double"
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    base, queries = base.drop("_norm"), queries.drop("_norm")

    shards = max(1, math.ceil(total / SHARD_ROWS))
    size = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * (width + 1))))
    sample = base.select("_vector").orderBy(F.xxhash64("_vector"), F.xxhash64("_id")).limit(size).toArrow() if shards > 1 else None  # SAMPLE_BYTES at most
    fit = np.unique(_lifted(_matrix(sample.column(0).combine_chunks(), width), longest), axis=0) if sample is not None else np.zeros((1, width + 1))
    top = spark.sparkContext.broadcast(grow(fit, max(8, math.ceil(len(fit) / shards)), open_ended=True))

    def routed(df: DataFrame, of_queries: bool) -> DataFrame:
        """``df`` with the shard that each row or query lies in."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column(2), width)
                at = route(top.value, _asking(rows)[0] if of_queries else _lifted(rows, longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "shard"])

        return df.select("_id", "_mark", "_vector").mapInArrow(run, f"_id {kind}, _mark long, _vector {df.schema['_vector'].dataType.simpleString()}, shard int")

    placed = routed(base, False)
    sizes = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # a row for each leaf of the top tree
    pieces = {s: math.ceil(n / MOST_ROWS) for s, n in sizes.items()}
    split = F.element_at(F.from_json(F.lit(str([pieces.get(i, 1) for i in range(len(top.value.leaves))])), "array<int>"), F.col("shard") + 1)
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("_id"), split).cast("int"))

    def searched(asks: DataFrame) -> DataFrame:
        """``asks``: (_id, _mark, _vector, shard, least) of all queries for all shards that they search."""
        block = {r[0]: math.ceil(r[1] / BLOCK_QUERIES) for r in asks.groupBy("shard").count().collect()}  # a row for each leaf of the top tree
        blocks = F.element_at(F.from_json(F.lit(str([block.get(i, 0) for i in range(len(top.value.leaves))])), "array<int>"), F.col("shard") + 1)
        parts = asks.withColumn("block", F.pmod(F.xxhash64("_mark", "_id"), blocks).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), split - 1)))
        held = placed.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

        def both(_, mine: pa.Table, theirs: pa.Table) -> pa.Table:
            if not len(mine) or not len(theirs):
                who = what = score = np.zeros(0, np.int64)
                ids = asked_ids = pa.array([], mine.schema.field("_id").type)
                marks = np.zeros(0, np.int64)
            else:
                ids, order = mine["_id"].combine_chunks(), None
                asked_ids, marks = theirs["_id"].combine_chunks(), np.asarray(theirs["_mark"])
                names = pa.chunked_array([ids, asked_ids]).combine_chunks().dictionary_encode()
                order = np.empty(len(names.dictionary), np.int64)
                order[np.asarray(pa.compute.sort_indices(names.dictionary))] = np.arange(len(names.dictionary))
                numbers = order[np.asarray(names.indices)]
                mine_, theirs_ = numbers[: len(ids)], numbers[len(ids) :]
                back = names.dictionary.take(pa.compute.sort_indices(names.dictionary))
                who, what, score = search(_matrix(mine["_vector"].combine_chunks(), width), mine_, _matrix(theirs["_vector"].combine_chunks(), width), theirs_, np.asarray(theirs["least"]), longest, k, factor)
                ids = back
            return pa.table({"query_id": asked_ids.take(pa.array(who.astype(np.int64))), "mark": pa.array(marks[who.astype(np.int64)], pa.int64()), "id": ids.take(pa.array(what.astype(np.int64))), "score": pa.array(score.astype(np.float64))})

        keys = ["shard", "piece", "block"]
        return held.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(both, columns)

    home = settle(routed(queries, True).withColumn("least", F.lit(float("-inf"))))
    near = settle(searched(home))
    if len(top.value.leaves) > 1:
        place = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "id")
        known = near.withColumn("_place", F.row_number().over(place)).where(F.col("_place") == k).select(F.col("query_id").alias("_id"), F.col("mark").alias("_mark"), F.col("score").alias("known"))
        rest = home.join(known, ["_id", "_mark"], "left").select("_id", "_mark", "_vector", "shard", F.coalesce("known", F.lit(float("-inf"))).alias("least"))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query for each other shard that its bounds don't rule out."""
            for batch in batches:
                unit, norms = _asking(_matrix(batch.column(2), width))
                limit = np.arccos(np.clip(np.asarray(batch.column(4)) / (norms * longest), -1, 1)) + SLACK
                wanted = top.value.bounds(unit) * (factor or 1.0) <= limit[:, None]
                wanted[np.arange(len(unit)), np.asarray(batch.column(3))] = False
                i, shard = np.nonzero(wanted)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(shard.astype(np.int32)), batch.column(4).take(at)], batch.schema.names)

        near = near.unionAll(searched(rest.mapInArrow(others, rest.schema)))
    place = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _mark, _vector, _norm) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(key).alias("_id"), F.col(vector).alias("_vector")).where(F.col("_id").isNotNull() & F.col("_vector").isNotNull())
    rows = rows.where(~F.exists("_vector", bad) & F.exists("_vector", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("_id", F.xxhash64("_vector").alias("_mark"), "_vector", norm.alias("_norm"))


def op13_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op13_vantage": op13_vantage}
SQL: dict[str, str] = {}
