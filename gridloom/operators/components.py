"""Connected components by star contraction (Kiveris et al., 2014) over edge DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges that one local contraction holds in memory.
CHUNK_EDGES = 1 << 19


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of this machine only where the session runs on it alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``settle``, but written as Parquet, which packs columns; rows may come back in other partitions."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, from 1 in the order of the columns, by ranges of rows whose sizes are added up; no task sees all rows."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


class Frontiers:
    """The rounds of a search, each written once to the shared folder and read back alone or all together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.rounds = spark, f"{checkpoint_dir(spark)}/frontiers-{uuid.uuid4().hex}", 0

    def add(self, rows: DataFrame) -> DataFrame:
        at = f"{self.folder}/{self.rounds}"
        self.rounds += 1
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def all(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/*")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces runs of edges by stars around the smallest node of each of their components.

    Labels go down along all edges at once and are then shortened (each label takes its own label's), until none moves.
    """
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        run = pa.Table.from_batches(held)
        n = len(run)
        nodes = pa.chunked_array([*run.column(0).chunks, *run.column(1).chunks]).combine_chunks().dictionary_encode()
        names = nodes.dictionary.take(order := pc.sort_indices(nodes.dictionary))
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(order)] = np.arange(len(names))
        ends = rank[np.asarray(nodes.indices)]
        u, v, label = ends[:n], ends[n:], np.arange(len(names))
        while True:
            low = np.minimum(label[u], label[v])
            moved = label.copy()
            for side in (u, v):  # both ends, and the roots that they had
                np.minimum.at(moved, side, low)
                np.minimum.at(moved, label[side], low)
            while (moved[moved] != moved).any():
                moved = moved[moved]
            if (moved == label).all():
                break
            label = moved
        own = np.flatnonzero(label != np.arange(len(names)))
        held.clear()
        return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(label[own]))], run.column_names)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_EDGES:
            yield stars()
    if any(b.num_rows for b in held):
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", contract: bool = True) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node. Self loops and nulls are ignored.

    Each round is two aggregations and two joins on the current stars; rounds grow with the logarithm of the
    longest path. ``contract`` first merges the edges that lie in the same partition. A star's centre has as many edges
    as its component has nodes: short rows, whose join AQE splits where they are many.
    """
    u, v = F.col(f"`{src}`"), F.col(f"`{dst}`")
    current = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    if contract:
        current = current.mapInArrow(_contract, current.schema)
    current, mark = settle(current.distinct()), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        current = settle(_small_star(_large_star(current)).distinct())
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Edges of a graph, or of what contraction has left of it, that one task joins at once.
FINISH = CHUNK_EDGES
#: Rows of a round that one task takes, and edges from which a node may be a hub.
TASK_ROWS = 1 << 13
LEAST_HUB = 64


def _whole(pairs: DataFrame) -> DataFrame:
    """(node, component) of at most FINISH edges (u, v), in one task."""
    stars = pairs.coalesce(1).mapInArrow(_contract, pairs.schema).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())


def join_beside(rows: DataFrame, facts: DataFrame, key: str, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` by ``key``; those of hubs, of which there are no more than tasks, by a broadcast."""
    if hubs is None:
        return rows.join(facts, key, how)
    few = F.broadcast(hubs.select(F.col("hub").alias(key)))
    return rows.join(F.broadcast(facts.join(few, key, "left_semi")), key).unionByName(rows.join(few, key, "left_anti").join(facts, key, how), allowMissingColumns=True)


def hubs_of(counted: DataFrame, key: str, total: int) -> DataFrame | None:
    """(hub): the keys of ``counted`` (key, n) that hold more than a task's mean of ``total`` rows, so fewer than tasks."""
    spark = counted.sparkSession
    most = max(LEAST_HUB, total / int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = counted.where(F.col("n") > most).select(F.col(key).alias("hub"))
    rows = found.collect()  # fewer than tasks
    return spark.createDataFrame(rows, found.schema) if rows else None


def _fit(df: DataFrame, rows: int) -> DataFrame:
    """Few rows in few tasks: each of them leaves files behind."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def _code(node: str) -> Column:
    return F.xxhash64(node)


def _numbered_pairs(names: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, number) with numbers in random order in place of hashes, and the pairs (a, b) of numbers."""
    names = store(numbered(names.select("node", F.xxhash64("node").alias("_order")), "_order", "node").select("node", "number"))
    one, two = (names.select(F.col("node").alias(c), F.col("number").alias(f"_{c}")) for c in ("a", "b"))
    return names, store(pairs.join(one, "a").join(two, "b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")))


def joined(edges: DataFrame, src: str = "src", dst: str = "dst", scattered: bool = False) -> DataFrame:
    """(node, component) as ``connected_components``, by local contraction (Lacki et al., 2018): each round halves the graph.

    Nodes go by their hashes, so in random order; where two nodes share one, by numbers instead. In a round every node
    takes the least number among itself and its neighbours (before the first, edges that lie together become stars, so that
    what is laid out by feeder or customer goes in one round); nodes of one number are one node of the next round, and an
    edge within it is gone. So all rounds together cost about twice the first, and components that are whole take no
    further part. What is left, FINISH edges at most, is joined in one task, as a graph of that size is from the start.

    ``scattered``: nodes are hashes, so in random order already, and any of a component's nodes may name it; then rounds
    go on to the end, without a last task.
    """
    u, v = F.col(f"`{src}`"), F.col(f"`{dst}`")
    pairs = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(u.isNotNull() & v.isNotNull() & (u != v))
    pairs = settle(pairs.distinct()) if scattered else store(pairs)
    left, least = pairs.count(), 0 if scattered else FINISH
    if left <= least and not scattered:
        return settle(_whole(pairs.toDF("u", "v")))
    current = _fit(pairs, left) if scattered else None
    if not scattered:
        names, a, b = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("number", _code("node"))), _code("a"), _code("b")
        current = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
        current = store(current.mapInArrow(_contract, "a long, b long"))
    rounds, kept, exact = [], settle if scattered else store, scattered
    while left > least or not exact:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "b").alias("into"), "n")
        taken = kept(_fit(taken, 2 * left))
        if not exact:
            exact = True
            if taken.count() != names.count():  # two nodes of one hash
                names, current = _numbered_pairs(names, pairs)
                continue
        hubs = hubs_of(taken, "node", left)
        one, two = (taken.select(F.col("node").alias(c), F.col("into").alias(f"_{c}")) for c in ("a", "b"))
        moved = join_beside(join_beside(current, one, "a", hubs), two, "b", hubs).where("_a != _b")
        current = kept(_fit(moved.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct(), left))
        left = current.count()
        current = _fit(current, left)
        rounds.append((taken.select("node", "into"), hubs))
    members = _whole(current.toDF("u", "v")) if left else None
    for taken, hubs in reversed(rounds):
        if members is None:
            members = taken.select("node", F.col("into").alias("component"))
        else:
            known = members.select(F.col("node").alias("into"), "component")
            members = join_beside(taken, known, "into", hubs, "left").select("node", F.coalesce("component", "into").alias("component"))
    if scattered:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")) if members is None else members
    named = store(names.select(F.col("node").alias("name"), F.col("number").alias("node")).join(members, "node").select(F.col("name").alias("node"), "component"))
    least = store(named.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    return join_beside(named, least.select("component", "least"), "component", hubs_of(least, "component", named.count())).select("node", F.col("least").alias("component"))


def components_of(spark: SparkSession, nodes: DataFrame, edges: DataFrame, node: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every row of ``nodes``; one without edges is its own component."""
    found = joined(edges, src, dst)
    return nodes.select(F.col(node).alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
