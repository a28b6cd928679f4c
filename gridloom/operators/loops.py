"""Loops of a network: for each edge that a spanning forest leaves over, the loop that it closes, as rows.

The forest is found by levels. Edges are dealt to parts of CHUNK_EDGES at most; a node belongs to the first part that has
it. Edges whose ends both belong to their part are joined there, breadth first; each tree is one node of the next level,
whose edges are those that are left. What lies together by feeder or customer so goes in one level; later levels put the
edges of a node together, in random order of nodes, and leave out edges that lead to nothing but leaves. The last level,
of FINISH edges at most, is one part. A closing edge's way through the tree of its level is a list of nodes, each with
the buses where the way comes in and goes out; that way through a node is found in the tree of the level below, down to
the buses. So jobs grow with the levels, not with the ways, and no row or task holds more than a part and its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import numbered, settle, store

#: Edges of a part, as a power of two, and edges of the last level.
CHUNK_BITS = 17
FINISH = 1 << 18
#: Ways that are asked of a tree in one group, and rows of a batch of answers.
ASKED = 1 << 16
ANSWERS = 1 << 16
#: Leaves are stripped in rounds as long as one in so many edges goes with each.
STRIPPED = 20

_END = "array<struct<n:string,p:long>>"


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of rows that are equal in the columns ``by``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [np.asarray(batch.column(c)) for c in by]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield tuple(int(m[i]) for m in marks), batch.slice(i, j - i)


def _tree(n: int, u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Parents (-1 at roots), the edges to them, depths and roots of a breadth-first forest of ``n`` nodes; roots are nodes of most edges."""
    ends, others = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.argsort(ends, kind="stable")
    degree = np.bincount(ends, minlength=n)
    first = np.concatenate([[0], np.cumsum(degree)]).tolist()
    beside, by = others[order].tolist(), (order % len(u)).tolist() if len(u) else []
    up, edge, depth, root = [-1] * n, [-1] * n, [0] * n, [-1] * n
    for r in np.argsort(-degree, kind="stable").tolist():
        if root[r] >= 0:
            continue
        root[r], now = r, [r]
        while now:
            fresh = []
            for x in now:
                for i in range(first[x], first[x + 1]):
                    y = beside[i]
                    if root[y] < 0:
                        root[y], up[y], edge[y], depth[y] = r, x, by[i], depth[x] + 1
                        fresh.append(y)
            now = fresh
    return up, edge, depth, root


#: Nodes that hold an end of an edge, from its bus up, each with its part.
_ENDS = pa.list_(pa.struct([("n", pa.string()), ("p", pa.int64())]))
_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("node", pa.string()), ("up", pa.string()), ("root", pa.string()), ("depth", pa.int64()), ("key", pa.string()), ("a", _ENDS), ("b", _ENDS)])
_OUT_SQL = f"kind int, part long, node string, up string, root string, depth long, key string, a {_END}, b {_END}"
TREE, CLOSING, REST = 0, 1, 2


def _join_part(part: int, foreign: list[pa.RecordBatch], edges: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's forest (a and b: the buses of the edge from a node to the one above), the edges that close a loop in it, and those left."""
    rows = pa.Table.from_batches(edges).combine_chunks()
    n = rows.num_rows
    coded = pa.concat_arrays([*rows["u"].chunks, *rows["v"].chunks]).dictionary_encode()
    names, ends = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    u, v = ends[:n], ends[n:]
    own = np.ones(len(names), bool)
    if foreign:
        own = ~np.asarray(pc.is_in(names, pa.concat_arrays([b.column("u") for b in foreign])).to_numpy(zero_copy_only=False))
    inside = np.flatnonzero(own[u] & own[v])
    up, edge, depth, root = (np.array(x, np.int64) for x in _tree(len(names), u[inside], v[inside]))
    met = np.zeros(len(names), bool)
    met[u[inside]] = met[v[inside]] = True
    nodes = np.flatnonzero(met)
    below = edge[nodes] >= 0  # all but roots
    by = np.where(below, inside[edge[nodes]] if len(inside) else 0, 0)
    forward = u[by] == nodes if n else below  # the edge's first end is the node
    both = pa.concat_arrays([x.cast(_ENDS) for c in ("a", "b") for x in rows[c].chunks])
    at = pa.array(np.where(forward, by, n + by), mask=~below)
    to = pa.array(np.where(forward, n + by, by), mask=~below)

    def made(kind: int, k: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array(np.full(k, kind, np.int32)), "part": pa.array(np.full(k, part, np.int64))}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(k, f.type)) for f in _OUT], schema=_OUT)

    yield made(TREE, len(nodes), node=names.take(pa.array(nodes)), up=names.take(pa.array(up[nodes], mask=~below)), root=names.take(pa.array(root[nodes])), depth=pa.array(depth[nodes]), a=both.take(at), b=both.take(to))
    keys = pa.concat_arrays(rows["key"].chunks)
    in_tree, local = np.zeros(n, bool), np.zeros(n, bool)
    in_tree[by[below]] = True
    local[inside] = True
    for kind, which in ((CLOSING, local & ~in_tree), (REST, ~local)):
        at = pa.array(np.flatnonzero(which))
        yield made(kind, len(at), key=keys.take(at), a=both.take(at), b=both.take(pa.array(n + np.flatnonzero(which))))


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, now = ([], []), None
    for (part, kind), rows in _runs(batches, ["part", "kind"]):
        if part != now and held[1]:
            yield from _join_part(now, *held)
        if part != now:
            held, now = ([], []), part
        held[kind].append(rows)
    if held[1]:
        yield from _join_part(now, *held)


def _node(end: str) -> F.Column:
    return F.element_at(end, -1)["n"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows as they lie with ``part``, that of CHUNK rows beside each other; written, since it holds for this order only."""
    return store(rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)))


class _Level:
    """One level's forest: ``trees`` (part, node, up, root, depth, a, b), ``closing`` (key, a, b) and, for the next level, ``rest`` (key, a, b)."""

    def __init__(self, edges: DataFrame, last: bool):
        rows = edges.select("part", F.lit(1).alias("kind"), "key", "a", "b", _node("a").alias("u"), _node("b").alias("v"))
        if not last:
            ends = rows.select("part", F.explode(F.array("u", "v")).alias("u"))
            owner = F.min("part").over(Window.partitionBy("u"))
            foreign = ends.withColumn("_owner", owner).where("part > _owner").select("part", "u").distinct()
            rows = rows.unionByName(foreign.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("part")
        else:
            rows = rows.coalesce(1)
        found = store(rows.sortWithinPartitions("part", "kind").mapInArrow(_join_parts, _OUT_SQL))
        of = lambda c, p="part": F.concat(F.slice(c, 1, F.size(c) - 1), F.array(F.struct(F.element_at(c, -1)["n"].alias("n"), F.col(p).alias("p"))))
        self.trees = found.where(f"kind = {TREE}").select("part", "node", "up", "root", "depth", of("a").alias("a"), of("b").alias("b"))
        closing = found.where(f"kind = {CLOSING}").select("key", of("a").alias("a"), of("b").alias("b"))
        self.rest = None
        if not last:
            rest = found.where(f"kind = {REST}").select("key", "a", "b", _node("a").alias("_a"), _node("b").alias("_b"))
            for c in ("a", "b"):
                of_tree = self.trees.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_root_{c}"), F.col("part").alias(f"_part_{c}"))
                rest = rest.join(of_tree, f"_{c}", "left").withColumn(f"_root_{c}", F.coalesce(f"_root_{c}", f"_{c}"))
            rest = store(rest.select("key", of("a", "_part_a").alias("a"), of("b", "_part_b").alias("b"), "_root_a", "_root_b"))
            closing = closing.unionAll(rest.where("_root_a = _root_b").select("key", "a", "b"))
            more = lambda c: F.concat(c, F.array(F.struct(F.col(f"_root_{c}").alias("n"), F.lit(None).cast("long").alias("p"))))
            self.rest = rest.where("_root_a <> _root_b").select("key", more("a").alias("a"), more("b").alias("b"))
        # of parallel edges the first closes, and none beside one of the tree
        x, y = F.col("a")[0]["n"], F.col("b")[0]["n"]
        named = F.struct("key", "a", "b")
        few = settle(closing.groupBy(F.least(x, y).alias("_x"), F.greatest(x, y).alias("_y")).agg(F.min_by(named, "key").alias("e")).select("_x", "_y", "e.*"))
        beside = self.trees.where("up IS NOT NULL").select(F.least(x, y).alias("_x"), F.greatest(x, y).alias("_y")).join(few.select("_x", "_y"), ["_x", "_y"], "left_semi")
        self.closing = settle(few.join(beside, ["_x", "_y"], "left_anti").select("key", "a", "b"))


def _stripped(edges: DataFrame, left: int) -> tuple[DataFrame, int]:
    """Edges (key, a, b) without most of those that lead to nothing but leaves, and how many are left."""
    while left > FINISH:
        ends = edges.select("key", _node("a").alias("u")).unionAll(edges.select("key", _node("b")))
        bare = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("key").distinct()
        edges = store(edges.join(bare, "key", "left_anti"))
        before, left = left, edges.count()
        if (before - left) * STRIPPED <= before:
            break
    return edges, left


def _levels(edge: DataFrame) -> list[_Level]:
    end = lambda c: F.array(F.struct(F.col(c).alias("n"), F.lit(None).cast("long").alias("p"))).alias("a" if c == "src" else "b")
    edges, found = _dealt(edge.where("conductive AND src <> dst").select("key", end("src"), end("dst"))), []
    left = edges.count()
    while left:
        last = left <= FINISH
        found.append(_Level(edges.withColumn("part", F.lit(0).cast("long")) if last else edges, last))
        if last:
            break
        rest = store(found[-1].rest)
        edges, left = _stripped(rest, rest.count())
        if left > FINISH:  # a node's edges lie together, nodes in random order
            rank = lambda c: F.xxhash64(_node(c), F.lit(len(found)))
            edges = _dealt(edges.withColumn("_rank", F.least(rank("a"), rank("b"))).repartitionByRange("_rank").sortWithinPartitions("_rank").drop("_rank"))
    return found


_ANSWER = pa.schema([("loop", pa.string()), ("order", pa.list_(pa.int64())), ("node", pa.string()), ("a", _ENDS), ("b", _ENDS)])
_ANSWER_SQL = f"loop string, order array<long>, node string, a {_END}, b {_END}"


class _Trees:
    """A part's trees, to be climbed."""

    def __init__(self, rows: list[pa.RecordBatch]):
        column = lambda c: pa.concat_arrays([r.column(c) for r in rows])
        self.names, self.a, self.b = column("node"), column("a").cast(_ENDS), column("b").cast(_ENDS)
        self.place = {x: i for i, x in enumerate(self.names.to_pylist())}
        self.up, self.depth = [self.place.get(x, -1) for x in column("up").to_pylist()], column("depth").to_pylist()

    def way(self, x: int, y: int) -> tuple[list[int], list[int]]:
        """The nodes from x to where both meet, that one too, and those from there to y."""
        up, depth, one, two = self.up, self.depth, [], []
        while x != y:
            if depth[x] >= depth[y]:
                one.append(x)
                x = up[x]
            else:
                two.append(y)
                y = up[y]
        return [*one, x], two[::-1]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways through trees: rows of a group are its trees', then those that ask, from the node x to y, where the way comes in at a and goes out at b."""
    held, trees, now = [], None, None
    for (part, salt, kind), rows in _runs(batches, ["part", "salt", "kind"]):
        if (part, salt) != now:
            held, trees, now = [], None, (part, salt)
        if kind == 0:
            held.append(rows)
            continue
        if trees is None:
            trees, held = _Trees(held), []
        n, m, place = len(trees.names), rows.num_rows, trees.place
        ends = pa.concat_arrays([trees.a, trees.b, rows.column("a").cast(_ENDS), rows.column("b").cast(_ENDS)])
        before = np.asarray(rows.column("order").flatten()).reshape(m, -1)  # all of one length

        def answers() -> pa.RecordBatch:
            order = np.concatenate([before[who], np.array(seq, np.int64)[:, None]], axis=1)
            order = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))
            return pa.RecordBatch.from_arrays([rows.column("loop").take(pa.array(who)), order, trees.names.take(pa.array(node)), ends.take(pa.array(came)), ends.take(pa.array(went))], schema=_ANSWER)

        who, seq, node, came, went = [], [], [], [], []
        for j, (x, y) in enumerate(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist())):
            one, two = trees.way(place[x], place[y])
            k = len(one) + len(two)
            who += [j] * k
            seq += range(k)
            node += [*one, *two]
            came += [2 * n + j, *(n + i for i in one[:-1]), *two]
            went += [*one[:-1], *(n + i for i in two), 2 * n + m + j]
            if len(who) >= ANSWERS:
                yield answers()
                who, seq, node, came, went = [], [], [], [], []
        if who:
            yield answers()


def _ways(levels: list[_Level]) -> DataFrame:
    """(loop, order, bus): the way of each closing edge through the trees, from level to level; ``order`` holds a number for each level."""
    asked, top = None, len(levels) - 1
    for k in range(top, -1, -1):
        own = levels[k].closing.select(F.col("key").alias("loop"), F.array_repeat(F.lit(0).cast("long"), top - k).alias("order"), "a", "b")
        asked = own if asked is None else own.unionAll(asked.select("loop", "order", "a", "b"))
        at = lambda c, f, k=k: F.col(c)[k][f]
        asked = asked.select("loop", "order", F.col("a").cast(_END).alias("a"), F.col("b").cast(_END).alias("b"), at("a", "n").alias("x"), at("b", "n").alias("y"), at("a", "p").alias("part"))
        through = asked.where("x = y").select("loop", F.concat("order", F.array(F.lit(0).cast("long"))).alias("order"), F.col("x").alias("node"), "a", "b")
        asked = asked.where("x <> y")
        salts = F.broadcast(settle(asked.groupBy("part").agg(F.ceil(F.count("*") / ASKED).alias("salts"))))  # one row for each part
        rows = asked.join(salts, "part").select("part", F.pmod(F.xxhash64("loop", "order"), "salts").alias("salt"), F.lit(1).alias("kind"), "loop", "order", "x", "y", "a", "b")
        trees = levels[k].trees.join(salts, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "up", "depth", F.col("a").cast(_END).alias("a"), F.col("b").cast(_END).alias("b"))
        both = rows.unionByName(trees, allowMissingColumns=True).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")
        asked = store(both.mapInArrow(_answer, _ANSWER_SQL).unionAll(through))
    return asked.select("loop", "order", F.col("node").alias("bus"))


def closing_edges(edge: DataFrame) -> DataFrame:
    """(loop, bus): the edge that closes each loop and one of its ends, without the ways."""
    found = [x.closing.select(F.col("key").alias("loop"), F.col("a")[0]["n"].alias("bus")) for x in _levels(edge)]
    return reduce(DataFrame.unionAll, found) if found else edge.select(F.col("key").alias("loop"), F.col("src").alias("bus")).limit(0)


def loops(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, loop, place, bus): as many loops as the network has independent ones, parallel elements and self loops apart.

    A loop is named by the edge that closes it. It begins at its smallest bus and goes on to the smaller one of the two
    next to it. ``labels``: (bus, component).
    """
    levels = _levels(edge)
    if not levels:
        return labels.select("component", F.lit("").alias("loop"), F.lit(0).cast("long").alias("place"), "bus").limit(0)
    around = Window.partitionBy("loop")
    place = (F.row_number().over(around.orderBy("order")) - 1).cast("long")
    rows = store(_ways(levels).select("loop", place.alias("place"), "bus", F.count("*").over(around).alias("n")))
    start = rows.groupBy("loop").agg(F.min_by("place", "bus").alias("start"))
    turned = rows.join(start, "loop").withColumn("place", F.pmod(F.col("place") - F.col("start"), F.col("n")))
    beside = turned.groupBy("loop").agg(F.max(F.when(F.col("place") == 1, F.col("bus"))).alias("next"), F.max(F.when(F.col("place") == F.col("n") - 1, F.col("bus"))).alias("last"))
    other = F.col("next") > F.col("last")
    ordered = turned.join(beside, "loop").select("loop", F.when(other, F.pmod(-F.col("place"), F.col("n"))).otherwise(F.col("place")).alias("place"), "bus")
    return ordered.join(labels, "bus").select("component", "loop", "place", "bus")


def numbered_loops(found: DataFrame) -> DataFrame:
    """(component, loop, n_buses, number): the loops of each component, from 1 by their names. ``found``: the rows of ``loops``."""
    return numbered_names(found.groupBy("component", "loop").agg(F.count("*").alias("n_buses")))


def numbered_names(found: DataFrame) -> DataFrame:
    """``found`` with ``number``, from 1 in each component by the loops' names. ``found``: component, loop and more, a row for each loop."""
    sizes = numbered(found, "component", "loop")
    first = sizes.groupBy("component").agg(F.min("number").alias("_first"))
    return sizes.join(first, "component").select(*found.columns, (F.col("number") - F.col("_first") + 1).alias("number"))
