"""Topology of a network: graphs, islands, energised buses, feeders, branches, loops.

All tables are in long form. An edge has key (``type:id``), object_type, object_id, src, dst, conductive. Reach is
never walked: it is a join on the component label of the right subgraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import Frontiers, hubs_of, join_beside, joined, numbered, settle, store

EDGE = ("key", "object_type", "object_id", "src", "dst", "conductive")


def edges(line: DataFrame, transformer: DataFrame, switch: DataFrame, out_of_service: bool = False) -> DataFrame:
    """All branch elements with whether they conduct; elements out of service only if asked for."""

    def part(df: DataFrame, kind: str, a: str, b: str, on) -> DataFrame:
        rows = df if out_of_service else df.where("in_service")
        return rows.select(F.concat(F.lit(f"{kind}:"), "id").alias("key"), F.lit(kind).alias("object_type"), F.col("id").alias("object_id"), F.col(a).alias("src"), F.col(b).alias("dst"), on.alias("conductive"))

    served = F.col("in_service")
    return part(line, "line", "from_bus", "to_bus", served).unionAll(part(transformer, "transformer", "hv_bus", "lv_bus", served)).unionAll(part(switch, "switch", "from_bus", "to_bus", served & F.col("closed")))


def known_ends(edge: DataFrame, bus: DataFrame) -> DataFrame:
    """Edges both of whose ends are buses. The edges are written once and compared with the ends that are no bus, of which there are few, so that they needn't be joined with all buses twice."""
    rows = store(edge.where("src IS NOT NULL AND dst IS NOT NULL"))
    ids = bus.select(F.col("id").alias("end"))
    lost = store(rows.select(F.explode(F.array("src", "dst")).alias("end")).distinct().join(ids, "end", "left_anti"))
    return rows.join(lost.withColumnRenamed("end", "src"), "src", "left_anti").join(lost.withColumnRenamed("end", "dst"), "dst", "left_anti").select(*edge.columns)


def conductive(edge: DataFrame) -> DataFrame:
    return edge.where("conductive")


def ends(edge: DataFrame) -> DataFrame:
    """Each edge from both sides: bus, other, key and type."""
    return edge.select(F.explode(F.array(F.struct(F.col("src").alias("bus"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("bus"), F.col("src").alias("other")))).alias("e"), "key", "object_type").select("e.bus", "e.other", "key", "object_type")


def islands_of_buses(bus: DataFrame, edge: DataFrame) -> DataFrame:
    """(bus, component): the component is its smallest bus id."""
    found = joined(conductive(edge))
    return bus.select(F.col("id").alias("bus")).join(found.withColumnRenamed("node", "bus"), "bus", "left").select("bus", F.coalesce("component", "bus").alias("component"))


def active_sources(source: DataFrame, bus: DataFrame) -> DataFrame:
    return source.where("in_service").join(bus.select(F.col("id").alias("bus_id")), "bus_id", "left_semi").select(F.col("id").alias("source_id"), F.col("bus_id").alias("bus"))


def island_sums(labels: DataFrame, edge: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each island: buses, edges, sources, energised, radial, independent loops."""
    n_bus = labels.groupBy("component").agg(F.count("*").alias("bus_count"))
    label = labels.withColumnRenamed("bus", "src")
    wires = conductive(edge).join(label, "src").select("component", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    n_edge = wires.groupBy("component", "a", "b").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum("n").alias("edge_count"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("pair_count"))
    fed = sources.join(labels, "bus").groupBy("component").agg(F.count("*").alias("source_count"), F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("source_ids"))
    facts = n_bus.join(n_edge, "component", "left").join(fed, "component", "left").na.fill(0, ["edge_count", "pair_count", "source_count"]).na.fill("", ["source_ids"])
    return facts.select(
        "component", "bus_count", "edge_count", "source_count", "source_ids",
        (F.col("source_count") > 0).alias("energized"), (F.col("edge_count") == F.col("bus_count") - 1).alias("radial"), (F.col("pair_count") - F.col("bus_count") + 1).alias("loop_count"),
    )


def island_facts(labels: DataFrame, edge: DataFrame, sources: DataFrame) -> DataFrame:
    """``island_sums`` with ids, numbered by smallest bus."""
    facts = numbered(island_sums(labels, edge, sources), "component")
    text = F.col("number").cast("string")
    return facts.select(F.concat(F.lit("ISLAND_"), F.when(F.col("number") < 10_000, F.lpad(text, 4, "0")).otherwise(text)).alias("island_id"), *(c for c in facts.columns if c != "number"))


def edges_within(edge: DataFrame, buses: DataFrame) -> DataFrame:
    """(object_type, object_id, key) of the edges both of whose ends are in ``buses`` (bus)."""
    ids = buses.select("bus").distinct()
    return edge.join(ids.withColumnRenamed("bus", "src"), "src", "left_semi").join(ids.withColumnRenamed("bus", "dst"), "dst", "left_semi").select("object_type", "object_id", "key")


def isolated(bus: DataFrame, edge: DataFrame) -> DataFrame:
    return bus.select(F.col("id").alias("bus")).join(ends(conductive(edge)).select("bus"), "bus", "left_anti")


def energized(labels: DataFrame, sources: DataFrame) -> DataFrame:
    fed = sources.join(labels, "bus").select("component").distinct()
    return labels.join(fed, "component", "left_semi").select("bus")


def source_trace(labels: DataFrame, edge: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buses and edges that each source reaches."""
    of = sources.join(labels, "bus").select("source_id", "component")
    buses = of.join(labels, "component").select("source_id", "bus")
    wires = conductive(edge).join(labels.withColumnRenamed("bus", "src"), "src").join(of, "component").select("source_id", "key")
    return buses, wires


def source_totals(labels: DataFrame, edge: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many buses and edges each source reaches, and the first and last of them: counted once for each island."""
    of = sources.join(labels, "bus").select("source_id", "component")
    buses = labels.groupBy("component").agg(F.count("*").alias("n_buses"), F.min("bus").alias("first_bus"), F.max("bus").alias("last_bus"))
    wires = conductive(edge).join(labels.withColumnRenamed("bus", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"), F.min("key").alias("first_edge"), F.max("key").alias("last_edge"))
    return of.join(buses, "component").drop("component"), of.join(wires, "component").drop("component")


def parallel_groups(edge: DataFrame) -> DataFrame:
    """Bus pairs with more than one conductive element."""
    pairs = conductive(edge).groupBy(F.least("src", "dst").alias("bus_a"), F.greatest("src", "dst").alias("bus_b"))
    return pairs.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys")).where("n > 1")


def open_boundaries(switch: DataFrame, live: DataFrame) -> DataFrame:
    """Open switches in service, with whether either side is energised."""
    live = live.withColumn("on", F.lit(True))
    a = live.select(F.col("bus").alias("from_bus"), F.col("on").alias("from_on"))
    b = live.select(F.col("bus").alias("to_bus"), F.col("on").alias("to_on"))
    rows = switch.where("in_service AND NOT closed").join(a, "from_bus", "left").join(b, "to_bus", "left")
    return rows.select(F.col("id").alias("switch_id"), "from_bus", "to_bus", F.coalesce("from_on", F.lit(False)).alias("from_energized"), F.coalesce("to_on", F.lit(False)).alias("to_energized"))


def degrees(edge: DataFrame) -> DataFrame:
    return ends(conductive(edge)).groupBy("bus").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("neighbours"))


class Feeders:
    """Feeder traces without walking: a feeder is a source, one edge from it, and the component behind that edge.

    Components are those of the graph of allowed edges between buses that hold no active source. Feeders are named
    ``source|edge``; a trace stops at other sources' buses and, unless asked otherwise, at transformers.
    """

    def __init__(self, bus: DataFrame, edge: DataFrame, sources: DataFrame, cross_transformers: bool = False):
        wires = conductive(edge).where(F.col("src") != F.col("dst"))
        allowed = wires if cross_transformers else wires.where("object_type <> 'transformer'")
        self.stops = sources.select("bus").distinct()
        self.sources, self.allowed, self.wires = sources, allowed, wires
        inner = allowed.join(self.stops.withColumnRenamed("bus", "src"), "src", "left_anti").join(self.stops.withColumnRenamed("bus", "dst"), "dst", "left_anti")
        found = joined(inner)
        interior = bus.select(F.col("id").alias("bus")).join(self.stops, "bus", "left_anti")
        self.labels = store(interior.distinct().join(found.withColumnRenamed("node", "bus"), "bus", "left").select("bus", F.coalesce("component", "bus").alias("component")))
        side = ends(allowed)
        near = side.join(self.stops, "bus", "left_semi")  # from a source's bus
        self.rim = near.join(self.labels.withColumnRenamed("bus", "other"), "other", "left").select("bus", "other", "key", "component")
        roots = self.rim.join(sources, "bus")
        self.roots = settle(roots.select(F.concat("source_id", F.lit("|"), "key").alias("feeder"), "source_id", F.col("bus").alias("source_bus"), F.col("key").alias("root_edge"), F.col("other").alias("root"), "component").distinct())

    def buses(self) -> DataFrame:
        """(feeder, bus), each once: buses without a source by their component, source buses apart; the rows, which may be the square of the network, aren't shuffled."""
        sizes = store(self.labels.groupBy("component").agg(F.count("*").alias("n")))
        hubs = hubs_of(sizes, "component", self.labels.count())  # components of more buses than a task's share: their feeders go to the buses
        inside = join_beside(self.labels, self.roots.where("component IS NOT NULL").select("component", "feeder"), "component", hubs).select("feeder", "bus")
        ends_ = self.roots.select("feeder", F.explode(F.when(F.col("component").isNull(), F.array("source_bus", "root")).otherwise(F.array("source_bus"))).alias("bus"))
        return inside.unionAll(ends_).unionAll(self._other_sources())

    def _other_sources(self) -> DataFrame:
        at = self.rim.where("component IS NOT NULL").select("component", "bus").distinct()
        return self.roots.join(at, "component").where(F.col("bus") != F.col("source_bus")).select("feeder", "bus")

    def edges(self) -> DataFrame:
        inside = self.allowed.join(self.labels.withColumnRenamed("bus", "src"), "src").join(self.labels.select(F.col("bus").alias("dst")), "dst").select("component", "key")
        rim = self.rim.where("component IS NOT NULL").select("component", "key", "bus")
        own = self.roots.select("feeder", F.col("root_edge").alias("key"))
        cut = self.roots.join(rim, "component").where(F.col("bus") != F.col("source_bus")).select("feeder", "key")
        return self.roots.join(inside, "component").select("feeder", "key").unionAll(own).unionAll(cut).distinct()

    def boundaries(self) -> DataFrame:
        """Source buses of a feeder, and its buses with a conductive edge that the trace doesn't take."""
        direct = self.roots.select("feeder", F.explode(F.when(F.col("component").isNull(), F.array("source_bus", "root")).otherwise(F.array("source_bus"))).alias("bus"))
        back = self.roots.join(self.rim.select("component", F.col("bus").alias("source_bus"), F.col("other").alias("bus"), "key"), ["component", "source_bus"]).where(F.col("key") != F.col("root_edge")).select("feeder", "bus")
        barred = ends(self.wires.join(self.allowed.select("key"), "key", "left_anti")).select("bus").distinct()
        behind = self.roots.join(self.labels, "component").join(barred, "bus", "left_semi").select("feeder", "bus")
        return direct.unionAll(back).unionAll(behind).unionAll(self._other_sources()).distinct()

    def overlaps(self) -> DataFrame:
        """Buses without a source in more than one feeder: counted once for each component."""
        shared = self.roots.where("component IS NOT NULL").groupBy("component").agg(F.count("*").alias("n_feeders"), F.array_join(F.array_sort(F.collect_list("feeder")), ",").alias("feeders")).where("n_feeders > 1")
        return self.labels.join(shared, "component").select("bus", "n_feeders", "feeders")

    def members(self) -> tuple[DataFrame, DataFrame]:
        """Feeders in their compact form: (feeder, component) and (bus, component); buses of sources apart."""
        return self.roots.select("feeder", "component"), self.labels

    def facts(self, bus: DataFrame) -> DataFrame:
        """(feeder, n_buses, n_edges, has_cycle, label): sizes by component, a cycle where edges are as many as buses, and the feeder id of the root bus."""
        inside = self.labels.groupBy("component").agg(F.count("*").alias("n"))
        wires = self.allowed.join(self.labels.withColumnRenamed("bus", "src"), "src").join(self.labels.select(F.col("bus").alias("dst")), "dst").groupBy("component").agg(F.count("*").alias("e"))
        rim = self.rim.where("component IS NOT NULL").groupBy("component", "bus").agg(F.count("*").alias("k"))
        ends_ = rim.groupBy("component").agg(F.count("*").alias("stops"), F.sum("k").alias("cuts"))
        own = rim.withColumnRenamed("bus", "source_bus")
        rows = self.roots.join(inside, "component", "left").join(wires, "component", "left").join(ends_, "component", "left").join(own, ["component", "source_bus"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        sized = rows.select("feeder", "root", F.when(F.col("component").isNull(), 2).otherwise(zero("n") + zero("stops")).alias("n_buses"), F.when(F.col("component").isNull(), 1).otherwise(zero("e") + zero("cuts") - zero("k") + 1).alias("n_edges"))
        label = bus.select(F.col("id").alias("root"), F.col("feeder_id").alias("label"))
        return sized.join(label, "root", "left").select("feeder", "n_buses", "n_edges", (F.col("n_edges") >= F.col("n_buses")).alias("has_cycle"), "label")


def unstopped_feeders(labels: DataFrame | None, edge: DataFrame, sources: DataFrame, cross_transformers: bool = False) -> DataFrame:
    """(feeder, bus) of traces that go on through other sources' buses: for each source, the components around it without its own bus.

    ``labels`` are those of islands, which only traces across transformers need. Where transformers aren't crossed a trace stays in what the other edges join, so
    only that much is laid out for each source, not its island.
    """
    wires = conductive(edge).where(F.col("src") != F.col("dst"))
    allowed = wires
    if not cross_transformers:
        allowed = wires.where("object_type <> 'transformer'")
        labels = settle(joined(allowed).withColumnRenamed("node", "bus"))
    of = settle(sources.join(labels, "bus").select("source_id", F.col("bus").alias("at"), "component"))
    wide = allowed.join(labels.withColumnRenamed("bus", "src"), "src").join(of, "component")
    name = lambda c: F.concat("source_id", F.lit("|"), c)
    inner = wide.where((F.col("src") != F.col("at")) & (F.col("dst") != F.col("at")))
    found = settle(joined(inner.select(name("src").alias("src"), name("dst").alias("dst"))))
    side = ends(allowed).join(of.select("source_id", F.col("at").alias("bus")), "bus")
    roots = side.select(name("key").alias("feeder"), "source_id", F.col("bus").alias("at"), "other", name("other").alias("node"))
    near = roots.join(found, "node", "left").select("feeder", "source_id", "at", "other", F.coalesce("component", "node").alias("component"))
    members = near.join(found, "component").select("feeder", F.substring_index("node", "|", -1).alias("bus"))
    own = near.select("feeder", F.explode(F.array("at", "other")).alias("bus"))
    return members.unionAll(own).distinct()


def branches(edge: DataFrame, stops: DataFrame) -> DataFrame:
    """(key, branch): maximal paths between structural boundaries; a branch is named by its smallest edge.

    Boundaries are buses without exactly two edges to two neighbours, ends of switches and transformers, and ``stops``.
    """
    wires = conductive(edge).where(F.col("src") != F.col("dst"))
    side = ends(wires)
    shape = side.groupBy("bus").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("neighbours"), F.max((F.col("object_type") != "line").cast("int")).alias("split"), F.min("key").alias("a"), F.max("key").alias("b"))
    inner = shape.where("degree = 2 AND neighbours = 2 AND split = 0").join(stops.select("bus"), "bus", "left_anti")
    found = joined(inner.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return wires.select("key").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("branch"))


def branch_facts(edge: DataFrame, member: DataFrame, stops: DataFrame) -> DataFrame:
    """One row for each branch: edges, its end buses in order, and whether it closes on itself."""
    side = ends(conductive(edge).where(F.col("src") != F.col("dst"))).join(member, "key")
    inside = side.groupBy("branch", "bus").agg(F.count("*").alias("n"))
    degree = side.groupBy("bus").agg(F.count("*").alias("degree"), F.countDistinct("other").alias("neighbours"), F.max((F.col("object_type") != "line").cast("int")).alias("split"))
    bound = degree.where("degree <> 2 OR neighbours <> 2 OR split = 1").select("bus").unionAll(stops.select("bus")).distinct().withColumn("bound", F.lit(1))
    facts = inside.join(bound, "bus", "left").groupBy("branch").agg(F.min(F.when(F.col("bound") == 1, F.col("bus"))).alias("start_bus"), F.max(F.when(F.col("bound") == 1, F.col("bus"))).alias("end_bus"))
    sizes = member.groupBy("branch").agg(F.count("*").alias("edge_count"))
    return sizes.join(facts, "branch").select("branch", "edge_count", "start_bus", "end_bus", (F.col("start_bus").isNull() | (F.col("start_bus") == F.col("end_bus"))).alias("closed"))


def propagate_labels(edge: DataFrame, labels: DataFrame) -> DataFrame:
    """(bus, label): the nearest label, the smaller of equally near ones. ``labels``: bus, label.

    Components with one label take it by a join; only the others go through rounds, until one adds nothing.
    """
    parts = store(joined(edge))
    marked = labels.join(parts.withColumnRenamed("node", "bus"), "bus")
    kinds = marked.groupBy("component").agg(F.min("label").alias("label"), F.countDistinct("label").alias("n"))
    single = parts.join(kinds.where("n = 1"), "component").select(F.col("node").alias("bus"), "label")
    many = parts.join(kinds.where("n > 1"), "component").select(F.col("node").alias("bus"))
    inside = edge.where("dst IS NOT NULL").join(many.withColumnRenamed("bus", "src"), "src", "left_semi")  # both ends of an edge lie in one component
    side = settle(ends(inside.select("src", "dst", F.lit("").alias("key"), F.lit("").alias("object_type"))).select("bus", "other").distinct())
    # the neighbours of a frontier lie in it, in the one before, or are new
    rounds = Frontiers(edge.sparkSession)
    before, now = None, rounds.add(labels.join(many, "bus", "left_semi").groupBy("bus").agg(F.min("label").alias("label")))
    schema = now.schema
    while not now.isEmpty():
        fresh = now.join(side, "bus").groupBy(F.col("other").alias("bus")).agg(F.min("label").alias("label")).join(now.select("bus"), "bus", "left_anti")
        before, now = now, rounds.add(fresh if before is None else fresh.join(before.select("bus"), "bus", "left_anti"))
    alone = labels.join(parts.select(F.col("node").alias("bus")), "bus", "left_anti").groupBy("bus").agg(F.min("label").alias("label"))
    return single.unionAll(rounds.all(schema).select("bus", "label")).unionAll(alone)


#: The feeder of buses without one, and what buses made from geometry are called.
ORPHAN, MADE = "__ORPHAN__", "GEO_"


def geometry_inventory(bus: DataFrame) -> DataFrame:
    """One row (inventory): whether there are buses made from geometry, and no feeder id that two buses share."""
    shared = bus.where("feeder_id IS NOT NULL").groupBy("feeder_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") >= 2, F.lit(False)).alias("real"))
    made = bus.agg(F.coalesce(F.bool_or(F.col("id").startswith(MADE)), F.lit(False)).alias("made"))
    return made.crossJoin(shared).select((F.col("made") & ~F.col("real")).alias("inventory"))  # one row each


def feeder_heads(bus: DataFrame, line: DataFrame, source: DataFrame) -> DataFrame:
    """(bus): buses of sources and buses whose id is a feeder id; without any, buses where lines only begin; without any, the smallest bus."""
    ids = bus.select(F.col("id").alias("bus"))
    named = source.select(F.col("bus_id").alias("bus")).unionAll(bus.select(F.col("feeder_id").alias("bus"))).distinct()
    roots = line.select(F.col("from_bus").alias("bus")).join(line.select(F.col("to_bus").alias("bus")), "bus", "left_anti").distinct()
    least = bus.agg(F.min("id").alias("bus")).where("bus IS NOT NULL")
    ranked = ids.join(named, "bus", "left_semi").withColumn("rank", F.lit(1)).unionAll(ids.join(roots, "bus", "left_semi").withColumn("rank", F.lit(2))).unionAll(least.withColumn("rank", F.lit(3)))
    best = ranked.agg(F.min("rank").alias("best"))  # one row
    return ranked.crossJoin(F.broadcast(best)).where("rank = best").select("bus")


def equivalent_sources(bus: DataFrame, line: DataFrame, source: DataFrame) -> DataFrame:
    """(id, name, bus_id, nominal_voltage_kv): a source for each feeder head without one; a geometry inventory without a source gets one in all."""
    inventory = F.broadcast(geometry_inventory(bus))
    seed = bus.select(F.min(F.when(~F.col("id").startswith(MADE), F.col("id"))).alias("a"), F.min("id").alias("b")).select(F.coalesce("a", "b").alias("bus")).where("bus IS NOT NULL")
    none = source.agg(F.count("*").alias("n")).where("n = 0").drop("n")
    heads = feeder_heads(bus, line, source).crossJoin(inventory).where("NOT inventory").select("bus").unionAll(seed.crossJoin(none).crossJoin(inventory).where("inventory").select("bus"))
    free = heads.join(source.select(F.col("bus_id").alias("bus")), "bus", "left_anti")
    taken = source.select(F.col("id").alias("bus"), F.lit(True).alias("taken")).distinct()
    rows = free.join(taken, "bus", "left").join(bus.select(F.col("id").alias("bus"), "nominal_voltage_kv"), "bus")
    return rows.select(F.when(F.col("taken"), F.concat(F.lit("EQ_"), "bus")).otherwise(F.col("bus")).alias("id"), F.left(F.concat(F.lit("Equiv_"), "bus"), F.lit(40)).alias("name"), F.col("bus").alias("bus_id"), "nominal_voltage_kv")


def feeder_membership(bus: DataFrame, line: DataFrame, transformer: DataFrame, source: DataFrame) -> DataFrame:
    """(bus, feeder): that of the smallest head in the bus's component of lines and transformers, in service or not; else its own feeder id; else none.

    A head's feeder is its own feeder id or its bus. In a geometry inventory, or without a line or transformer, no bus has a feeder.
    """
    wires = line.select(F.col("from_bus").alias("src"), F.col("to_bus").alias("dst")).unionAll(transformer.select("hv_bus", "lv_bus"))
    found = joined(wires)
    labels = settle(bus.select(F.col("id").alias("bus"), "feeder_id").join(found.withColumnRenamed("node", "bus"), "bus", "left").withColumn("component", F.coalesce("component", "bus")))
    heads = feeder_heads(bus, line, source).join(labels, "bus").groupBy("component").agg(F.min_by(F.coalesce("feeder_id", "bus"), "bus").alias("head"))
    bare = geometry_inventory(bus).crossJoin(wires.agg(F.count("*").alias("n"))).select((F.col("inventory") | (F.col("n") == 0)).alias("bare"))  # one row
    rows = labels.join(heads, "component", "left").crossJoin(F.broadcast(bare))
    return rows.select("bus", F.when(F.col("bare"), F.lit(ORPHAN)).otherwise(F.coalesce("head", "feeder_id", F.lit(ORPHAN))).alias("feeder"))


def report(bus: DataFrame, line: DataFrame, transformer: DataFrame, switch: DataFrame, source: DataFrame, cross_transformers: bool = False) -> dict[str, DataFrame]:
    """The whole topology of a network, each part lazy: edges and labels are worked out once."""
    edge = store(known_ends(edges(line, transformer, switch), bus))
    sources = settle(active_sources(source, bus))
    labels = store(islands_of_buses(bus, edge))
    live = energized(labels, sources)
    open_ = open_boundaries(switch, live)
    stops = open_.select(F.explode(F.array("from_bus", "to_bus")).alias("bus")).unionAll(sources.select("bus")).distinct()
    feeders, member = Feeders(bus, edge, sources, cross_transformers), settle(branches(edge, stops))
    return {
        "islands": island_facts(labels, edge, sources), "traces": source_totals(labels, edge, sources)[0], "feeders": feeders.facts(bus), "branches": branch_facts(edge, member, stops), "parallel": parallel_groups(edge),
        "boundaries": open_, "overlaps": feeders.overlaps(), "energized": live, "deenergized": labels.select("bus").join(live, "bus", "left_anti"),
    }


def is_radial(islands: DataFrame) -> DataFrame:
    """One row (radial): whether there is an energised island and all of them are trees."""
    return islands.agg(F.coalesce(F.bool_and(F.when(F.col("energized"), F.col("radial"))), F.lit(False)).alias("radial"))
