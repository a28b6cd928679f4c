"""Connectivity from geometry, hierarchy and point chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import distance
from gridloom.operators.components import settle, store


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order given."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _cells(points: DataFrame, bus: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Points with their cell, and buses (bus_id, bx, by) in each cell from which they can be reached: cells are two tolerances wide, so four at most. Points, of which there are more, aren't repeated."""
    cell = lambda c: F.floor(c / (2 * tolerance))
    sides = lambda c: F.explode(F.array_distinct(F.array(cell(F.col(c) - tolerance), cell(F.col(c) + tolerance))))
    placed = bus.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("id").alias("bus_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return points.withColumn("_i", cell(F.col("x"))).withColumn("_j", cell(F.col("y"))), placed.withColumn("_i", sides("bx")).withColumn("_j", sides("by"))


def within_radius(points: DataFrame, bus: DataFrame, tolerance: float) -> DataFrame:
    """Candidates (point columns, bus_id, distance) within the tolerance, by an equi-join on grid cells.

    ``points``: x, y and what names the point; ``bus``: id, x, y.
    """
    at, placed = _cells(points, bus, tolerance)
    found = at.join(placed, ["_i", "_j"]).withColumn("distance", distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")))
    return found.where(F.col("distance") <= tolerance).drop("_i", "_j", "bx", "by")


#: Buses of a cell, in the mean around a bus, from which nearest ones are searched for in smaller cells first.
CELL_BUSES = 8


def nearest_two(points: DataFrame, bus: DataFrame, tolerance: float, keys: list[str]) -> DataFrame:
    """(keys, bus_id, distance, second): the nearest bus of each point within the tolerance, and the distance of the next; ``keys`` name a point.

    Where buses are dense the radius begins small; a point with two buses within it is done, the others go on with twice
    the radius, up to the tolerance. So a point looks at few buses however dense they are. A point lies in one cell, where
    its candidates are ranked without being moved.
    """
    cell = lambda c: F.floor(F.col(c) / (2 * tolerance))
    around = bus.where("x IS NOT NULL AND y IS NOT NULL").groupBy(cell("x"), cell("y")).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
    halved = 0
    while (around or 0) / 4**halved > CELL_BUSES:
        halved += 1
    order = Window.partitionBy("_i", "_j", *keys).orderBy("distance", "bus_id")
    done, left = None, points
    for k in range(halved, -1, -1):
        radius = tolerance / 2**k
        at, placed = _cells(left.select(*keys, "x", "y"), bus, radius)
        far = distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
        near = at.join(placed.withColumnsRenamed({"_i": "_bi", "_j": "_bj"}), (F.col("_i") == F.col("_bi")) & (F.col("_j") == F.col("_bj")) & (far <= radius), "left").withColumn("distance", far)
        ranked = near.withColumn("_rank", F.row_number().over(order)).withColumn("second", F.lead("distance").over(order)).where("_rank = 1")
        found = store(ranked.select(*keys, "x", "y", "bus_id", "distance", "second"))
        whole = (found.where("second IS NOT NULL") if k else found.where("bus_id IS NOT NULL")).select(*keys, "bus_id", "distance", "second")
        done = whole if done is None else done.unionAll(whole)
        left = found.where("second IS NULL")
    return done


def resolve(candidates: DataFrame, keys: list[str], tie: float) -> DataFrame:
    """The candidate of each point that is alone or nearer than the second by more than ``tolerance``; else null."""
    near = Window.partitionBy(*keys).orderBy("distance", "bus_id")
    ranked = candidates.withColumn("_rank", F.row_number().over(near)).withColumn("_second", F.lead("distance").over(near)).where("_rank = 1")
    clear = F.col("_second").isNull() | (F.col("_second") - F.col("distance") > tie)
    return ranked.select(*keys, F.when(clear, F.col("bus_id")).alias("bus_id"), "distance")


def resolve_within(points: DataFrame, bus: DataFrame, tolerance: float, keys: list[str], tie: float) -> DataFrame:
    """``resolve`` of the candidates within the tolerance, of which only the two nearest of each point are looked for."""
    clear = F.col("second").isNull() | (F.col("second") - F.col("distance") > tie)
    return nearest_two(points, bus, tolerance, keys).select(*keys, F.when(clear, F.col("bus_id")).alias("bus_id"), "distance")


def suggestions(candidates: DataFrame, keys: list[str], tie: float) -> DataFrame:
    """(keys, n, candidates) of the points that ``resolve`` leaves open: their candidates by distance, each (bus_id, distance_m)."""
    item = F.struct("distance", "bus_id")
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"))  # buses within the tolerance of one point
    open_ = lists.where((F.size("_all") > 1) & (F.try_element_at("_all", F.lit(2))["distance"] - F.col("_all")[0]["distance"] <= tie))
    return open_.select(*keys, F.size("_all").cast("long").alias("n"), F.transform("_all", lambda c: F.struct(c["bus_id"].alias("bus_id"), F.round(c["distance"], 3).cast("decimal(18,3)").alias("distance_m"))).alias("candidates"))


def apply_ends(line: DataFrame, resolved: DataFrame) -> DataFrame:
    """Lines with unresolved ends filled in. ``resolved``: id, side ('from' or 'to'), bus_id."""
    sides = resolved.groupBy("id").agg(F.max(F.when(F.col("side") == "from", F.col("bus_id"))).alias("_from"), F.max(F.when(F.col("side") == "to", F.col("bus_id"))).alias("_to"))
    return line.join(sides, "id", "left").withColumn("from_bus", F.coalesce("from_bus", "_from")).withColumn("to_bus", F.coalesce("to_bus", "_to")).drop("_from", "_to")


def snap_spans(spans: DataFrame, bus: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Ends of spans (id, side, x, y) on the nearest bus within the tolerance, else on a new bus ``GEO_x_y``: (ends, new buses)."""
    best = within_radius(spans, bus, tolerance).groupBy("id", "side").agg(F.min(F.struct("distance", "bus_id")).alias("b"))
    geo = F.concat(F.lit("GEO_"), F.bround("x", 0).cast("long").cast("string"), F.lit("_"), F.bround("y", 0).cast("long").cast("string"))
    ends = spans.join(best, ["id", "side"], "left").select("id", "side", "x", "y", F.coalesce("b.bus_id", geo).alias("bus_id"), F.col("b").isNull().alias("created"))
    made = ends.where("created").groupBy("bus_id").agg(F.min(F.struct("x", "y")).alias("p")).select(F.col("bus_id").alias("id"), "p.x", "p.y")
    return ends, made


def span_lines(ends: DataFrame, line: DataFrame, default_km: float) -> DataFrame:
    """(id, from_bus, to_bus, length_km): a line for each span that is no line yet and whose two ends lie on different buses.

    ``ends``: what ``snap_spans`` gives; the length is that of the span, in metres, but no less than the default.
    """
    at = lambda side: F.max(F.when(F.col("side") == side, F.struct("bus_id", "x", "y")))
    spans = ends.groupBy("id").agg(at("from").alias("a"), at("to").alias("b")).where("a.bus_id <> b.bus_id").join(line.select("id"), "id", "left_anti")
    length = distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) / 1000
    return spans.select("id", F.col("a.bus_id").alias("from_bus"), F.col("b.bus_id").alias("to_bus"), F.greatest(length, F.lit(default_km)).alias("length_km"))


def unheld(asked: DataFrame, held: DataFrame, value: Column, tasks: int | None = None) -> DataFrame:
    """(id, value) of the ids asked for that are not held, by one aggregation of both. ``value``: over the rows of ``asked``; ``tasks``: in how many the ids are dealt."""
    both = asked.where("id IS NOT NULL").withColumn("_held", F.lit(False)).unionByName(held.select("id", F.lit(True).alias("_held")), allowMissingColumns=True)
    both = both.repartition("id") if tasks is None else both.repartition(tasks, "id")
    return both.groupBy("id").agg(value.alias("value"), F.max("_held").alias("_held")).where("NOT _held").drop("_held")


def missing_ends(branch: DataFrame, bus: DataFrame, kv: float, tasks: int | None = None) -> DataFrame:
    """New buses for ends that no bus has. ``branch``: from_bus, to_bus."""
    ends = branch.select(F.explode(F.array("from_bus", "to_bus")).alias("id"))
    return unheld(ends, bus, F.count("*"), tasks).select("id", F.lit(kv).alias("nominal_voltage_kv"))


def held_of(asked: DataFrame, held: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, hit): each distinct key asked for, a null too, and whether it is held, by one aggregation of both."""
    both = asked.select(key, F.lit(True).alias("_asked"), F.lit(False).alias("hit")).unionAll(held.where(F.col(key).isNotNull()).select(key, F.lit(False), F.lit(True)))
    both = both.repartition(key) if tasks is None else both.repartition(tasks, key)
    return both.groupBy(key).agg(F.max("_asked").alias("_asked"), F.max("hit").alias("hit")).where("_asked").drop("_asked")


def hierarchical_ends(own: Column, parent: Column, feeder: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Ends of a segment from its parent: the start is the parent, or the feeder at the root; the end is the segment."""
    root = parent.isNull() | parent.isin("0", "") | (parent == own)
    return F.coalesce(start, F.when(root, feeder).otherwise(parent)), F.coalesce(end, own)


def preorder(segment: DataFrame) -> DataFrame:
    """Place of every segment (feeder, id, parent) in its feeder's hierarchy, parents first.

    Ancestor paths grow by pointer doubling; a path longer than its feeder has segments is a cycle, whose segments come
    last.
    """
    sizes = segment.groupBy("feeder").agg(F.count("*").alias("n"))
    keyed = segment.select("feeder", "id", "parent").join(sizes, "feeder")
    known = keyed.select("feeder", F.col("id").alias("parent"), F.lit(True).alias("_known"))
    state = settle(keyed.join(known, ["feeder", "parent"], "left").select("feeder", "id", "n", F.when(F.col("_known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("up"), F.array("id").alias("path")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select("feeder", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = state.join(above, ["feeder", "up"], "left")
        longer = F.when(F.col("up").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path"))
        grown = joined.select("feeder", "id", "n", "_up", longer.alias("path"))
        state = settle(grown.select("feeder", "id", "n", F.when(F.size("path") <= F.col("n"), F.col("_up")).alias("up"), "path"))
    lost = F.size("path") > F.col("n")
    place = F.row_number().over(Window.partitionBy("feeder").orderBy(lost, F.when(~lost, F.col("path")), "id"))
    return state.select("feeder", "id", place.alias("place"), F.when(lost, F.lit(None)).otherwise(F.size("path") - 1).cast("int").alias("depth"))


def chain(points: DataFrame, tasks: int | None = None) -> DataFrame:
    """(feeder, place, id, x, y, at): ordered points (feeder, id, seq, x, y) of each feeder with the distance run so far.

    A point equal (to 1e-6) to the last kept one is dropped; feeders of fewer than two points give none. ``tasks``: in how
    many the feeders are dealt; else Spark's own.
    """
    dealt = lambda df: df.repartition("feeder") if tasks is None else df.repartition(tasks, "feeder")
    order = Window.partitionBy("feeder").orderBy("seq", "id", "x", "y")
    same = lambda x, y: F.coalesce((F.abs(F.col("x") - x) <= 1e-6) & (F.abs(F.col("y") - y) <= 1e-6), F.lit(False))
    rows = points.select("feeder", "seq", F.col("id").cast("string").alias("id"), "x", "y")
    while True:  # again only where points creep, each within reach of the one before but not of the last kept
        marked = dealt(rows).withColumn("_same", same(F.lag("x").over(order), F.lag("y").over(order)))
        # of a run of equal points those near its first go; all in one order, so that rows are sorted once
        first = F.last(F.when(~F.col("_same"), F.struct("x", "y")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        judged = marked.withColumn("_first", first).where(~(F.col("_same") & same(F.col("_first.x"), F.col("_first.y"))))
        judged = store(judged.select("feeder", "seq", "id", "x", "y", F.col("_same").alias("_left")))
        rows = judged.drop("_left")
        if judged.where("_left").isEmpty():
            break
    step = F.coalesce(distance(F.lag("x").over(order), F.lag("y").over(order), F.col("x"), F.col("y")), F.lit(0.0))
    run = F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt(rows).withColumn("_step", step).select("feeder", (F.row_number().over(order) - 1).alias("place"), "id", "x", "y", run.alias("at"), F.count("*").over(Window.partitionBy("feeder")).alias("_n"))
    return placed.where("_n >= 2").drop("_n")


def assign_to_chain(chains: DataFrame, segment: DataFrame) -> DataFrame:
    """Chain points at which each segment (feeder, id, place, length) begins and ends.

    Lengths run along the chain in the order of ``place``, cut at its end; a missing length is an even share. An end
    goes to the nearest point (the lower of two equally near) and behind its start where the chain allows it. Ends and
    points are put in one order by distance, so that an end's neighbours are the last point before and the next after.
    """
    whole = chains.groupBy("feeder").agg(F.max("at").alias("_path"), F.max("place").alias("_last"))
    sizes = segment.groupBy("feeder").agg(F.count("*").alias("_n"))
    rows = segment.join(whole, "feeder").join(sizes, "feeder").withColumn("_length", F.coalesce("length", F.col("_path") / F.col("_n")))
    run = F.sum("_length").over(Window.partitionBy("feeder").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = settle(rows.withColumn("_run", run).select("feeder", "id", "place", "_path", "_last", F.least("_path", "_run").alias("_to"), F.least(F.col("_path"), F.col("_run") - F.col("_length")).alias("_from")))
    asked = rows.select("feeder", "id", F.explode(F.array(F.struct(F.lit("i").alias("side"), F.col("_from").alias("d")), F.struct(F.lit("j").alias("side"), F.col("_to").alias("d")))).alias("e")).select("feeder", "id", "e.side", "e.d", F.lit(None).cast("struct<at:double,place:int>").alias("p"))
    points = chains.select("feeder", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("side"), F.col("at").alias("d"), F.struct("at", F.col("place").cast("int").alias("place")).alias("p"))
    order = Window.partitionBy("feeder").orderBy("d")
    both = asked.unionByName(points).withColumn("_lo", F.last("p", True).over(order)).withColumn("_hi", F.first("p", True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("_hi").isNull() | (F.col("d") - F.col("_lo.at") <= F.col("_hi.at") - F.col("d")), F.col("_lo.place")).otherwise(F.col("_hi.place"))
    found = both.where("side IS NOT NULL").select("feeder", "id", "side", F.coalesce(near, F.lit(0)).alias("at")).groupBy("feeder", "id").agg(F.max(F.when(F.col("side") == "i", F.col("at"))).alias("_i0"), F.max(F.when(F.col("side") == "j", F.col("at"))).alias("_j0"))
    rows = rows.join(found, ["feeder", "id"])
    end = lambda d, c: F.when(F.col(d) <= 0, 0).when(F.col(d) >= F.col("_path"), F.col("_last")).otherwise(F.col(c))
    rows = rows.withColumn("_i", end("_from", "_i0")).withColumn("_j", end("_to", "_j0"))
    rows = rows.withColumn("_j", F.when((F.col("_j") <= F.col("_i")) & (F.col("_i") < F.col("_last")), F.col("_i") + 1).otherwise(F.col("_j")))
    rows = rows.withColumn("_i", F.when((F.col("_j") == F.col("_i")) & (F.col("_i") > 0), F.col("_i") - 1).otherwise(F.col("_i")))
    names = chains.select("feeder", "place", "id")
    out = rows.join(names.toDF("feeder", "_i", "from_bus"), ["feeder", "_i"]).join(names.toDF("feeder", "_j", "to_bus"), ["feeder", "_j"])
    return out.select("feeder", "id", "place", "from_bus", "to_bus", F.round("_from", 6).alias("from_at"), F.round("_to", 6).alias("to_at"))


def chain_counts(chains: DataFrame, segment: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: feeders_linked, lines_updated and lines_skipped (those of feeders without a chain)."""
    linked = chains.select("feeder").distinct().join(segment.select("feeder").distinct(), "feeder").agg(F.count("*").alias("feeders_linked"))
    done = assigned.agg(F.count("*").alias("lines_updated"))
    return linked.crossJoin(done).crossJoin(segment.agg(F.count("*").alias("_n"))).select("feeders_linked", "lines_updated", (F.col("_n") - F.col("lines_updated")).alias("lines_skipped"))  # one row each
