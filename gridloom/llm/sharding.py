"""Operator 1, sharding by balanced label propagation.

Documents are linked through groups: those of equal texts, or those of a table of links, in which a document may be in
any number of groups. Every document starts in a shard by hash. In each round every linked document counts its
neighbours in each shard (a sum over its groups) and wants to move where most of them are, or, where it can't, where
most of them are among the shards with room. Between each two shards a quota says what share of the wishes is granted:
the largest for which every shard takes in no more than its free places and those that its own leavers free, so shards
that are full exchange documents. The movers of a small group go together, those of a large group one by one, by hash.
At first a shard may hold a quarter more than its share; as that slack shrinks, a shard that is too full sends some of
its groups, each as a whole, to shards with room. So a group that fits in one shard gathers there, and one that doesn't
fills a few shards. Unlinked documents, which cut nothing wherever they are, then fill the rooms that are left, and a
last pass gives every document its place in one order over all shards (shard, then unlinked, linked, unlinked
documents), cut into shards whose row counts differ by one at most: at each of these cuts one group may be parted.

All state is per document or per (group, shard) and stays in Spark; the driver sees a few numbers for each shard.
A group of any size is handled through sums, never listed, and the documents of a hot group are dealt over all tasks.
Everything is DataFrame expressions.

Cases: a null text counts as empty (size 1) and null texts are linked like equal ones; rows alike in id and text are one
node of as much weight, and get places next to each other; null ids are placed like others; links of unknown ids or
without a group are not used; texts of any length are only hashed and measured; with fewer rows than shards some shards
stay empty; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Spread, partitions, settle, spread_join, table

ROUNDS = 8
#: Rounds end before when fewer than one in so many linked rows would move.
STILL = 500
#: By how much a shard may be too full in the first round; in the last two by nothing.
SLACK = 0.25
#: Movers of a group go together if the group fills this share of a shard at most.
TOGETHER = 1 / 4


def _unit(*columns) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(values: list[float], shard: str) -> Column:
    return F.element_at(F.from_json(F.lit(str([float(v) for v in values])), "array<double>"), F.expr(f"int({shard}) + 1"))


def _quotas(wanted: list[list[float]], room: list[float]) -> list[list[float]]:
    """The shares of the wishes (from shard, to shard) that can be granted, where leavers free places for others."""
    every = range(len(room))
    share = [1.0 for _ in every]
    for _ in range(200):  # shares only fall, to the largest that fit
        flow = [[wanted[a][b] * share[b] for b in every] for a in every]
        spare = [max(0.0, room[b] + sum(flow[b])) for b in every]
        into = [sum(flow[a][b] for a in every) for b in every]
        if all(into[b] <= spare[b] + 1e-6 for b in every):
            break
        share = [share[b] * min(1.0, spare[b] / into[b]) if into[b] else share[b] for b in every]
    return [share for _ in every]  # alike from all shards


def propagate(member: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) after moving nodes towards their neighbours' shards; ``member``: (node, group, weight, shard), each node and group once."""
    first = F.row_number().over(Window.partitionBy("node").orderBy("group")) == 1
    sizes = member.groupBy("group").agg(F.sum("weight").alias("_w")).where(F.col("_w") > TOGETHER * capacity).select("group", F.lit(True).alias("large"))
    spread = Spread(settle(spread_join(settle(member.withColumn("own", F.when(first, F.col("weight")).otherwise(0))), sizes, "group", "left")), "group")
    spread.rows = settle(spread.rows)
    held = {r[0]: r[1] for r in spread.rows.groupBy("shard").agg(F.sum("own")).collect()}  # a row for each shard at most
    every = range(shards)
    loads = [float(held.get(i, 0)) for i in every]
    for step in range(rounds):
        full = capacity * (1 + SLACK * max(0.0, 1 - step / max(1, rounds - 2)))
        room = [full - n for n in loads]
        cells = spread.rows.groupBy("group", "shard").agg(F.sum("weight").alias("held")).withColumnRenamed("shard", "there")
        near = spread.join(cells).withColumnRenamed("shard", "home").repartition("node")  # a row for each shard that holds some of the group
        votes = near.groupBy("node", "weight", "home", "there").agg(F.sum("held").alias("held"), F.max(F.struct("held", "group", "large")).alias("lead"), F.count("*").alias("groups"))
        own = F.col("there") == F.col("home")
        votes = votes.withColumn("held", F.col("held") - F.when(own, F.col("weight") * F.col("groups")).otherwise(0))
        goal = F.struct("held", (-F.col("there")).alias("back"), "lead")
        goals = votes.groupBy("node", "weight", "home").agg(F.max(goal).alias("best"), F.max(F.when(own | (_pick(room, "there") >= 1), goal)).alias("open"), F.max(F.when(own, goal)).alias("stay"))
        crowd = lambda c: F.when(F.col(f"{c}.lead.large"), F.col("node")).otherwise(F.col(f"{c}.lead.group").cast("string"))
        better = lambda c: (-F.col(f"{c}.back") != F.col("home")) & ((F.col(f"{c}.held") > F.col("stay.held")) | ((F.col(f"{c}.held") == F.col("stay.held")) & (-F.col(f"{c}.back") < F.col("home"))))
        wish = lambda c: F.when(better(c), -F.col(f"{c}.back"))
        wishes = settle(goals.select("node", "weight", "home", wish("best").alias("one"), wish("open").alias("two"), crowd("best").alias("crowd_one"), crowd("open").alias("crowd_two"), crowd("stay").alias("crowd")))
        asked = wishes.groupBy("home", "one", "two").agg(F.sum("weight")).collect()  # shards to the power of three at most
        loads = [float(sum(n for home, _, _, n in asked if home == i)) for i in every]
        room = [full - n for n in loads]
        wanted, second = [[0.0] * shards for _ in every], [[0.0] * shards for _ in every]
        for home, one, _, n in asked:
            if one is not None:
                wanted[home][one] += n
        grant = _quotas(wanted, room)
        room = [room[i] + sum(wanted[i][b] * grant[i][b] - wanted[b][i] * grant[b][i] for b in every) for i in every]
        for home, one, two, n in asked:
            if two is not None:
                second[home][two] += n * (1 - (grant[home][one] if one is not None else 0))
        more = _quotas(second, room)
        room = [room[i] + sum(second[i][b] * more[i][b] - second[b][i] * more[b][i] for b in every) for i in every]
        over = [min(1.0, max(0.0, -room[i]) / max(1.0, loads[i])) for i in every]
        free = [max(0.0, r) for r in room]
        upto = [sum(free[: i + 1]) / max(1e-9, sum(free)) for i in range(shards - 1)]
        moving = sum(wanted[a][b] * grant[a][b] + second[a][b] * more[a][b] for a in every for b in every) + sum(o * n for o, n in zip(over, loads, strict=True))
        if moving * STILL < sum(loads):
            break
        loads = [full - r for r in room]  # as expected
        granted = lambda shares, c: _pick([x for row in shares for x in row], f"home * {shards} + {c}")
        away = sum(((_unit("crowd", F.lit(step), F.lit("where")) >= c).cast("int") for c in upto), F.lit(0))
        target = (
            F.when(F.col("one").isNotNull() & (_unit("crowd_one", F.lit(step)) < granted(grant, "one")), F.col("one"))
            .when(F.col("two").isNotNull() & (_unit("crowd_two", F.lit(step), F.lit("two")) < granted(more, "two")), F.col("two"))
            .when(_unit("crowd", F.lit(step), F.lit("out")) < _pick(over, "home"), away)
        )
        taken = wishes.select("node", target.alias("target")).where("target IS NOT NULL")
        spread.rows = settle(spread.rows.join(taken, "node", "left").withColumn("shard", F.coalesce("target", "shard").cast("int")).drop("target"))
    return spread.rows.where("own > 0").select("node", "weight", "shard")


def cut(member: DataFrame) -> tuple[int, int]:
    """(links whose two ends lie in different shards, all links): every two rows of a group are a link. ``member``: group, weight, shard."""
    cells = member.groupBy("group", "shard").agg(F.sum("weight").cast("decimal(38,0)").alias("held"))
    groups = cells.groupBy("group").agg(F.sum("held").alias("n"), F.sum(F.col("held") * F.col("held")).alias("squares"))
    r = groups.agg(F.sum(F.col("n") * F.col("n") - F.col("squares")), F.sum(F.col("n") * F.col("n") - F.col("n"))).first()
    return int(r[0] or 0) // 2, int(r[1] or 0) // 2


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", links: DataFrame | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; counts of the shards differ by one at most.

    ``links``: (key, group), any number of groups for a key; without it the rows with equal texts are a group.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(words.cast("binary"))
    base = docs.select(F.col(key).alias("key"), (F.octet_length(words) + 1).cast("long").alias("size"), F.crc32(words.cast("binary")).alias("crc"), digest.alias("text_md5"))
    base = settle(base.withColumn("node", F.concat_ws("/", F.xxhash64("key").cast("string"), "text_md5")))
    total = base.count()
    every = base.groupBy("node").agg(F.first("key").alias("key"), F.first("text_md5").alias("text_md5"), F.count("*").alias("weight"))
    if links is None:
        groups = every.groupBy("text_md5").agg(F.sum("weight").alias("n")).where("n > 1").select("text_md5")
        member = spread_join(settle(every), groups, "text_md5").select("node", "weight", F.col("text_md5").alias("group"))
    else:
        asked = links.select(F.col(key).alias("_key"), F.col("group").cast("string").alias("group")).where("group IS NOT NULL").distinct()
        member = every.join(asked, F.col("key").eqNullSafe(F.col("_key"))).select("node", "weight", "group")
    member = settle(member.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")))
    tied = member.groupBy("node").agg(F.min("group").alias("group"))
    placed = settle(propagate(member, shards, total / shards))

    # unlinked documents fill the rooms, half of them before a shard's linked ones and half after
    loads = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.sum("weight")).collect()}  # a row for each shard at most
    room = [max(0.0, total / shards - loads.get(i, 0)) for i in range(shards)]
    upto = [sum(room[: i + 1]) / max(1e-9, sum(room)) for i in range(shards - 1)]
    draw = _unit("node", F.lit("fill"))
    rows = base.join(placed.join(tied, "node").select("node", F.col("shard").alias("_shard"), "group"), "node", "left")
    filled = sum(((draw >= c).cast("int") for c in upto), F.lit(0))
    side = F.when(F.col("_shard").isNotNull(), 1).when(_unit("node", F.lit("side")) < 0.5, 0).otherwise(2)
    every = rows.select("key", "size", "crc", "node", "group", F.coalesce("_shard", filled).alias("shard"), side.alias("part"))

    line = ["shard", "part", "group", "key", "node", "size"]
    dealt = every.repartitionByRange(partitions(spark), *line).sortWithinPartitions(*line)
    dealt = settle(dealt.select("key", "size", "crc", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    pieces = dealt.groupBy("piece").agg(F.count("*").alias("n"))  # a row for each partition
    starts = pieces.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("start"))
    place = dealt.join(F.broadcast(starts), "piece").select("key", "size", "crc", (F.col("start") + F.col("at")).alias("place"))
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")  # the shard's first place
    return place.withColumn("shard", shard.cast("int")).select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - first).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
