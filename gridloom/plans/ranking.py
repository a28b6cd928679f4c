"""Queries that rank parts and suppliers, and match the tables' columns to fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import ranking as R
from gridloom.plans.testbed import Grid

# Fields and some of their aliases in inventories.
ALIASES = {
    ("bus", "id"): ("key", "custkey", "nodo"), ("bus", "name"): ("name", "nombre"), ("line", "id"): ("orderkey", "tramo"), ("line", "length_km"): ("quantity", "longitud"),
    ("load", "active_power_mw"): ("totalprice", "acctbal", "potencia"), ("load", "bus_id"): ("custkey", "nodo"), ("source", "nominal_voltage_kv"): ("retailprice", "tension"),
}
TABLES = ("customer", "supplier", "part", "orders", "lineitem")


def _suppliers(g):
    """Alternatives: what a supplier ships, how much of it, and its balance."""
    item = g.table("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("volume"), F.round(F.avg("l_discount"), 4).alias("discount"))
    return g.table("supplier").join(item, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").alias("k"), "volume", "discount", F.round("s_acctbal", 2).alias("balance"))


def rank_pareto_front(spark, sf_dir):
    return R.pareto_front(_suppliers(Grid(spark, sf_dir)), "k", ["volume", "discount", "balance"])


def rank_pareto_parts(spark, sf_dir):
    """The front of all parts by size and price."""
    return R.pareto_front(Grid(spark, sf_dir).table("part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"), F.round("p_retailprice", 2).alias("price")), "k", ["size", "price"])


def rank_crowding(spark, sf_dir):
    front = rank_pareto_front(spark, sf_dir).withColumn("front", F.lit(1))
    return R.crowding(front, "k", ["volume", "discount", "balance"]).select("k", F.round(F.coalesce("crowding", F.lit(-1.0)), 6).alias("crowding"))


def rank_topsis(spark, sf_dir):
    return R.topsis(_suppliers(Grid(spark, sf_dir)), "k", {"volume": 3.0, "discount": 1.0, "balance": 2.0}).select("k", F.round("closeness", 6).alias("closeness"))


def _catalog(g):
    """The columns of the tables that hold a value, as (table, column)."""
    out = None
    for t in TABLES:
        df = g.table(t)
        flat = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns))
        part = flat.select(F.explode(F.array(*(F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns))).alias("x")).where("x.n > 0").select("x.table", "x.column")
        out = part if out is None else out.unionAll(part)
    return out


def _aliases(spark):
    rows = F.array(*(F.struct(F.lit(e).alias("entity"), F.lit(f).alias("field"), F.lit(a).alias("alias")) for (e, f), names in ALIASES.items() for a in names))
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def match_prefix_scores(spark, sf_dir):
    return R.match_fields(_catalog(Grid(spark, sf_dir)), _aliases(spark)).withColumn("score", F.round("score", 6))


def match_assignment(spark, sf_dir):
    scores = match_prefix_scores(spark, sf_dir).groupBy("table", "entity").agg(F.round(F.sum("score"), 6).alias("score"))
    return R.greedy_assignment(scores, "table", "entity")


QUERIES = {f.__name__: f for f in (rank_pareto_front, rank_pareto_parts, rank_crowding, rank_topsis, match_prefix_scores, match_assignment)}

_SUP = "sup AS (SELECT s_suppkey AS k, volume, discount, round(s_acctbal, 2) AS balance FROM supplier JOIN (SELECT l_suppkey, sum(l_quantity) AS volume, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)"
_FRONT = _SUP + ", front AS (SELECT * FROM sup a WHERE NOT EXISTS (SELECT 1 FROM sup b WHERE b.volume >= a.volume AND b.discount >= a.discount AND b.balance >= a.balance AND (b.volume > a.volume OR b.discount > a.discount OR b.balance > a.balance)))"
_OBJ = ("volume", "discount", "balance")
_COLS = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"}
_CAT = "cat AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\" FROM {t} HAVING count({c}) > 0" for t, cs in _COLS.items() for c in cs.split()) + ")"
_ALI = "ali AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{f}', '{a}')" for (e, f), names in ALIASES.items() for a in names) + ") v(entity, field, alias))"
_SCORE = """score AS (SELECT "table", "column", entity, field, round(max(s), 6) AS score FROM (SELECT *, CASE WHEN c = a THEN 1.0 WHEN starts_with(c, a) OR starts_with(a, c) THEN 0.72 + 0.20 * least(length(c), length(a)) / greatest(length(c), length(a)) WHEN length(a) >= 3 AND contains(c, a) THEN 0.68 + 0.24 * length(a) / length(c)
 WHEN length(c) >= 3 AND contains(a, c) THEN 0.68 + 0.24 * length(c) / length(a) ELSE 0 END::DOUBLE AS s FROM (SELECT *, regexp_replace(lower("column"), '[^a-z0-9]+', '', 'g') AS c, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS a FROM cat, ali)) WHERE s > 0 GROUP BY 1, 2, 3, 4)"""
SQL = {
    "rank_pareto_front": f"WITH {_FRONT} SELECT k, volume, discount, balance FROM front",
    "rank_pareto_parts": 'WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS "size", round(p_retailprice, 2) AS price FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b."size" >= a."size" AND b.price >= a.price AND (b."size" > a."size" OR b.price > a.price))',
    "rank_crowding": f"WITH {_FRONT}, x AS (SELECT k, " + ", ".join(f"lag({o}) OVER (ORDER BY {o}, k) AS lo_{o}, lead({o}) OVER (ORDER BY {o}, k) AS hi_{o}, max({o}) OVER () - min({o}) OVER () AS sp_{o}" for o in _OBJ) + " FROM front) SELECT k, round(coalesce(" + " + ".join(f"CASE WHEN sp_{o} > 0 THEN (hi_{o} - lo_{o}) / sp_{o} ELSE 0 * (hi_{o} - lo_{o}) END" for o in _OBJ) + ", -1), 6) AS crowding FROM x",
    "rank_topsis": f"WITH {_SUP}, n AS (SELECT k, " + ", ".join(f"{o} / sqrt(sum({o} * {o}) OVER ()) * {w} / 6 AS {o}" for o, w in zip(_OBJ, (3, 1, 2), strict=True)) + " FROM sup), d AS (SELECT k, " + ", ".join(f"sqrt({' + '.join(f'({o} - {fn}({o}) OVER ()) ** 2' for o in _OBJ)}) AS {name}" for fn, name in (("max", "far_best"), ("min", "far_worst"))) + " FROM n) SELECT k, round(far_worst / (far_best + far_worst), 6) AS closeness FROM d",
    "match_prefix_scores": f"WITH {_CAT}, {_ALI}, {_SCORE} SELECT * FROM score",
}
