"""Queries over a catalog that is profiled from all rows of all tables, and over type libraries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gridloom.operators import library as L
from gridloom.operators import proposal as P
from gridloom.operators import validate as V
from gridloom.operators.components import settle
from gridloom.plans.ranking import ALIASES, _aliases
from gridloom.plans.testbed import Grid

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: A mapping of the tables: entity, field, table, column.
MAPPING = (("buses", "id", "customer", "c_custkey"), ("buses", "name", "customer", "c_name"), ("lines", "id", "lineitem", "l_orderkey"), ("lines", "from_bus", "lineitem", "l_suppkey"), ("lines", "color", "lineitem", "l_nothing"), ("loads", "id", "orders", "o_orderkey"), ("sources", "id", "supplier", "s_suppkey"), ("switches", "id", "events", "event_id"))


def _catalog(spark, sf_dir):
    """How far each column is filled, counted over all rows once; no proposal asks for its distinct values."""
    g = Grid(spark, sf_dir)
    return settle(reduce(lambda a, b: a.unionAll(b), (V.filled_columns(g.table(t), t) for t in TABLES)))


def _mapping(spark):
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(m, ("entity", "field", "table", "column"), strict=True))) for m in MAPPING))
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def _scores(spark, sf_dir, similar=False):
    return P.field_scores(_catalog(spark, sf_dir), _aliases(spark), similar)


def prop_columns(spark, sf_dir):
    return P.candidate_columns(_scores(spark, sf_dir), 3, 1).select("entity", "field", "table", "column", F.round("score", 6).alias("score"))


def prop_tables(spark, sf_dir):
    return P.candidate_tables(_scores(spark, sf_dir), 3).select("entity", "table", F.round("score", 6).alias("score"))


def prop_likeness(spark, sf_dir):
    """Scores of all columns with unlike names compared as texts."""
    return _scores(spark, sf_dir, True).withColumn("score", F.round("score", 6))


def prop_sound(spark, sf_dir):
    fields = _mapping(spark).where("field <> 'color'")
    return P.sound(_mapping(spark), _catalog(spark, sf_dir), fields).select("entity", "field", "table", "column")


def prop_warnings(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    return P.warnings(P.sound(_mapping(spark), catalog, _mapping(spark)), catalog, _mapping(spark).select(F.lit("buses").alias("entity"), F.lit("nominal_voltage_kv").alias("field")))


def prop_strategies(spark, sf_dir):
    """What each strategy leaves of the mapping."""
    catalog, mapping = _catalog(spark, sf_dir), _mapping(spark)
    parts = [P.apply_strategy(mapping, catalog, s).groupBy("entity").agg(F.count("*").alias("n")).select(F.lit(s).alias("strategy"), "entity", "n") for s in ("full", "network_core", "compact_lines")]
    return reduce(lambda a, b: a.unionAll(b), parts)


def prop_modality(spark, sf_dir):
    tables = _catalog(spark, sf_dir).groupBy("table").agg(F.bool_or(F.col("column").contains("nation")).alias("spatial")).withColumn("source", F.lit("files"))
    return P.modality(tables).select(F.lit("all").alias("name"), "modality").unionAll(P.modality(tables.where("spatial")).select(F.lit("places"), "modality"))


def _types(g):
    k = F.col("p_partkey")
    ident = F.concat(F.lit("T"), (k - F.when(k % 97 == 5, 1).otherwise(0)).cast("string"))
    zero = [F.when(k % 7 != 0, F.lit(0.3)), F.when(k % 5 != 0, F.lit(0.9)), F.when(k % 5 != 0, F.lit(5.0))]
    line = g.table("part").select(ident.alias("id"), F.col("p_name").alias("name"), F.lit(22.9).alias("nominal_voltage_kv"), F.when(k % 11 == 0, -0.1).otherwise(0.2).alias("r1_ohm_per_km"), F.lit(0.3).alias("x1_ohm_per_km"), F.when(k % 13 == 0, float("inf")).otherwise(200.0).alias("rated_current_a"), F.lit(10.0).alias("c1_nf_per_km"), *(z.alias(n) for z, n in zip(zero, ("r0_ohm_per_km", "x0_ohm_per_km", "c0_nf_per_km"), strict=True)), (k % 4).cast("int").alias("phases"))
    trafo = g.table("part").select(ident.alias("id"), F.col("p_name").alias("name"), F.lit("Dyn11").alias("vector_group"), F.lit(10.0).alias("rated_power_mva"), F.when(k % 9 == 0, 22.9).otherwise(60.0).alias("hv_voltage_kv"), F.lit(22.9).alias("lv_voltage_kv"), F.when(k % 10 == 0, 120.0).otherwise(8.0).alias("uk_percent"), (k % 30 * 40.0).alias("copper_loss_kw"), F.lit(None).cast("double").alias("no_load_loss_kw"), F.lit(None).cast("double").alias("no_load_current_percent"), F.when(k % 6 != 0, 7.5).alias("uk0_percent"), F.when(k % 6 != 0, F.when(k % 14 == 1, 9.0).otherwise(1.0)).alias("ur0_percent"))
    return line, trafo


def library_lines(spark, sf_dir):
    line, _ = _types(Grid(spark, sf_dir))
    return L.bad_line_types(line).unionAll(L.double_types(line))


def library_transformers(spark, sf_dir):
    return L.bad_transformer_types(_types(Grid(spark, sf_dir))[1])


def library_summary(spark, sf_dir):
    return L.summary(*_types(Grid(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (prop_columns, prop_tables, prop_likeness, prop_sound, prop_warnings, prop_strategies, prop_modality, library_lines, library_transformers, library_summary)}

_COLS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
}
_CAT = "cat AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n, count({c}) AS non_null FROM {t}" for t, cs in _COLS.items() for c in cs.split()) + ")"
_MAP = "map_ AS (SELECT * FROM (VALUES " + ", ".join(str(m) for m in MAPPING) + ') v(entity, field, "table", "column"))'
_ALI = "ali AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{f}', '{a}')" for (e, f), names in ALIASES.items() for a in names) + ") v(entity, field, alias))"
_SC = """sc AS (SELECT "table", "column", entity, field, max(s * CASE WHEN non_null = 0 THEN 0.2 WHEN non_null < 0.5 * n THEN 0.7 ELSE 1 END) AS score FROM (SELECT *, CASE WHEN c = a THEN 1.0 WHEN starts_with(c, a) OR starts_with(a, c) THEN 0.72 + 0.20 * least(length(c), length(a)) / greatest(length(c), length(a)) WHEN length(a) >= 3 AND contains(c, a) THEN 0.68 + 0.24 * length(a) / length(c)
 WHEN length(c) >= 3 AND contains(a, c) THEN 0.68 + 0.24 * length(c) / length(a) ELSE 0 END::DOUBLE AS s FROM (SELECT *, regexp_replace(lower("column"), '[^a-z0-9]+', '', 'g') AS c, regexp_replace(lower(alias), '[^a-z0-9]+', '', 'g') AS a FROM cat, ali)) WHERE s > 0 GROUP BY 1, 2, 3, 4)"""
_ROW = "(SELECT 'T' || (p_partkey - CASE WHEN p_partkey % 97 = 5 THEN 1 ELSE 0 END) AS id, p_partkey AS k FROM part)"
_SOUND = "ok AS (SELECT m.* FROM map_ m JOIN cat USING (\"table\", \"column\") WHERE non_null > 0)"
SQL = {
    "prop_columns": f'WITH {_CAT}, {_ALI}, {_SC} SELECT entity, field, "table", "column", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, "table", "column") AS a, row_number() OVER (PARTITION BY entity, field, "table" ORDER BY score DESC, "column") AS o FROM sc) WHERE a <= 3 OR o <= 1',
    "prop_tables": f'WITH {_CAT}, {_ALI}, {_SC}, w AS (SELECT entity, "table", sum(s) / max(f) AS score FROM (SELECT entity, field, "table", max(score) AS s FROM sc GROUP BY 1, 2, 3) JOIN (SELECT entity, count(DISTINCT field) AS f FROM sc GROUP BY 1) USING (entity) GROUP BY 1, 2) SELECT entity, "table", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, "table") AS r FROM w) WHERE r <= 3',
    "prop_sound": f"WITH {_CAT}, {_MAP}, {_SOUND} SELECT * FROM ok WHERE field <> 'color'",
    "prop_warnings": f"WITH {_CAT}, {_MAP}, {_SOUND} SELECT 'no_end' AS kind, 'to_bus' AS detail UNION ALL SELECT 'placeholder', 'nominal_voltage_kv' UNION ALL SELECT DISTINCT 'unused_table', \"table\" FROM cat WHERE \"table\" NOT IN (SELECT \"table\" FROM ok)",
    "prop_strategies": f"WITH {_CAT}, {_MAP} SELECT 'full' AS strategy, entity, count(*) AS n FROM map_ GROUP BY 2 UNION ALL SELECT 'network_core', entity, count(*) FROM map_ WHERE entity NOT IN ('loads', 'generators', 'switches') GROUP BY 2 UNION ALL SELECT 'compact_lines', entity, count(*) FROM map_ WHERE entity <> 'loads' OR (SELECT count(*) FROM lineitem) <= 50000 GROUP BY 2",
    "prop_modality": f"WITH {_CAT} SELECT 'all' AS name, CASE WHEN count(*) FILTER (s) >= count(*) // 2 THEN 'spatial' ELSE 'mixed' END AS modality FROM (SELECT \"table\", bool_or(contains(\"column\", 'nation')) AS s FROM cat GROUP BY 1) UNION ALL SELECT 'places', 'spatial'",
    "library_lines": f"SELECT id, reason FROM (SELECT id, CASE WHEN k % 11 = 0 THEN 'r1_ohm_per_km' WHEN k % 13 = 0 THEN 'rated_current_a' WHEN k % 4 = 0 THEN 'phases' WHEN (k % 7 = 0) <> (k % 5 = 0) THEN 'zero_sequence' END AS reason FROM {_ROW}) WHERE reason IS NOT NULL UNION ALL SELECT id, 'duplicate' FROM {_ROW} GROUP BY id HAVING count(*) > 1",
    "library_transformers": f"SELECT id, reason FROM (SELECT id, CASE WHEN k % 9 = 0 THEN 'voltages' WHEN k % 10 = 0 THEN 'uk_percent' WHEN k % 6 <> 0 AND k % 14 = 1 THEN 'ur0_percent' WHEN k % 30 * 40.0 / 100 > 8 THEN 'losses' END AS reason FROM {_ROW}) WHERE reason IS NOT NULL",
    "library_summary": "SELECT 'line_types' AS kind, count(*) AS n, count(CASE WHEN p_partkey % 7 <> 0 THEN 1 END) AS with_zero_sequence FROM part UNION ALL SELECT 'transformer_types', count(*), count(CASE WHEN p_partkey % 6 <> 0 THEN 1 END) FROM part",
}
