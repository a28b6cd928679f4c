"""Queries that give tables roles and weigh candidate mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import matching as M
from gridloom.operators import ranking as R
from gridloom.plans.ranking import _catalog
from gridloom.plans.testbed import Grid

# Markers of table names, by role.
MARKERS = {
    "buses": ("nodo", "node", "bus", "barra", "customer"), "lines": ("tramo", "line", "linea", "lineitem", "section"), "loads": ("carga", "load", "suministro", "orders"),
    "sources": ("alimentador", "feeder", "fuente", "source", "supplier"), "transformers": ("transformador", "transformer", "trafo", "part"),
}
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "region", "nation", "events")


def _tables(g):
    """The tables that hold a row."""
    out = None
    for t in TABLES:
        part = g.table(t).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(t).alias("table"))
        out = part if out is None else out.unionAll(part)
    return out


def _markers(spark):
    rows = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(m).alias("marker")) for r, names in MARKERS.items() for m in names))
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def match_roles(spark, sf_dir):
    return M.table_roles(_tables(Grid(spark, sf_dir)), _markers(spark)).withColumn("score", F.round("score", 6))


def match_allowed(spark, sf_dir):
    return M.allowed(M.role_scores(_tables(Grid(spark, sf_dir)), _markers(spark))).withColumn("score", F.round("score", 6))


def _candidates(g):
    """Twenty candidate mappings: each takes its own part of the catalog's columns."""
    c = _catalog(g).withColumn("h", F.length("column") + F.length("table"))
    wide = c.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(20)))).where((F.col("h") * 7 + F.length("column") * F.col("candidate")) % 5 < 2)
    return wide.select("candidate", F.concat(F.lit("e"), (F.col("h") % 3).cast("string")).alias("entity"), F.concat(F.lit("f"), (F.length("column") % 4).cast("string")).alias("field"), "table", "column", (F.col("h") % 10 / 10).alias("score"))


def match_objectives(spark, sf_dir):
    g = Grid(spark, sf_dir)
    chosen = _candidates(g)
    rows = M.objectives(chosen, chosen.select("entity", "field"))
    return rows.select("candidate", *(F.round(c, 6).alias(c) for c in ("coverage", "lexical", "uniqueness", "compactness")))


def match_choice(spark, sf_dir):
    """Closeness of every candidate on its objectives."""
    rows = match_objectives(spark, sf_dir)
    return R.topsis(rows, "candidate", {"coverage": 3.0, "lexical": 2.0, "uniqueness": 1.0, "compactness": 1.0}).select("candidate", F.round("closeness", 5).alias("closeness"))


QUERIES = {f.__name__: f for f in (match_roles, match_allowed, match_objectives, match_choice)}

_T = "t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\" FROM {t} HAVING count(*) > 0" for t in TABLES) + "), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{x}')" for r, names in MARKERS.items() for x in names) + ") v(role, a))"
_SC = """, sc AS (SELECT "table", role, max(CASE WHEN c = a THEN 1.0 WHEN starts_with(c, a) OR starts_with(a, c) THEN 0.72 + 0.20 * least(length(c), length(a)) / greatest(length(c), length(a)) WHEN length(a) >= 3 AND contains(c, a) THEN 0.68 + 0.24 * length(a) / length(c) WHEN length(c) >= 3 AND contains(a, c) THEN 0.68 + 0.24 * length(c) / length(a) ELSE 0 END::DOUBLE) AS score FROM (SELECT *, "table" AS c FROM t, m) GROUP BY 1, 2)"""
SQL = {
    "match_roles": f"WITH {_T}{_SC}, b AS (SELECT \"table\", max((score, role)) AS b FROM sc GROUP BY 1) SELECT \"table\", CASE WHEN b[1] >= 0.45 THEN b[2] ELSE 'unassigned' END AS role, round(b[1], 6) AS score FROM b",
    "match_allowed": f"WITH {_T}{_SC} SELECT \"table\", role, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY \"table\") AS best FROM sc) WHERE score > 0 AND score >= best - 0.12",
}
from gridloom.plans.ranking import _CAT  # noqa: E402

_CAND = _CAT + """, cand AS (SELECT candidate, 'e' || (h % 3) AS entity, 'f' || (l % 4) AS field, "table", "column", h % 10 / 10 AS score FROM (SELECT *, length("column") AS l, length("column") + length("table") AS h FROM cat), (SELECT unnest(range(1, 21)) AS candidate) WHERE (h * 7 + l * candidate) % 5 < 2)
, obj AS (SELECT candidate::INTEGER AS candidate, round(count(DISTINCT (entity, field)) / (SELECT count(DISTINCT (entity, field)) FROM cand), 6) AS coverage, round(avg(score), 6) AS lexical, round(count(DISTINCT ("table", "column")) / count(*), 6) AS uniqueness, round(1 / count(DISTINCT "table"), 6) AS compactness FROM cand GROUP BY 1)"""
_OBJ = {"coverage": 3, "lexical": 2, "uniqueness": 1, "compactness": 1}
SQL["match_objectives"] = f"WITH {_CAND} SELECT * FROM obj"
SQL["match_choice"] = f"WITH {_CAND}, n AS (SELECT candidate, " + ", ".join(f"{o} / sqrt(sum({o} * {o}) OVER ()) * {w} / 7 AS {o}" for o, w in _OBJ.items()) + " FROM obj), d AS (SELECT candidate, " + ", ".join(f"sqrt({' + '.join(f'({o} - {fn}({o}) OVER ()) ** 2' for o in _OBJ)}) AS {name}" for fn, name in (("max", "best"), ("min", "worst"))) + " FROM n) SELECT candidate, round(worst / (best + worst), 5) AS closeness FROM d"
