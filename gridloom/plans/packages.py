"""Queries over a manifest of files, one for each order: names carry markers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import packages as P
from gridloom.plans.testbed import Grid

_NAMES = """SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS package, CASE o_orderkey % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'loads' ELSE 'unknown' END AS role,
 concat(CASE o_orderkey % 4 WHEN 0 THEN 'RED_' WHEN 1 THEN 'carga_' WHEN 2 THEN 'foto_red_' ELSE 'tramo_' END, CAST(o_custkey % 200 AS VARCHAR(20)), 'x', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CASE o_orderkey % 3 WHEN 0 THEN concat('_', CAST(20240000 + o_orderkey % 12 * 100 + 101 AS VARCHAR(20))) WHEN 1 THEN concat('_2024-', lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR(20)), 2, '0'), '-01') ELSE concat('_01.', lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR(20)), 2, '0'), '.2024') END END, CASE WHEN o_orderkey % 40 = 3 THEN '_123456' ELSE '' END, '.txt') AS name, o_orderkey FROM {orders}"""
INCLUDE, SKIP = ("red", "tramo", "carga"), ("foto",)


def _files(spark, sf_dir):
    return P.with_tokens(spark.sql(_NAMES, orders=Grid(spark, sf_dir).table("orders")))


def files_tokens(spark, sf_dir):
    return _files(spark, sf_dir).select("o_orderkey", "stem", F.coalesce("token", F.lit("")).alias("token"))


def files_newest(spark, sf_dir):
    files = _files(spark, sf_dir).select("name", "stem", "token").distinct()
    return P.newest_copies(files).select("stem", "name")


def files_relevant(spark, sf_dir):
    return P.relevant(_files(spark, sf_dir), INCLUDE, SKIP).select("o_orderkey", "name")


def files_packages(spark, sf_dir):
    return P.assess(_files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (files_tokens, files_newest, files_relevant, files_packages)}

_F = "f AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(20240000 + o_orderkey % 12 * 100 + 101 AS VARCHAR) END AS token, regexp_replace(regexp_replace(lower(name), '\\.txt$', ''), '_(\\d{8}|2024-\\d\\d-01|01\\.\\d\\d\\.2024)(_|$)', '\\2') AS stem FROM (" + _NAMES.replace("{orders}", "orders") + "))"
SQL = {
    "files_tokens": f"WITH {_F} SELECT o_orderkey, stem, token FROM f",
    "files_newest": f"WITH {_F} SELECT stem, name FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY token <> '', token DESC, name) AS r FROM (SELECT DISTINCT stem, name, token FROM f)) WHERE r = 1",
    "files_relevant": f"WITH {_F} SELECT o_orderkey, name FROM f WHERE o_orderkey % 4 <> 2",
    "files_packages": f"WITH {_F} SELECT package, count(*) AS n_files, count(DISTINCT nullif(token, '')) <= 1 AS dates_agree, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, round(CASE WHEN max(role = 'network') THEN 0.6 ELSE 0 END + CASE WHEN max(role = 'loads') THEN 0.2 ELSE 0 END + CASE WHEN count(DISTINCT nullif(token, '')) <= 1 THEN 0.2 ELSE 0 END, 3)::DOUBLE AS score FROM f GROUP BY 1",
}
