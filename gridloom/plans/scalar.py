"""Queries over raw columns: normalisation, units, states, names, keys, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geodesy, geometry, normalize
from gridloom.plans.testbed import Grid, with_grid

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_ID = r"CASE WHEN trim(raw_id) = '' THEN NULL ELSE regexp_replace(trim(raw_id), '^(-?)0*(\d+)\.0$', '\1\2') END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Grid(spark, sf_dir).raw


def x_identifier(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select("k", normalize.identifier(F.col("raw_id")).alias("id"), normalize.identifier(F.col("raw_id")).isNull().alias("rejected"), normalize.parent_reference(F.col("raw_id")).alias("parent"))


def x_name(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", normalize.name(F.col("raw_name"), F.col("k").cast("string")).alias("name"))


def x_number(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", F.round(normalize.number(F.col("raw_number")), 6).alias("number"))


def x_voltage_token(spark, sf_dir):
    codes = F.when(F.trim("raw_voltage") == "G", 22.9)
    return _raw(spark, sf_dir).select("k", F.round(normalize.voltage_kv(F.col("raw_voltage")), 6).alias("kv"), F.round(normalize.voltage_kv(F.col("raw_voltage"), codes=codes), 6).alias("kv_by_code"))


def x_unit_convert(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select("k", F.round(normalize.convert_by_column(F.col("raw_number"), "active_power", F.col("raw_unit")), 9).alias("mw"), F.round(normalize.convert(F.col("raw_number"), "length", "m"), 9).alias("km"))


def x_xy_text(spark, sf_dir):
    x, y = normalize.xy_from_text(F.col("raw_xy"))
    return _raw(spark, sf_dir).select("k", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def x_switch_state(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", normalize.switch_closed(F.col("raw_switch")).alias("closed"))


def x_service_state(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", normalize.in_service(F.col("raw_service")).alias("in_service"), normalize.service_problem(F.col("raw_service")).alias("problem"))


def x_token(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", normalize.token(F.col("raw_name")).alias("token"))


def x_safe_name(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", normalize.safe_name(F.col("raw_name")).alias("safe_name"))


def x_object_key(spark, sf_dir):
    named = _raw(spark, sf_dir).where("trim(raw_name) <> '' AND raw_name <> ':::'")
    return named.select("k", normalize.object_key("line", F.col("raw_name")).alias("object_key"))


def x_load_power(spark, sf_dir):
    p, q = normalize.load_power(F.col("value_type"), F.col("value_1").cast("string"), F.col("value_2").cast("string"))
    return _raw(spark, sf_dir).select("k", F.round(p, 3).alias("kw"), F.round(q, 3).alias("kvar"))


def x_output_value(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select(
        "k",
        normalize.output_value(F.col("raw_unit"), "string", value_map={"kW": "1", "w": "2"}).alias("mapped"),
        normalize.output_value(F.col("k"), "bigint", pattern="T%06d").alias("formatted"),
        normalize.output_value(F.col("k") % 2 == 0, "boolean").alias("flag"),
        F.round(normalize.output_value(F.col("value_2"), "double", scale=2.5, offset=1.0), 6).alias("scaled"),
    )


#: Labels of columns, and the units that they stand for as a length, an active and a reactive power.
LABELS = {
    "Longitud_m": "m MW Mvar", "Longitudkm": "km MW Mvar", "LargoM": "m MW Mvar", "Largo (m)": "m MW Mvar", "metros total": "m MW Mvar", "Longitud": "km MW Mvar", "Potencia (kW)": "km kW Mvar", "P MW": "km MW Mvar", "W": "km W Mvar",
    "PAC": "km kW Mvar", "Demanda": "km kW Mvar", "Q kvar": "km MW kvar", "Qac": "km MW kvar", "Reactiva": "km MW kvar", "Var": "km MW var", "Q (MVAr)": "km MW Mvar", "Dato": "km MW Mvar", "Potencia MW": "km MW Mvar", "mwkw": "km kW Mvar",
}


def x_header_parts(spark, sf_dir):
    label = F.concat(F.when(F.col("k") % 3 == 0, "loc_name").when(F.col("k") % 3 == 1, "dline").otherwise("bad"), F.when(F.col("k") % 3 == 2, "").otherwise(F.concat(F.lit("("), F.when(F.col("k") % 2 == 0, "a:40").otherwise("r"), F.lit(")"))))
    name, kind, size = normalize.header_parts(F.col("label"))
    return _raw(spark, sf_dir).withColumn("label", label).select("k", name.alias("name"), kind.alias("kind"), F.coalesce(size, F.lit(0)).alias("size"))


def x_unit_label(spark, sf_dir):
    words = F.element_at(F.array(*(F.lit(w) for w in LABELS)), (F.col("k") % len(LABELS) + 1).cast("int"))
    label = F.concat(words, F.when(F.col("k") % 3 == 0, F.lit(" ")).otherwise(F.lit("")))
    rows = _raw(spark, sf_dir).withColumn("label", label)
    return rows.select("k", *(normalize.unit_of_label(F.col("label"), q).alias(q) for q in ("length", "active", "reactive")))


def x_wkt_length(spark, sf_dir):
    path = geometry.path_from_wkt(F.col("raw_wkt"))
    start, end = geometry.path_ends(F.col("path"))
    return _raw(spark, sf_dir).withColumn("path", path).where("path IS NOT NULL").select("k", F.size("path").alias("n_points"), F.round(geometry.path_length(F.col("path")), 6).alias("length"), F.round(start["x"], 6).alias("x1"), F.round(end["y"], 6).alias("y2"))


def x_lonlat(spark, sf_dir):
    x, y = normalize.xy_from_text(F.col("raw_xy"))
    lon, lat = geometry.utm_to_lonlat(F.col("x"), F.col("y"), 18, True)
    return _raw(spark, sf_dir).select("k", x.alias("x"), y.alias("y")).where("x IS NOT NULL").select("k", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def x_reproject(spark, sf_dir):
    """Coordinates taken to longitude and latitude and back again, to the centimetre."""
    x, y = normalize.xy_from_text(F.col("raw_xy"))
    lon, lat = geometry.utm_to_lonlat(F.col("x"), F.col("y"), 18, True)
    there = _raw(spark, sf_dir).select("k", x.alias("x"), y.alias("y")).where("x IS NOT NULL").select("k", lon.alias("lon"), lat.alias("lat"))
    x2, y2 = geodesy.lonlat_to_utm(F.col("lon"), F.col("lat"), 18, True)
    return there.select("k", F.round(x2, 2).alias("x"), F.round(y2, 2).alias("y"))


def x_geodesic(spark, sf_dir):
    """Geodesic metres between the places of neighbouring rows' texts, a kilometre north of each other on the plane."""
    x, y = normalize.xy_from_text(F.col("raw_xy"))
    a, b = geometry.utm_to_lonlat(F.col("x"), F.col("y"), 18, True), geometry.utm_to_lonlat(F.col("x"), F.col("y") + 1000.0, 18, True)
    points = _raw(spark, sf_dir).select("k", x.alias("x"), y.alias("y")).where("x IS NOT NULL").select("k", a[0].alias("lon1"), a[1].alias("lat1"), b[0].alias("lon2"), b[1].alias("lat2"))
    return points.select("k", F.round(geodesy.geodesic_metres(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


QUERIES = {f.__name__: f for f in (x_reproject, x_geodesic, x_identifier, x_name, x_number, x_voltage_token, x_unit_convert, x_xy_text, x_switch_state, x_service_state, x_token, x_safe_name, x_object_key, x_load_power, x_output_value, x_header_parts, x_unit_label, x_wkt_length, x_lonlat)}

_NUMBER = "CASE WHEN contains({0}, ',') AND NOT contains({0}, '.') THEN replace({0}, ',', '.') ELSE {0} END"
_NUM = "try_cast(" + _NUMBER.format(r"regexp_replace(raw_number, '\s', '', 'g')") + " AS DOUBLE)"
_VT = r"regexp_extract(raw_voltage, '^\s*([+-]?\d+(?:[.,]\d+)?)\s*([kK]?[vV])?\s*$', {})"
_KV = "try_cast(replace(" + _VT.format(1) + ", ',', '.') AS DOUBLE) * CASE WHEN lower(" + _VT.format(2) + ") = 'v' THEN 0.001 ELSE 1.0 END"
_XYP = r"(?i)X\s*[-–:]\s*([+-]?[0-9]+(?:[.,][0-9]+)?)[,;\s]+Y\s*[-–:]\s*([+-]?[0-9]+(?:[.,][0-9]+)?)"
_X = f"try_cast(replace(regexp_extract(raw_xy, '{_XYP}', 1), ',', '.') AS DOUBLE)"
_Y = f"try_cast(replace(regexp_extract(raw_xy, '{_XYP}', 2), ',', '.') AS DOUBLE)"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(trim(coalesce(raw_name, '')), '[:*?=\",\\~|\n\r!]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"
_SERVED = f"CASE WHEN s IN ({_LIST(normalize.IN_SERVICE + normalize.LIFECYCLE)}) OR regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRUE WHEN s IN ({_LIST(normalize.OUT_OF_SERVICE)}) THEN FALSE END"
_KEYCLEAN = "regexp_replace(regexp_replace(trim(raw_name), '[^A-Za-z0-9_.:-]+', '_', 'g'), '^_+|_+$', '', 'g')"

SQL = {
    "x_identifier": with_grid(f"SELECT k, {_ID} AS id, ({_ID}) IS NULL AS rejected, " + _ID.replace("trim(raw_id)", r"trim(regexp_replace(trim(raw_id), ' [-–] .*$', ''))") + " AS parent FROM raw", "raw"),
    "x_name": with_grid("SELECT k, coalesce(nullif(trim(raw_name), ''), CAST(k AS VARCHAR)) AS name FROM raw", "raw"),
    "x_number": with_grid(f"SELECT k, round({_NUM}, 6) AS number FROM raw", "raw"),
    "x_voltage_token": with_grid(f"SELECT k, round({_KV}, 6) AS kv, round(coalesce({_KV}, CASE WHEN raw_voltage = 'G' THEN 22.9 END), 6) AS kv_by_code FROM raw", "raw"),
    "x_unit_convert": with_grid(f"SELECT k, round({_NUM} * CASE raw_unit WHEN 'kW' THEN 0.001 WHEN 'w' THEN 0.000001 WHEN 'MW' THEN 1.0 END, 9) AS mw, round({_NUM} * 0.001, 9) AS km FROM raw", "raw"),
    "x_xy_text": with_grid(f"SELECT k, round({_X}, 6) AS x, round({_Y}, 6) AS y FROM raw", "raw"),
    "x_switch_state": with_grid(f"SELECT k, CASE WHEN upper(trim(raw_switch)) IN ({_LIST(normalize.CLOSED)}) THEN TRUE WHEN upper(trim(raw_switch)) IN ({_LIST(normalize.OPEN)}) THEN FALSE END AS closed FROM raw", "raw"),
    "x_service_state": with_grid(f"SELECT k, {_SERVED} AS in_service, CASE WHEN ({_SERVED}) IS NOT NULL THEN NULL WHEN s IS NULL OR s = '' THEN 'empty' WHEN s IN ({_LIST(normalize.OWNERSHIP)}) THEN 'ownership' ELSE 'unknown' END AS problem FROM (SELECT k, upper(trim(raw_service)) AS s FROM raw)", "raw"),
    "x_token": with_grid("SELECT k, regexp_replace(strip_accents(lower(trim(raw_name))), '[^a-z0-9]+', '', 'g') AS token FROM raw", "raw"),
    "x_safe_name": with_grid(f"SELECT k, left(CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} ELSE 'unnamed' END, 40) AS safe_name FROM raw", "raw"),
    "x_object_key": with_grid(f"SELECT k, CASE WHEN length(key) <= 40 THEN key ELSE left(key, 31) || '~' || left(sha256(key), 8) END AS object_key FROM (SELECT k, 'GRID:line:' || CASE WHEN {_KEYCLEAN} = trim(raw_name) THEN trim(raw_name) ELSE {_KEYCLEAN} || '~' || left(sha256(trim(raw_name)), 8) END AS key FROM raw WHERE trim(raw_name) <> '' AND raw_name <> ':::')", "raw"),
    "x_load_power": with_grid("""SELECT k, round(CASE value_type WHEN '1' THEN value_1 * pf ELSE value_1 END, 3) AS kw, round(CASE value_type WHEN '1' THEN value_1 * sign_ * sqrt(greatest(0.0, 1 - pf * pf)) WHEN '2' THEN value_1 * sign_ * sqrt(greatest(0.0, 1 - near * near)) / near ELSE value_2 END, 3) AS kvar
FROM (SELECT *, CASE WHEN pf >= 0 THEN 1.0 ELSE -1.0 END AS sign_, greatest(abs(pf), 1e-9) AS near FROM (SELECT *, greatest(-1.0, least(1.0, value_2 / 100)) AS pf FROM raw))""", "raw"),
    "x_output_value": with_grid("SELECT k, CASE raw_unit WHEN 'kW' THEN '1' WHEN 'w' THEN '2' ELSE raw_unit END AS mapped, printf('T%06d', k) AS formatted, CAST(k % 2 = 0 AS INTEGER) AS flag, round(value_2 * 2.5 + 1, 6) AS scaled FROM raw", "raw"),
    "x_header_parts": with_grid("SELECT k, CASE k % 3 WHEN 0 THEN 'loc_name' WHEN 1 THEN 'dline' ELSE '' END AS name, CASE WHEN k % 3 = 2 THEN '' WHEN k % 2 = 0 THEN 'a' ELSE 'r' END AS kind, CASE WHEN k % 3 <> 2 AND k % 2 = 0 THEN 40 ELSE 0 END::INTEGER AS size FROM raw", "raw"),
    "x_unit_label": with_grid("SELECT k, u[1] AS length, u[2] AS active, u[3] AS reactive FROM (SELECT k, string_split([" + ", ".join(f"'{u}'" for u in LABELS.values()) + f"][k % {len(LABELS)} + 1], ' ') AS u FROM raw)", "raw"),
    "x_wkt_length": with_grid("SELECT k, CASE k % 3 WHEN 0 THEN 3 ELSE 1 END::INTEGER AS n_points, round(CASE k % 3 WHEN 0 THEN sqrt((k % 100 - 3) * (k % 100 - 3) + 16.0) + abs(k % 50 + 0.5 - 4) ELSE 0 END, 6) AS length, CAST(k % 100 AS DOUBLE) AS x1, CASE k % 3 WHEN 0 THEN k % 50 + 0.5 ELSE 7 END::DOUBLE AS y2 FROM raw WHERE k % 3 <> 2", "raw"),
}

_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_EP2, _E1 = _E2 / (1 - _E2), (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
SQL["x_reproject"] = with_grid(f"SELECT k, round({_X}, 2) AS x, round({_Y}, 2) AS y FROM raw WHERE {_X} IS NOT NULL", "raw")
# the same published series, step by step
SQL["x_lonlat"] = with_grid(
    f"""+p0 AS (SELECT k, {_X} AS x, ({_Y} - 10000000) / 0.9996 / {_A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256)!r} AS mu FROM raw WHERE {_X} IS NOT NULL),
p1 AS (SELECT k, x, mu + {3 * _E1 / 2 - 27 * _E1**3 / 32!r} * sin(2 * mu) + {21 * _E1**2 / 16 - 55 * _E1**4 / 32!r} * sin(4 * mu) + {151 * _E1**3 / 96!r} * sin(6 * mu) + {1097 * _E1**4 / 512!r} * sin(8 * mu) AS p FROM p0),
p2 AS (SELECT *, sin(p) AS s, cos(p) AS c, tan(p) AS t, {_EP2!r} * cos(p) ** 2 AS c1, tan(p) ** 2 AS t1, 1 - {_E2!r} * sin(p) ** 2 AS w FROM p1),
p3 AS (SELECT *, {_A!r} / sqrt(w) AS n1, {_A * (1 - _E2)!r} / (w * sqrt(w)) AS r1, (x - 500000) / ({_A!r} / sqrt(w) * 0.9996) AS d FROM p2)
SELECT k, round(degrees((d - (1 + 2 * t1 + c1) * d ** 3 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 ** 2 + 8 * {_EP2!r} + 24 * t1 ** 2) * d ** 5 / 120) / c) - 75, 7) AS lon,
  round(degrees(p - n1 * t / r1 * (d ** 2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 ** 2 - 9 * {_EP2!r}) * d ** 4 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 ** 2 - 252 * {_EP2!r} - 3 * c1 ** 2) * d ** 6 / 720)), 7) AS lat FROM p3""",
    "raw",
)
