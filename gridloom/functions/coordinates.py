"""Coordinates of inventory rows: from mapped columns, geometries or texts; and what column names say about a layer."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import number, token, xy_from_text

#: Beyond this a coordinate can't be degrees, so the layer is in metres.
DEGREES = 1000.0
# Parts of column names, by what the column holds.
PARENT = ("from_bus", "nodo_i", "bus1", "origen", "padre", "codtramobtpadre", "codtramomtpadre", "tramopadre", "codigotramopadre")
FEEDER = ("codsalidabt", "codsalidamt", "salida", "feeder", "alimentador")
NO_ENDPOINT = (
    "distrito", "district", "jerarquia", "localidad", "ubicacion", "direccion", "provincia", "departamento", "zona", "estado", "fecha", "color",
    "kw", "kwh", "mva", "mw", "mvar", "voltaje", "tension", "nominal", "total",
)
PLACE_WORDS = ("coord", "coordenada", "coordenadas")


def name_token(name: str) -> str:
    """A column name in lower case, without accents and anything but letters and digits."""
    plain = unicodedata.normalize("NFKD", name.strip().lower())
    return "".join(c for c in plain if c.isascii() and c.isalnum())


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _pair(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def text_point(c: Column) -> Column:
    """(x, y) of a text such as ``X- 421677.43  Y- 8453832.776``, or null."""
    return _pair(*xy_from_text(c))


def mapped_point(x: Column, y: Column) -> Column:
    """(x, y) of two text columns: a text that holds both in either, else both as numbers; else null."""
    x, y = _filled(x), _filled(y)
    one, two = text_point(x), text_point(y)
    alone = F.coalesce(one, two)
    whole = F.when(one.isNotNull() & (two.isNotNull() | (x == y)), one)
    return F.when(x.isNull() | y.isNull(), alone).otherwise(F.coalesce(whole, _pair(number(x), number(y)), alone))


def resolve_point(x: Column, y: Column, geometry: Column, texts: Iterable[Column] = ()) -> tuple[Column, Column]:
    """(point, problem) of a row: mapped columns first, then its point geometry (x, y), then texts that name coordinates.

    One mapped column without the other, or two that can't be read, is a problem; without any there is no point.
    """
    asked = _filled(x).isNotNull() | _filled(y).isNotNull()
    mapped = mapped_point(x, y)
    both = _filled(x).isNotNull() & _filled(y).isNotNull()
    problem = F.when(asked & mapped.isNull(), F.when(both, "unreadable").otherwise("one-sided"))
    return F.when(asked, mapped).otherwise(F.coalesce(geometry, *(text_point(t) for t in texts))), problem


def place_columns(columns: Iterable[str]) -> list[str]:
    """Columns whose name speaks of a geometry or coordinates."""
    return [c for c in columns if "geometr" in c.casefold() or c.casefold() in PLACE_WORDS]


def span_columns(columns: Iterable[str]) -> tuple[str, str, str, str] | None:
    """The columns x1, y1, x2 and y2 of a layer, however they are written; null without all four."""
    named = {name_token(c): c for c in columns}
    found = [named.get(t) for t in ("x1", "y1", "x2", "y2")]
    return None if None in found else tuple(found)


def with_points(df: DataFrame, x: str | None, y: str | None, name: str = "point") -> DataFrame:
    """Adds the mapped point of each row; a layer that has one filled, or lacks the columns, stays as it is."""
    if name in df.columns or x not in df.columns or y not in df.columns:
        return df
    return df.withColumn(name, mapped_point(F.col(f"`{x}`").cast("string"), F.col(f"`{y}`").cast("string")))


def with_spans(df: DataFrame, name: str = "points") -> DataFrame:
    """Adds each row's span as two points, where the layer has the four columns and no path yet; a row that can't be read has none."""
    ends = span_columns(df.columns)
    if name in df.columns or ends is None:
        return df
    x1, y1, x2, y2 = (number(F.col(f"`{c}`").cast("string")) for c in ends)
    return df.withColumn(name, F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), F.array(_pair(x1, y1), _pair(x2, y2))))


def in_metres(df: DataFrame, x: str, y: str, order: str, rows: int = 25) -> DataFrame:
    """One row (metric): whether one of the first complete coordinates is too large for degrees; null without any."""
    first = df.select(order, F.col(x).try_cast("double").alias("_x"), F.col(y).try_cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").orderBy(order).limit(rows)
    return first.agg((F.max(F.greatest(F.abs("_x"), F.abs("_y"))) > DEGREES).alias("metric"))


def materialise(layers: Mapping[str, DataFrame], buses: tuple[str, str, str] | None = None, substations: tuple[str, str, str] | None = None, lines: str | None = None) -> dict[str, DataFrame]:
    """All layers, with points for buses and substations (layer, x, y) and spans for lines (layer)."""
    out = dict(layers)
    for asked in (buses, substations):
        if asked and asked[0] in out:
            out[asked[0]] = with_points(out[asked[0]], asked[1], asked[2])
    if lines in out:
        out[lines] = with_spans(out[lines])
    return out


def column_roles(catalog: DataFrame) -> DataFrame:
    """(table, parent, feeder): of each table the columns that name a segment's parent and the feeder of its root segments.

    ``catalog``: a row for each column of any number of tables, (table, column, position). Each column gets a score: a
    parent's by a name of its own or by the two words for a parent and a segment (the first such column wins), less by
    a name that only holds one (the last wins); a feeder's by a name of its own or one that holds its outlet's word.
    """
    rows = catalog.withColumn("token", token(F.col("column")))
    holds = lambda *words: F.greatest(*(F.col("token").contains(w) for w in words), F.lit(False))
    parents = sorted({name_token(w) for w in PARENT})
    sure = F.col("token").isin(*parents) | (holds("padre") & holds("tramo", "segment"))
    likely = holds(*(w for w in parents if len(w) >= 4))
    place = F.col("position").cast("long")
    parent = F.when(sure, F.struct(F.lit(2).alias("score"), (-place).alias("place"))).when(likely, F.struct(F.lit(1).alias("score"), place.alias("place")))
    feeder = F.when(holds("salida") | F.col("token").isin(*sorted({name_token(w) for w in FEEDER})), -place)
    return rows.groupBy("table").agg(F.max_by("column", parent).alias("parent"), F.max_by("column", feeder).alias("feeder"))


def sound_endpoints(mapping: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows (table, field, column) of a mapping without ends of lines that lead to a column that isn't there or whose name says that it holds something else."""
    there = mapping.join(catalog.select("table", "column").distinct(), ["table", "column"], "left_semi")
    fit = there.where(~F.greatest(*(token(F.col("column")).contains(w) for w in NO_ENDPOINT)))
    return mapping.where(~F.col("field").isin("from_bus", "to_bus")).unionByName(fit.where(F.col("field").isin("from_bus", "to_bus")))
