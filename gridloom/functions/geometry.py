"""Coordinates, paths and projections as Column expressions; a path is an array of (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = "array<struct<x:double,y:double>>"


def path_from_wkt(c: Column) -> Column:
    """Points of a WKT POINT or LINESTRING; null for anything else."""
    inside = F.regexp_extract(c, r"(?i)^\s*(?:POINT|LINESTRING)\s*(?:Z|M|ZM)?\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.when(inside != "", F.transform(points, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("y"))))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def path_length(path: Column) -> Column:
    """Planar length of a path, in its own unit."""
    steps = F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(path) > 1, F.aggregate(steps, F.lit(0.0), lambda total, s: total + s)).otherwise(F.lit(0.0))


def path_ends(path: Column) -> tuple[Column, Column]:
    return F.try_element_at(path, F.lit(1)), F.try_element_at(path, F.lit(-1))


def utm_to_lonlat(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Longitude and latitude (WGS84, degrees) of UTM metres, by Snyder's series (USGS Professional Paper 1395)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    m = (y - F.lit(10_000_000.0 if south else 0.0)) / k0
    mu = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p1 = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(p1), F.cos(p1), F.tan(p1)
    c1, t1 = ep2 * c * c, t * t
    w = 1 - e2 * s * s
    n1, r1 = a / F.sqrt(w), a * (1 - e2) / (w * F.sqrt(w))
    d = (x - 500_000.0) / (n1 * k0)
    lat = p1 - (n1 * t / r1) * (d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * d * d * d * d / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * d * d * d * d * d * d / 720)
    lon = (d - (1 + 2 * t1 + c1) * d * d * d / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * d * d * d * d * d / 120) / c
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)
