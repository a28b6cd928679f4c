"""Geodesic lengths on WGS84 and projection to UTM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres between points by Vincenty's inverse formula; NaN where it doesn't settle (nearly opposite points)."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians(lon2 - lon1)
    lam, settled = span.copy(), np.zeros(len(span), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        k = ca2 * (a * a - b * b) / (b * b)
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return np.where(settled, b * big_a * (sigma - delta), np.nan)


def geodesic_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points given in degrees."""

    @F.pandas_udf("double")
    def metres(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(_inverse(*(p.to_numpy(float) for p in part)))

    return metres(lon1, lat1, lon2, lat2)


def lonlat_to_utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """UTM metres of degrees on WGS84, by Snyder's series (USGS Professional Paper 1395)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    p, l0 = F.radians(lat), math.radians(zone * 6 - 183)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    n, t2, cc, w = a / F.sqrt(1 - e2 * s * s), t * t, ep2 * c * c, (F.radians(lon) - l0) * c
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - (35 * e2**3 / 3072) * F.sin(6 * p))
    x = k0 * n * (w + (1 - t2 + cc) * w * w * w / 6 + (5 - 18 * t2 + t2 * t2 + 72 * cc - 58 * ep2) * w * w * w * w * w / 120) + 500_000.0
    y = k0 * (m + n * t * (w * w / 2 + (5 - t2 + 9 * cc + 4 * cc * cc) * w * w * w * w / 24 + (61 - 58 * t2 + t2 * t2 + 600 * cc - 330 * ep2) * w * w * w * w * w * w / 720))
    return x, y + (10_000_000.0 if south else 0.0)
