"""Map projections and planar measures as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tilewright.functions.bind import let
from tilewright.vocab import EQUAL_AREA_LAT, WGS84_A, WGS84_E, WGS84_F

_TS = math.radians(EQUAL_AREA_LAT)
_K0 = math.cos(_TS) / math.sqrt(1 - (WGS84_E * math.sin(_TS)) ** 2)


def equal_area_x(lon: Column) -> Column:
    return F.radians(lon) * (WGS84_A * _K0)


def equal_area_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    es = s * WGS84_E
    q = (1 - WGS84_E ** 2) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * WGS84_E))
    return q * (WGS84_A / (2 * _K0))


def box_km2(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Area of a longitude/latitude box; exact, because parallels and meridians map to straight lines."""
    return (equal_area_x(maxx) - equal_area_x(minx)) * (equal_area_y(maxy) - equal_area_y(miny)) / 1e6


def project_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(equal_area_x(p["x"]).alias("x"), equal_area_y(p["y"]).alias("y")))


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
                      lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def signed_area(ring: Column) -> Column:
    """Shoelace sum of a closed ring, positive when counter-clockwise."""
    return let(ring, lambda q: F.aggregate(_edges(q), F.lit(0.0), lambda acc, e: acc + e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_km2(ring: Column) -> Column:
    return ring_area(project_ring(ring)) / 1e6


def centroid(ring: Column) -> Column:
    """Area centroid of a closed ring; the mean of its vertices when it has no area."""
    return let(ring, _centroid)


def _centroid(ring: Column) -> Column:
    parts = F.aggregate(
        _edges(ring), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, e: F.struct(
            (acc["a"] + (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("a"),
            (acc["x"] + (e["ax"] + e["bx"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("x"),
            (acc["y"] + (e["ay"] + e["by"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("y")))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    return let(parts, lambda p: F.when(p["a"] == 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(
        F.struct((p["x"] / (3 * p["a"])).alias("x"), (p["y"] / (3 * p["a"])).alias("y"))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Zone code of a point: north zones 326xx, south zones 327xx."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


# Krueger series for the transverse Mercator projection, to the sixth order of the third flattening.
_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64 + _N ** 6 / 256)
_ALPHA = (
    _N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180 - 127 * _N ** 5 / 288 + 7891 * _N ** 6 / 37800,
    13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440 + 281 * _N ** 5 / 630 - 1983433 * _N ** 6 / 1935360,
    61 * _N ** 3 / 240 - 103 * _N ** 4 / 140 + 15061 * _N ** 5 / 26880 + 167603 * _N ** 6 / 181440,
    49561 * _N ** 4 / 161280 - 179 * _N ** 5 / 168 + 6601661 * _N ** 6 / 7257600,
    34729 * _N ** 5 / 80640 - 3418889 * _N ** 6 / 1995840,
    212378941 * _N ** 6 / 319334400,
)
_UTM_SCALE = 0.9996


def utm_xy(lon: Column, lat: Column, epsg: Column) -> Column:
    """Easting and northing in the given zone, as a struct (x, y)."""
    zone = F.pmod(epsg, F.lit(100))
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(s) - F.atanh(s * WGS84_E) * WGS84_E)
    south = F.when(F.floor(epsg / 100) == 327, F.lit(10_000_000.0)).otherwise(F.lit(0.0))

    def series(g):
        dx, dy = g["eta"], g["xi"]
        for j, a in enumerate(_ALPHA, 1):
            dx = dx + F.cos(g["xi"] * (2 * j)) * F.sinh(g["eta"] * (2 * j)) * a
            dy = dy + F.sin(g["xi"] * (2 * j)) * F.cosh(g["eta"] * (2 * j)) * a
        return F.struct((dx * (_UTM_SCALE * _RECTIFYING) + 500_000.0).alias("x"), (dy * (_UTM_SCALE * _RECTIFYING) + south).alias("y"))

    sphere = let(conformal, lambda t: F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.atanh(F.sin(lam) / F.sqrt(t * t + 1)).alias("eta")))
    return let(sphere, series)
