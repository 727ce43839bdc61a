"""Projected coordinates to longitude and latitude, by Krueger's series as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from rankmill.functions.bind import let

# The ellipsoid GRS 80, and of the national grids the central meridian in degrees, scale and false easting.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101


@dataclass(frozen=True)
class TransverseMercator:
    meridian: float
    scale: float = 1.0
    false_easting: float = 150_000.0


GRIDS = {
    3006: TransverseMercator(15.0, 0.9996, 500_000.0),
    3007: TransverseMercator(12.0),
    3008: TransverseMercator(13.5),
    3009: TransverseMercator(15.0),
    3010: TransverseMercator(16.5),
    3011: TransverseMercator(18.0),
    3012: TransverseMercator(14.25),
    3013: TransverseMercator(15.75),
    3014: TransverseMercator(17.25),
    3015: TransverseMercator(18.75),
    3016: TransverseMercator(20.25),
    3017: TransverseMercator(21.75),
    3018: TransverseMercator(23.25),
}


def series() -> tuple[float, list[float], list[float]]:
    """Radius of the rectifying sphere, coefficients back from the plane, coefficients from conformal to geographic latitude."""
    n, e2 = FLATTENING / (2 - FLATTENING), FLATTENING * (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    plane = [
        n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
        17 / 480 * n**3 - 37 / 840 * n**4,
        4397 / 161_280 * n**4,
    ]
    latitude = [
        e2 + e2**2 + e2**3 + e2**4,
        -(7 * e2**2 + 17 * e2**3 + 30 * e2**4) / 6,
        (224 * e2**3 + 889 * e2**4) / 120,
        -4279 * e2**4 / 1260,
    ]
    return radius, plane, latitude


def lon_lat(easting: Column, northing: Column, grid: TransverseMercator) -> Column:
    """[longitude, latitude] in degrees of a point of the grid."""
    radius, plane, latitude = series()
    xi, eta = northing / (grid.scale * radius), (easting - grid.false_easting) / (grid.scale * radius)

    def on_sphere(p: Column) -> Column:
        x, y = p["xi"], p["eta"]
        for k, d in enumerate(plane, 1):
            x = x - d * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
            y = y - d * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return F.struct(x.alias("xi"), y.alias("eta"))

    def degrees(p: Column) -> Column:
        def geographic(conformal: Column) -> Column:
            square = F.sin(conformal) * F.sin(conformal)
            terms = latitude[0] + square * (latitude[1] + square * (latitude[2] + square * latitude[3]))
            return F.degrees(conformal + F.sin(conformal) * F.cos(conformal) * terms)

        lon = grid.meridian + F.degrees(F.atan(F.sinh(p["eta"]) / F.cos(p["xi"])))
        return F.array(lon, let(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), geographic))

    return let(let(F.struct(xi.alias("xi"), eta.alias("eta")), on_sphere), degrees)


def grid_point(lon: float, lat: float, grid: TransverseMercator) -> tuple[float, float]:
    """(easting, northing) of a point; for single points such as the corners of a box."""
    n, e2 = FLATTENING / (2 - FLATTENING), FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    radius = series()[0]
    plane = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49_561 / 161_280 * n**4,
    ]
    phi, turn = math.radians(lat), math.radians(lon - grid.meridian)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))  # tangent of the conformal latitude
    xi, eta = math.atan2(t, math.cos(turn)), math.asinh(math.sin(turn) / math.hypot(t, math.cos(turn)))
    x = xi + sum(d * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, d in enumerate(plane, 1))
    y = eta + sum(d * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, d in enumerate(plane, 1))
    return grid.scale * radius * y + grid.false_easting, grid.scale * radius * x
