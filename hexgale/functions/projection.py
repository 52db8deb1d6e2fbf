"""Lon/lat <-> LAEA Europe (EPSG:3035) and ellipsoidal cell areas as column expressions (I1, I5, H9m).

Formulas: J. P. Snyder, Map Projections - A Working Manual, USGS Professional Paper 1395 (1987).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# EPSG:3035 (GRS80, origin 52 N 10 E).
A = 6378137.0
F_GRS80 = 1.0 / 298.257222101
LAT0, LON0 = 52.0, 10.0
FALSE_E, FALSE_N = 4321000.0, 3210000.0
# Fixed value: WGS84 flattening, used for cell areas.
F_WGS84 = 1.0 / 298.257223563

E2 = F_GRS80 * (2.0 - F_GRS80)
E = math.sqrt(E2)


def _q(sin_lat: float) -> float:
    log_term = math.log((1 - E * sin_lat) / (1 + E * sin_lat)) / (2 * E)
    return (1 - E2) * (sin_lat / (1 - E2 * sin_lat**2) - log_term)


QP = _q(1.0)
RQ = A * math.sqrt(QP / 2)
SIN0 = math.sin(math.radians(LAT0))
BETA0 = math.asin(_q(SIN0) / QP)
SINB0, COSB0 = math.sin(BETA0), math.cos(BETA0)
D = A * (math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * SIN0**2)) / (RQ * COSB0)


def _latitude_series(terms: int = 5, samples: int = 64) -> list[float]:
    """Coefficients of latitude - authalic latitude over sin(2 k beta), from Newton inversions of q."""

    def geodetic(beta: float) -> float:
        lat = beta
        for _ in range(30):
            s = math.sin(lat)
            slope = 2 * (1 - E2) * math.cos(lat) / (1 - E2 * s * s) ** 2
            lat += (QP * math.sin(beta) - _q(s)) / slope
        return lat

    # Odd in beta with period pi: a sine transform over interior samples is exact up to aliasing.
    betas = [math.pi / 2 * (i + 0.5) / samples for i in range(samples)]
    gaps = [geodetic(b) - b for b in betas]
    return [2.0 / samples * sum(g * math.sin(2 * k * b) for g, b in zip(gaps, betas)) for k in range(1, terms + 1)]


SERIES = _latitude_series()


def laea_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - E2) * (
        s / (F.lit(1.0) - F.lit(E2) * s * s)
        - F.log((F.lit(1.0) - F.lit(E) * s) / (F.lit(1.0) + F.lit(E) * s)) / F.lit(2 * E)
    )
    sinb = q / F.lit(QP)
    cosb = F.sqrt(F.greatest(F.lit(1.0) - sinb * sinb, F.lit(0.0)))
    dlon = F.radians(lon - F.lit(LON0))
    b = F.lit(RQ) * F.sqrt(F.lit(2.0) / (F.lit(1.0) + F.lit(SINB0) * sinb + F.lit(COSB0) * cosb * F.cos(dlon)))
    x = F.lit(FALSE_E) + b * F.lit(D) * cosb * F.sin(dlon)
    y = F.lit(FALSE_N) + b / F.lit(D) * (F.lit(COSB0) * sinb - F.lit(SINB0) * cosb * F.cos(dlon))
    return x, y


def laea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    dx, dy = x - F.lit(FALSE_E), y - F.lit(FALSE_N)
    rho = F.hypot(dx / F.lit(D), dy * F.lit(D))
    c = F.lit(2.0) * F.asin(rho / F.lit(2 * RQ))
    at_origin = rho < F.lit(1e-9)
    sinb = F.when(at_origin, F.lit(SINB0)).otherwise(
        F.cos(c) * F.lit(SINB0) + F.lit(D) * dy * F.sin(c) * F.lit(COSB0) / rho
    )
    b = F.asin(sinb)
    lat = b
    for k, s in enumerate(SERIES, start=1):
        lat = lat + F.lit(s) * F.sin(2 * k * b)
    angle = F.atan2(
        dx * F.sin(c), F.lit(D) * rho * F.lit(COSB0) * F.cos(c) - F.lit(D * D) * dy * F.lit(SINB0) * F.sin(c)
    )
    lon = F.lit(LON0) + F.when(at_origin, F.lit(0.0)).otherwise(F.degrees(angle))
    return lon, F.degrees(lat)


def with_laea(df, lon: str = "lon", lat: str = "lat", x: str = "x_laea", y: str = "y_laea"):
    px, py = laea_forward(F.col(lon), F.col(lat))
    return df.withColumns({x: px, y: py})


_WE2 = F_WGS84 * (2.0 - F_WGS84)
_WE = math.sqrt(_WE2)
_WB = A * (1.0 - F_WGS84)


def _band(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    e = F.lit(_WE)
    return s / (F.lit(1.0) - F.lit(_WE2) * s * s) + F.log((F.lit(1.0) + e * s) / (F.lit(1.0) - e * s)) / F.lit(2 * _WE)


def cell_area_km2(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Area of a lon/lat cell on the WGS84 ellipsoid."""
    half_b2 = F.lit(_WB * _WB / 2.0 / 1e6)
    return F.abs(half_b2 * F.radians(east - west) * (_band(north) - _band(south)))


def hexagon_side(area_km2: float) -> float:
    """Side in metres of a regular hexagon of the given area (at least 1 km2)."""
    return math.sqrt(2.0 * max(1.0, area_km2) * 1e6 / (3.0 * math.sqrt(3.0)))


def point_laea(lon: float, lat: float) -> tuple[float, float]:
    """Driver-side projection of a single parameter point (a bounding-box corner)."""
    sinb = _q(math.sin(math.radians(lat))) / QP
    cosb = math.sqrt(1 - sinb * sinb)
    dlon = math.radians(lon - LON0)
    b = RQ * math.sqrt(2.0 / (1 + SINB0 * sinb + COSB0 * cosb * math.cos(dlon)))
    return (
        FALSE_E + b * D * cosb * math.sin(dlon),
        FALSE_N + b / D * (COSB0 * sinb - SINB0 * cosb * math.cos(dlon)),
    )
