"""WGS84 longitude/latitude to and from the British National Grid, as column maths.

Published Ordnance Survey formulae: a seven-parameter Helmert shift between the WGS84 and Airy 1830
datums and a Transverse Mercator projection; about five metres from the official grid. Each step is a
projection of its own, so Catalyst evaluates every intermediate once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: ellipsoids, datum shift and projection of the national grid -------------------
WGS84 = (6378137.0, 6356752.314245)
AIRY = (6377563.396, 6356256.909)
SCALE = 0.9996012717
LAT0, LON0 = math.radians(49), math.radians(-2)
EAST0, NORTH0 = 400000.0, -100000.0
SHIFT_M = (-446.448, 125.157, -542.060)
SHIFT_PPM = 20.4894
SHIFT_SECONDS = (-0.1502, -0.2470, -0.8421)
# ---- end of fixed values -------------------------------------------------------------------------


def _ecc2(ellipsoid: tuple[float, float]) -> float:
    a, b = ellipsoid
    return 1 - (b * b) / (a * a)


def _meridian_arc(lat: Column) -> Column:
    """Scaled distance along the meridian from the true origin to `lat`."""
    a, b = AIRY
    n = (a - b) / (a + b)
    less, more = lat - F.lit(LAT0), lat + F.lit(LAT0)
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * less
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(less) * F.cos(more)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * less) * F.cos(2 * more)
        - 35 / 24 * n**3 * F.sin(3 * less) * F.cos(3 * more)
    )
    return F.lit(b * SCALE) * terms


def _to_cartesian(df: DataFrame, lat: str, lon: str, ellipsoid: tuple[float, float]) -> DataFrame:
    e2 = _ecc2(ellipsoid)
    nu = F.lit(ellipsoid[0]) / F.sqrt(1 - e2 * F.sin(lat) ** 2)
    df = df.withColumn("_nu", nu)
    return df.withColumns({
        "_x": F.col("_nu") * F.cos(lat) * F.cos(lon),
        "_y": F.col("_nu") * F.cos(lat) * F.sin(lon),
        "_z": (1 - e2) * F.col("_nu") * F.sin(lat),
    })


def _datum_shift(df: DataFrame, sign: int) -> DataFrame:
    """Helmert shift: sign +1 from WGS84 to Airy, -1 back."""
    tx, ty, tz = (sign * v for v in SHIFT_M)
    s = 1 + sign * SHIFT_PPM * 1e-6
    rx, ry, rz = (math.radians(sign * v / 3600) for v in SHIFT_SECONDS)
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    return df.withColumns({
        "_x": tx + x * s - y * rz + z * ry,
        "_y": ty + x * rz + y * s - z * rx,
        "_z": tz - x * ry + y * rx + z * s,
    })


def _to_geodetic(df: DataFrame, ellipsoid: tuple[float, float]) -> DataFrame:
    e2 = _ecc2(ellipsoid)
    df = df.withColumn("_p", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))
    df = df.withColumn("_lat", F.atan2(F.col("_z"), F.col("_p") * (1 - e2)))
    for _ in range(5):
        nu = F.lit(ellipsoid[0]) / F.sqrt(1 - e2 * F.sin("_lat") ** 2)
        df = df.withColumn("_lat", F.atan2(F.col("_z") + e2 * nu * F.sin("_lat"), F.col("_p")))
    return df.withColumn("_lon", F.atan2("_y", "_x"))


def _radii(df: DataFrame) -> DataFrame:
    e2 = _ecc2(AIRY)
    w = 1 - e2 * F.sin("_lat") ** 2
    df = df.withColumns({
        "_nu": F.lit(AIRY[0] * SCALE) / F.sqrt(w),
        "_rho": F.lit(AIRY[0] * SCALE * (1 - e2)) / F.pow(w, F.lit(1.5)),
    })
    return df.withColumn("_eta2", F.col("_nu") / F.col("_rho") - 1)


def airy_to_grid(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Project Airy latitude `_lat` and longitude `_lon` (radians) to the grid."""
    df = _radii(df).withColumns({"_t2": F.tan("_lat") ** 2, "_d": F.col("_lon") - F.lit(LON0)})
    lat, nu, rho, eta2, t2, d = (F.col(c) for c in ("_lat", "_nu", "_rho", "_eta2", "_t2", "_d"))
    sin, cos = F.sin(lat), F.cos(lat)
    north = (
        _meridian_arc(lat) + F.lit(NORTH0)
        + nu / 2 * sin * cos * d**2
        + nu / 24 * sin * cos**3 * (5 - t2 + 9 * eta2) * d**4
        + nu / 720 * sin * cos**5 * (61 - 58 * t2 + t2**2) * d**6
    )
    east = (
        F.lit(EAST0) + nu * cos * d
        + nu / 6 * cos**3 * (nu / rho - t2) * d**3
        + nu / 120 * cos**5 * (5 - 18 * t2 + t2**2 + 14 * eta2 - 58 * t2 * eta2) * d**5
    )
    return df.withColumns({easting: east, northing: north})


def grid_to_airy(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Airy latitude `_lat` and longitude `_lon` (radians) of grid coordinates."""
    df = df.withColumn("_lat", (F.col(northing) - NORTH0) / (AIRY[0] * SCALE) + LAT0)
    for _ in range(6):
        residue = F.col(northing) - F.lit(NORTH0) - _meridian_arc(F.col("_lat"))
        df = df.withColumn("_lat", F.col("_lat") + residue / (AIRY[0] * SCALE))
    df = _radii(df).withColumns({"_t": F.tan("_lat"), "_d": F.col(easting) - F.lit(EAST0)})
    df = df.withColumn("_t2", F.col("_t") ** 2)
    lat, nu, rho, eta2, t, t2, d = (F.col(c) for c in ("_lat", "_nu", "_rho", "_eta2", "_t", "_t2", "_d"))
    sec = 1 / F.cos(lat)
    new_lat = (
        lat
        - t / (2 * rho * nu) * d**2
        + t / (24 * rho * nu**3) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * d**4
        - t / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2**2) * d**6
    )
    new_lon = (
        F.lit(LON0) + sec / nu * d
        - sec / (6 * nu**3) * (nu / rho + 2 * t2) * d**3
        + sec / (120 * nu**5) * (5 + 28 * t2 + 24 * t2**2) * d**5
        - sec / (5040 * nu**7) * (61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3) * d**7
    )
    return df.withColumns({"_lat": new_lat, "_lon": new_lon})


def with_national_grid(df: DataFrame, lon: str = "lon", lat: str = "lat",
                       easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add grid coordinates for WGS84 degrees."""
    keep = [c for c in df.columns if c not in (easting, northing)]
    df = df.withColumns({"_lat": F.radians(lat), "_lon": F.radians(lon)})
    df = _to_geodetic(_datum_shift(_to_cartesian(df, "_lat", "_lon", WGS84), 1), AIRY)
    return airy_to_grid(df, easting, northing).select(*keep, easting, northing)


def with_lon_lat(df: DataFrame, easting: str = "easting", northing: str = "northing",
                 lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add WGS84 degrees for grid coordinates."""
    keep = [c for c in df.columns if c not in (lon, lat)]
    df = grid_to_airy(df, easting, northing)
    df = _to_geodetic(_datum_shift(_to_cartesian(df, "_lat", "_lon", AIRY), -1), WGS84)
    return df.select(*keep, F.degrees("_lon").alias(lon), F.degrees("_lat").alias(lat))
