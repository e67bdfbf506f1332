"""South polar stereographic projection (EPSG:3031) as column expressions.

Formulas: Snyder, Map Projections - A Working Manual, USGS Professional Paper 1395, section 21.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 ellipsoid and the projection's standard parallel.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
STANDARD_PARALLEL = 71.0

ECC = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _t_scalar(q: float) -> float:
    es = ECC * math.sin(q)
    return math.tan(math.pi / 4 - q / 2) / ((1 - es) / (1 + es)) ** (ECC / 2)


_PHI = math.radians(STANDARD_PARALLEL)
_M = math.cos(_PHI) / math.sqrt(1 - (ECC * math.sin(_PHI)) ** 2)
SCALE = SEMI_MAJOR * _M / _t_scalar(_PHI)

# Coefficients of Snyder's series (3-5) from conformal to geodetic latitude.
_E2 = ECC**2
SERIES = (
    _E2 / 2 + 5 * _E2**2 / 24 + _E2**3 / 12 + 13 * _E2**4 / 360,
    7 * _E2**2 / 48 + 29 * _E2**3 / 240 + 811 * _E2**4 / 11520,
    7 * _E2**3 / 120 + 81 * _E2**4 / 1120,
    4279 * _E2**4 / 161280,
)


def to_polar(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``x``, ``y`` in metres for southern latitudes in degrees."""
    q = F.radians(-F.col(lat))
    es = F.sin(q) * F.lit(ECC)
    t = F.tan(F.lit(math.pi / 4) - q / 2) / F.pow((1 - es) / (1 + es), F.lit(ECC / 2))
    rho = t * F.lit(SCALE)
    theta = F.radians(F.col(lon))
    return df.withColumns({"x": rho * F.sin(theta), "y": rho * F.cos(theta)})


def to_geographic(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``lat``, ``lon`` in degrees for projected coordinates in metres."""
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.hypot(x, y) / F.lit(SCALE))
    phi = chi
    for order, coefficient in enumerate(SERIES, start=1):
        phi = phi + F.sin(chi * (2 * order)) * F.lit(coefficient)
    return df.withColumns({"lat": -F.degrees(phi), "lon": F.degrees(F.atan2(x, y))})


def wrap_longitude(df: DataFrame, name: str = "lon", to: str = "180") -> DataFrame:
    """Longitudes to [-180, 180) (``to="180"``) or [0, 360) (``to="360"``)."""
    shift = {"180": 180.0, "360": 0.0}[to]
    return df.withColumn(name, F.pmod(F.col(name) + F.lit(shift), F.lit(360.0)) - F.lit(shift))


def cell_of(coordinate: Column, cell: float) -> Column:
    return F.floor(coordinate / F.lit(cell)).cast("bigint")


def snap(df: DataFrame, cell: float = 500.0, x: str = "x", y: str = "y") -> DataFrame:
    """Integer cell of every point: the equi-join key of the grid."""
    return df.withColumns({"cell_x": cell_of(F.col(x), cell), "cell_y": cell_of(F.col(y), cell)})
