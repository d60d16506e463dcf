"""Geodesy and Web Mercator expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnfield.constants import (
    CAPTURE_CIRCUMFERENCE_M,
    CAPTURE_SIN_LIMIT,
    DETAIL_CELL_PX,
    DETAIL_ZOOM,
    EARTH_RADIUS_M,
    EXTENT_MAX_LAT,
    HALF_WORLD_M,
    MAX_MERCATOR_LAT,
    TILE_CIRCUMFERENCE_M,
    TILE_SIZE,
)

D2R = math.pi / 180
METERS_PER_DEGREE = EARTH_RADIUS_M * D2R


def finite(*cols: Column) -> Column:
    """True when every column is a real number (null, NaN and infinities are not)."""
    out = None
    for c in cols:
        ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        out = ok if out is None else out & ok
    return out


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((lat2 - lat1) * D2R / 2)
    half_lon = F.sin((lon2 - lon1) * D2R / 2)
    chord = half_lat * half_lat + F.cos(lat1 * D2R) * F.cos(lat2 * D2R) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2 * EARTH_RADIUS_M)


def world_size(z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    z = z if isinstance(z, Column) else F.lit(z)
    return F.pow(F.lit(2.0), z) * tile_size


def world_x(lon: Column, z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    return (lon + 180) / 360 * world_size(z, tile_size)


def _y_of_sin(s: Column, z: Column | int | float, tile_size: int) -> Column:
    return (F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * world_size(z, tile_size)


def world_y(lat: Column, z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    """World pixel row with the tile grid's latitude clamp."""
    return _y_of_sin(F.sin(clamp(lat, -MAX_MERCATOR_LAT, MAX_MERCATOR_LAT) * D2R), z, tile_size)


def capture_y(lat: Column, z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    """World pixel row with the capture frame's clamp on the sine."""
    return _y_of_sin(clamp(F.sin(lat * D2R), -CAPTURE_SIN_LIMIT, CAPTURE_SIN_LIMIT), z, tile_size)


def world_lon(x: Column, z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    return x / world_size(z, tile_size) * 360 - 180


def world_lat(y: Column, z: Column | int | float, tile_size: int = TILE_SIZE) -> Column:
    return F.atan(F.sinh((1 - 2 * y / world_size(z, tile_size)) * math.pi)) / D2R


def ground_resolution(lat: Column, z: Column | int | float) -> Column:
    return F.cos(lat * D2R) * CAPTURE_CIRCUMFERENCE_M / world_size(z)


def mercator_x_m(lon: Column) -> Column:
    return lon * HALF_WORLD_M / 180


def mercator_y_m(lat: Column, limit: float = MAX_MERCATOR_LAT) -> Column:
    return F.ln(F.tan((clamp(lat, -limit, limit) + 90) * math.pi / 360)) * HALF_WORLD_M / math.pi


def world_px_to_m_x(x: Column, z: int = DETAIL_ZOOM) -> Column:
    return (x / world_size(z) - 0.5) * TILE_CIRCUMFERENCE_M


def world_px_to_m_y(y: Column, z: int = DETAIL_ZOOM) -> Column:
    return (0.5 - y / world_size(z)) * TILE_CIRCUMFERENCE_M


def detail_cell_x(lon: Column) -> Column:
    return F.floor(world_x(lon, DETAIL_ZOOM) / DETAIL_CELL_PX).cast("bigint")


def detail_cell_y(lat: Column) -> Column:
    return F.floor(world_y(lat, DETAIL_ZOOM) / DETAIL_CELL_PX).cast("bigint")


def tile_key(z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))


def cell_key(x: Column, y: Column) -> Column:
    return F.concat_ws("/", x.cast("string"), y.cast("string"))


def tile_quad(x0: Column, y0: Column, x1: Column, y1: Column, z: Column | int) -> Column:
    """Corners south-west, south-east, north-east, north-west of a world-pixel box."""
    corner = lambda x, y: F.struct(world_lat(y, z).alias("lat"), world_lon(x, z).alias("lon"))
    return F.array(corner(x0, y1), corner(x1, y1), corner(x1, y0), corner(x0, y0))


def geographic_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return mercator_x_m(lon), mercator_y_m(lat, EXTENT_MAX_LAT)


def florida_albers_to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse of the state-wide equal-area projection EPSG:3087, then to Mercator metres."""
    # fixed values: EPSG:3087 parameters
    a, flattening = 6378137.0, 1 / 298.257222101
    lat_1, lat_2, lat_0, lon_0, false_east = 24.0, 31.5, 24.0, -84.0, 400000.0
    e2 = 2 * flattening - flattening**2
    e = math.sqrt(e2)

    def q_at(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_at(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(v) for v in (lat_1, lat_2, lat_0))
    n = (m_at(p1) ** 2 - m_at(p2) ** 2) / (q_at(p2) - q_at(p1))
    c = m_at(p1) ** 2 + n * q_at(p1)
    rho_0 = a * math.sqrt(c - n * q_at(p0)) / n
    dx, dy = x - false_east, F.lit(rho_0) - y
    rho = F.hypot(dx, dy)
    target = (F.lit(c) - F.pow(rho * (n / a), F.lit(2.0))) / n

    def newton(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        q = (s / (1 - s * s * e2) - F.ln((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)
        slope = F.cos(phi) * (2 * (1 - e2)) / F.pow(1 - s * s * e2, F.lit(2.0))
        return F.when(F.abs(slope) < 1e-12, phi).otherwise(phi - (q - target) / slope)

    phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.asin(target / 2), newton)
    lon = F.atan2(dx, dy) / n / D2R + lon_0
    return geographic_to_mercator(lon, phi / D2R)
