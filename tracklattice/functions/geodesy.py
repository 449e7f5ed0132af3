"""WGS84 geodesy as column functions. Angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklattice.functions.rotation import add, held, rotate, subtract, transpose, vector
from tracklattice.functions.units import finite, valid_latitude, valid_longitude

A = 6378137.0
INVERSE_FLATTENING = 298.257223563
_F = 1 / INVERSE_FLATTENING
B = A * (1 - _F)
E2 = 2 * _F - _F * _F
EP2 = (A * A - B * B) / (B * B)


def geodetic_to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """Array (x, y, z); null outside the ranges of latitude and longitude or for a number that isn't finite."""
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    ok = valid_latitude(lat) & valid_longitude(lon) & finite(alt)
    return F.when(ok, vector((n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)))


def ecef_to_geodetic(v: Column) -> Column:
    """Struct (lat, lon, alt) by Bowring's closed form. On the axis lon is 0, and z = 0 counts as the north."""
    return held(v, _to_geodetic)


def _to_geodetic(v: Column) -> Column:
    x, y, z = v[0], v[1], v[2]
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    at = held(F.struct(F.sin(theta).alias("s"), F.cos(theta).alias("c")), lambda t: F.atan2(z + EP2 * B * t["s"] * t["s"] * t["s"], p - E2 * A * t["c"] * t["c"] * t["c"]))
    both = held(at, lambda lat: F.struct(lat.alias("lat"), _height(lat, p, z).alias("alt")))
    lat, alt = both["lat"], both["alt"]
    axis = p < 1e-6
    return F.struct(
        F.when(axis, F.when(z >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(lat)).alias("lat"),
        F.when(axis, 0.0).otherwise(F.degrees(F.atan2(y, x))).alias("lon"),
        F.when(axis, F.abs(z) - B).otherwise(alt).alias("alt"),
    )


def _height(lat: Column, p: Column, z: Column) -> Column:
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.when(F.abs(F.cos(lat)) > 1e-4, F.try_divide(p, F.cos(lat)) - n).otherwise(F.try_divide(z, F.sin(lat)) - n * (1 - E2))


def ecef_to_enu_rotation(lat: Column, lon: Column) -> Column:
    """Matrix from ECEF differences to (east, north, up) at an origin."""
    p, q = F.radians(lat), F.radians(lon)
    sp, cp, sq, cq = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    return vector(-sq, cq, 0.0, -sp * cq, -sp * sq, cp, cp * cq, cp * sq, sp)


def ecef_to_enu(v: Column, lat: Column, lon: Column, alt: Column) -> Column:
    return rotate(ecef_to_enu_rotation(lat, lon), subtract(v, geodetic_to_ecef(lat, lon, alt)))


def enu_to_ecef(v: Column, lat: Column, lon: Column, alt: Column) -> Column:
    return add(geodetic_to_ecef(lat, lon, alt), rotate(transpose(ecef_to_enu_rotation(lat, lon)), v))


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> Column:
    return ecef_to_enu(geodetic_to_ecef(lat, lon, alt), lat0, lon0, alt0)


def enu_to_geodetic(v: Column, lat0: Column, lon0: Column, alt0: Column) -> Column:
    return ecef_to_geodetic(enu_to_ecef(v, lat0, lon0, alt0))
