"""Times, units, angles and plain predicates as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_IN = {"seconds": 1.0, "milliseconds": 1e3, "microseconds": 1e6}
FEET, KMH, KNOTS = 0.3048, 3.6, 0.514444


def _known(unit: str, units) -> str:
    if unit not in units:
        raise ValueError(f"unit {unit!r} is none of {sorted(units)}")
    return unit


def timecode_seconds(text: Column) -> Column:
    """``HH:MM:SS,mmm`` (or with a point) to seconds; null where there is no such timecode at the start."""
    part = lambda i: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def clean_number(text: Column) -> Column:
    """A number with an optional metric suffix and a decimal comma; null if it isn't one."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(text), r"[msMS/]+$", "")), ",", ".").try_cast("double")


def timestamp_seconds(raw: Column, unit: str = "seconds") -> Column:
    return raw / SECONDS_IN[_known(unit, SECONDS_IN)]


def degrees(raw: Column, unit: str = "degrees") -> Column:
    return F.degrees(raw) if _known(unit, ("degrees", "radians")) == "radians" else raw


def metres(raw: Column, unit: str = "meters") -> Column:
    return raw * FEET if _known(unit, ("meters", "feet")) == "feet" else raw


def metres_per_second(raw: Column, unit: str = "mps") -> Column:
    """An unknown unit is an error here; a log whose speeds have another unit would otherwise pass unnoticed."""
    return {"mps": raw, "kmph": raw / KMH, "knots": raw * KNOTS}[_known(unit, ("mps", "kmph", "knots"))]


def fix_type(satellites: Column) -> Column:
    return F.when(satellites >= 4, "3D_FIX").when(satellites.isNotNull(), "NO_FIX")


def shifted(seconds: Column, offset: float = 0.0) -> Column:
    """Another clock's time. The identity clock has offset 0."""
    if not math.isfinite(offset):
        raise ValueError("a clock offset must be finite")
    return seconds + F.lit(float(offset))


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """Null if either side is."""
    return a + alpha * (b - a)


def turn(degrees_from: Column, degrees_to: Column) -> Column:
    """Shortest signed turn between two angles, in [-180, 180)."""
    return F.pmod(degrees_to - degrees_from + 180.0, F.lit(360.0)) - 180.0


def lerp_longitude(a: Column, b: Column, alpha: Column) -> Column:
    """Along the shortest arc, in [-180, 180)."""
    return F.pmod(a + alpha * turn(a, b) + 180.0, F.lit(360.0)) - 180.0


def lerp_heading(a: Column, b: Column, alpha: Column) -> Column:
    """Along the shortest arc, in [0, 360)."""
    return F.pmod(a + alpha * turn(a, b), F.lit(360.0))


def presentation_millis(seconds: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.bround(seconds * 1000.0, 0).cast("long")


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_latitude(x: Column) -> Column:
    return finite(x) & x.between(-90.0, 90.0)


def valid_longitude(x: Column) -> Column:
    return finite(x) & x.between(-180.0, 180.0)


def valid_speed(x: Column) -> Column:
    return finite(x) & (x >= 0)
