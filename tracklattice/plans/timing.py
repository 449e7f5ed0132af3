"""Timing profiles of runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def latency_tier(fps: Column) -> Column:
    return F.when(fps.isNull() | (fps <= 0), "NOT_CLASSIFIED").when(fps < 1, "OFFLINE_BATCH").when(fps < 30, "NEAR_REAL_TIME").otherwise("REAL_TIME")


def profile(frames: int, seconds: float, clip_seconds: float) -> dict[str, float | str | None]:
    """Frames a second and real-time factor of a measured run; nothing is assumed where something wasn't measured."""
    fps = frames / seconds if frames and seconds > 0 else None
    tier = "NOT_CLASSIFIED" if not fps else "OFFLINE_BATCH" if fps < 1 else "NEAR_REAL_TIME" if fps < 30 else "REAL_TIME"
    return {"fps": fps, "real_time_factor": seconds / clip_seconds if clip_seconds > 0 else None, "tier": tier}
