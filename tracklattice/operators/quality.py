"""Reason-coded validation of timelines, points, clouds, claims and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions.units import finite

# Parts of a metric's name that make it non-negative, and names of percentages.
NON_NEGATIVE = ("rmse", "mae", "ate", "rpe", "chamfer", "distance", "error", "time", "vram", "memory", "residual", "variance", "std")
PERCENTAGES = ("accuracy_at_tau_pct", "completeness_at_tau_pct", "success_rate_pct", "scale_drift_pct", "inlier_ratio_pct")


def first_reason(*tests: tuple[Column, str]) -> Column:
    """Reason of the first test that holds; null if none does. A test that is null doesn't hold."""
    out = None
    for test, reason in tests:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out


def temporal_order(rows: DataFrame, key: str, t: str, order: tuple[str, ...], allow_equal: bool = False) -> DataFrame:
    """Rows with ``violation``: TIME_GOES_BACK or, unless allowed, TIME_REPEATS against the row before in ``order``."""
    before = F.lag(t).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("violation", first_reason((F.col(t) < before, "TIME_GOES_BACK"), ((F.col(t) == before) & F.lit(not allow_equal), "TIME_REPEATS")))


def timeline_findings(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, frames, gaps_in_index, backward_steps, valid) of frames (key, frame_index, timestamp_seconds)."""
    w = Window.partitionBy(key).orderBy("frame_index", "timestamp_seconds")
    rows = frames.select(key, "frame_index", (F.col("frame_index") - F.coalesce(F.lag("frame_index").over(w), F.lit(-1))).alias("_step"), (F.col("timestamp_seconds") < F.lag("timestamp_seconds").over(w)).alias("_back"))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("_step") != 1).alias("gaps_in_index"), F.count_if("_back").alias("backward_steps"))
    return out.withColumn("valid", (F.col("gaps_in_index") == 0) & (F.col("backward_steps") == 0))


def keyframe_gate(decoded: Column, severe: Column, static_fraction: Column, match_contamination: Column, most_dynamic: float = 0.60) -> Column:
    """Reason to keep a frame from being a key frame, else null. Much movement is tolerated where few matches lie in it."""
    risky = (1 - static_fraction > most_dynamic) & ~F.coalesce(match_contamination < 0.15, F.lit(False))
    return first_reason((~decoded, "UNSAFE_DECODE_FAILURE"), (F.coalesce(severe, F.lit(False)), "UNSAFE_SEVERELY_DEGRADED"), (risky, "DYNAMIC_RISK_EXCLUSION"))


def dense_point_reason(world: Column, z_camera: Column, z_rectified: Column, depth: Column, confidence: Column, visibility: Column, error: Column, low: float = 0.5, high: float = 100.0, least_confidence: float = 0.20, most_error: float = 2.0) -> Column:
    bad = F.exists(world, lambda x: ~finite(x))
    return first_reason((bad, "NON_FINITE_COORDINATES"), ((z_camera <= 1e-6) | (z_rectified <= 1e-6), "CHEIRALITY_VIOLATION"), ((depth < low) | (depth > high), "OUT_OF_DEPTH_BOUNDS"), (confidence < least_confidence, "LOW_CONFIDENCE"), (visibility.isin("INCONSISTENT", "OCCLUDED", "INVALID_DEPTH"), "OCCLUDED_OR_INCONSISTENT"), (error.isNull() | (error > most_error), "REPROJECTION_ERROR_EXCEEDED"))


def claim_violations(name: Column, value: Column, unit: Column, dataset: Column, truth: Column, method: Column, tau: Column) -> Column:
    """Array of what keeps a metric from being claimed. Non-negative metrics are known by parts of their names."""
    low = F.lower(F.trim(name))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    part = F.exists(F.array(*[F.lit(p) for p in NON_NEGATIVE]), lambda p: F.contains(low, p))
    tests = [(blank(name), "NO_NAME"), (blank(unit), "NO_UNIT"), (blank(dataset), "NO_DATASET"), (blank(truth), "NO_GROUND_TRUTH"), (blank(method), "NO_METHOD"), (~finite(value), "NOT_FINITE"), (part & (value < 0), "NEGATIVE"), (low.isin(*PERCENTAGES) & ~value.between(0.0, 100.0), "NOT_A_PERCENTAGE"), (tau.isNotNull() & (F.isnan(tau) | (tau <= 0)), "BAD_THRESHOLD")]
    return F.filter(F.array(*[F.when(t, r) for t, r in tests]), lambda x: x.isNotNull())


def first_wins(rows: DataFrame, *steps: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """``rows`` without repeats: for each (keys, order) in turn the first row of each key stays."""
    for keys, order in steps:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return rows


def cloud_findings(points: DataFrame) -> DataFrame:
    """One row of counts over a cloud (x, y, z, confidence, support)."""
    bad = ~(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    return points.agg(F.count(F.lit(1)).alias("points"), F.count_if(bad).alias("not_finite"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("bad_confidence"), F.count_if(F.col("support") < 1).alias("no_support")).withColumn("valid", (F.col("points") > 0) & (F.col("not_finite") + F.col("bad_confidence") + F.col("no_support") == 0))


def visibility(reconstructed: Column, in_frustum: Column, traced: Column, foreground: Column) -> Column:
    """State of a scene point. Occlusion is claimed only where rays were traced."""
    return F.when(reconstructed, "OBSERVED").when(~in_frustum, "UNOBSERVED").when(~traced, "UNDETERMINED").when(foreground, "PHYSICALLY_OCCLUDED").otherwise("RECONSTRUCTION_MISSING")
