"""Depth and disparity rasters as pixel rows (frame, r, c, value), checked against the next frame's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.functions import camera, units
from tracklattice.operators import quality


def left_right(disparity: DataFrame, tolerance: float) -> DataFrame:
    """Pixels with ``matched`` and ``consistent``: the other view has a disparity there that differs by no more than ``tolerance``."""
    target = F.bround(F.col("c") - F.col("disparity"), 0).cast("int")
    other = disparity.select((F.col("frame") - 1).alias("frame"), "r", F.col("c").alias("target"), F.col("disparity").alias("other"))
    out = disparity.withColumn("target", target).join(other, ["frame", "r", "target"], "left")
    return out.select("frame", "r", "c", "disparity", F.col("other").isNotNull().alias("matched"), F.coalesce(F.abs(F.col("disparity") - F.col("other")) <= tolerance, F.lit(False)).alias("consistent"))


def depth_consistency(depth: DataFrame, shift: float, most_relative: float, most_pixels: float) -> DataFrame:
    """Pixels whose depth, warped into the next view (by ``shift`` / depth columns), meets a depth there within both bounds.

    The warped column is rounded half to even, compared there, and warped back.
    """
    to = F.bround(F.col("c") + shift / F.col("depth"), 0).cast("int")
    other = depth.select((F.col("frame") - 1).alias("frame"), "r", F.col("c").alias("source_c"), F.col("depth").alias("other"))
    relative = F.abs(F.col("other") - F.col("depth")) / F.col("depth")
    back = F.abs(F.col("source_c") - shift / F.col("other") - F.col("c"))
    out = depth.withColumn("source_c", to).join(other, ["frame", "r", "source_c"]).filter((relative <= most_relative) & (back <= most_pixels))
    return out.select("frame", "r", "c", "source_c", relative.alias("relative"))


def dense_points(pixels: DataFrame, rect: Column, r_cw: Column, t_cw: Column, k: tuple, need_disparity: bool = True) -> DataFrame:
    """``pixels`` (u, v, masked, disparity, depth, confidence, visibility) with ``world``, ``error`` (pixels) and ``reason``.

    One row a pixel of a rectified raster: mask, disparity and depth are tested first, then the point goes back through the
    rectifying rotation ``rect`` and the pose to the world, and the ladder of ``quality.dense_point_reason`` decides. A null reason is a
    valid point; ``reject_histogram`` counts the others. ``k`` is (fx, fy, cx, cy) of the rectified camera.
    """
    world = camera.backproject_rectified(F.col("u"), F.col("v"), F.col("depth"), rect, r_cw, t_cw, *k)
    out = pixels.withColumn("world", world)
    back = camera.project_rectified(F.col("world"), rect, r_cw, t_cw, *k)
    out = out.withColumn("_seen", back).withColumn("error", F.sqrt((F.col("_seen.u") - F.col("u")) ** 2 + (F.col("_seen.v") - F.col("v")) ** 2))
    depth_in = camera.to_camera(F.col("world"), r_cw, t_cw)[2]
    ladder = quality.dense_point_reason(F.col("world"), depth_in, F.col("depth"), F.col("depth"), F.col("confidence"), F.col("visibility"), F.col("error"))
    first = F.when(F.col("masked"), "MASKED_OUT").when(F.lit(need_disparity) & ~(F.col("disparity") > 0), "INVALID_DISPARITY").when(~F.coalesce(units.finite(F.col("depth")) & (F.col("depth") > camera.BEHIND), F.lit(False)), "INVALID_DEPTH_VALUE")
    return out.withColumn("reason", F.coalesce(first, ladder)).drop("_seen")
