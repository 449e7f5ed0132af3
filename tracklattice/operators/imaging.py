"""Frame statistics over pixel and flow rows; stencils as kernels over one frame a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def illumination(tiles: DataFrame, grid: int, uniform: float, slope: float, ratio: float) -> DataFrame:
    """(frame, pattern, nonuniformity) from tile means (frame, r, c, m) of a grid x grid raster."""
    line = lambda axis, i: F.avg(F.when(F.col(axis) == i, F.col("m"))).alias(f"{axis}{i}")
    g = tiles.groupBy("frame").agg(F.stddev_pop("m").alias("s"), F.median("m").alias("med"), F.max("m").alias("hi"), F.min("m").alias("lo"), *[line(a, i) for a in "rc" for i in range(grid)])

    def monotone(axis: str) -> Column:
        steps = [F.col(f"{axis}{i + 1}") - F.col(f"{axis}{i}") for i in range(grid - 1)]
        up, down = steps[0] > 1, steps[0] < -1
        for s in steps[1:]:
            up, down = up & (s > 1), down & (s < -1)
        return (up | down) & (F.abs(F.col(f"{axis}{grid - 1}") - F.col(f"{axis}0")) > slope)

    middle = F.greatest("med", F.lit(10.0))
    bright, dark = F.col("hi") > ratio * middle, F.col("lo") < middle / ratio
    pattern = F.when(F.col("s") < uniform, "UNIFORM").when(monotone("c") | monotone("r"), "GRADIENT").when(bright & ~dark, "LOCALIZED_BRIGHTNESS").when(dark & ~bright, "LOCALIZED_DARKNESS").otherwise("MIXED")
    return g.select("frame", pattern.alias("pattern"), F.col("s").alias("nonuniformity"))


def photometric_category(distance: Column, mean_change: Column, localized: Column, change: float = 0.15) -> Column:
    moved = F.abs(mean_change)
    return F.when((distance < change) & (moved < 5), "STABLE").when((moved >= 15) | (distance >= change), F.when(localized, "POTENTIAL_LOCAL_ILLUMINATION_CHANGE").otherwise("POTENTIAL_EXPOSURE_TRANSITION")).otherwise("MIXED_CHANGE")


def temporal_change(pixels: DataFrame, height: int, width: int, bins: int = 64, change: float = 0.15) -> DataFrame:
    """(frame, mean_change, distance, category) of each frame (frame: a number; row, col, v) against the one before it.

    The distance is Bhattacharyya's between the frames' histograms; a change is local where the frame's own light is.
    """
    from tracklattice.operators import summaries

    means = pixels.groupBy("frame").agg(F.avg("v").alias("m"))
    pairs = means.select((F.col("frame") - 1).alias("a"), F.col("frame").alias("b")).join(means.select(F.col("frame").alias("a")), "a", "left_semi")
    h = summaries.histogram(pixels, F.col("v"), bins, 0.0, 255.0, "frame")
    apart = summaries.bhattacharyya(h, "frame", pairs).select("a", F.col("b").alias("frame"), "distance")
    tiles = pixels.groupBy("frame", summaries.tile_of(F.col("row"), height, 3).alias("r"), summaries.tile_of(F.col("col"), width, 3).alias("c")).agg(F.avg("v").alias("m"))
    light = illumination(tiles, 3, 12.0, 25.0, 1.5).select("frame", F.col("pattern").isin("LOCALIZED_BRIGHTNESS", "LOCALIZED_DARKNESS").alias("localized"))
    out = apart.join(means, "frame").join(means.select(F.col("frame").alias("a"), F.col("m").alias("before")), "a").join(light, "frame").withColumn("mean_change", F.col("m") - F.col("before"))
    return out.select("frame", "mean_change", "distance", photometric_category(F.col("distance"), F.col("mean_change"), F.col("localized"), change).alias("category"))


def flow_summary(flow: DataFrame, *by: str) -> DataFrame:
    """Median and mean displacement and coherence (length of the mean direction of vectors beyond 0.1) of u, v rows."""
    mag = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    rows = flow.withColumn("_m", mag)
    way = lambda c: F.avg(F.when(F.col("_m") > 0.1, F.col(c) / F.col("_m")))
    out = rows.groupBy(*by).agg(F.median("_m").alias("median_displacement"), F.avg("_m").alias("mean_displacement"), way("u").alias("_u"), way("v").alias("_v"))
    return out.withColumn("coherence", F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))).drop("_u", "_v")


def motion_category(local_outlier: Column, coherent: Column, still: Column, low_texture: Column) -> Column:
    return F.when(local_outlier & ~coherent, "POTENTIAL_LOCAL_MOTION").when(still & ~local_outlier, F.when(low_texture, "INSUFFICIENT_EVIDENCE").otherwise("LOW_APPARENT_MOTION")).when(coherent & ~local_outlier, "POTENTIAL_CAMERA_MOTION").otherwise("MIXED_MOTION")


def blur_index(velocity: Column, sharpness_drop: Column) -> Column:
    return F.least(F.lit(1.0), velocity / 100.0) * sharpness_drop


def persistence(regions: DataFrame, full: int) -> DataFrame:
    """Regions (frame, key, d) with ``seen``, the frames in a row that the key has been seen, and ``score``."""
    frames = regions.select("key", "frame").distinct()
    run = frames.withColumn("_run", F.col("frame") - F.row_number().over(Window.partitionBy("key").orderBy("frame")))
    seen = run.select("key", "frame", F.row_number().over(Window.partitionBy("key", "_run").orderBy("frame")).alias("seen"))
    score = 0.7 * F.col("d") + 0.3 * F.col("d") * F.least(F.lit(1.0), F.col("seen") / full)
    return regions.join(seen, ["key", "frame"]).withColumn("score", score)


def image_similarity(pixels: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """PSNR (at most 100) and SSIM over one window, the whole image."""
    x, y = F.col(a), F.col(b)
    s = pixels.groupBy(*by).agg(F.avg((x - y) * (x - y)).alias("_mse"), F.avg(x).alias("_ma"), F.avg(y).alias("_mb"), F.var_pop(x).alias("_va"), F.var_pop(y).alias("_vb"), F.covar_pop(x, y).alias("_c"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = F.col("_ma"), F.col("_mb")
    psnr = F.when(F.col("_mse") < 1e-10, 100.0).otherwise(F.least(F.lit(100.0), 10 * F.log10(255.0 * 255.0 / F.col("_mse"))))
    ssim = (2 * ma * mb + c1) * (2 * F.col("_c") + c2) / ((ma * ma + mb * mb + c1) * (F.col("_va") + F.col("_vb") + c2))
    return s.select(*by, psnr.alias("psnr"), ssim.alias("ssim"))


def gradient_along(pixels: DataFrame, seam: Column) -> DataFrame:
    """(frame, seam_gradient): mean gradient length of pixels (frame, row, col, v) on a seam; one-sided at the borders."""

    def slope(*part: str, order: str) -> Column:
        w = Window.partitionBy("frame", *part).orderBy(order)
        before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    g = pixels.select("frame", seam.alias("_seam"), slope("row", order="col").alias("_x"), slope("col", order="row").alias("_y"))
    return g.filter("_seam").groupBy("frame").agg(F.avg(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).alias("seam_gradient"))


def _image(pdf: pd.DataFrame, rows: int, columns: int) -> np.ndarray:
    image = np.zeros((rows, columns))
    image[pdf["row"], pdf["col"]] = pdf["v"]
    return image


def stencil(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with borders reflected about the edge pixel."""
    r, c = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image, ((r, r), (c, c)), mode="reflect")
    views = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)
    return np.einsum("ijkl,kl->ij", views, kernel)


LAPLACIAN = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
MODIFIED = np.array([[-1.0, 2.0, -1.0]])
_ROW = np.array([1, 4, 6, 4, 1], float) / 16
GAUSSIAN = np.outer(_ROW, _ROW)


def sharpness(pixels: DataFrame, rows: int, columns: int) -> DataFrame:
    """(frame, laplacian_variance, tenengrad, modified_laplacian, compression_proxy) of frames of rows x columns pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = _image(pdf, rows, columns)
        gx, gy = stencil(image, SOBEL), stencil(image, SOBEL.T)
        modified = np.abs(stencil(image, MODIFIED)) + np.abs(stencil(image, MODIFIED.T))
        return pd.DataFrame([(pdf["frame"].iloc[0], stencil(image, LAPLACIAN).var(), (gx * gx + gy * gy).mean(), modified.mean(), (image - stencil(image, GAUSSIAN)).std())], columns=["frame", "laplacian_variance", "tenengrad", "modified_laplacian", "compression_proxy"])

    kind = dict(pixels.dtypes)["frame"]
    return pixels.groupBy("frame").applyInPandas(run, f"frame {kind}, laplacian_variance double, tenengrad double, modified_laplacian double, compression_proxy double")


def zncc(a: np.ndarray, b: np.ndarray) -> float:
    """Zero-mean normalised correlation of two images; flat images are alike if their means are near, else not at all."""
    x, y = a - a.mean(), b - b.mean()
    below = np.sqrt((x * x).sum() * (y * y).sum())
    if below < 1e-9:
        return 1.0 if abs(a.mean() - b.mean()) < 1.0 else 0.0
    return float((x * y).sum() / below)


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull, by a monotone chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return 0.0
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (p, p[::-1]):
        chain: list = []
        for q in order:
            while len(chain) > 1 and turn(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        chains += chain[:-1]
    h = np.array(chains)
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)


def hull_fraction(features: DataFrame, area: float) -> DataFrame:
    """(frame, hull_fraction) of features (frame, u, v). Of features with one v only the outermost can be corners."""
    ends = features.groupBy("frame", "v").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    kind = dict(features.dtypes)["frame"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate([pdf[["lo", "v"]].to_numpy(), pdf[["hi", "v"]].to_numpy()])
        return pd.DataFrame([(pdf["frame"].iloc[0], hull_area(points) / area)], columns=["frame", "hull_fraction"])

    return ends.select("frame", "lo", "hi", "v").groupBy("frame").applyInPandas(run, f"frame {kind}, hull_fraction double")
