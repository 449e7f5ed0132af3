"""Rasters as pixel rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilinear(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """(id, value) of points (id, frame, u, v) in pixels (frame, row, col, v): four neighbours joined; null unless all four exist."""
    u0, v0 = F.floor("u"), F.floor("v")
    corner = lambda i, j: F.struct((v0 + j).cast("int").alias("row"), (u0 + i).cast("int").alias("col"), ((1 - F.abs(F.col("u") - u0 - i)) * (1 - F.abs(F.col("v") - v0 - j))).alias("w"))
    four = points.select("id", "frame", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("id", "frame", "c.*")
    met = four.join(pixels, ["frame", "row", "col"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("value"), F.count(F.lit(1)).alias("n")).filter("n = 4")
    return points.select("id").join(met.select("id", "value"), "id", "left")


def synthetic_frames(frames: DataFrame, width: int, height: int, band: int = 8) -> DataFrame:
    """(video_id, frame_index, width, height, channels, data): four quadrants of fixed colours and a band at (20 i) mod 255."""

    def run(batches):
        for pdf in batches:
            out = []
            for video, i in zip(pdf["video_id"], pdf["frame_index"], strict=True):
                image = np.zeros((height, width, 3), np.uint8)
                for q, colour in enumerate(((200, 40, 40), (40, 200, 40), (40, 40, 200), (200, 200, 40))):
                    image[(q // 2) * height // 2 : (q // 2 + 1) * height // 2, (q % 2) * width // 2 : (q % 2 + 1) * width // 2] = colour
                image[height // 2 - band // 2 : height // 2 + band // 2] = (20 * int(i)) % 255
                out.append((video, i, width, height, 3, image.tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "frame_index", "width", "height", "channels", "data"])

    kind = dict(frames.dtypes)["video_id"]
    return frames.select("video_id", "frame_index").mapInPandas(run, f"video_id {kind}, frame_index long, width int, height int, channels int, data binary")


def rows_of(images: DataFrame) -> DataFrame:
    """Decoded frames (video_id, frame_index, width, height, channels, data) as pixel rows (.., row, col, channel, v)."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int")))
    flat = images.select("video_id", "frame_index", "width", "channels", at.alias("i", "v"))
    return flat.select("video_id", "frame_index", F.floor(F.col("i") / (F.col("width") * F.col("channels"))).alias("row"), F.floor(F.col("i") / F.col("channels") % F.col("width")).alias("col"), (F.col("i") % F.col("channels")).alias("channel"), "v")


# Perturbations for robustness studies. What is random is a hash of the row, so every run and partitioning agrees.


def _normal(seed: int, *keys: str):
    """A standard normal number of a row, by Box and Muller from two hashes."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))


def gnss_noise(rows: DataFrame, sigma: float, axes: tuple[str, ...], *keys: str, seed: int = 42) -> DataFrame:
    return rows.withColumns({a: F.col(a) + sigma * _normal(seed + i, *keys) for i, a in enumerate(axes)})


def outliers(rows: DataFrame, share: float, size: float, axis: str, *keys: str, seed: int = 42) -> DataFrame:
    hit = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < share * 1_000_000
    return rows.withColumn(axis, F.col(axis) + F.when(hit, size).otherwise(0.0)).withColumn("is_outlier", hit)


def dropout(rows: DataFrame, t: str, start: float, end: float) -> DataFrame:
    return rows.filter(~F.col(t).between(start, end))


def clock_bias(rows: DataFrame, t: str, bias: float) -> DataFrame:
    return rows.withColumn(t, F.col(t) + bias)


def focal_error(rows: DataFrame, share: float, *focals: str) -> DataFrame:
    return rows.withColumns({f: F.col(f) * (1 + share) for f in focals})


def frame_dropping(rows: DataFrame, index: str, every: int) -> DataFrame:
    """Every ``every``-th frame is lost."""
    return rows.filter(F.col(index) % every != every - 1)


def collinear_path(rows: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """A path flattened to its first axis."""
    return rows.withColumns({a: F.lit(0.0) for a in axes[1:]})


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur with reflected borders."""
    from tracklattice.operators.imaging import stencil

    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return stencil(stencil(image, (k / k.sum())[None, :]), (k / k.sum())[:, None])


def motion_blur(image: np.ndarray, length: int) -> np.ndarray:
    """Horizontal motion blur over ``length`` pixels."""
    from tracklattice.operators.imaging import stencil

    n = length | 1
    return stencil(image, np.full((1, n), 1 / n))
