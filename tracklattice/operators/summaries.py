"""Summaries: five-figure errors, distributions, histograms, weighted statistics, coverage, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_summary(df: DataFrame, error: Column, *by: str) -> DataFrame:
    """mae, rmse, median, p95, max, n of errors, by group.

    Errors must be finite and not below -1e-9 (then they count as 0); others raise, as a wrong error would pass for a good one.
    Percentiles interpolate linearly and are exact.
    """
    e = F.when(error.isNull() | F.isnan(error) | (F.abs(error) == float("inf")) | (error < -1e-9), F.raise_error(F.lit("an error must be finite and not negative"))).otherwise(F.greatest(error, F.lit(0.0)))
    rows = df.select(*by, e.cast("double").alias("_e"))
    return rows.groupBy(*by).agg(F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.median("_e").alias("median"), F.percentile("_e", 0.95).alias("p95"), F.max("_e").alias("max"), F.count("_e").alias("n"))


def luma_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Mean, median, deviation, percentiles, clipping, contrast and dynamic range of 0..255 values."""
    rows = df.select(*by, value.cast("double").alias("_v"))
    p = F.percentile("_v", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.99)]))
    out = rows.groupBy(*by).agg(F.avg("_v").alias("mean"), F.median("_v").alias("median"), F.stddev_pop("_v").alias("std"), p.alias("_p"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg((F.col("_v") <= 5).cast("double")).alias("dark_fraction"), F.avg((F.col("_v") >= 250).cast("double")).alias("bright_fraction"), F.count("_v").alias("n"))
    names = ["p1", "p5", "p10", "p25", "p75", "p90", "p95", "p99"]
    out = out.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")
    return out.withColumns({"contrast": F.col("p90") - F.col("p10"), "michelson": (F.col("p95") - F.col("p5")) / (F.col("p95") + F.col("p5") + 1e-6), "dynamic_range": F.col("p99") - F.col("p1")})


def quality_status(laplacian: Column, clipped: Column) -> Column:
    return F.when((laplacian < 10) | (clipped > 0.40), "SEVERELY_DEGRADED").when((laplacian < 30) | (clipped > 0.20), "DEGRADED").otherwise("GOOD")


def histogram(df: DataFrame, value: Column, bins: int, low: float, high: float, *by: str) -> DataFrame:
    """(by, bin, n, share): bins of equal width on [low, high]; the last is closed; values outside don't count."""
    width = (high - low) / bins
    rows = df.select(*by, value.alias("_v")).filter(F.col("_v").between(low, high))
    counts = rows.groupBy(*by, F.least(F.lit(bins - 1), F.floor((F.col("_v") - low) / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total")) if by else counts.agg(F.sum("n").alias("_total"))
    joined = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, "bin", "n", (F.col("n") / F.col("_total")).alias("share"))


def bhattacharyya(histograms: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(a, b, coefficient, distance) of the histograms that ``pairs`` (a, b) names; the distance is at most 10."""
    h = histograms.select(F.col(key).alias("_key"), "bin", "share")
    a = pairs.join(h, F.col("a") == F.col("_key")).select("a", "b", "bin", F.col("share").alias("p"))
    b = h.select(F.col("_key").alias("b"), "bin", F.col("share").alias("q"))
    sums = a.join(b, ["b", "bin"]).groupBy("a", "b").agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("c"))
    c = F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)))
    out = pairs.join(sums, ["a", "b"], "left").withColumn("coefficient", c)
    return out.select("a", "b", "coefficient", F.when(F.col("coefficient") > 4.5399929762484854e-05, -F.ln("coefficient")).otherwise(10.0).alias("distance"))


def weighted_median(df: DataFrame, value: str, weight: str, tie: str, *by: str) -> DataFrame:
    """First value whose running weight reaches half; without any positive weight the value at place n // 2.

    Rows of a group are first added up per value, so a group's window sees different values, not rows.
    """
    per = df.groupBy(*by, value).agg(F.sum(F.greatest(F.col(weight), F.lit(0.0))).alias("_w"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    rows = per.select(*by, value, F.sum("_w").over(w).alias("_run"), F.sum("_w").over(Window.partitionBy(*by)).alias("_all"), F.sum("_n").over(w).alias("_upto"), F.sum("_n").over(Window.partitionBy(*by)).alias("_count"))
    ok = F.when(F.col("_all") > 0, F.col("_run") >= F.col("_all") / 2).otherwise(F.col("_upto") > F.floor(F.col("_count") / 2))
    return rows.filter(ok).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def occupancy(df: DataFrame, row: Column, column: Column, rows: int, columns: int, *by: str) -> DataFrame:
    """(by, occupied, entropy): share of grid cells in use and normalised entropy of the counts."""
    total = rows * columns
    counts = df.groupBy(*by, row.alias("_r"), column.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    # Shannon entropy from sums alone: log n - (sum c log c) / n.
    sums = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"), F.sum("_n").alias("n"), F.sum(F.col("_n") * F.log2("_n")).alias("_x"))
    entropy = (F.log2("n") - F.col("_x") / F.col("n")) / F.log2(F.lit(float(total)))
    return sums.select(*by, "n", (F.col("_cells") / total).alias("occupied"), entropy.alias("entropy"))


def spearman(df: DataFrame, x: str, y: str, tie: str, *by: str) -> DataFrame:
    """Rank correlation with ranks by order (ties by ``tie``, not averaged) and a two-sided normal p."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)).cast("double")
    ranked = df.select(*by, rank(x).alias("_rx"), rank(y).alias("_ry"))
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def quantile_medians(df: DataFrame, by_value: str, error: str, tie: str, parts: int, *by: str) -> DataFrame:
    """(by, part, median_value, median_error): groups of equal size by ``by_value``, larger ones first."""
    w = Window.partitionBy(*by).orderBy(by_value, tie)
    rows = df.select(*by, by_value, error, F.ntile(parts).over(w).alias("part"))
    return rows.groupBy(*by, "part").agg(F.median(by_value).alias("median_value"), F.median(error).alias("median_error"), F.count(F.lit(1)).alias("n"))


def sigma_coverage(df: DataFrame, error: Column, sigma: Column, *by: str) -> DataFrame:
    """Share of errors within 1, 2 and 3 sigma, and whether the first two are near the normal ones."""
    shares = [F.avg((error <= k * sigma).cast("double")).alias(f"within{k}") for k in (1, 2, 3)]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *shares)
    return out.withColumn("supported", (F.abs(F.col("within1") - 0.6827) < 0.15) & (F.abs(F.col("within2") - 0.9545) < 0.10))


def zero_filled(counts: DataFrame, reasons: tuple[str, ...], reason: str = "reason", *by: str) -> DataFrame:
    """Counts (by, reason, n) with a row for each reason of each group that occurs."""
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    every = groups.withColumn(reason, F.explode(F.array(*[F.lit(r) for r in reasons])))
    return every.join(counts, [*by, reason], "left").select(*by, reason, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def relative_pose_error(df: DataFrame, key: str, order: tuple[str, ...], step: int, axes: tuple[str, ...], other: tuple[str, ...]) -> DataFrame:
    """(key, drift): error of the displacement over ``step`` rows between two trajectories."""
    w = Window.partitionBy(key).orderBy(*order)
    moved = [(F.lead(a, step).over(w) - F.col(a)) - (F.lead(b, step).over(w) - F.col(b)) for a, b in zip(axes, other, strict=True)]
    return df.select(key, *order, F.sqrt(sum((m * m for m in moved[1:]), moved[0] * moved[0])).alias("drift")).filter("drift is not null")


def tile_edges(size: int, parts: int) -> list[int]:
    """Integer edges of ``parts`` tiles over ``size`` pixels, as an even division cut down."""
    return [int(size * i / parts) for i in range(parts + 1)]


def tile_of(pixel: Column, size: int, parts: int) -> Column:
    """Number of the tile that a pixel lies in."""
    edges = tile_edges(size, parts)[1:-1]
    out = F.lit(0)
    for e in edges:
        out = out + (pixel >= e).cast("int")
    return out
