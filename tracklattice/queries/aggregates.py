"""Aggregations (section F): summaries, histograms, voxels, weighted and robust statistics, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.functions import camera, rotation
from tracklattice.operators import fusion, imaging, mesh, metrology, summaries
from tracklattice.queries.registry import CLOUD, EVENTS, cloud, events, query, rounded, table


@query("SELECT l_returnflag, round(avg(l_discount), 6) AS mae, round(sqrt(avg(l_discount * l_discount)), 6) AS rmse, round(median(l_discount), 6) AS median, round(quantile_cont(l_discount, 0.95), 6) AS p95, round(max(l_discount), 6) AS max, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def error_summary_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """five-figure error summary."""
    out = summaries.error_summary(table(spark, sf_dir, "lineitem"), F.col("l_discount"), "l_returnflag")
    return rounded(out, 6, "mae", "rmse", "median", "p95", "max")


_LUMA = "SELECT event_type, least(255, value * 0.5171) AS v FROM events"


@query(f"""
SELECT event_type, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.05), 4) AS p5, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.95), 4) AS p95, round(avg((v <= 5)::INT), 6) AS dark_fraction, round(avg((v >= 250)::INT), 6) AS bright_fraction,
  round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 4) AS contrast, round((quantile_cont(v, 0.95) - quantile_cont(v, 0.05)) / (quantile_cont(v, 0.95) + quantile_cont(v, 0.05) + 1e-6), 6) AS michelson, round(quantile_cont(v, 0.99) - quantile_cont(v, 0.01), 4) AS dynamic_range FROM ({_LUMA}) GROUP BY event_type
""")
def luma_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distribution, clipping, contrast and dynamic range."""
    out = summaries.luma_summary(table(spark, sf_dir, "events"), F.least(F.lit(255.0), F.col("value") * 0.5171), "event_type")
    out = out.select("event_type", "mean", "median", "std", "p5", "p25", "p95", "dark_fraction", "bright_fraction", "contrast", "michelson", "dynamic_range")
    return rounded(rounded(out, 4, "mean", "median", "std", "p5", "p25", "p95", "contrast", "dynamic_range"), 6, "dark_fraction", "bright_fraction", "michelson")


_PIXELS = "SELECT frame, row, col, ((row * 7 + col * 13 + frame * 29) % 256)::DOUBLE AS v FROM (SELECT n_nationkey AS frame FROM nation), range(48) r(row), range(64) c(col)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 48 x 64 raster a nation, by rule."""
    frames = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame"))
    at = frames.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return at.withColumn("v", ((F.col("row") * 7 + F.col("col") * 13 + F.col("frame") * 29) % 256).cast("double"))


@query(f"SELECT frame, ((row >= 16)::INT + (row >= 32)::INT)::INT AS tile_row, ((col >= 21)::INT + (col >= 42)::INT)::INT AS tile_column, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std FROM ({_PIXELS}) GROUP BY ALL")
def tile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 tiles with integer edges."""
    p = _pixels(spark, sf_dir)
    out = p.groupBy("frame", summaries.tile_of(F.col("row"), 48, 3).cast("int").alias("tile_row"), summaries.tile_of(F.col("col"), 64, 3).cast("int").alias("tile_column")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return rounded(out, 4, "mean", "std")


@query(f"""
WITH p AS ({_PIXELS}), t AS (SELECT frame, (row >= 16)::INT + (row >= 32)::INT AS r, (col >= 21)::INT + (col >= 42)::INT AS c, avg(v + 20 * ((col >= 21)::INT + (col >= 42)::INT)) AS m FROM p GROUP BY ALL),
g AS (SELECT frame, stddev_pop(m) AS s, median(m) AS med, max(m) AS hi, min(m) AS lo, avg(m) FILTER (c = 0) AS c0, avg(m) FILTER (c = 1) AS c1, avg(m) FILTER (c = 2) AS c2, avg(m) FILTER (r = 0) AS r0, avg(m) FILTER (r = 1) AS r1, avg(m) FILTER (r = 2) AS r2 FROM t GROUP BY frame)
SELECT frame, CASE WHEN s < 12 THEN 'UNIFORM' WHEN ((c1 - c0 > 1 AND c2 - c1 > 1) OR (c1 - c0 < -1 AND c2 - c1 < -1)) AND abs(c2 - c0) > 25 OR ((r1 - r0 > 1 AND r2 - r1 > 1) OR (r1 - r0 < -1 AND r2 - r1 < -1)) AND abs(r2 - r0) > 25 THEN 'GRADIENT'
  WHEN hi > 1.5 * greatest(med, 10) AND NOT lo < greatest(med, 10) / 1.5 THEN 'LOCALIZED_BRIGHTNESS' WHEN lo < greatest(med, 10) / 1.5 AND NOT hi > 1.5 * greatest(med, 10) THEN 'LOCALIZED_DARKNESS' ELSE 'MIXED' END AS pattern, round(s, 4) AS nonuniformity FROM g
""")
def illumination_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniform, gradient or local illumination from tile means."""
    p = _pixels(spark, sf_dir)
    r, c = summaries.tile_of(F.col("row"), 48, 3), summaries.tile_of(F.col("col"), 64, 3)
    tiles = p.groupBy("frame", r.alias("r"), c.alias("c")).agg(F.avg(F.col("v") + 20 * c).alias("m"))
    return rounded(imaging.illumination(tiles, 3, 12.0, 25.0, 1.5), 4, "nonuniformity")


_LIT = f"SELECT frame, row, col, least(255.0, v * (0.3 + frame % 4 * 0.2) + CASE WHEN frame % 5 = 0 AND row >= 16 AND row < 32 AND col < 21 THEN 200 ELSE 0 END) AS v FROM ({_PIXELS})"


@query(f"""
WITH p AS ({_LIT}), m AS (SELECT frame, avg(v) AS m FROM p GROUP BY frame), h AS (SELECT frame, least(63, floor(v / (255.0 / 64)))::INT AS bin, count(*) / 3072.0 AS share FROM p GROUP BY ALL),
t AS (SELECT frame, (row >= 16)::INT + (row >= 32)::INT AS r, (col >= 21)::INT + (col >= 42)::INT AS c, avg(v) AS m FROM p GROUP BY ALL),
g AS (SELECT frame, stddev_pop(m) AS s, median(m) AS med, max(m) AS hi, min(m) AS lo, avg(m) FILTER (c = 0) AS c0, avg(m) FILTER (c = 1) AS c1, avg(m) FILTER (c = 2) AS c2, avg(m) FILTER (r = 0) AS r0, avg(m) FILTER (r = 1) AS r1, avg(m) FILTER (r = 2) AS r2 FROM t GROUP BY frame),
i AS (SELECT frame, CASE WHEN s < 12 THEN 'UNIFORM' WHEN ((c1 - c0 > 1 AND c2 - c1 > 1) OR (c1 - c0 < -1 AND c2 - c1 < -1)) AND abs(c2 - c0) > 25 OR ((r1 - r0 > 1 AND r2 - r1 > 1) OR (r1 - r0 < -1 AND r2 - r1 < -1)) AND abs(r2 - r0) > 25 THEN 'GRADIENT'
  WHEN hi > 1.5 * greatest(med, 10) AND NOT lo < greatest(med, 10) / 1.5 THEN 'LOCALIZED_BRIGHTNESS' WHEN lo < greatest(med, 10) / 1.5 AND NOT hi > 1.5 * greatest(med, 10) THEN 'LOCALIZED_DARKNESS' ELSE 'MIXED' END AS pattern FROM g),
c AS (SELECT b.frame, coalesce(sum(sqrt(a.share * b.share)), 0) AS bc FROM h b JOIN h a ON a.frame = b.frame - 1 AND a.bin = b.bin GROUP BY b.frame),
d AS (SELECT m.frame, m.m - n.m AS change, pattern LIKE 'LOCALIZED%' AS localized, CASE WHEN least(1, coalesce(bc, 0)) > 4.5399929762484854e-05 THEN -ln(least(1, bc)) ELSE 10 END AS distance FROM m JOIN m n ON n.frame = m.frame - 1 JOIN i ON i.frame = m.frame LEFT JOIN c ON c.frame = m.frame)
SELECT frame, round(change, 4) AS mean_change, round(distance, 4) AS distance, CASE WHEN distance < 0.15 AND abs(change) < 5 THEN 'STABLE' WHEN abs(change) >= 15 OR distance >= 0.15 THEN CASE WHEN localized THEN 'POTENTIAL_LOCAL_ILLUMINATION_CHANGE' ELSE 'POTENTIAL_EXPOSURE_TRANSITION' END ELSE 'MIXED_CHANGE' END AS category FROM d
""")
def photometric_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: change of luminance to the frame before, by the means, the histograms' distance and where the light falls."""
    p = _pixels(spark, sf_dir)
    spot = F.when((F.col("frame") % 5 == 0) & F.col("row").between(16, 31) & (F.col("col") < 21), 200).otherwise(0)
    p = p.withColumn("v", F.least(F.lit(255.0), F.col("v") * (0.3 + F.col("frame") % 4 * 0.2) + spot))
    return rounded(imaging.temporal_change(p, 48, 64).select("frame", "mean_change", "distance", "category"), 4, "mean_change", "distance")


@query("SELECT n_nationkey, CASE WHEN lap < 10 OR clip > 0.4 THEN 'SEVERELY_DEGRADED' WHEN lap < 30 OR clip > 0.2 THEN 'DEGRADED' ELSE 'GOOD' END AS status FROM (SELECT n_nationkey, (n_nationkey * 3 % 50)::DOUBLE AS lap, n_nationkey / 40 AS clip FROM nation)")
def quality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: quality status from sharpness and clipping."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", summaries.quality_status((k * 3 % 50).cast("double"), k / 40).alias("status"))


@query(f"""
WITH p AS ({_PIXELS}), s AS (SELECT frame, col, row, v, (255 - v) AS g, abs(v - 128) AS b FROM p)
SELECT frame, round(stddev_pop(x), 4) AS spread, round(avg(0.299 * v + 0.587 * g + 0.114 * b), 4) AS luminance FROM (SELECT frame, v, g, b, unnest([v - g, g - b, b - v]) AS x FROM s) GROUP BY frame
""")
def chromatic_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of channel differences and BT.601 luminance."""
    from tracklattice.functions.robust import luminance

    s = _pixels(spark, sf_dir).select("frame", "v", (255 - F.col("v")).alias("g"), F.abs(F.col("v") - 128).alias("b"))
    s = s.withColumn("x", F.explode(F.array(F.col("v") - F.col("g"), F.col("g") - F.col("b"), F.col("b") - F.col("v"))))
    return rounded(s.groupBy("frame").agg(F.stddev_pop("x").alias("spread"), F.avg(luminance(F.col("v"), F.col("g"), F.col("b"))).alias("luminance")), 4, "spread", "luminance")


@query("""
WITH b AS (SELECT l_returnflag AS flag, least(63, floor(l_extendedprice % 256 / 255 * 64))::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice % 256 <= 255 GROUP BY ALL), h AS (SELECT flag, bin, n / sum(n) OVER (PARTITION BY flag) AS share FROM b),
p AS (SELECT x.flag AS a, y.flag AS b FROM (SELECT DISTINCT flag FROM h) x JOIN (SELECT DISTINCT flag FROM h) y ON x.flag < y.flag)
SELECT p.a, p.b, round(sum(sqrt(u.share * v.share)), 6) AS coefficient, round(-ln(sum(sqrt(u.share * v.share))), 6) AS distance FROM p JOIN h u ON u.flag = p.a JOIN h v ON v.flag = p.b AND v.bin = u.bin GROUP BY p.a, p.b
""")
def histogram_bhattacharyya(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bin histograms by flag and the distances between them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") % 256).alias("v"))
    h = summaries.histogram(li, F.col("v"), 64, 0.0, 255.0, "flag")
    flags = h.select("flag").distinct()
    pairs = flags.select(F.col("flag").alias("a")).join(flags.select(F.col("flag").alias("b")), F.col("a") < F.col("b"))
    return rounded(summaries.bhattacharyya(h, "flag", pairs), 6, "coefficient", "distance")


@query(f"""
WITH e AS (SELECT user_id, value - lag(value) OVER w AS dx, t - lag(t) OVER w AS dy FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), f AS (SELECT user_id, dx AS u, dy / 3600 AS v FROM e WHERE dx IS NOT NULL), m AS (SELECT *, sqrt(u * u + v * v) AS mag FROM f)
SELECT user_id, round(median(mag), 4) AS median_displacement, round(avg(mag), 4) AS mean_displacement, round(sqrt(avg(CASE WHEN mag > 0.1 THEN u / mag END) ** 2 + avg(CASE WHEN mag > 0.1 THEN v / mag END) ** 2), 5) AS coherence FROM m GROUP BY user_id
""")
def flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """displacement statistics and directional coherence of flow rows."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = events(spark, sf_dir).select("user_id", (F.col("value") - F.lag("value").over(w)).alias("u"), ((F.col("t") - F.lag("t").over(w)) / 3600).alias("v")).filter("u is not null")
    return rounded(rounded(imaging.flow_summary(f, "user_id"), 4, "median_displacement", "mean_displacement"), 5, "coherence")


@query("SELECT event_id, CASE WHEN value > 250 AND user_id % 2 = 0 THEN 'POTENTIAL_LOCAL_MOTION' WHEN value < 50 THEN CASE WHEN user_id % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'LOW_APPARENT_MOTION' END WHEN user_id % 2 = 1 AND NOT value > 250 THEN 'POTENTIAL_CAMERA_MOTION' ELSE 'MIXED_MOTION' END AS category, round(least(1, value / 100) * (user_id % 10) / 10, 6) AS blur FROM events")
def motion_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """motion ladder and blur index."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    local, coherent = F.col("value") > 250, u % 2 == 1
    return rounded(e.select("event_id", imaging.motion_category(local, coherent, F.col("value") < 50, u % 3 == 0).alias("category"), imaging.blur_index(F.col("value"), (u % 10) / 10).alias("blur")), 6, "blur")


@query(f"""
WITH r AS (SELECT label AS frame, id, floor((x + 1) * 10)::INT * 100 + floor((y + 1) * 10)::INT AS key, abs(z) AS d FROM ({CLOUD})), f AS (SELECT DISTINCT key, frame FROM r),
g AS (SELECT key, frame, frame - row_number() OVER (PARTITION BY key ORDER BY frame) AS run FROM f), n AS (SELECT key, frame, row_number() OVER (PARTITION BY key, run ORDER BY frame) AS seen FROM g)
SELECT id, seen::INT AS seen, round(0.7 * d + 0.3 * d * least(1, seen / 3), 6) AS score FROM r JOIN n USING (key, frame)
""")
def dynamic_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence weighted by how many frames in a row a region's cell has been seen."""
    r = cloud(spark, sf_dir).select(F.col("label").alias("frame"), "id", (F.floor((F.col("x") + 1) * 10) * 100 + F.floor((F.col("y") + 1) * 10)).cast("int").alias("key"), F.abs("z").alias("d"))
    return rounded(imaging.persistence(r, 3).select("id", "seen", "score"), 6, "score")


@query(f"SELECT label AS frame, round(greatest(0, 1 - sum((20 + abs(z) * 60) * (15 + abs(z) * 40)) / 90000), 6) AS static_fraction FROM ({CLOUD}) GROUP BY label")
def static_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what regions leave of a frame; overlaps count twice, as in the definition, and the result is held at 0."""
    z = F.abs("z")
    return cloud(spark, sf_dir).groupBy(F.col("label").alias("frame")).agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum((20 + z * 60) * (15 + z * 40)) / 90000), 6).alias("static_fraction"))


@query(f"""
WITH k AS (SELECT label AS frame, floor((x + 1) * 4)::INT AS r, floor((y + 1) * 4)::INT AS c FROM ({CLOUD})), n AS (SELECT frame, r, c, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT frame, sum(n)::BIGINT AS n, count(*) AS cells, sum(n * log2(n)) AS x FROM n GROUP BY frame)
SELECT frame, n, round(cells / 64, 6) AS occupied, round((log2(n) - x / n) / log2(64), 6) AS entropy FROM s
""")
def grid_occupancy_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occupied share of an 8 x 8 grid and entropy of its counts."""
    out = summaries.occupancy(cloud(spark, sf_dir).withColumnRenamed("label", "frame"), F.floor((F.col("x") + 1) * 4), F.floor((F.col("y") + 1) * 4), 8, 8, "frame")
    return rounded(out, 6, "occupied", "entropy")


@query(f"SELECT label AS frame, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(avg((abs(x) > 0.2 OR abs(y) > 0.2)::INT), 6) AS edge_fraction FROM ({CLOUD}) GROUP BY label")
def feature_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bounding box and share of features near the border."""
    c = cloud(spark, sf_dir).groupBy(F.col("label").alias("frame")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg(((F.abs("x") > 0.2) | (F.abs("y") > 0.2)).cast("int")).alias("edge_fraction"))
    return rounded(c, 6, "x0", "x1", "y0", "y1", "edge_fraction")


@query(f"""
WITH c AS (SELECT DISTINCT label AS frame, x, y FROM ({CLOUD})),
e AS (SELECT a.frame, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN c b ON a.frame = b.frame AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.frame = a.frame AND (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0))
SELECT frame, round(sum(ax * b_y - bx * ay) / 2 / 4.0, 6) AS hull_fraction FROM e GROUP BY frame
""")
def hull_area_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area of the convex hull of a frame's features."""
    c = cloud(spark, sf_dir).select(F.col("label").alias("frame"), F.col("x").alias("u"), F.col("y").alias("v"))
    return rounded(imaging.hull_fraction(c, 4.0), 6, "hull_fraction")


_OBS = f"SELECT id, 'f' || label AS frame, x, y, z, least(1, abs(x) * 4 + 0.3) AS confidence FROM ({CLOUD})"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cloud(spark, sf_dir)
    return c.select("id", F.concat(F.lit("f"), F.col("label").cast("string")).alias("frame"), "x", "y", "z", F.least(F.lit(1.0), F.abs("x") * 4 + 0.3).alias("confidence"))


@query(f"""
WITH o AS (SELECT *, floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, floor(z / 0.1)::BIGINT AS k FROM ({_OBS}) WHERE confidence >= 0.5)
SELECT i, j, k, round(sum(confidence * x) / sum(confidence), 6) AS x, round(sum(confidence * y) / sum(confidence), 6) AS y, round(sum(confidence * z) / sum(confidence), 6) AS z, round(avg(confidence), 6) AS confidence, count(DISTINCT frame) AS views, count(*) AS n, string_agg(DISTINCT frame, ',' ORDER BY frame) AS frames FROM o GROUP BY i, j, k HAVING count(DISTINCT frame) >= 2
""")
def voxel_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """confidence-weighted points of voxels that two frames see."""
    out = fusion.voxel_fusion(_observations(spark, sf_dir), 0.1, 0.5, 2)
    return rounded(out.withColumn("frames", F.array_join("frames", ",")), 6, "x", "y", "z", "confidence")


@query()
def cluster_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greedy clusters in canonical order, reduced to weighted points."""
    o = _observations(spark, sf_dir).select("*", F.lit(0.0).alias("u"), F.col("id").cast("double").alias("v"), F.lit(1).alias("support"))
    out = fusion.cluster_fusion(o, fusion.ClusterConfig(threshold=0.03, diameter=0.06, voxel=0.03))
    return rounded(out, 6, "x", "y", "z", "confidence", "spread")


@query(f"""
WITH o AS (SELECT id, CASE WHEN x <> x THEN 'NON_FINITE_COORDINATES' WHEN confidence <> confidence THEN 'NON_FINITE_CONFIDENCE' WHEN confidence < 0 OR confidence > 1 THEN 'OUT_OF_BOUNDS_CONFIDENCE' WHEN confidence < 0.4 THEN 'LOW_CONFIDENCE' WHEN abs(z) > 0.2 THEN 'DYNAMIC_RISK_EXCEEDED' ELSE 'ACCEPTED' END AS reason FROM ({_OBS}))
SELECT r.reason, count(o.id) AS n FROM (VALUES ('NON_FINITE_COORDINATES'), ('NON_FINITE_CONFIDENCE'), ('OUT_OF_BOUNDS_CONFIDENCE'), ('LOW_CONFIDENCE'), ('DYNAMIC_RISK_EXCEEDED'), ('ACCEPTED')) r(reason) LEFT JOIN o ON o.reason = r.reason GROUP BY r.reason
""")
def reject_histogram_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching reject reason, counted with zeros."""
    o = _observations(spark, sf_dir).withColumn("dynamic_risk", F.abs("z"))
    counts = o.groupBy(F.coalesce(fusion.reject_reason(0.4, 0.2), F.lit("ACCEPTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return summaries.zero_filled(counts, (*fusion.REASONS, "ACCEPTED"))


@query("""
WITH w AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS run, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
SELECT l_returnflag, min(v) AS weighted_median FROM w WHERE run >= total / 2 GROUP BY l_returnflag
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """price at half the quantity, by flag."""
    return summaries.weighted_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_orderkey", "l_returnflag")


def _tukey_round(k: int) -> str:
    """One round of the estimate in SQL; a texel that has settled (``done``) keeps its row."""
    return f"""d{k} AS (SELECT c.*, s.ar, s.ag, s.ab, s.done, s.inliers AS was, s.share AS held, sqrt((r - ar) ** 2 + (g - ag) ** 2 + (b - ab) ** 2) AS d FROM c JOIN s{k - 1} s USING (texel)),
u{k} AS (SELECT *, d / (4.685 * greatest(1.4826 * median(d) OVER (PARTITION BY texel), 1)) AS u FROM d{k}), w{k} AS (SELECT *, CASE WHEN u <= 1 THEN (1 - u * u) ** 2 ELSE 0 END * weight AS w FROM u{k}),
a{k} AS (SELECT texel, any_value(ar) AS ar, any_value(ag) AS ag, any_value(ab) AS ab, any_value(done) AS done, any_value(was) AS was, any_value(held) AS held, sum(w) AS total, sum(r * w) AS sr, sum(g * w) AS sg, sum(b * w) AS sb, count(*) FILTER (w > 0) AS inliers, coalesce(sum(weight) FILTER (w > 0), 0) / sum(weight) AS share FROM w{k} GROUP BY texel),
s{k} AS (SELECT texel, CASE WHEN done OR total <= 0 THEN ar ELSE sr / total END AS ar, CASE WHEN done OR total <= 0 THEN ag ELSE sg / total END AS ag, CASE WHEN done OR total <= 0 THEN ab ELSE sb / total END AS ab, CASE WHEN done THEN was ELSE inliers END AS inliers, CASE WHEN done THEN held ELSE share END AS share, done OR total <= 0 OR greatest(abs(sr / total - ar), abs(sg / total - ag), abs(sb / total - ab)) < 1e-6 AS done FROM a{k})"""


@query(f"""
WITH c AS (SELECT l_orderkey AS texel, l_linenumber AS candidate, l_extendedprice % 256 AS r, l_quantity * 5 AS g, l_tax * 1000 % 256 AS b, l_discount + 0.01 AS weight FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY texel ORDER BY 0.2126 * r + 0.7152 * g + 0.0722 * b, candidate, r, g, b, weight) AS i FROM c), m AS (SELECT *, sum(weight) OVER (PARTITION BY texel ORDER BY i) AS run, sum(weight) OVER (PARTITION BY texel) AS total FROM l),
s0 AS (SELECT texel, arg_min(r, i) AS ar, arg_min(g, i) AS ag, arg_min(b, i) AS ab, count(*) AS inliers, 1.0 AS share, false AS done FROM m WHERE run >= total / 2 GROUP BY texel),
{", ".join(_tukey_round(k) for k in range(1, 6))}
SELECT texel, round(ar, 4) AS r, round(ag, 4) AS g, round(ab, 4) AS b, n::INT AS n, inliers::INT AS inliers, CASE WHEN n = 1 THEN 'SINGLE_VIEW' WHEN share < 0.5 - 1e-9 THEN 'CONFLICTING' ELSE 'FUSED' END AS state FROM s5 JOIN (SELECT texel, count(*) AS n FROM c GROUP BY texel) USING (texel)
""")
def tukey_colour_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust colour of each texel's candidates."""
    k = F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("texel"), k.alias("candidate"), (F.col("l_extendedprice") % 256).alias("r"), (F.col("l_quantity") * 5).alias("g"), (F.col("l_tax") * 1000 % 256).alias("b"), (F.col("l_discount") + 0.01).alias("weight"))
    return rounded(fusion.tukey_colours(c), 4, "r", "g", "b")


@query(f"""
WITH c AS ({CLOUD}), p AS (SELECT * FROM c WHERE label < 5), q AS (SELECT * FROM c WHERE label >= 5), m AS (SELECT p.id, q.id AS qid, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, q.x AS nx, q.y AS ny, q.z AS nz, p.x AS mx, p.y AS my, p.z AS mz FROM p, q),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sqrt(dx * dx + dy * dy + dz * dz), qid) AS rn FROM m), e AS (SELECT abs(dx * nx + dy * ny + dz * nz) / sqrt(nx * nx + ny * ny + nz * nz) AS plane, degrees(acos(least(1, abs(nx * mx + ny * my + nz * mz) / sqrt((nx * nx + ny * ny + nz * nz) * (mx * mx + my * my + mz * mz))))) AS angle FROM b WHERE rn = 1)
SELECT round(avg(plane), 6) AS plane_mae, round(sqrt(avg(plane * plane)), 6) AS plane_rmse, round(median(angle), 4) AS angle_median, round(max(angle), 4) AS angle_max, count(*) AS n FROM e
""")
def plane_and_normal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point-to-plane distance and unsigned normal deviation at nearest neighbours (points taken as normals)."""
    from tracklattice.operators.neighbours import nearest

    c = cloud(spark, sf_dir)
    p, q = c.filter("label < 5"), c.filter("label >= 5")
    j = nearest(p, q, 0.05).join(p.select("id", F.array("x", "y", "z").alias("m")), "id").join(q.select(F.col("id").alias("reference_id"), F.array("x", "y", "z").alias("n")), "reference_id")
    nn, mm = rotation.dot(F.col("n"), F.col("n"), 3), rotation.dot(F.col("m"), F.col("m"), 3)
    plane = F.abs(rotation.dot(rotation.subtract(F.col("m"), F.col("n")), F.col("n"), 3)) / F.sqrt(nn)
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(rotation.dot(F.col("m"), F.col("n"), 3)) / F.sqrt(nn * mm))))
    out = j.select(plane.alias("plane"), angle.alias("angle")).agg(F.avg("plane").alias("plane_mae"), F.sqrt(F.avg(F.col("plane") * F.col("plane"))).alias("plane_rmse"), F.median("angle").alias("angle_median"), F.max("angle").alias("angle_max"), F.count(F.lit(1)).alias("n"))
    return rounded(rounded(out, 6, "plane_mae", "plane_rmse"), 4, "angle_median", "angle_max")


@query(f"""
WITH c AS (SELECT * FROM ({CLOUD}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2), q AS (SELECT * FROM c WHERE label >= 5), p AS (SELECT * FROM c WHERE label < 5),
d AS (SELECT q.id, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS d FROM q LEFT JOIN p ON true GROUP BY q.id)
SELECT count(*) AS n_reference, count(*) FILTER (d <= 0.08) AS n_complete, round(avg((coalesce(d, 9) <= 0.08)::INT), 6) AS completeness FROM d
""")
def roi_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness inside a box; the box is plain comparisons, so it is pushed down where the source can."""
    c = cloud(spark, sf_dir).filter(metrology.in_box((-0.1, -0.2, -0.2), (0.1, 0.2, 0.2)))
    return rounded(metrology.completeness(c.filter("label < 5"), c.filter("label >= 5"), 0.08), 6, "completeness")


_TRACK = "SELECT user_id, event_id, t, value AS x, value * 0.9 + event_id % 7 AS ex, (event_id % 50)::DOUBLE AS y, event_id % 50 + event_id % 3 * 0.1 AS ey FROM (" + EVENTS + ")"


@query(f"""
WITH e AS (SELECT user_id, sqrt(((lead(x, 3) OVER w - x) - (lead(ex, 3) OVER w - ex)) ** 2 + ((lead(y, 3) OVER w - y) - (lead(ey, 3) OVER w - ey)) ** 2) AS drift FROM ({_TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(drift) AS n, round(avg(drift), 5) AS mae, round(sqrt(avg(drift * drift)), 5) AS rmse, round(max(drift), 5) AS max FROM e WHERE drift IS NOT NULL GROUP BY user_id
""")
def rpe_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relative pose error over three steps, by user."""
    i = F.col("event_id")
    e = events(spark, sf_dir).select("user_id", "event_id", "t", F.col("value").alias("x"), (F.col("value") * 0.9 + i % 7).alias("ex"), (i % 50).cast("double").alias("y"), (i % 50 + i % 3 * 0.1).alias("ey"))
    d = summaries.relative_pose_error(e, "user_id", ("t", "event_id"), 3, ("x", "y"), ("ex", "ey"))
    return rounded(summaries.error_summary(d, F.col("drift"), "user_id").select("user_id", "n", "mae", "rmse", "max"), 5, "mae", "rmse", "max")


@query(f"SELECT user_id, count(*) AS n, round(sqrt(avg((x - ex) ** 2 + (y - ey) ** 2)), 5) AS ate_rmse, round(avg(sqrt((x - ex) ** 2 + (y - ey) ** 2)), 5) AS ate_mean FROM ({_TRACK}) GROUP BY user_id")
def ate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """absolute trajectory error without alignment."""
    i = F.col("event_id")
    dx, dy = F.col("value") - (F.col("value") * 0.9 + i % 7), (i % 50) - (i % 50 + i % 3 * 0.1)
    e = table(spark, sf_dir, "events").select("user_id", F.sqrt(dx * dx + dy * dy).alias("e"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("ate_rmse"), F.round(F.avg("e"), 5).alias("ate_mean"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and their images under a known similarity with noise by rule: s 4.25, a turn about z, a shift."""
    import math

    c, s = math.cos(0.6), math.sin(0.6)
    p = cloud(spark, sf_dir).select("id", *[(F.col(a) * 20).alias(f"a{a}") for a in "xyz"])
    noise = ((F.col("id") * 37 % 11) - 5) * 0.001 + F.when(F.col("id") % 40 == 0, 30.0).otherwise(0.0)
    return p.select("*", (4.25 * (c * F.col("ax") - s * F.col("ay")) + 100 + noise).alias("bx"), (4.25 * (s * F.col("ax") + c * F.col("ay")) - 200 + noise).alias("by"), (4.25 * F.col("az") + 5 - noise).alias("bz"))


@query()
def similarity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus and reweighted similarity between two trajectories, then aligned errors."""
    pairs = _pairs(spark, sf_dir)
    s, r, t, votes = metrology.consensus_similarity(pairs, 0.5)
    e = metrology.aligned_errors(pairs, s, r, t)
    out = summaries.error_summary(e, F.col("error")).withColumns({"scale": F.lit(s), "inliers": F.lit(votes)})
    return rounded(out, 4, "mae", "rmse", "median", "p95", "max", "scale")


@query(f"""
WITH c AS (SELECT x * 100 AS x, y * 100 AS y, z * 100 AS z FROM ({CLOUD})), m AS (SELECT count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM c),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3)))) / 3 AS t FROM q),
v AS (SELECT *, q + 2 * p * cos(t) AS first, q + 2 * p * cos(t - 2 * pi() / 3) AS second FROM t), w AS (SELECT max(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2)) AS extent FROM c u, c v)
SELECT n, round(sqrt(a + b + c), 5) AS dispersion, round(extent, 5) AS extent, round(second / first, 5) AS eigen_ratio, n >= 4 AND extent >= 10 AND second / first >= 1e-3 AS observable FROM v, w
""")
def scale_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a trajectory's extent lets a scale be observed."""
    p = cloud(spark, sf_dir).select(*[(F.col(a) * 100).alias(a) for a in "xyz"])
    return rounded(metrology.observability(p), 5, "dispersion", "extent", "eigen_ratio")


@query()
def parameter_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """standard deviations of the seven parameters of a similarity."""
    import numpy as np

    pairs = _pairs(spark, sf_dir)
    s, r, t = metrology.robust_similarity(pairs, 0.5)
    cov = metrology.parameter_covariance(pairs, s, r, t, F.lit(0.05))
    names = ("scale", "rx", "ry", "rz", "tx", "ty", "tz")
    return spark.createDataFrame([(n, round(float(v), 8)) for n, v in zip(names, np.sqrt(np.diag(cov)), strict=True)], "parameter string, sigma double")


@query("""
WITH r AS (SELECT l_shipdate::DATE - DATE '1992-01-01' AS x, l_extendedprice AS y, l_orderkey * 10 + l_linenumber AS i, l_returnflag FROM lineitem), k AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity * 1000 + l_discount, l_orderkey * 10 + l_linenumber, l_partkey)::DOUBLE AS rx, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber, l_partkey)::DOUBLE AS ry FROM lineitem)
SELECT l_returnflag, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY l_returnflag
""")
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation, ties by row."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000 + F.col("l_discount")).alias("x"), F.col("l_extendedprice").alias("y"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_partkey").alias("tie"))
    return rounded(summaries.spearman(li, "x", "y", "tie", "l_returnflag"), 6, "rho")


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 seeded resamples of the mean, as Poisson weights drawn by hash, so rows never leave their tasks."""
    from tracklattice.operators.resampling import bootstrap_mean

    return rounded(bootstrap_mean(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_discount").alias("v")), "id", "v"), 6, "mean", "low", "high")


@query("""
WITH q AS (SELECT l_returnflag, l_quantity, l_extendedprice, ntile(5) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey) AS part FROM lineitem), m AS (SELECT l_returnflag, part::INT AS part, median(l_quantity) AS median_value, median(l_extendedprice) AS median_error, count(*) AS n FROM q GROUP BY ALL)
SELECT l_returnflag, part, round(median_value, 4) AS median_value, round(median_error, 4) AS median_error, n FROM m
""")
def quintile_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """medians of five equal groups."""
    li = table(spark, sf_dir, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    out = summaries.quantile_medians(li, "l_quantity", "l_extendedprice", "tie", 5, "l_returnflag")
    return rounded(out, 4, "median_value", "median_error")


@query("SELECT l_linestatus, count(*) AS n, round(avg((abs(l_discount - 0.05) <= l_tax)::INT), 6) AS within1, round(avg((abs(l_discount - 0.05) <= 2 * l_tax)::INT), 6) AS within2, round(avg((abs(l_discount - 0.05) <= 3 * l_tax)::INT), 6) AS within3, abs(avg((abs(l_discount - 0.05) <= l_tax)::INT) - 0.6827) < 0.15 AND abs(avg((abs(l_discount - 0.05) <= 2 * l_tax)::INT) - 0.9545) < 0.1 AS supported FROM lineitem GROUP BY l_linestatus")
def sigma_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share of errors within multiples of their sigma."""
    out = summaries.sigma_coverage(table(spark, sf_dir, "lineitem"), F.abs(F.col("l_discount") - 0.05), F.col("l_tax"), "l_linestatus")
    return rounded(out, 6, "within1", "within2", "within3")


@query(f"""
WITH p AS (SELECT frame, row, col, v AS a, (v + (row * col) % 9) AS b FROM ({_PIXELS})), s AS (SELECT frame, avg((a - b) ** 2) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab FROM p GROUP BY frame)
SELECT frame, round(CASE WHEN mse < 1e-10 THEN 100 ELSE least(100, 10 * log10(65025 / mse)) END, 5) AS psnr, round((2 * ma * mb + 6.5025) * (2 * cab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM s
""")
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR and single-window SSIM of two rasters."""
    p = _pixels(spark, sf_dir).withColumn("b", F.col("v") + (F.col("row") * F.col("col")) % 9)
    return rounded(rounded(imaging.image_similarity(p, "v", "b", "frame"), 5, "psnr"), 6, "ssim")


@query(f"""
WITH g AS (SELECT frame, row, col, v, lead(v) OVER c AS r, lag(v) OVER c AS l, lead(v) OVER w AS d, lag(v) OVER w AS u FROM ({_PIXELS}) WINDOW c AS (PARTITION BY frame, row ORDER BY col), w AS (PARTITION BY frame, col ORDER BY row))
SELECT frame, round(avg(sqrt((CASE WHEN l IS NULL THEN r - v WHEN r IS NULL THEN v - l ELSE (r - l) / 2 END) ** 2 + (CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END) ** 2)), 5) AS seam_gradient FROM g WHERE col % 16 = 0 GROUP BY frame
""")
def seam_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean gradient along seams, one-sided at the borders."""
    return rounded(imaging.gradient_along(_pixels(spark, sf_dir), F.col("col") % 16 == 0), 5, "seam_gradient")


@query(f"""
WITH p AS ({_PIXELS}), o AS (SELECT i, j, [1, 4, 6, 4, 1][i + 3] * [1, 4, 6, 4, 1][j + 3] / 256 AS gauss, CASE WHEN i = 0 AND j = 0 THEN -4 WHEN abs(i) + abs(j) = 1 THEN 1 ELSE 0 END AS lap, CASE WHEN abs(i) < 2 AND abs(j) < 2 THEN j * (2 - abs(i)) ELSE 0 END AS gx, CASE WHEN abs(i) < 2 AND abs(j) < 2 THEN i * (2 - abs(j)) ELSE 0 END AS gy, CASE WHEN i = 0 AND abs(j) < 2 THEN 2 - 3 * abs(j) ELSE 0 END AS mx, CASE WHEN j = 0 AND abs(i) < 2 THEN 2 - 3 * abs(i) ELSE 0 END AS my FROM range(-2, 3) a(i), range(-2, 3) b(j)),
s AS (SELECT p.frame, p.row, p.col, p.v, o.*, ((47 - abs(47 - abs(p.row + i))) * 7 + (63 - abs(63 - abs(p.col + j))) * 13 + p.frame * 29) % 256 AS w FROM p, o),
f AS (SELECT frame, row, col, sum(lap * w) AS lap, sum(gx * w) AS gx, sum(gy * w) AS gy, abs(sum(mx * w)) + abs(sum(my * w)) AS modified, any_value(v) - sum(gauss * w) AS rest FROM s GROUP BY frame, row, col)
SELECT frame, round(var_pop(lap), 4) AS laplacian_variance, round(avg(gx * gx + gy * gy), 4) AS tenengrad, round(avg(modified), 4) AS modified_laplacian, round(stddev_pop(rest), 4) AS compression_proxy FROM f GROUP BY frame
""")
def sharpness_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian variance, Tenengrad, modified Laplacian, compression proxy; stencils with reflected borders."""
    return rounded(imaging.sharpness(_pixels(spark, sf_dir), 48, 64), 4, "laplacian_variance", "tenengrad", "modified_laplacian", "compression_proxy")


@query("""
WITH o AS (SELECT c_custkey, c_nationkey, c_acctbal / 100 AS lat, c_custkey % 180 AS lon FROM customer), f AS (SELECT c_nationkey, min_by(c_custkey, c_custkey) AS first_id, median(lat) AS median_lat, median(lon) AS median_lon FROM o GROUP BY c_nationkey), u AS (SELECT c_nationkey, lat, row_number() OVER (PARTITION BY c_nationkey ORDER BY lat, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM o)
SELECT f.c_nationkey, first_id, round(median_lat, 6) AS median_lat, round(median_lon, 6) AS median_lon, round(u.lat, 6) AS upper_median_lat FROM f JOIN u ON f.c_nationkey = u.c_nationkey AND u.i = u.n // 2
""")
def origin_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first record, median and upper median as origins."""
    o = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_custkey") % 180).alias("lon"))
    # The upper median: the value at place n // 2, which is percentile_disc past the half.
    rank = o.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("lat", "c_custkey")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")))
    out = rank.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first_id"), F.median("lat").alias("median_lat"), F.median("lon").alias("median_lon"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("lat"))).alias("upper_median_lat"))
    return rounded(out, 6, "median_lat", "median_lon", "upper_median_lat")


@query("""
WITH d AS (SELECT n_name AS dataset, c_custkey, c_acctbal, o.n AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey), i AS (SELECT dataset, count(*) AS frames, count(*) FILTER (orders IS NULL) AS missing, count(*) FILTER (c_acctbal < -900) AS errors FROM d GROUP BY dataset)
SELECT dataset, frames, missing, errors, CASE WHEN errors > 0 THEN 'INVALID' WHEN missing > 0 THEN 'PARTIALLY_VALID' ELSE 'VALID' END AS status FROM i
""")
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue counts and status of a dataset."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    i = d.groupBy(F.col("n_name").alias("dataset")).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("orders").isNull()).alias("missing"), F.count_if(F.col("c_acctbal") < -900).alias("errors"))
    return i.withColumn("status", F.when(F.col("errors") > 0, "INVALID").when(F.col("missing") > 0, "PARTIALLY_VALID").otherwise("VALID"))


_REPROJ = f"""
o AS (SELECT id, label AS frame, 50 * x / (z + 2) + 32 AS pu, 50 * y / (z + 2) + 24 AS pv, 50 * x / (z + 2) + 32 + (id % 5 - 2) * 0.3 AS u, 50 * y / (z + 2) + 24 + (id % 3 - 1) * 0.4 AS v FROM ({CLOUD})), e AS (SELECT *, sqrt((pu - u) ** 2 + (pv - v) ** 2) AS e FROM o)
"""


@query(f"WITH {_REPROJ} SELECT frame, round(avg(e), 6) AS mean, round(sqrt(avg(e * e)), 6) AS rmse, round(median(e), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, round(max(e), 6) AS max, round(sum(CASE WHEN e <= 0.5 THEN e * e / 2 ELSE 0.5 * (e - 0.25) END), 5) AS huber_cost FROM e GROUP BY frame")
def reprojection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reprojection errors of observations joined to cameras and landmarks, with their Huber cost."""
    from tracklattice.functions.robust import huber_loss

    c = cloud(spark, sf_dir)
    cameras = c.select(F.col("label").alias("frame")).distinct().withColumn("r_cw", rotation.vector(1, 0, 0, 0, 1, 0, 0, 0, 1)).withColumn("t_cw", rotation.vector(0, 0, 2))
    shift = lambda n, k, s: (F.col("id") % n - k) * s
    o = c.select("id", F.col("label").alias("frame"), F.array("x", "y", "z").alias("p"), (50 * F.col("x") / (F.col("z") + 2) + 32 + shift(5, 2, 0.3)).alias("u"), (50 * F.col("y") / (F.col("z") + 2) + 24 + shift(3, 1, 0.4)).alias("v"))
    j = o.join(cameras, "frame").withColumn("e", camera.reprojection_error(F.col("p"), F.col("r_cw"), F.col("t_cw"), 50.0, 50.0, 32.0, 24.0, F.col("u"), F.col("v")))
    out = j.groupBy("frame").agg(F.avg("e").alias("mean"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.median("e").alias("median"), F.percentile("e", 0.9).alias("p90"), F.max("e").alias("max"), F.sum(huber_loss(F.col("e"), 0.5)).alias("huber_cost"))
    return rounded(rounded(out, 6, "mean", "rmse", "median", "p90", "max"), 5, "huber_cost")


@query(f"""
WITH v AS ({CLOUD}), f AS (SELECT id AS face, id AS i0, id + 1 + id % 3 AS i1, id + 4 AS i2 FROM v), t AS (SELECT face, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM f JOIN v a ON a.id = i0 JOIN v b ON b.id = i1 JOIN v c ON c.id = i2),
g AS (SELECT face, sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2 AS area, sqrt(ux * ux + uy * uy + uz * uz) AS a, sqrt(vx * vx + vy * vy + vz * vz) AS b, sqrt((ux - vx) ** 2 + (uy - vy) ** 2 + (uz - vz) ** 2) AS c FROM t)
SELECT face, round(area, 6) AS area, round(coalesce(4 * pi() * area / nullif((a + b + c) ** 2, 0), 0), 6) AS roundness, round(least(a, b, c), 6) AS shortest, CASE WHEN greatest(a, b, c) > 0.4 THEN 'EDGE_TOO_LONG' WHEN area < 0.2 * (SELECT avg(area) FROM g) THEN 'AREA_TOO_SMALL' WHEN coalesce(4 * pi() * area / nullif((a + b + c) ** 2, 0), 0) < 0.2 THEN 'ASPECT' END AS dropped FROM g
""")
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, shapes and filter reasons of faces."""
    c = cloud(spark, sf_dir)
    i = F.col("id")
    faces = c.select(i.alias("face"), i.alias("i0"), (i + 1 + i % 3).alias("i1"), (i + 4).alias("i2"))
    p = mesh.with_corners(faces, c.select(i.alias("v"), "x", "y", "z"))
    a, b, d = F.col("p0"), F.col("p1"), F.col("p2")
    g = p.select("face", camera.triangle_area(a, b, d).alias("area"), camera.roundness(a, b, d).alias("roundness"), camera.shortest_edge(a, b, d).alias("shortest"), F.greatest(camera.distance(a, b), camera.distance(b, d), camera.distance(d, a)).alias("longest"))
    mean = g.agg(F.avg("area").alias("mean_area"))
    out = g.crossJoin(F.broadcast(mean))  # one row
    out = out.select("face", "area", "roundness", "shortest", mesh.shape_filter(F.col("area"), F.col("longest"), F.col("roundness"), F.col("mean_area"), 0.4, 0.2, 0.2).alias("dropped"))
    return rounded(out, 6, "area", "roundness", "shortest")


@query(f"""
WITH s AS (SELECT label AS chart, id, CASE WHEN z > 0.05 THEN 'OBSERVED' WHEN z > -0.05 THEN 'INTERPOLATED' ELSE 'UNOBSERVED' END AS state FROM ({CLOUD}))
SELECT chart, count(*) AS texels, count(*) FILTER (state = 'OBSERVED') AS observed, round(avg((state = 'OBSERVED')::INT), 6) AS observed_ratio, round(avg((state <> 'UNOBSERVED')::INT), 6) AS covered_ratio FROM s GROUP BY chart
""")
def texture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coverage ratios of texels."""
    z = F.col("z")
    s = cloud(spark, sf_dir).select(F.col("label").alias("chart"), F.when(z > 0.05, "OBSERVED").when(z > -0.05, "INTERPOLATED").otherwise("UNOBSERVED").alias("state"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.groupBy("chart").agg(F.count(F.lit(1)).alias("texels"), F.count_if(F.col("state") == "OBSERVED").alias("observed"), share(F.col("state") == "OBSERVED").alias("observed_ratio"), share(F.col("state") != "UNOBSERVED").alias("covered_ratio"))


@query(f"""
WITH c AS ({CLOUD}), d AS (SELECT a.id, b.id AS other, b.x, b.y, b.z, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM c a, c b), k AS (SELECT * FROM d WHERE d <= 0.12 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 12),
m AS (SELECT id, count(*)::INT AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM k GROUP BY id), g AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m WHERE n >= 3),
t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3)))) / 3 AS t FROM g),
v AS (SELECT *, q + 2 * p * cos(t) AS l1, q + 2 * p * cos(t + 2 * pi() / 3) AS l3, 3 * q - l1 - l3 AS l2 FROM t),
x AS (SELECT *, unnest([[d * f - e * (b - l3), e * d - (a - l3) * f, (a - l3) * (b - l3) - d * d], [d * (c - l3) - e * f, e * e - (a - l3) * (c - l3), (a - l3) * f - d * e], [(b - l3) * (c - l3) - f * f, f * e - d * (c - l3), d * f - (b - l3) * e]]) AS w FROM v),
w AS (SELECT id, arg_max(w, w[1] ** 2 + w[2] ** 2 + w[3] ** 2) AS w, any_value(n) AS n, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3 FROM x GROUP BY id), u AS (SELECT *, sqrt(w[1] ** 2 + w[2] ** 2 + w[3] ** 2) * sign(w[3]) AS s FROM w)
SELECT id, n, round(w[1] / s, 4) + 0.0 AS nx, round(w[2] / s, 4) + 0.0 AS ny, round(w[3] / s, 4) + 0.0 AS nz, round((l2 - greatest(l3, 0)) / l1, 4) + 0.0 AS planarity, round((l1 - l2) / l1, 4) + 0.0 AS linearity, round(greatest(l3, 0) / l1, 4) + 0.0 AS sphericity FROM u
UNION ALL SELECT id, n, 0, 0, 0, 0, 0, 0 FROM m WHERE n < 3
""")
def pca_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normals, planarity, linearity and sphericity from neighbourhoods."""
    from tracklattice.operators.surface import pca_normals as normals

    return rounded(normals(cloud(spark, sf_dir), 0.12, 12), 4, "nx", "ny", "nz", "planarity", "linearity", "sphericity")


@query("SELECT o_orderpriority, count(*) AS frames, round(count(*) / 120.0, 6) AS fps, CASE WHEN count(*) / 120.0 < 1 THEN 'OFFLINE_BATCH' WHEN count(*) / 120.0 < 30 THEN 'NEAR_REAL_TIME' ELSE 'REAL_TIME' END AS tier FROM orders GROUP BY o_orderpriority")
def timing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames a second and latency tier of counted frames over measured time."""
    from tracklattice.plans.timing import latency_tier

    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("frames"))
    fps = F.col("frames") / 120.0
    return g.select("o_orderpriority", "frames", F.round(fps, 6).alias("fps"), latency_tier(fps).alias("tier"))
