"""Filters, predicates and row validation (section D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.operators import asof, mesh, quality
from tracklattice.queries.registry import CLOUD, EVENTS, cloud, events, query, rounded, table


@query(f"""
WITH e AS (SELECT user_id, event_id, t, floor(t / 600) AS m, lag(floor(t / 600)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({EVENTS}))
SELECT user_id, CASE WHEN m < p THEN 'TIME_GOES_BACK' WHEN m = p THEN 'TIME_REPEATS' ELSE 'OK' END AS finding, count(*) AS n FROM e GROUP BY ALL
""")
def timeline_monotonic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of time within each user, at ten-minute grain."""
    e = events(spark, sf_dir).withColumn("m", F.floor(F.col("t") / 600))
    out = quality.temporal_order(e, "user_id", "m", ("event_id",))
    return out.groupBy("user_id", F.coalesce("violation", F.lit("OK")).alias("finding")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT l_orderkey AS video_id, l_linenumber - 1 AS frame_index, l_shipdate FROM lineitem), s AS (SELECT video_id, frame_index - coalesce(lag(frame_index) OVER w, -1) AS step, l_shipdate < lag(l_shipdate) OVER w AS back FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_index, l_shipdate))
SELECT video_id, count(*) AS frames, count(*) FILTER (step <> 1) AS gaps_in_index, count(*) FILTER (back) AS backward_steps, count(*) FILTER (step <> 1) = 0 AND count(*) FILTER (back) = 0 AS valid FROM s GROUP BY video_id
""")
def timeline_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous index and non-decreasing time, a line of an order taken as a frame."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") - 1).alias("frame_index"), F.col("l_shipdate").alias("timestamp_seconds"))
    return quality.timeline_findings(f)


@query("SELECT user_id, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: times that occur more than once, at hour grain."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"))
    return e.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT status, count(*) AS n, count(*) FILTER (status IN ('EXACT', 'INTERPOLATED', 'NEAREST', 'OFFSET_APPLIED', 'OFFSET_ESTIMATED', 'OFFSET_VALIDATED')) AS synchronized FROM (SELECT ['EXACT', 'INTERPOLATED', 'EXTRAPOLATED', 'OUT_OF_RANGE', 'NEAREST', 'UNSYNCHRONIZED'][event_id % 6 + 1] AS status FROM events) GROUP BY status")
def synchronized_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six statuses are synchronized; a held end isn't."""
    names = F.array(*[F.lit(x) for x in ("EXACT", "INTERPOLATED", "EXTRAPOLATED", "OUT_OF_RANGE", "NEAREST", "UNSYNCHRONIZED")])
    e = table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(asof.synchronized(F.col("status"))).alias("synchronized"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'UNSAFE_DECODE_FAILURE' WHEN value > 200 THEN 'UNSAFE_SEVERELY_DEGRADED' WHEN 1 - user_id % 10 / 10 > 0.6 AND NOT coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 4 * 0.1 END < 0.15, false) THEN 'DYNAMIC_RISK_EXCLUSION' END AS reason FROM events
""")
def keyframe_safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode, quality and movement, in that order."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    reason = quality.keyframe_gate(F.col("event_type") != "error", F.col("value") > 200, F.col("user_id") % 10 / 10, F.when(i % 4 > 0, i % 4 * 0.1))
    return e.select("event_id", reason.alias("reason"))


@query(f"""
WITH p AS (SELECT id, x, z, CASE WHEN id % 17 = 0 THEN -1.0 ELSE 2 + z * 10 END AS depth, least(1, abs(x) * 4) AS confidence, CASE WHEN id % 13 = 0 THEN 'OCCLUDED' ELSE 'VALID' END AS vis, CASE WHEN id % 19 <> 0 THEN abs(y) * 10 END AS err FROM ({CLOUD}))
SELECT coalesce(CASE WHEN depth <= 1e-6 THEN 'CHEIRALITY_VIOLATION' WHEN depth < 0.5 OR depth > 100 THEN 'OUT_OF_DEPTH_BOUNDS' WHEN confidence < 0.2 THEN 'LOW_CONFIDENCE' WHEN vis = 'OCCLUDED' THEN 'OCCLUDED_OR_INCONSISTENT' WHEN err IS NULL OR err > 2 THEN 'REPROJECTION_ERROR_EXCEEDED' END, 'VALIDATED') AS reason, count(*) AS n FROM p GROUP BY 1
""")
def dense_point_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite, in front, in range, confident, visible, consistent."""
    i, depth = F.col("id"), F.when(F.col("id") % 17 == 0, -1.0).otherwise(2 + F.col("z") * 10)
    p = cloud(spark, sf_dir).select(quality.dense_point_reason(F.array("x", "y", "z"), depth, depth, depth, F.least(F.lit(1.0), F.abs("x") * 4), F.when(i % 13 == 0, "OCCLUDED").otherwise("VALID"), F.when(i % 19 != 0, F.abs("y") * 10)).alias("r"))
    return p.groupBy(F.coalesce("r", F.lit("VALIDATED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS points, 0::BIGINT AS not_finite, count(*) FILTER (z * 10 > 1 OR z * 10 < 0) AS bad_confidence, count(*) FILTER (id % 5 < 1) AS no_support, false AS valid FROM ({CLOUD})")
def cloud_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of violations in a cloud."""
    return quality.cloud_findings(cloud(spark, sf_dir).withColumns({"confidence": F.col("z") * 10, "support": F.col("id") % 5}))


@query("SELECT (SELECT count(*) FROM (SELECT unnest([vec_id, vec_id + 1, vec_id * 2]) AS v FROM embeddings) WHERE v NOT IN (SELECT vec_id FROM embeddings)) AS unknown_vertices, (SELECT count(*) FROM embeddings WHERE vec_id = vec_id * 2 OR vec_id + 1 = vec_id * 2) AS degenerate_faces, 0::BIGINT AS not_finite, false AS wrong_unit")
def mesh_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces against vertices."""
    c, i = cloud(spark, sf_dir), F.col("id")
    return mesh.violations(c.select(i.alias("face"), i.alias("i0"), (i + 1).alias("i1"), (i * 2).alias("i2")), c.select(i.alias("v"), "x", "y", "z"))


@query("""
WITH c AS (SELECT p_partkey AS id, ['rmse_3d', 'f_score', 'accuracy_at_tau_pct', ' ', 'chamfer_distance', 'psnr'][p_partkey % 6 + 1] AS name, CASE WHEN p_size % 5 = 0 THEN -p_size ELSE p_size * 3 END::DOUBLE AS value, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'm' END AS unit, CASE WHEN p_partkey % 11 > 0 THEN 'tls scan' END AS truth, (p_size - 2)::DOUBLE AS tau FROM part)
SELECT id, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'NO_NAME' END, CASE WHEN unit = '' THEN 'NO_UNIT' END, CASE WHEN truth IS NULL THEN 'NO_GROUND_TRUTH' END, CASE WHEN name IN ('rmse_3d', 'chamfer_distance') AND value < 0 THEN 'NEGATIVE' END, CASE WHEN name = 'accuracy_at_tau_pct' AND NOT value BETWEEN 0 AND 100 THEN 'NOT_A_PERCENTAGE' END, CASE WHEN tau <= 0 THEN 'BAD_THRESHOLD' END], lambda x: x IS NOT NULL), ',') AS violations FROM c
""")
def metric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps metrics from being claimed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(*[F.lit(x) for x in ("rmse_3d", "f_score", "accuracy_at_tau_pct", " ", "chamfer_distance", "psnr")])
    value = F.when(size % 5 == 0, -size).otherwise(size * 3).cast("double")
    v = quality.claim_violations(F.element_at(names, (k % 6 + 1).cast("int")), value, F.when(k % 7 == 0, "").otherwise("m"), F.lit("parts"), F.when(k % 11 > 0, "tls scan"), F.lit("batch"), (size - 2).cast("double"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(v, ",").alias("violations"))


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'OBSERVED' WHEN x < 0 THEN 'UNOBSERVED' WHEN y < 0 THEN 'UNDETERMINED' WHEN z < 0 THEN 'PHYSICALLY_OCCLUDED' ELSE 'RECONSTRUCTION_MISSING' END AS state FROM ({CLOUD})")
def visibility_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states of visibility."""
    return cloud(spark, sf_dir).select("id", quality.visibility(F.col("id") % 3 == 0, F.col("x") >= 0, F.col("y") >= 0, F.col("z") < 0).alias("state"))


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem), b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS m FROM a WHERE n = 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM b WHERE m = 1
""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track once a frame, then a keypoint once a track; the first wins."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return quality.first_wins(li, (("l_orderkey", "l_suppkey"), ("l_linenumber", "l_partkey")), (("l_partkey", "l_suppkey"), ("l_orderkey", "l_linenumber")))


@query("SELECT c_custkey, c_acctbal / 100 BETWEEN -90 AND 90 AS latitude_ok, c_custkey / 5.0 BETWEEN -180 AND 180 AS longitude_ok, c_acctbal >= 0 AS speed_ok FROM customer")
def range_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of latitude, longitude and speed."""
    from tracklattice.functions import units

    return table(spark, sf_dir, "customer").select("c_custkey", units.valid_latitude(F.col("c_acctbal") / 100).alias("latitude_ok"), units.valid_longitude(F.col("c_custkey") / 5.0).alias("longitude_ok"), units.valid_speed(F.col("c_acctbal")).alias("speed_ok"))


@query(f"SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, count(*) AS n FROM ({CLOUD}) WHERE x BETWEEN -0.1 AND 0.2 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.3 AND 0.05")
def roi_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a box."""
    from tracklattice.operators.metrology import in_box

    c = cloud(spark, sf_dir).filter(in_box((-0.1, -0.1, -0.3), (0.2, 0.1, 0.05)))
    return rounded(c.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n")), 6, "x0", "x1")
