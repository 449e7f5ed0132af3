"""Whole plans over stand-in flights: dataset, alignment, stage runner, two-view kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import rotation
from tracklattice.operators import asof, geometry, summaries
from tracklattice.plans import flight, runner
from tracklattice.queries.registry import CLOUD, EVENTS, cloud, events, query, rounded


def _flight(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    i = F.col("event_id")
    frames = e.filter("event_type = 'view'").select((F.col("user_id") % 8).alias("stream_id"), F.format_string("f%08d", i).alias("frame_id"), i.alias("frame_index"), "t")
    # Places follow from the time, so that they can be told between records too.
    telemetry = e.filter("event_type = 'click'").select((F.col("user_id") % 8).alias("stream_id"), "t", i.alias("record_index"), (F.lit(18.5) + F.col("t") % 100000 / 1e7).alias("lat"), (F.lit(73.8) + F.col("t") % 90000 / 1e7).alias("lon"), (F.lit(500.0) + F.col("value") / 10).alias("alt"), F.when(F.col("user_id") % 50 == 0, "ELLIPSOIDAL").otherwise("MSL").alias("datum"), (i * 7 % 360).cast("double").alias("yaw"), (i % 20 - 10).cast("double").alias("pitch"), (i % 10 - 5).cast("double").alias("roll"), F.col("value").alias("speed"))
    return frames, telemetry


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT user_id % 8 AS stream_id, event_id, t FROM e WHERE event_type = 'view'), r AS (SELECT user_id % 8 AS stream_id, t, max_by(user_id % 50 = 0, event_id) AS ell FROM e WHERE event_type = 'click' GROUP BY ALL),
l AS (SELECT f.*, r.t AS lt, r.ell AS le FROM f ASOF LEFT JOIN r ON f.stream_id = r.stream_id AND f.t >= r.t), b AS (SELECT l.*, r.t AS rt, r.ell AS re FROM l ASOF LEFT JOIN r ON l.stream_id = r.stream_id AND l.t <= r.t),
s AS (SELECT stream_id, CASE WHEN lt IS NULL OR rt IS NULL THEN 'OUT_OF_RANGE' WHEN t - lt <= 1e-4 OR rt - t <= 1e-4 THEN 'EXACT' WHEN rt - lt > 20000 THEN 'UNSYNCHRONIZED' WHEN le <> re THEN 'INCOMPATIBLE_REFERENCE' ELSE 'INTERPOLATED' END AS status FROM b)
SELECT stream_id, status, count(*) AS n FROM s GROUP BY ALL
""")
def flight_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with datums, C1 to C3, section 3.2: frames placed on their flights, by status."""
    frames, telemetry = _flight(spark, sf_dir)
    d = flight.build(frames, telemetry, asof.BracketConfig(max_gap=20000.0, same="datum"))
    return d.groupBy("stream_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT user_id % 8 AS stream_id, event_id, t FROM e WHERE event_type = 'view'), k AS (SELECT user_id % 8 AS stream_id, t, event_id, user_id % 50 = 0 AS ell, value FROM e WHERE event_type = 'click'), r AS (SELECT stream_id, t, max_by(ell, event_id) AS ell FROM k GROUP BY ALL),
l AS (SELECT f.*, r.t AS lt, r.ell AS le FROM f ASOF LEFT JOIN r ON f.stream_id = r.stream_id AND f.t >= r.t), b AS (SELECT l.*, r.t AS rt, r.ell AS re FROM l ASOF LEFT JOIN r ON l.stream_id = r.stream_id AND l.t <= r.t),
s AS (SELECT stream_id, lt IS NOT NULL AND rt IS NOT NULL AND (t - lt <= 1e-4 OR rt - t <= 1e-4 OR (rt - lt <= 20000 AND le = re)) AS ok FROM b), g AS (SELECT stream_id, count(*) AS frames, count(*) FILTER (ok) AS synchronized FROM s GROUP BY stream_id), h AS (SELECT stream_id, count(DISTINCT ell) AS datums, count(*) FILTER (value IS NULL) AS slow FROM k GROUP BY stream_id)
SELECT stream_id, frames, synchronized, coalesce(datums, 0) AS datums, concat_ws(',', CASE WHEN datums IS NULL THEN 'ERROR:NO_TELEMETRY' END, CASE WHEN datums > 1 THEN 'WARNING:MIXED_DATUMS' END, CASE WHEN slow > 0 THEN 'WARNING:MISSING_SPEED' END, CASE WHEN synchronized < frames THEN 'WARNING:UNSYNCHRONIZED_FRAMES' END) AS findings, CASE WHEN datums IS NULL OR synchronized = 0 THEN 'INVALID' WHEN synchronized < frames THEN 'PARTIALLY_VALID' ELSE 'VALID' END AS status FROM g LEFT JOIN h USING (stream_id)
""")
def flight_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings and status of each flight."""
    frames, telemetry = _flight(spark, sf_dir)
    d = flight.build(frames, telemetry, asof.BracketConfig(max_gap=20000.0, same="datum"))
    return flight.issues(d, telemetry).withColumn("findings", F.array_join("findings", ","))


@query(f"""
SELECT 'METRIC_SCALE_ESTIMATED' AS state, 4.0::DOUBLE AS scale, count(*)::INT AS inliers, 0.0::DOUBLE AS rmse FROM ({CLOUD})
""")
def geospatial_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, F46 to F48, G9, K10, section 3.3: join, consensus, covariance, state of one flight that is a quarter of its truth."""
    n = cloud(spark, sf_dir).select(F.col("id").cast("double").alias("i"))
    t = F.col("i") * 0.5
    lat, lon, alt = F.lit(18.5) + F.sin(t / 20) * 1e-3, F.lit(73.8) + F.cos(t / 20) * 1e-3, F.lit(500.0) + t / 10
    telemetry = n.select(F.lit(0).alias("stream_id"), t.alias("t"), F.col("i").cast("long").alias("record_index"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), F.lit(0.0).alias("yaw"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("roll"), F.lit(0.5).alias("h_acc"), F.lit(0.8).alias("v_acc"), F.lit(False).alias("rtk"))
    from tracklattice.functions import geodesy

    frames = telemetry.select("stream_id", F.format_string("f%05d", "record_index").alias("frame_id"), "t", geodesy.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(18.5), F.lit(73.8), F.lit(500.0)).alias("e"))
    frames = frames.select("stream_id", "frame_id", "t", (F.col("e")[0] / 4).alias("ax"), (F.col("e")[1] / 4).alias("ay"), (F.col("e")[2] / 4).alias("az"))
    r = flight.align(flight.observations(frames, telemetry, (18.5, 73.8, 500.0)))
    return spark.createDataFrame([(r["state"][-1], round(float(r.get("scale", 0.0)), 4), int(r.get("inliers", 0)), round(float(r.get("rmse", 0.0)), 3))], "state string, scale double, inliers int, rmse double")


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT user_id % 8 AS stream_id, event_id, t FROM e WHERE event_type = 'view'), r AS (SELECT user_id % 8 AS stream_id, t, max_by(user_id % 50 = 0, event_id) AS ell FROM e WHERE event_type = 'click' GROUP BY ALL),
l AS (SELECT f.*, r.t AS lt, r.ell AS le FROM f ASOF LEFT JOIN r ON f.stream_id = r.stream_id AND f.t >= r.t), b AS (SELECT l.*, r.t AS rt, r.ell AS re FROM l ASOF LEFT JOIN r ON l.stream_id = r.stream_id AND l.t <= r.t),
n AS (SELECT count(*) AS frames, count(DISTINCT CASE WHEN lt IS NULL OR rt IS NULL THEN NULL WHEN t - lt <= 1e-4 OR rt - t <= 1e-4 THEN 'EXACT' WHEN rt - lt > 20000 THEN 'UNSYNCHRONIZED' WHEN le <> re THEN 'INCOMPATIBLE_REFERENCE' ELSE 'INTERPOLATED' END) AS kinds FROM b)
SELECT s.step, s.stage, s.status, CASE s.step WHEN 0 THEN frames WHEN 1 THEN kinds ELSE 0 END AS rows FROM n, (VALUES (0, 'dataset', 'SUCCESS'), (1, 'brackets', 'SUCCESS'), (2, 'leak', 'CONTRACT_VIOLATION'), (3, 'texture', 'NOT_EVALUABLE'), (4, 'off', 'NOT_EVALUABLE'), (5, 'run', 'DEGRADED')) s(step, stage, status)
""")
def staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages with gates, digests and records; an optional stage that fails degrades the run."""
    frames, telemetry = _flight(spark, sf_dir)
    stages = [
        runner.Stage("dataset", lambda t: flight.build(t["frames"], t["telemetry"], asof.BracketConfig(max_gap=20000.0, same="datum")).select("stream_id", "frame_id", "status", "gap"), ("frames", "telemetry")),
        runner.Stage("brackets", lambda t: summaries.error_summary(t["dataset"].filter("gap is not null"), F.col("gap"), "status"), ("dataset",)),
        runner.Stage("leak", lambda t: t["dataset"].withColumn("true_depth", F.lit(1)), ("dataset",), runner.OPTIONAL),
        runner.Stage("texture", lambda t: t["mesh"], ("mesh",), runner.OPTIONAL),
        runner.Stage("off", lambda t: t["dataset"], ("dataset",), runner.OPTIONAL, enabled=False),
    ]
    status, _, records = runner.run(stages, [runner.admit("frames", frames), runner.admit("telemetry", telemetry)])
    rows = [(i, r.stage, r.status, r.rows) for i, r in enumerate(records)] + [(len(records), "run", status, 0)]
    return spark.createDataFrame(rows, "step int, stage string, status string, rows long")



@query()
def two_view_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamental matrices of frame pairs by seeded consensus; every ninth match is wrong."""
    c = cloud(spark, sf_dir).select(F.col("label").alias("frame_a"), (F.col("label") + 1).alias("frame_b"), F.col("id").alias("idx"), "x", "y", (F.col("z") + 3).alias("z"))
    m = c.select("frame_a", "frame_b", "idx", (500 * F.col("x") / F.col("z")).alias("ua"), (500 * F.col("y") / F.col("z")).alias("va"), (500 * (F.col("x") + 0.3) / (F.col("z") + 0.1)).alias("ub"), (500 * F.col("y") / (F.col("z") + 0.1) + F.when(F.col("idx") % 9 == 0, 40.0).otherwise(0.0)).alias("vb"))
    return geometry.two_view(m).drop("f")


@query(f"SELECT id AS track_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, 3 AS views, 'TRIANGULATED' AS status FROM ({CLOUD})")
def track_triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: tracks of three views back to their points."""
    c = cloud(spark, sf_dir).withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = F.col("frame") * 0.5
    o = c.select(F.col("id").alias("track_id"), "frame", rotation.vector(500, 0, 0, 500 * k, 0, 500, 0, 0, 0, 0, 1, 3).alias("p"), (500 * (F.col("x") + k) / (F.col("z") + 3)).alias("u"), (500 * F.col("y") / (F.col("z") + 3)).alias("v"))
    return rounded(geometry.triangulated(o).drop("error"), 4, "x", "y", "z")


@query(f"""
WITH s AS ({CLOUD}), c AS (SELECT n_nationkey AS frame, (n_nationkey % 5 - 2) * 0.3 AS cx, (n_nationkey // 5 - 2) * 0.3 AS cy FROM nation),
j AS (SELECT s.id AS sample, frame, 300 * (x - cx) / (z + 2) + 100 AS u, 300 * (y - cy) / (z + 2) + 80 AS v, z + 2 AS depth, (z + 2) / sqrt((cx - x) ** 2 + (cy - y) ** 2 + (z + 2) ** 2) AS cosine FROM s, c),
r AS (SELECT *, CASE WHEN u < 0 OR u > 199 OR v < 0 OR v > 159 THEN 'OUTSIDE_IMAGE' WHEN cosine < 0.97 THEN 'GRAZING_ANGLE' END AS reason, round(cosine / depth, 9) AS raw FROM j), k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY sample, reason IS NULL ORDER BY raw DESC, frame) END AS rank FROM r)
SELECT sample, frame, coalesce(reason, CASE WHEN rank <= 8 THEN 'ACCEPTED' ELSE 'ACCEPTED_NOT_RETAINED' END) AS decision, CASE WHEN reason IS NULL THEN round(raw, 5) END AS score FROM k
""")
def texture_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with every camera of a flight, decided and audited, the best eight kept."""
    from tracklattice.operators.texturing import associate
    from tracklattice.queries.registry import table

    k = F.col("n_nationkey")
    cx, cy = (k % 5 - 2) * 0.3, (F.floor(k / 5) - 2) * 0.3
    cams = table(spark, sf_dir, "nation").select(k.alias("frame"), rotation.vector(1, 0, 0, 0, 1, 0, 0, 0, 1).alias("r_cw"), rotation.vector(-cx, -cy, 2).alias("t_cw"), rotation.vector(cx, cy, -2).alias("c_w"), F.lit(300.0).alias("fx"), F.lit(300.0).alias("fy"), F.lit(100.0).alias("cx"), F.lit(80.0).alias("cy"), F.lit(200).alias("width"), F.lit(160).alias("height"))
    samples = cloud(spark, sf_dir).select(F.col("id").alias("sample"), F.array("x", "y", "z").alias("p"), rotation.vector(0, 0, 1).alias("n"))
    return rounded(associate(samples, cams, 8, 0.97).select("sample", "frame", "decision", "score"), 5, "score")


@query(f"""
WITH c AS ({CLOUD})
SELECT s.id, EXISTS (SELECT 1 FROM c t WHERE t.id <> s.id AND (t.z - s.z) / 0.5 > 1e-6 AND (t.z - s.z) / 0.5 < 1 - 1e-6 AND s.y >= t.y - 0.03 AND abs(s.x - t.x) <= (t.y + 0.03 - s.y) / 2) AS occluded FROM c s
""")
def occlusion_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from samples to a camera, occluded by triangles other than their own."""
    from tracklattice.operators.neighbours import occluded

    i = F.col("id")
    c = cloud(spark, sf_dir).withColumn("p", F.array("x", "y", "z"))
    seg = c.select("id", i.alias("own_face"), F.col("p").alias("a"), rotation.vector(F.col("x"), F.col("y"), F.col("z") + 0.5).alias("b"))
    tri = c.select(i.alias("face"), rotation.vector(F.col("x") - 0.03, F.col("y") - 0.03, F.col("z")).alias("p0"), rotation.vector(F.col("x") + 0.03, F.col("y") - 0.03, F.col("z")).alias("p1"), rotation.vector(F.col("x"), F.col("y") + 0.03, F.col("z")).alias("p2"))
    return occluded(seg, tri, 0.1).select("id", "occluded")


@query(f"""
WITH RECURSIVE o AS (SELECT DISTINCT l_suppkey % 10 AS frame, l_partkey AS track FROM lineitem), t AS (SELECT track, list(frame) AS frames FROM o GROUP BY track),
r AS (SELECT 1 AS step, [0, 1]::BIGINT[] AS done, 1::BIGINT AS frame, 0::BIGINT AS shared UNION ALL
  SELECT step + 1, list_append(done, best.frame), best.frame, best.shared FROM (SELECT step, done, (SELECT {{'frame': arg_min(frame, (-n, frame)), 'shared': max(n)}} FROM (SELECT o.frame, count(*) AS n FROM o JOIN t USING (track) WHERE NOT list_contains(done, o.frame) AND len(list_intersect(t.frames, done)) >= 2 GROUP BY o.frame)) AS best FROM r) WHERE best.shared >= 2)
SELECT 0 AS step, 0::BIGINT AS frame, 0::BIGINT AS shared UNION ALL SELECT step, frame, shared FROM r
""")
def registration_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by how many known tracks they see, two suppliers' frames as the seed."""
    from tracklattice.operators.texturing import registration_order
    from tracklattice.queries.registry import table

    seen = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("frame"), F.col("l_partkey").alias("track_id"))
    return registration_order(seen, (0, 1), 2)


@query("SELECT user_id, count(*) AS pairs, round(avg(value / (value + 100)), 6) AS mean_match_ratio FROM events GROUP BY user_id")
def redundancy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mean match ratio, matches over the fewer key points, of a frame's relations."""
    from tracklattice.queries.registry import table

    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(v / F.least(v + 100, v + 200)), 6).alias("mean_match_ratio"))
