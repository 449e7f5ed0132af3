"""Window, ordered and sequential operators, sorts and limits (sections G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.operators import asof, mesh, selection
from tracklattice.queries.registry import CLOUD, EVENTS, cloud, events, query, rounded, table


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS delta FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, (sum(delta) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, delta ROWS UNBOUNDED PRECEDING) - delta)::BIGINT AS dts FROM d
""")
def dts_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, G1: decode times as an exclusive running sum of deltas."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "delta").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("delta"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", (F.sum("delta").over(w) - F.col("delta")).alias("dts"))


@query(f"""
WITH e AS (SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM ({EVENTS})), s AS (SELECT user_id, t, sum((coalesce(d, 0) > 36000)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM e)
SELECT user_id, session::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 3) AS span FROM s GROUP BY ALL
""")
def session_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 in batch: a new segment after a gap of ten hours."""
    s = selection.sessions(events(spark, sf_dir), "user_id", "t", "event_id", 36000.0)
    return rounded(s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span")), 3, "span")


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ({EVENTS})),
k AS (SELECT user_id, event_id, t, i FROM e WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.t, n.i FROM k, LATERAL (SELECT * FROM e WHERE e.user_id = k.user_id AND e.i > k.i AND e.t - k.t >= 21600 ORDER BY e.i LIMIT 1) n)
SELECT user_id, event_id, round(t, 3) AS t FROM k
""")
def keyframes_time_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least six hours after the last one kept."""
    return rounded(selection.time_gated(events(spark, sf_dir), "user_id", "t", "event_id", 21600.0), 3, "t")


@query(f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ({EVENTS})),
r AS (SELECT user_id, event_id, i, t AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN o.t - r.last > 90000 THEN o.t ELSE r.last END, o.t - r.last > 90000 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, round(last, 3) AS t FROM r WHERE kept
""")
def near_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records no more than a distance after the last one kept go; here 25 hours, and each event is offered twice."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("stream_id"), "t", F.col("event_id").alias("record_index"))
    twice = e.unionByName(e.withColumn("record_index", F.col("record_index") + 10**12))
    return rounded(asof.without_near_repeats(twice, 90000.0).select(F.col("stream_id").alias("user_id"), F.col("record_index").alias("event_id"), "t"), 3, "t")


@query(f"""
WITH RECURSIVE f AS (SELECT user_id, event_id, t, event_type <> 'error' AS decoded, value > 250 AS severe, 1 - event_id % 10 / 10 > 0.6 AND event_id % 3 <> 1 AS risky, 1 - event_id % 7 / 7 AS novelty, event_id % 11 = 0 AS dynamic, event_id % 5 AS x, event_id % 3 AS y, radians(event_id % 36 * 5.5) AS turn, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ({EVENTS})),
u AS (SELECT *, CASE WHEN NOT decoded THEN 'UNSAFE_DECODE_FAILURE' WHEN severe THEN 'UNSAFE_SEVERELY_DEGRADED' WHEN risky THEN 'DYNAMIC_RISK_EXCLUSION' END AS unsafe FROM f),
v AS (SELECT *, count(*) FILTER (unsafe IS NULL) OVER (PARTITION BY user_id) AS safe, coalesce(min(i) FILTER (decoded) OVER (PARTITION BY user_id), 0) AS spare, max(i) OVER (PARTITION BY user_id) AS final FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n, count(*) OVER (PARTITION BY user_id) AS offers FROM v WHERE CASE WHEN safe > 0 THEN unsafe IS NULL ELSE i = spare END),
r AS (SELECT user_id, i, n, t AS pt, x AS px, y AS py, turn AS pturn, CASE WHEN safe = 0 THEN 'FALLBACK' WHEN i = 0 THEN 'INITIAL_ANCHOR' ELSE 'INITIAL_BOUNDARY_FALLBACK' END AS reason, 1.0::DOUBLE AS gain, true AS chosen FROM o WHERE n = 1
  UNION ALL SELECT user_id, i, n, CASE WHEN ok THEN t ELSE pt END, CASE WHEN ok THEN x ELSE px END, CASE WHEN ok THEN y ELSE py END, CASE WHEN ok THEN turn ELSE pturn END, why, worth, ok FROM (
    SELECT *, CASE WHEN dt < 600 THEN 'BELOW_MIN_TEMPORAL_SPACING' WHEN dt >= 86400 THEN 'TEMPORAL_GAP_COVERAGE' WHEN moved >= 2 THEN 'TRAJECTORY_DIVERSITY' WHEN angle >= 10 THEN 'ORIENTATION_DIVERSITY' WHEN novelty >= 0.4 THEN 'FEATURE_NOVELTY' ELSE 'HIGH_REDUNDANCY' END AS why, why NOT IN ('BELOW_MIN_TEMPORAL_SPACING', 'HIGH_REDUNDANCY') AS ok,
      CASE WHEN dt < 600 THEN 0 ELSE greatest(0, 0.35 * least(1, dt / 86400) + 0.3 * least(1, moved / 4) + 0.2 * least(1, angle / 20) + 0.15 * novelty - CASE WHEN dynamic THEN 0.2 ELSE 0 END) END AS worth
    FROM (SELECT o.user_id, o.i, o.n, o.t, o.x, o.y, o.turn, o.novelty, o.dynamic, r.pt, r.px, r.py, r.pturn, o.t - r.pt AS dt, sqrt(((o.x - r.px) ** 2 + (o.y - r.py) ** 2)::DOUBLE) AS moved, degrees(2 * acos(least(1, abs(cos(o.turn) * cos(r.pturn) + sin(o.turn) * sin(r.pturn))))) AS angle FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))),
d AS (SELECT v.user_id, v.event_id, v.i, v.t, v.unsafe, v.final, o.n, o.offers, r.chosen, r.reason, r.gain, o.n > 1 AND o.n = o.offers AND NOT r.chosen AS anchor FROM v LEFT JOIN o ON o.user_id = v.user_id AND o.i = v.i LEFT JOIN r ON r.user_id = v.user_id AND r.i = v.i)
SELECT printf('u%04d', user_id) AS video_id, printf('e%08d', event_id) AS frame_id, i AS frame_index, round(t, 3) AS t, CASE WHEN chosen OR anchor THEN 'SELECTED' ELSE 'REJECTED' END AS decision, CASE WHEN anchor THEN CASE WHEN i = final THEN 'FINAL_ANCHOR' ELSE 'FINAL_BOUNDARY_FALLBACK' END ELSE coalesce(reason, unsafe) END AS reason, CASE WHEN anchor THEN 1 ELSE round(coalesce(gain, 0), 4) END::DOUBLE AS gain FROM d
""")
def keyframes_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy marginal gain over each user's events as frames. Headings are 11 degrees apart, none at the threshold of 10."""
    out = selection.select_keyframes(keyframe_candidates(spark, sf_dir), selection.KeyframeConfig(least_spacing=600.0, most_gap=86400.0, least_baseline=2.0))
    return rounded(rounded(out, 3, "t"), 4, "gain")


def keyframe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    i, v = F.col("event_id"), F.col("value")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long") - 1
    angle = F.radians((i % 36).cast("double") * 5.5)
    return e.select(F.format_string("u%04d", "user_id").alias("video_id"), F.format_string("e%08d", "event_id").alias("frame_id"), index.alias("frame_index"), "t", (F.col("event_type") != "error").alias("decoded"), (v > 250).alias("severe"), (i % 10 / 10).alias("static_fraction"), F.when(i % 3 > 0, i % 3 * 0.1).alias("match_contamination"), (i % 7 / 7).alias("match_ratio"), (i % 11 == 0).alias("dynamic"), F.array((i % 5).cast("double"), (i % 3).cast("double"), F.lit(0.0)).alias("place"), F.array(F.cos(angle), F.lit(0.0), F.lit(0.0), F.sin(angle)).alias("quat"))


@query(f"""
WITH RECURSIVE c AS (SELECT label AS atlas, id AS chart, floor(abs(x) * 100)::INT + 4 AS w, floor(abs(y) * 100)::INT + 4 AS h FROM ({CLOUD})),
o AS (SELECT *, row_number() OVER (PARTITION BY atlas ORDER BY h DESC, w DESC, chart) AS i FROM c),
r AS (SELECT atlas, chart, i, 0 AS x, 0 AS y, w AS filled, h AS high FROM o WHERE i = 1
  UNION ALL SELECT o.atlas, o.chart, o.i, CASE WHEN r.filled + o.w > 128 THEN 0 ELSE r.filled END, CASE WHEN r.filled + o.w > 128 THEN r.y + r.high ELSE r.y END, CASE WHEN r.filled + o.w > 128 THEN o.w ELSE r.filled + o.w END, CASE WHEN r.filled + o.w > 128 THEN o.h ELSE greatest(r.high, o.h) END
  FROM r JOIN o ON o.atlas = r.atlas AND o.i = r.i + 1)
SELECT atlas, chart, x, y FROM r
""")
def shelf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chart stands on its atlas' shelves."""
    c = cloud(spark, sf_dir).select(F.col("label").alias("atlas"), F.col("id").alias("chart"), (F.floor(F.abs("x") * 100) + 4).cast("int").alias("w"), (F.floor(F.abs("y") * 100) + 4).cast("int").alias("h"))
    return selection.shelves(c, 128)


@query("""
SELECT o_orderkey, array_to_string(list_filter(['NOT_METRIC', CASE WHEN NOT ok THEN 'METRIC_ALIGNMENT_FAILED' WHEN o_totalprice > 200000 OR o_orderkey % 10 / 50 > 0.15 THEN 'METRIC_SCALE_UNCERTAIN' ELSE 'METRIC_SCALE_ESTIMATED' END, CASE WHEN ok AND o_orderstatus <> 'O' THEN CASE WHEN o_orderstatus = 'F' THEN 'METRIC_SCALE_VALIDATED' ELSE 'METRIC_SCALE_UNCERTAIN' END END], lambda x: x IS NOT NULL), '>') AS history
FROM (SELECT *, o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 12 >= 4 AS ok FROM orders)
""")
def metric_state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the metric scale from estimation to validation."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    h = selection.metric_state(k % 5 > 0, k % 7 > 0, k % 12, F.col("o_totalprice") / 40000, k % 10 / 50, F.when(s != "O", s == "F"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(h, ">").alias("history"))


@query("""
WITH f AS (SELECT vec_id AS face, [vec_id, vec_id + 1, vec_id + 2] AS v FROM embeddings), e AS (SELECT face, least(v[a], v[b]) AS i, greatest(v[a], v[b]) AS j FROM f, (VALUES (1, 2), (2, 3), (3, 1)) s(a, b)),
x AS (SELECT min(face) AS a, max(face) AS b FROM e GROUP BY i, j HAVING count(*) = 2), g AS (SELECT face, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.b = f.face AND (x.a // 7) = (x.b // 7)) THEN 0 ELSE 1 END AS starts FROM f)
SELECT face, (face // 7) * 7 AS chart FROM g
""")
def chart_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts grown over shared edges with similar normals; on this strip normals change every seven faces."""
    i = F.col("id")
    c = cloud(spark, sf_dir)
    faces = c.select(i.alias("face"), i.alias("i0"), (i + 1).alias("i1"), (i + 2).alias("i2"))
    turn = F.radians((F.floor(i / 7) % 4).cast("double") * 90)
    normals = c.select(i.alias("face"), F.array(F.cos(turn), F.sin(turn), F.lit(0.0)).alias("n"))
    return mesh.charts(faces, normals, 0.7071)


@query("SELECT event_id, rank::INT AS rank FROM (SELECT event_id, row_number() OVER (ORDER BY round(value, 1), ts, event_id) AS rank FROM events) WHERE rank <= 100")
def canonical_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H4, H6 to H8: canonical order with a unique tie-break, the first hundred (a top-k report)."""
    top = table(spark, sf_dir, "events").select("event_id", F.round("value", 1).alias("v"), "ts").orderBy("v", "ts", "event_id").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("v", "ts", "event_id"))).select("event_id", "rank")


@query("SELECT l_suppkey AS a, count(*) AS matches, min(l_partkey) AS b FROM lineitem GROUP BY l_suppkey ORDER BY matches DESC, a LIMIT 10")
def pairs_by_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, H6: candidates by falling count, then id; the first ten (a top-k report)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.count(F.lit(1)).alias("matches"), F.min("l_partkey").alias("b")).orderBy(F.col("matches").desc(), "a").limit(10)


@query("SELECT event_id, event_id // 3 AS step FROM events WHERE event_id >= 30 AND event_id < 5000 AND (event_id - 30) % 3 = 0")
def frame_sub_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: a sub-range of frames with a step; the reference's operator, not a saving."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").filter((i >= 30) & (i < 5000) & ((i - 30) % 3 == 0)).select("event_id", F.floor(i / 3).alias("step"))


@query("SELECT r_name, n_name, rank::INT AS rank FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY count(*) DESC, n_name) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest of each group, ties by name."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("r_name").orderBy(F.col("n").desc(), "n_name"))).filter("rank <= 3").select("r_name", "n_name", "rank")


