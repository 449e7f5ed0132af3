"""As-of, neighbour, window, audit and spatial joins (section E), set operations (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.operators import asof, neighbours
from tracklattice.queries.registry import CLOUD, EVENTS, cloud, events, query, rounded, table

GAP = 3600.0


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    frames = e.filter("event_type = 'view'").select(F.lit(0).alias("stream_id"), "event_id", "t")
    # Of records at one time the last that has a value stands, on either side of a frame; SQL's as-of join has no order among ties.
    valued = F.when(F.col("value").isNotNull(), F.col("event_id"))
    records = e.filter("event_type = 'click' AND t IS NOT NULL").groupBy("t").agg(F.max("event_id").alias("record_index"), F.max_by("value", valued).alias("value")).withColumn("stream_id", F.lit(0))
    return frames, records


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT event_id, t FROM e WHERE event_type = 'view'),
r AS (SELECT t, max_by(value, event_id) AS value FROM e WHERE event_type = 'click' GROUP BY t),
l AS (SELECT f.event_id, f.t, r.t AS lt, r.value AS lv FROM f ASOF LEFT JOIN r ON f.t >= r.t),
b AS (SELECT l.*, r.t AS rt, r.value AS rv FROM l ASOF LEFT JOIN r ON l.t <= r.t),
s AS (SELECT *, CASE WHEN lt IS NULL OR rt IS NULL THEN 'OUT_OF_RANGE' WHEN abs(t - lt) <= 1e-4 OR abs(rt - t) <= 1e-4 THEN 'EXACT' WHEN rt - lt > {GAP} THEN 'UNSYNCHRONIZED' ELSE 'INTERPOLATED' END AS status FROM b)
SELECT event_id, status, CASE WHEN status = 'EXACT' THEN CASE WHEN abs(t - lt) <= 1e-4 THEN 0.0 ELSE 1.0 END WHEN status = 'INTERPOLATED' THEN round((t - lt) / (rt - lt), 5) END AS alpha,
  CASE WHEN status = 'EXACT' THEN round(CASE WHEN abs(t - lt) <= 1e-4 THEN lv ELSE rv END, 4) WHEN status = 'INTERPOLATED' THEN round(lv + (t - lt) / (rt - lt) * (rv - lv), 4) END AS value
FROM s
""")
def asof_bracket_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views bracketed by clicks, gap-limited, interpolated. The stream is cut into days."""
    frames, records = _sides(spark, sf_dir)
    out = asof.bracket(frames, records, asof.BracketConfig(max_gap=GAP, bucket=86400.0))
    return rounded(out.select("event_id", "status", F.round("alpha", 5).alias("alpha"), asof.carried("value").alias("value")), 4, "value")


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT user_id, event_id, t FROM e WHERE event_type <> 'click'),
r AS (SELECT user_id, t, max_by(value, event_id) AS value FROM e WHERE event_type = 'click' GROUP BY user_id, t),
l AS (SELECT f.*, r.t AS lt FROM f ASOF LEFT JOIN r ON f.user_id = r.user_id AND f.t + 120 >= r.t),
b AS (SELECT l.*, r.t AS rt FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t + 120 <= r.t),
n AS (SELECT b.*, c.n FROM b LEFT JOIN (SELECT user_id, count(*) AS n FROM r GROUP BY user_id) c ON b.user_id = c.user_id),
s AS (SELECT user_id, CASE WHEN n IS NULL THEN 'UNSYNCHRONIZED' WHEN lt IS NULL OR rt IS NULL THEN 'EXTRAPOLATED' WHEN t + 120 - lt <= 60 OR rt - t - 120 <= 60 THEN 'OFFSET_APPLIED' WHEN rt - lt > 200000 THEN 'UNSYNCHRONIZED' ELSE 'INTERPOLATED' END AS status FROM n)
SELECT user_id, status, count(*) AS n FROM s GROUP BY user_id, status
""")
def asof_by_user_offset_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 per stream with a clock offset of 120 s, held ends and a one-minute exact tolerance."""
    e = events(spark, sf_dir)
    frames = e.filter("event_type <> 'click'").select(F.col("user_id").alias("stream_id"), "event_id", "t")
    records = e.filter("event_type = 'click'").select(F.col("user_id").alias("stream_id"), "t", F.col("event_id").alias("record_index"), "value")
    out = asof.bracket(frames, records, asof.BracketConfig(max_gap=200000.0, exact=60.0, extrapolate=True, offset=120.0))
    return out.groupBy(F.col("stream_id").alias("user_id"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH e AS ({EVENTS}), f AS (SELECT event_id, t FROM e WHERE event_type = 'purchase'),
r AS (SELECT t, max(event_id) AS hit FROM e WHERE event_type = 'view' GROUP BY t),
l AS (SELECT f.*, r.t AS lt, r.hit AS lh FROM f ASOF LEFT JOIN r ON f.t >= r.t),
b AS (SELECT l.*, r.t AS rt, r.hit AS rh FROM l ASOF LEFT JOIN r ON l.t <= r.t),
d AS (SELECT event_id, CASE WHEN rt IS NULL OR t - lt <= rt - t THEN lh ELSE rh END AS hit, least(coalesce(t - lt, 1e18), coalesce(rt - t, 1e18)) AS distance FROM b)
SELECT event_id, CASE WHEN distance <= 600 THEN hit END AS hit_id, CASE WHEN distance <= 600 THEN round(distance, 4) END AS distance FROM d
""")
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's nearest view within ten minutes. The stream is cut into days."""
    e = events(spark, sf_dir).withColumn("stream_id", F.lit(0))
    frames = e.filter("event_type = 'purchase'").select("stream_id", "event_id", "t")
    records = e.filter("event_type = 'view'").select("stream_id", "t", F.col("event_id").alias("record_index"))
    return rounded(asof.nearest(frames, records, 600.0, bucket=86400.0).select("event_id", F.col("hit.record_index").alias("hit_id"), "distance"), 4, "distance")


@query(f"""
WITH e AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ({EVENTS})),
p AS (SELECT b.user_id, (b.i - a.i)::INT AS steps, a.event_id AS a_event_id, b.event_id AS b_event_id, b.t - a.t AS dt FROM e a JOIN e b ON a.user_id = b.user_id AND a.i BETWEEN b.i - 5 AND b.i - 1)
SELECT user_id, steps, a_event_id, b_event_id, round(dt, 4) AS dt FROM p
""")
def row_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the user's five before it."""
    out = neighbours.row_pairs(events(spark, sf_dir), 5, ("user_id",), ("t", "event_id"), ("event_id", "t"))
    return rounded(out.select("user_id", "steps", "a_event_id", "b_event_id", (F.col("b_t") - F.col("a_t")).alias("dt")), 4, "dt")


@query(f"""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ({EVENTS}))
SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id, (b.i - a.i)::INT AS skip FROM e a JOIN e b ON a.user_id = b.user_id AND b.i IN (a.i + 1, a.i + 2)
""")
def skip_pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs i with i+1 and i+2."""
    out = neighbours.row_pairs(events(spark, sf_dir), 2, ("user_id",), ("t", "event_id"), ("event_id",))
    return out.select("user_id", F.col("a_event_id").alias("first_id"), F.col("b_event_id").alias("second_id"), F.col("steps").alias("skip"))


@query(f"""
WITH e AS (SELECT user_id, event_id, t, value, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, CASE WHEN t - pt > 0 AND t - pt <= 3600 THEN round(value - pv, 4) END AS back_step, CASE WHEN nt - t > 0 AND nt - t <= 3600 THEN round(nv - value, 4) END AS forward_step FROM e
""")
def neighbour_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the previous and next event within an hour."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir).select("event_id", "t", "value", *[f("t").over(w).alias(n + "t") for n, f in (("p", F.lag), ("n", F.lead))], *[f("value").over(w).alias(n + "v") for n, f in (("p", F.lag), ("n", F.lead))])
    near = lambda d: (d > 0) & (d <= 3600)
    out = e.select("event_id", F.when(near(F.col("t") - F.col("pt")), F.col("value") - F.col("pv")).alias("back_step"), F.when(near(F.col("nt") - F.col("t")), F.col("nv") - F.col("value")).alias("forward_step"))
    return rounded(out, 4, "back_step", "forward_step")


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part),
c AS (SELECT a.p_brand, a.p_partkey AS ref, b.p_partkey AS cand, abs(a.p_retailprice - b.p_retailprice) AS d, CASE WHEN abs(a.p_size - b.p_size) < 2 THEN 'BASELINE_TOO_SHORT' WHEN abs(a.p_size - b.p_size) > 20 THEN 'BASELINE_TOO_LONG' ELSE 'OK' END AS reason FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY round(1 / (1 + d), 9) DESC, cand) AS rank FROM c WHERE reason = 'OK')
SELECT ref, cand, rank::INT AS rank, round(1 / (1 + d), 6) AS score FROM k WHERE rank <= 4
""")
def topk_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs within a brand with a reject ladder, the four best of each reference.

    Candidates are met by sorted order of price: the score falls with the distance, so a group's rows are scanned as one
    array of (price, size, key), and only four a row are kept; pairs are never materialised.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p.groupBy("p_brand").applyInPandas(_best_views, "ref long, cand long, rank int, score double")


def _best_views(group):
    import numpy as np
    import pandas as pd

    key, size, price = (group[c].to_numpy() for c in ("p_partkey", "p_size", "p_retailprice"))
    out = []
    for i in range(len(key)):
        gap = np.abs(size - size[i])
        ok = np.flatnonzero((gap >= 2) & (gap <= 20) & (key != key[i]))
        score = 1 / (1 + np.abs(price[ok] - price[i]))
        best = np.lexsort((key[ok], -np.round(score, 9)))[:4]
        out += [(key[i], key[ok[j]], r + 1, round(float(score[j]), 6)) for r, j in enumerate(best)]
    return pd.DataFrame(out, columns=["ref", "cand", "rank", "score"])


@query("""
WITH f AS (SELECT label AS frame, vec_id AS idx, embedding::DOUBLE[] AS d FROM embeddings),
p AS (SELECT a.frame AS frame_a, b.frame AS frame_b, a.idx AS idx_a, b.idx AS idx_b, list_sum(list_transform(range(1, 65), lambda i: (a.d[i] - b.d[i]) ** 2)) AS x FROM f a JOIN f b ON b.frame = a.frame + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY frame_a, idx_a ORDER BY x, idx_b) AS ra, lead(x) OVER (PARTITION BY frame_a, idx_a ORDER BY x, idx_b) AS xa, row_number() OVER (PARTITION BY frame_b, idx_b ORDER BY x, idx_a) AS rb, lead(x) OVER (PARTITION BY frame_b, idx_b ORDER BY x, idx_a) AS xb FROM p)
SELECT frame_a, frame_b, idx_a, idx_b, round(x, 6) AS distance FROM n WHERE ra = 1 AND rb = 1 AND x <= 0.95 * 0.95 * xa AND x <= 0.95 * 0.95 * xb
""")
def knn_ratio_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest descriptors of adjacent frames (labels), ratio test, both ways."""
    f = table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("descriptor"))
    frames = f.select("frame").distinct()
    pairs = frames.select(F.col("frame").alias("frame_a"), (F.col("frame") + 1).alias("frame_b")).join(frames.withColumnRenamed("frame", "frame_b"), "frame_b", "left_semi").select("frame_a", "frame_b")
    return rounded(neighbours.descriptor_matches(f, pairs, ratio=0.95), 6, "distance")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = cloud(spark, sf_dir)
    return c.filter("label < 5"), c.filter("label >= 5")


_NN = f"""
c AS ({CLOUD}), p AS (SELECT * FROM c WHERE label < 5), q AS (SELECT * FROM c WHERE label >= 5),
m AS (SELECT p.id AS pid, q.id AS qid, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM p, q),
fwd AS (SELECT pid AS id, min(d) AS d FROM m GROUP BY pid), bwd AS (SELECT qid AS id, min(d) AS d FROM m GROUP BY qid)
"""


@query(f"WITH {_NN} SELECT pid AS id, first(qid ORDER BY d, qid) AS reference_id, round(min(d), 6) AS distance FROM m GROUP BY pid")
def nn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest point of the other cloud, by rings of grid cells."""
    p, q = _halves(spark, sf_dir)
    return rounded(neighbours.nearest(p, q, 0.05), 6, "distance")


@query(f"""
WITH {_NN}, b AS (SELECT d FROM fwd UNION ALL SELECT d FROM bwd)
SELECT round((SELECT avg(d) FROM fwd) / 2 + (SELECT avg(d) FROM bwd) / 2, 6) AS chamfer, round((SELECT max(d) FROM fwd), 6) AS hausdorff_forward, round((SELECT max(d) FROM bwd), 6) AS hausdorff_backward,
  round(max(d), 6) AS hausdorff, round(quantile_cont(d, 0.95), 6) AS hausdorff95,
  round((SELECT avg((d <= 0.08)::INT) FROM fwd), 6) AS precision_at, round((SELECT avg((d <= 0.08)::INT) FROM bwd), 6) AS recall_at,
  round(2 * (SELECT avg((d <= 0.08)::INT) FROM fwd) * (SELECT avg((d <= 0.08)::INT) FROM bwd) / ((SELECT avg((d <= 0.08)::INT) FROM fwd) + (SELECT avg((d <= 0.08)::INT) FROM bwd)), 6) AS f1 FROM b
""")
def cloud_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chamfer, Hausdorff, precision, recall and F1 between two clouds."""
    from tracklattice.operators.metrology import compare_clouds

    p, q = _halves(spark, sf_dir)
    out = compare_clouds(p, q, first_cell=0.05, tau=0.08)
    return rounded(out, 6, *out.columns)


@query(f"WITH {_NN} SELECT count(*) AS n_reference, count(*) FILTER (d <= 0.08) AS n_complete, round(avg((d <= 0.08)::INT), 6) AS completeness FROM bwd")
def reference_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of reference points with a reconstructed point within a radius, by semi-join."""
    from tracklattice.operators.metrology import completeness

    p, q = _halves(spark, sf_dir)
    return rounded(completeness(p, q, 0.08), 6, "completeness")


@query(f"""
WITH c AS ({CLOUD}), o AS (SELECT label AS frame, id AS track_id, x * 100 AS u, y * 100 AS v FROM c WHERE id % 2 = 0), f AS (SELECT label AS frame, id AS idx, x * 100 AS u, y * 100 AS v FROM c WHERE id % 2 = 1),
d AS (SELECT o.frame, track_id, idx, sqrt((o.u - f.u) ** 2 + (o.v - f.v) ** 2) AS distance FROM o JOIN f ON o.frame = f.frame)
SELECT frame, track_id, first(idx ORDER BY distance, idx) AS idx, round(min(distance), 6) AS distance FROM d WHERE distance < 1.5 GROUP BY frame, track_id
""")
def feature_radius_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations and the nearest feature of their frame within 1.5 pixels."""
    c = cloud(spark, sf_dir).select(F.col("label").alias("frame"), "id", (F.col("x") * 100).alias("u"), (F.col("y") * 100).alias("v"))
    out = neighbours.nearest_in_frame(c.filter("id % 2 = 0").withColumnRenamed("id", "track_id"), c.filter("id % 2 = 1").withColumnRenamed("id", "idx"))
    return rounded(out, 6, "distance")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS estimate FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (estimate IS NULL) AS missing, round(avg(abs(estimate - o_totalprice) / o_totalprice), 6) AS mean_relative, round(sqrt(avg((estimate - o_totalprice) ** 2)), 3) AS rmse FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY o_orderpriority
""")
def checkpoint_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference totals against estimates from their lines; orders without lines are counted, not dropped."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("estimate"))
    j = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    d = F.col("estimate") - F.col("o_totalprice")
    out = j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("estimate").isNull()).alias("missing"), F.avg(F.abs(d) / F.col("o_totalprice")).alias("mean_relative"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return rounded(rounded(out, 6, "mean_relative"), 3, "rmse")


@query("""
SELECT o_orderkey AS segment_id, round(abs(c_acctbal - s_acctbal), 4) AS measured, round(abs(abs(c_acctbal - s_acctbal) - o_totalprice) / o_totalprice, 6) AS relative_error
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey JOIN supplier ON k = s_suppkey
""")
def segment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined to both their end markers, length against reference."""
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k"))
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(ends, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("k") == F.col("s_suppkey"))
    m = F.abs(F.col("c_acctbal") - F.col("s_acctbal"))
    return j.select(F.col("o_orderkey").alias("segment_id"), F.round(m, 4).alias("measured"), F.round(F.abs(m - F.col("o_totalprice")) / F.col("o_totalprice"), 6).alias("relative_error"))


@query("""
WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'estimation' WHEN 1 THEN 'calibration' ELSE 'validation' END AS role FROM customer UNION ALL SELECT c_custkey, 'validation' FROM customer WHERE c_custkey % 50 = 0),
p AS (SELECT a.role AS role_a, b.role AS role_b, count(DISTINCT a.id) AS shared FROM r a JOIN r b ON a.id = b.id AND a.role < b.role GROUP BY a.role, b.role)
SELECT role_a, role_b, shared, shared = 0 AS disjoint FROM (SELECT x.a AS role_a, x.b AS role_b, coalesce(p.shared, 0) AS shared FROM (VALUES ('calibration', 'estimation'), ('calibration', 'validation'), ('estimation', 'validation')) x(a, b) LEFT JOIN p ON p.role_a = x.a AND p.role_b = x.b)
""")
def partition_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two roles of a partition share, for all pairs of roles."""
    from tracklattice.operators.audits import disjointness

    k = F.col("c_custkey")
    roles = F.when(k % 3 == 0, F.lit("estimation")).when(k % 3 == 1, "calibration").otherwise("validation")
    r = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(F.when(k % 50 == 0, F.array(roles, F.lit("validation"))).otherwise(F.array(roles))).alias("role"))
    return disjointness(r, ("calibration", "estimation", "validation"))


@query("""
WITH x AS (SELECT o_orderkey AS id FROM orders), y AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber >= 2 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 100 = 0)
SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'SPURIOUS' ELSE 'MISSING' END AS finding FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL
UNION ALL SELECT l_orderkey, 'DUPLICATE' FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY l_orderkey
""")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed against reported runs, both differences and duplicates."""
    from tracklattice.operators.audits import completeness

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    reported = lines.filter("l_linenumber >= 2").select(F.col("l_orderkey").alias("id")).distinct().unionByName(orders.filter("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("id")))
    twice = lines.groupBy("l_orderkey", "l_partkey").count().filter("count > 1").select(F.col("l_orderkey").alias("id")).distinct().withColumn("finding", F.lit("DUPLICATE"))
    return completeness(orders.select(F.col("o_orderkey").alias("id")), reported).unionByName(twice)


@query(r"""
WITH b AS (SELECT item_id, sha256(trim(lower(text))) AS h FROM benchmark), d AS (SELECT doc_id, sha256(trim(lower(text))) AS h FROM documents)
SELECT 'key' AS overlap, count(*) AS n FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark) UNION ALL SELECT 'checksum', count(*) FROM d WHERE h IN (SELECT h FROM b) UNION ALL SELECT 'label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def input_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that inputs and evaluation share, by key, by checksum and labels without documents."""
    docs, bench, labels = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    h = F.sha2(F.trim(F.lower("text")).cast("binary"), 256)
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("overlap"), "n")
    key = docs.join(bench, F.col("doc_id") == F.col("item_id"), "left_semi")
    checksum = docs.select(h.alias("h")).join(bench.select(h.alias("h")), "h", "left_semi")
    return n(key, "key").unionByName(n(checksum, "checksum")).unionByName(n(labels.join(docs, "doc_id", "left_anti"), "label"))


_BOXES = f"b AS (SELECT id, label AS frame, (x + 1) * 100 AS x0, (y + 1) * 100 AS y0, (x + 1) * 100 + 20 + abs(z) * 60 AS x1, (y + 1) * 100 + 15 + abs(z) * 40 AS y1 FROM ({CLOUD}))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("x") + 1) * 100, (F.col("y") + 1) * 100
    return cloud(spark, sf_dir).select("id", F.col("label").alias("frame"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.abs("z") * 60).alias("x1"), (y0 + 15 + F.abs("z") * 40).alias("y1"))


@query(f"""
WITH {_BOXES}, t AS (SELECT r, c FROM range(6) a(r), range(8) e(c))
SELECT frame, r::INT AS tile_row, c::INT AS tile_column, count(*) AS regions FROM b JOIN t ON x0 < (c + 1) * 25 AND x1 > c * 25 AND y0 < (r + 1) * 25 AND y1 > r * 25 GROUP BY frame, r, c
""")
def region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by the tiles of a 6 x 8 raster that they overlap."""
    out = neighbours.overlapping_tiles(_boxes(spark, sf_dir), 6, 8, 200.0, 150.0)
    return out.groupBy("frame", "tile_row", "tile_column").agg(F.count(F.lit(1)).alias("regions"))


@query(f"""
WITH {_BOXES}, p AS (SELECT id, label AS frame, (x + 1) * 100 AS u, (y + 1) * 100 + 45 AS v FROM ({CLOUD}))
SELECT frame, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM b WHERE b.frame = p.frame AND u BETWEEN x0 AND x1 AND v BETWEEN y0 AND y1))::INT), 6) AS inside_fraction FROM p GROUP BY frame
""")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a frame's points that any of its boxes holds."""
    p = cloud(spark, sf_dir).select("id", F.col("label").alias("frame"), ((F.col("x") + 1) * 100).alias("u"), ((F.col("y") + 1) * 100 + 45).alias("v"))
    out = neighbours.inside_any_box(p, _boxes(spark, sf_dir), "frame", 25.0)
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("inside").cast("int")), 6).alias("inside_fraction"))


@query(f"""
WITH v AS (SELECT id, floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, floor(z / 0.1)::BIGINT AS k FROM ({CLOUD}))
SELECT a.id, count(*) AS neighbours FROM v a JOIN v b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY a.id
""")
def voxel_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the 27 voxels around each point, from counts by voxel."""
    c = cloud(spark, sf_dir).select("id", *[neighbours.cell(F.col(a), 0.1).alias(n) for a, n in zip("xyz", "ijk", strict=True)])
    counts = c.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))
    for n in "ijk":
        counts = counts.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    around = counts.groupBy("i", "j", "k").agg(F.sum("n").alias("neighbours"))
    return c.join(around, ["i", "j", "k"]).select("id", "neighbours")


@query("""
WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey), u AS (SELECT a AS node, b AS neighbour, false AS reversed FROM e UNION ALL SELECT b, a, true FROM e)
SELECT node, count(DISTINCT neighbour) AS degree, count(*) FILTER (reversed) AS reversed_edges, min(neighbour) AS first_neighbour, max(neighbour) AS last_neighbour FROM u GROUP BY node
""")
def match_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of an undirected graph, with a flag for edges read backwards."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).filter("a <> b").distinct()
    u = e.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), F.lit(False).alias("reversed")).unionByName(e.select(F.col("b"), F.col("a"), F.lit(True)).toDF("node", "neighbour", "reversed"))
    return u.groupBy("node").agg(F.count_distinct("neighbour").alias("degree"), F.count_if("reversed").alias("reversed_edges"), F.min("neighbour").alias("first_neighbour"), F.max("neighbour").alias("last_neighbour"))


_FACES = "f AS (SELECT id AS face, [id, id + 1 + id % 3, id + 4] AS v FROM (SELECT vec_id AS id FROM embeddings)), e AS (SELECT face, least(v[a], v[b]) AS i, greatest(v[a], v[b]) AS j FROM f, (VALUES (1, 2), (2, 3), (3, 1)) s(a, b))"


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(i.alias("face"), i.alias("i0"), (i + 1 + i % 3).alias("i1"), (i + 4).alias("i2"))


@query(f"WITH {_FACES} SELECT min(face) AS face_a, max(face) AS face_b, i, j FROM e GROUP BY i, j HAVING count(*) = 2")
def face_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces that share an edge of exactly two."""
    from tracklattice.operators.mesh import adjacency

    return adjacency(_faces(spark, sf_dir))


@query(f"WITH {_FACES} SELECT i, j, min(face) AS face FROM e GROUP BY i, j HAVING count(*) = 1")
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges of one face only."""
    from tracklattice.operators.mesh import boundary

    return boundary(_faces(spark, sf_dir))


_DEPTH = f"d AS (SELECT label AS frame, floor((x + 1) * 10)::INT AS r, floor((y + 1) * 40)::INT AS c, avg(2 + z) AS depth FROM ({CLOUD}) GROUP BY ALL)"


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).groupBy(F.col("label").alias("frame"), F.floor((F.col("x") + 1) * 10).cast("int").alias("r"), F.floor((F.col("y") + 1) * 40).cast("int").alias("c")).agg(F.avg(2 + F.col("z")).alias("depth"))


@query(f"""
WITH {_DEPTH}, p AS (SELECT *, round_even(c + 6 / depth, 0)::INT AS sc FROM d)
SELECT p.frame, p.r, p.c, s.c AS source_c, round(abs(s.depth - p.depth) / p.depth, 6) AS relative FROM p JOIN d s ON s.frame = p.frame + 1 AND s.r = p.r AND s.c = p.sc WHERE abs(s.depth - p.depth) / p.depth <= 0.1 AND abs(s.c - 6 / s.depth - p.c) <= 1
""")
def depth_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths warped into the next view, compared there and warped back."""
    from tracklattice.operators.stereo import depth_consistency as consistent

    return rounded(consistent(_raster(spark, sf_dir), 6.0, 0.1, 1.0), 6, "relative")


@query(f"""
WITH {_DEPTH}, g AS (SELECT frame, r, c, 6 / depth AS disparity FROM d)
SELECT a.frame, a.r, a.c, round(a.disparity, 6) AS disparity, b.disparity IS NOT NULL AS matched, coalesce(abs(a.disparity - b.disparity) <= 1, false) AS consistent FROM g a LEFT JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = round_even(a.c - a.disparity, 0)::INT
""")
def left_right_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disparities checked against the other view's at the pixel that they point to."""
    from tracklattice.operators.stereo import left_right

    d = _raster(spark, sf_dir).select("frame", "r", "c", (6 / F.col("depth")).alias("disparity"))
    return rounded(left_right(d, 1.0), 6, "disparity")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_quantity FROM lineitem), p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS i FROM lineitem)
SELECT l.l_orderkey, l.i::INT AS i, l.l_quantity, p.l_partkey FROM l JOIN p ON l.l_orderkey = p.l_orderkey AND l.i = p.i
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences of a group joined by position."""
    li = table(spark, sf_dir, "lineitem")
    at = lambda *o: (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*o)) - 1).alias("i")
    return li.select("l_orderkey", at("l_linenumber", "l_partkey", "l_suppkey"), "l_quantity").join(li.select("l_orderkey", at("l_partkey", "l_suppkey", "l_linenumber"), "l_partkey"), ["l_orderkey", "i"])


@query("""
SELECT c_custkey, n_name, r_name, quality.n AS orders, c_acctbal >= 0 AS in_credit FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) quality ON o_custkey = c_custkey
""")
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: left joins of small dimensions and an aggregate; what is missing stays null."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", "r_name", "orders", (F.col("c_acctbal") >= 0).alias("in_credit"))


@query("""
WITH a AS (SELECT DISTINCT user_id, event_type FROM events), b AS (SELECT DISTINCT user_id, 'view' AS event_type FROM events WHERE value > 400)
SELECT 'first_only' AS side, user_id, event_type FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second_only', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences both ways, intersection, union of tagged sets."""
    e = table(spark, sf_dir, "events")
    a, b = e.select("user_id", "event_type").distinct(), e.filter("value > 400").select("user_id", F.lit("view").alias("event_type")).distinct()
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "user_id", "event_type")
    return tag(a.exceptAll(b), "first_only").unionByName(tag(b.exceptAll(a), "second_only")).unionByName(tag(a.intersect(b), "both"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join and the five-figure summary of its brackets, by status."""
    from tracklattice.operators.summaries import error_summary

    frames, records = _sides(spark, sf_dir)
    out = asof.bracket(frames, records, asof.BracketConfig(max_gap=GAP, bucket=86400.0))
    return error_summary(out.filter("gap is not null"), F.col("gap"), "status")


