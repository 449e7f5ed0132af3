"""Segment scale, dense points, configuration rules and the kernels of reconstruction, on scenes of known geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import rotation
from tracklattice.operators import geometry, metrology, policy, stereo, surface
from tracklattice.queries.registry import CLOUD, cloud, query, rounded, table
from tracklattice.queries.aggregates import _PIXELS, _pixels

_FIVE = ["mae", "rmse", "median", "p95", "max"]


@query(f"""
WITH c AS ({CLOUD}), s AS (SELECT a.id % 5 AS part, a.id AS segment_id, b.x - a.x AS x, b.y - a.y AS y, CASE WHEN a.id % 5 = 1 THEN 0 ELSE b.z - a.z END AS z, 0.5 + a.id % 7 / 10 AS reference, b.id IS NULL AS missing FROM c a LEFT JOIN c b ON b.id = a.id + CASE WHEN a.id % 5 = 2 THEN 0 ELSE 1 END WHERE a.id % 5 < 4),
l AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM s), u AS (SELECT part, missing, abs(n - reference) AS off, abs(n - reference) / reference AS rel, CASE WHEN n > 1e-9 THEN x / n END AS ux, CASE WHEN n > 1e-9 THEN y / n END AS uy, CASE WHEN n > 1e-9 THEN z / n END AS uz FROM l)
SELECT part, count(*) AS segments, count(*) FILTER (missing) AS missing, part <> 2 AS non_collinear, CASE WHEN count(*) FILTER (missing) > 0 THEN 'MISSING_MARKER' WHEN part = 2 THEN 'COLLINEAR' ELSE 'OK' END AS status,
  round(avg(rel) FILTER (part <> 2), 6) AS rel_mae, round(sqrt(avg(rel * rel) FILTER (part <> 2)), 6) AS rel_rmse, round(median(rel) FILTER (part <> 2), 6) AS rel_median, round(quantile_cont(rel, 0.95) FILTER (part <> 2), 6) AS rel_p95, round(max(rel) FILTER (part <> 2), 6) AS rel_max,
  round(avg(off) FILTER (part <> 2), 6) AS off_mae, round(sqrt(avg(off * off) FILTER (part <> 2)), 6) AS off_rmse, round(median(off) FILTER (part <> 2), 6) AS off_median, round(quantile_cont(off, 0.95) FILTER (part <> 2), 6) AS off_p95, round(max(off) FILTER (part <> 2), 6) AS off_max
FROM u GROUP BY part HAVING count(*) FILTER (missing) = 0
""")
def segment_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """errors of measured segments, refused where their directions are collinear (part 2 has no directions at all)."""
    c = cloud(spark, sf_dir)
    flat = F.col("id") % 5 == 1
    # Part 1 lies in a plane: its second markers are copies of its own with the first one's height.
    nxt = c.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    ends = c.filter("id % 5 < 4").join(nxt, "id", "left")
    own = F.col("id") % 5 == 2
    markers = ends.select((F.col("id") * 2).alias("marker"), "x", "y", "z")
    other = ends.select((F.col("id") * 2 + 1).alias("marker"), F.when(own, F.col("x")).otherwise(F.col("bx")).alias("x"), F.when(own, F.col("y")).otherwise(F.col("by")).alias("y"), F.when(own | flat, F.col("z")).otherwise(F.col("bz")).alias("z")).filter("x is not null")
    segments = ends.select((F.col("id") % 5).alias("part"), F.col("id").alias("segment_id"), (F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"), (0.5 + F.col("id") % 7 / 10).alias("reference"))
    out = metrology.segment_scale(segments, markers.unionByName(other), "part")
    return rounded(out.filter("missing = 0"), 6, *[f"{c}_{k}" for c in ("rel", "off") for k in _FIVE])


_DENSE = f"SELECT frame, row, col, v, (row + col) % 11 = 0 AS masked, CASE WHEN (row * col) % 13 = 5 THEN 0.0 ELSE 4.0 + v / 32 END AS disparity, CASE WHEN (row + 2 * col) % 17 = 3 THEN -1.0 WHEN (row + 2 * col) % 17 = 4 THEN 150.0 ELSE 1.0 + v / 16 END AS depth, v % 64 / 64 AS confidence, CASE WHEN (row + frame) % 9 = 0 THEN 'OCCLUDED' ELSE 'VALID' END AS visibility FROM ({_PIXELS})"


@query(f"""
WITH p AS ({_DENSE}), r AS (SELECT *, CASE WHEN masked THEN 'MASKED_OUT' WHEN disparity <= 0 THEN 'INVALID_DISPARITY' WHEN depth <= 1e-6 THEN 'INVALID_DEPTH_VALUE' WHEN depth < 0.5 OR depth > 100 THEN 'OUT_OF_DEPTH_BOUNDS' WHEN confidence < 0.2 THEN 'LOW_CONFIDENCE' WHEN visibility = 'OCCLUDED' THEN 'OCCLUDED_OR_INCONSISTENT' ELSE 'VALIDATED' END AS reason,
  0.96 * depth * (col - 30) / 50 - 0.28 * depth AS ox, depth * (row - 20) / 60 - 1 AS oy, 0.28 * depth * (col - 30) / 50 + 0.96 * depth - frame AS oz FROM p)
SELECT frame, reason, count(*) AS n, round(avg(CASE WHEN reason = 'VALIDATED' THEN 0.8 * ox + 0.6 * oy END), 6) AS x, round(avg(CASE WHEN reason = 'VALIDATED' THEN -0.6 * ox + 0.8 * oy END), 6) AS y, round(avg(CASE WHEN reason = 'VALIDATED' THEN oz END), 6) AS z, round(avg(CASE WHEN reason = 'VALIDATED' THEN confidence END), 6) AS confidence FROM r GROUP BY frame, reason
""")
def dense_point_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: every pixel of a rectified depth raster to a world point or its reason, by frame; the pose moves with the frame."""
    p, at = _pixels(spark, sf_dir), F.col("row") + 2 * F.col("col")
    p = p.select("frame", F.col("col").cast("double").alias("u"), F.col("row").cast("double").alias("v"), ((F.col("row") + F.col("col")) % 11 == 0).alias("masked"), F.when(F.col("row") * F.col("col") % 13 == 5, 0.0).otherwise(4.0 + F.col("v") / 32).alias("disparity"), F.when(at % 17 == 3, -1.0).when(at % 17 == 4, 150.0).otherwise(1.0 + F.col("v") / 16).alias("depth"), (F.col("v") % 64 / 64).alias("confidence"), F.when((F.col("row") + F.col("frame")) % 9 == 0, "OCCLUDED").otherwise("VALID").alias("visibility"))
    rect, pose = rotation.vector(0.96, 0, 0.28, 0, 1, 0, -0.28, 0, 0.96), rotation.vector(0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1)
    out = stereo.dense_points(p, rect, pose, F.array(F.lit(0.0), F.lit(1.0), F.col("frame").cast("double")), (50.0, 60.0, 30.0, 20.0))
    good = lambda c: F.avg(F.when(F.col("reason").isNull(), c))
    out = out.groupBy("frame", F.coalesce("reason", F.lit("VALIDATED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), *[good(F.col("world")[i]).alias(a) for i, a in enumerate("xyz")], good(F.col("confidence")).alias("confidence"))
    return rounded(out, 6, "x", "y", "z", "confidence")


_FLAGS = ["texturing", "surface_meshing", "dense_fusion", "dense_point_generation", "dense_stereo"]


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS t, o_orderkey // 2 % 2 = 1 AS m, o_orderkey // 4 % 2 = 1 AS f, o_orderkey // 8 % 2 = 1 AS p, o_orderkey // 16 % 2 = 1 AS s FROM orders)
SELECT concat_ws('; ', CASE WHEN t AND NOT m THEN 'texturing needs surface_meshing' END, CASE WHEN p AND NOT s THEN 'dense_point_generation needs dense_stereo' END, CASE WHEN f AND NOT p THEN 'dense_fusion needs dense_point_generation' END, CASE WHEN m AND NOT f THEN 'surface_meshing needs dense_fusion' END) AS violations, count(*) AS n FROM c GROUP BY 1
""")
def config_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that are enabled without the stage they need."""
    k = F.col("o_orderkey")
    enabled = {name: F.floor(k / (1 << i)) % 2 == 1 for i, name in enumerate(_FLAGS)}
    o = table(spark, sf_dir, "orders").select(F.array_join(policy.config_violations(enabled), "; ").alias("violations"))
    return o.groupBy("violations").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH c AS (SELECT id, x * 3 AS x, y * 3 AS y, z * 3 AS z FROM ({CLOUD})), a AS (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM c), k AS (SELECT *, x / t AS kx, y / t AS ky, z / t AS kz FROM a)
SELECT id, round(cos(t) + (1 - cos(t)) * kx * kx, 6) + 0.0 AS m00, round((1 - cos(t)) * kx * ky - sin(t) * kz, 6) + 0.0 AS m01, round((1 - cos(t)) * kx * kz + sin(t) * ky, 6) + 0.0 AS m02, round(cos(t) + (1 - cos(t)) * kz * kz, 6) + 0.0 AS m22,
  round(x * least(1, (2 * pi() - t) / t * CASE WHEN t > pi() THEN 1 ELSE 1e9 END) * CASE WHEN t > pi() THEN -1 ELSE 1 END, 5) + 0.0 AS vx, round(least(t, 2), 6) AS apart, round(t * 0.3, 6) + 0.0 AS chart_x FROM k
""")
def rotation_and_direction_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation vectors to matrices and back, and the tangent chart of directions there and back."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf[["x", "y", "z"]].to_numpy(), strict=True):
                r, t = geometry.rotation_of(v), np.linalg.norm(v)
                d = v / t
                e = geometry.direction_at(d, np.array([min(t, 2.0), 0.0]))
                back = geometry.chart_of(d, geometry.direction_at(d, np.array([0.3 * t, 0.1])))
                out.append((i, r[0, 0], r[0, 1], r[0, 2], r[2, 2], geometry.rotation_vector(r)[0], np.arccos(np.clip(d @ e, -1, 1)), back[0]))
            yield pd.DataFrame(out, columns=["id", "m00", "m01", "m02", "m22", "vx", "apart", "chart_x"])

    c = cloud(spark, sf_dir).select("id", *[(F.col(a) * 3).alias(a) for a in "xyz"])
    out = c.mapInPandas(run, "id long, m00 double, m01 double, m02 double, m22 double, vx double, apart double, chart_x double")
    return rounded(rounded(out, 6, "m00", "m01", "m02", "m22", "apart", "chart_x"), 5, "vx")


@query(f"SELECT id % 3 AS frame, count(*) AS n, count(*) FILTER (id % 10 <> 0) AS inliers, 0.8 AS r00, -0.6 AS r01, 0.1 AS tx, -0.2 AS ty, 2.0 AS tz FROM ({CLOUD}) GROUP BY 1")
def resection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a camera's pose from points that it sees, a tenth of them wrong, is the pose that made the picture."""
    r, t = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1.0]]), np.array([0.1, -0.2, 2.0])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        points = pdf[["x", "y", "z"]].to_numpy()
        seen = points @ r.T + t
        rays = seen[:, :2] / seen[:, 2:] + 0.5 * (pdf["id"].to_numpy() % 10 == 0)[:, None]
        found, at, inside = geometry.resect(points, rays, 1e-3)
        return pd.DataFrame([(pdf["frame"].iloc[0], len(pdf), int(inside.sum()), found[0, 0], found[0, 1], *at)], columns=["frame", "n", "inliers", "r00", "r01", "tx", "ty", "tz"])

    c = cloud(spark, sf_dir).select((F.col("id") % 3).alias("frame"), "id", "x", "y", "z")
    out = c.groupBy("frame").applyInPandas(run, "frame long, n long, inliers long, r00 double, r01 double, tx double, ty double, tz double")
    return rounded(out, 4, "r00", "r01", "tx", "ty", "tz")


@query(f"""
SELECT label AS window, camera, round(0.03 * camera, 4) + 0.0 AS turn, round(0.3 * camera, 4) + 0.0 AS x, round(-0.1 * camera, 4) + 0.0 AS y, round(0.05 * camera, 4) + 0.0 AS z, true AS settled FROM (SELECT DISTINCT label FROM ({CLOUD})), (SELECT unnest(range(4))::INT AS camera)
""")
def window_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: from poses and points that are off, adjustment comes back to the cameras that made the picture; the second one's distance is known."""
    c = cloud(spark, sf_dir).select(F.col("label").alias("window"), F.col("id").alias("point"), *[(F.col(a) * 4).alias(a) for a in "xy"], (F.col("z") * 4 + 5).alias("z"))
    cams = c.select("window").distinct().withColumn("camera", F.explode(F.sequence(F.lit(0), F.lit(3))))
    k = F.col("camera")
    off = lambda a: F.when(k > 1, a).otherwise(0.0)
    poses = cams.select("window", "camera", F.array(F.when(k > 0, 0.01).otherwise(0.0), 0.03 * k + off(0.01), off(-0.01), 0.3 * k + off(0.02), -0.1 * k + off(-0.02), 0.05 * k + off(0.01)).alias("pose"))
    points = c.select("window", "point", F.array(F.col("x") + 0.02 * F.sin("point"), F.col("y") + 0.02 * F.cos("point"), F.col("z") + 0.05 * F.sin(F.col("point") * 3)).alias("p"))
    # Cameras turn about the y axis.
    turned = [F.cos(0.03 * k) * F.col("x") + F.sin(0.03 * k) * F.col("z") + 0.3 * k, F.col("y") - 0.1 * k, F.cos(0.03 * k) * F.col("z") - F.sin(0.03 * k) * F.col("x") + 0.05 * k]
    rays = c.join(cams, "window").select("window", "camera", "point", (turned[0] / turned[2]).alias("x"), (turned[1] / turned[2]).alias("y"))
    out = geometry.adjust_windows(poses, points, rays)
    at = lambda i: F.col("pose")[i]
    return rounded(out.select("window", "camera", at(1).alias("turn"), at(3).alias("x"), at(4).alias("y"), at(5).alias("z"), (F.col("cost_after") < F.col("cost_before") * 1e-6).alias("settled")), 4, "turn", "x", "y", "z")


@query(f"SELECT label, count(*) AS n, round(degrees(atan2(sum(sin(x * 5)), sum(cos(x * 5)))), 4) + 0.0 AS heading FROM ({CLOUD}) GROUP BY label")
def mean_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chordal mean of rotations about one axis is the rotation by their mean direction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        turns = np.stack([geometry.rotation_of(np.array([0, 0, a])) for a in pdf.sort_values("id")["x"] * 5])
        m = geometry.mean_rotation(turns)
        # Free about the axis, the rotation is turned until it agrees with the attitudes.
        about = geometry.resolve_axis(np.eye(3), np.array([0, 0, 1.0]), turns, np.broadcast_to(np.eye(3), turns.shape))
        assert np.allclose(about, m, atol=1e-9)
        return pd.DataFrame([(pdf["label"].iloc[0], len(pdf), np.degrees(np.arctan2(m[1, 0], m[0, 0])))], columns=["label", "n", "heading"])

    c = cloud(spark, sf_dir).select("label", "id", "x")
    return rounded(c.groupBy("label").applyInPandas(run, f"label {dict(c.dtypes)['label']}, n long, heading double"), 4, "heading")


@query(f"""
WITH f AS (SELECT label AS chart, id AS face, 8 + x * 20 AS u0, 8 + y * 20 AS v0, 14.3 + y * 20 AS u1, 9.1 + z * 20 AS v1, 9.7 + z * 20 AS u2, 15.9 + x * 20 AS v2 FROM ({CLOUD})),
d AS (SELECT *, (v1 - v2) * (u0 - u2) + (u2 - u1) * (v0 - v2) AS det FROM f), g AS (SELECT chart, face, row, col, ((v1 - v2) * (col + 0.5 - u2) + (u2 - u1) * (row + 0.5 - v2)) / det AS a, ((v2 - v0) * (col + 0.5 - u2) + (u0 - u2) * (row + 0.5 - v2)) / det AS b
  FROM d, range(-20, 45) r(row), range(-20, 45) c(col) WHERE abs(det) >= 1e-12 AND row + 1 > least(v0, v1, v2) AND row < greatest(v0, v1, v2) AND col + 1 > least(u0, u1, u2) AND col < greatest(u0, u1, u2)),
i AS (SELECT *, row_number() OVER (PARTITION BY chart, row, col ORDER BY face) AS n FROM g WHERE a >= 0 AND b >= 0 AND a + b <= 1)
SELECT chart, face, row::INT AS row, col::INT AS col, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM i WHERE n = 1
""")
def texel_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: texels of each chart's triangles with their barycentric weights; the smaller face wins."""
    x, y, z = (F.col(c) * 20 for c in "xyz")
    faces = cloud(spark, sf_dir).select(F.col("label").alias("chart"), F.col("id").alias("face"), F.array(8 + x, 8 + y, 14.3 + y, 9.1 + z, 9.7 + z, 15.9 + x).alias("uv"))
    return rounded(geometry.texels(faces).select("chart", "face", "row", "col", "a", "b"), 4, "a", "b")


@query(f"""
WITH c AS ({CLOUD}), t AS (SELECT a.id AS i, b.id AS j, c2.id AS k, d.id AS l, b.x - a.x AS ax, b.y - a.y AS ay, b.z - a.z AS az, c2.x - a.x AS ux, c2.y - a.y AS uy, c2.z - a.z AS uz, d.x - a.x AS cx, d.y - a.y AS cy, d.z - a.z AS cz FROM c a JOIN c b ON b.id = a.id + 1 JOIN c c2 ON c2.id = a.id + 2 JOIN c d ON d.id = a.id + 3),
q AS (SELECT *, ax * ax + ay * ay + az * az AS aa, ux * ux + uy * uy + uz * uz AS bb, cx * cx + cy * cy + cz * cz AS cc, ax * (uy * cz - uz * cy) + ay * (uz * cx - ux * cz) + az * (ux * cy - uy * cx) AS det FROM t),
r AS (SELECT i, j, k, l, sqrt((aa * (uy * cz - uz * cy) + bb * (cy * az - cz * ay) + cc * (ay * uz - az * uy)) ** 2 + (aa * (uz * cx - ux * cz) + bb * (cz * ax - cx * az) + cc * (az * ux - ax * uz)) ** 2 + (aa * (ux * cy - uy * cx) + bb * (cx * ay - cy * ax) + cc * (ax * uy - ay * ux)) ** 2) / abs(2 * det) AS radius FROM q),
f AS (SELECT unnest([[i, j, k], [i, j, l], [i, k, l], [j, k, l]]) AS f FROM r WHERE radius <= 0.3)
SELECT f[1] AS i0, f[2] AS i1, f[3] AS i2 FROM f GROUP BY f HAVING count(*) = 1
""")
def alpha_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 after the tetrahedra: triangles that bound those whose circumscribed sphere is small; neighbours share faces."""
    c = cloud(spark, sf_dir)
    ids = c.select("id")
    t = ids.select(F.col("id").alias("a"), *[(F.col("id") + i).alias(n) for i, n in enumerate("bcd", 1)]).join(ids.select((F.col("id") - 3).alias("a")), "a", "left_semi")
    out = surface.alpha_surface(t, c.select(F.col("id").alias("v"), "x", "y", "z"), 0.3)
    s = out.select(F.array_sort(F.array("i0", "i1", "i2")).alias("f"))
    return s.select(*[F.col("f")[i].alias(f"i{i}") for i in range(3)])
