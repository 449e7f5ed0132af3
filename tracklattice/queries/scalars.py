"""Projections and scalar functions (sections B, C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import camera, geodesy, robust, rotation, units
from tracklattice.queries.registry import CLOUD, cloud, query, rounded, table

_C = "SELECT c_custkey AS id, (c_custkey * 37 % 170 - 85)::DOUBLE AS lat, (c_custkey * 73 % 360 - 180)::DOUBLE AS lon, c_acctbal AS alt, (c_custkey * 11 % 360)::DOUBLE AS yaw, (c_custkey * 7 % 160 - 80)::DOUBLE AS pitch, (c_custkey * 5 % 340 - 170)::DOUBLE AS roll, c_custkey % 10 / 10.0 AS alpha FROM customer"


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = lambda a, m, s: (k * a % m - s).cast("double")
    return table(spark, sf_dir, "customer").select(k.alias("id"), d(37, 170, 85).alias("lat"), d(73, 360, 180).alias("lon"), F.col("c_acctbal").alias("alt"), d(11, 360, 0).alias("yaw"), d(7, 160, 80).alias("pitch"), d(5, 340, 170).alias("roll"), (k % 10 / 10.0).alias("alpha"))


def _each(a: Column, names: str, digits: int = 6) -> list[Column]:
    return [(F.round(a[i], digits) + 0.0).alias(n) for i, n in enumerate(names.split())]


@query("SELECT event_id, (epoch_us(ts) // 1000 % 86400000) / 1000.0 AS seconds FROM events")
def timecode_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: subtitle timecodes to seconds."""
    t = F.date_format(F.col("ts"), "HH:mm:ss,SSS")
    return table(spark, sf_dir, "events").select("event_id", F.round(units.timecode_seconds(t), 3).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 1000, 6) AS t_ms, round(l_quantity / 1000000, 9) AS t_us, round(degrees(l_discount), 6) AS angle, round(l_extendedprice * 0.3048, 4) AS metres, round(l_quantity / 3.6, 6) AS kmph, round(l_quantity * 0.514444, 6) AS knots, round_even(l_quantity * 62.5, 0)::BIGINT AS pts FROM lineitem")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of time, angle, length and speed, and milliseconds rounded half to even."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    r = lambda c, n, name: F.round(c, n).alias(name)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(units.timestamp_seconds(q, "milliseconds"), 6, "t_ms"), r(units.timestamp_seconds(q, "microseconds"), 9, "t_us"), r(units.degrees(F.col("l_discount"), "radians"), 6, "angle"), r(units.metres(p, "feet"), 4, "metres"), r(units.metres_per_second(q, "kmph"), 6, "kmph"), r(units.metres_per_second(q, "knots"), 6, "knots"), units.presentation_millis(q / 16).alias("pts"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS value FROM part")
def number_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with decimal commas and suffixes; what isn't a number is null."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ","), F.when(k % 2 == 0, "m/s").otherwise("m "), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", units.clean_number(text).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size >= 4 THEN '3D_FIX' ELSE 'NO_FIX' END AS fix FROM part")
def fix_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fix type from satellites."""
    return table(spark, sf_dir, "part").select("p_partkey", units.fix_type(F.col("p_size")).alias("fix"))


_MOD = "((({0}) % 360 + 360) % 360)"
_TURN = "(" + _MOD.format("yaw - lon + 180") + " - 180)"


@query(f"SELECT id, round({_TURN}, 6) + 0.0 AS turn, round({_MOD.format(f'lon + alpha * {_TURN} + 180')} - 180, 6) + 0.0 AS lon, round({_MOD.format(f'lon + alpha * {_TURN}')}, 6) + 0.0 AS heading FROM ({_C})")
def angle_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest-arc interpolation of longitudes and headings."""
    a, b, t = F.col("lon"), F.col("yaw"), F.col("alpha")
    out = _poses(spark, sf_dir).select("id", units.turn(a, b).alias("turn"), units.lerp_longitude(a, b, t).alias("lon2"), units.lerp_heading(a, b, t).alias("heading"))
    return rounded(out.withColumnRenamed("lon2", "lon"), 6, "turn", "lon", "heading")


_Q = "[cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]"
_HALF = "cos(radians(yaw) / 2) AS cy, sin(radians(yaw) / 2) AS sy, cos(radians(pitch) / 2) AS cp, sin(radians(pitch) / 2) AS sp, cos(radians(roll) / 2) AS cr, sin(radians(roll) / 2) AS sr"


@query(f"""
WITH a AS (SELECT id, alpha, yaw, pitch, roll, {_Q} AS q FROM (SELECT *, {_HALF} FROM ({_C}))), b AS (SELECT id, {_Q} AS p FROM (SELECT *, {_HALF} FROM (SELECT id, yaw + 50 AS yaw, pitch / 2 AS pitch, roll / 3 AS roll FROM ({_C})))),
d AS (SELECT a.*, p, list_sum(list_transform(range(1, 5), lambda i: q[i] * p[i])) AS x FROM a JOIN b USING (id)), e AS (SELECT *, CASE WHEN x < 0 THEN -1 ELSE 1 END AS s, acos(least(1, abs(x))) AS w FROM d),
f AS (SELECT *, CASE WHEN abs(x) > 0.9995 THEN 1 - alpha ELSE sin((1 - alpha) * w) / sin(w) END AS k0, CASE WHEN abs(x) > 0.9995 THEN alpha ELSE sin(alpha * w) / sin(w) END * s AS k1 FROM e),
g AS (SELECT id, x, list_transform(range(1, 5), lambda i: k0 * q[i] + k1 * p[i]) AS r FROM f), h AS (SELECT id, x, r, sqrt(r[1] ** 2 + r[2] ** 2 + r[3] ** 2 + r[4] ** 2) AS n FROM g)
SELECT id, round(r[1] / n, 6) + 0.0 AS w, round(r[2] / n, 6) + 0.0 AS x, round(r[3] / n, 6) + 0.0 AS y, round(r[4] / n, 6) + 0.0 AS z, round(degrees(2 * acos(least(1, abs(x)))), 4) AS angle FROM (SELECT id, r, n, x FROM h)
""")
def quaternion_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternions from angles, spherical interpolation, angle between them."""
    y, p, r = F.col("yaw"), F.col("pitch"), F.col("roll")
    s = _poses(spark, sf_dir).select("id", "alpha", rotation.euler_to_quaternion(y, p, r).alias("a"), rotation.euler_to_quaternion(y + 50, p / 2, r / 3).alias("b"))
    s = s.select("id", rotation.slerp(F.col("a"), F.col("b"), F.col("alpha")).alias("q"), rotation.quaternion_angle(F.col("a"), F.col("b")).alias("angle"))
    return s.select("id", *_each(F.col("q"), "w x y z"), F.round("angle", 4).alias("angle"))


@query(f"""
WITH a AS (SELECT id, {_Q} AS q FROM (SELECT *, {_HALF} FROM ({_C}))),
p AS (SELECT id, list_transform(q, lambda v: v * CASE WHEN q[1] < 0 THEN -1 ELSE 1 END) AS q FROM a),
m AS (SELECT id, q[1] AS w, q[2] AS x, q[3] AS y, q[4] AS z FROM p)
SELECT id, round(abs(w), 5) + 0.0 AS w, round(1 - 2 * (y * y + z * z), 5) + 0.0 AS m00, round(2 * (x * y + w * z), 5) + 0.0 AS m10, round(2 * (x * z - w * y), 5) + 0.0 AS m20, round(2 * (y * z + w * x), 5) + 0.0 AS m21, round(degrees(asin(greatest(-1, least(1, 2 * (w * y - z * x))))), 3) + 0.0 AS pitch,
  round(degrees(acos(greatest(-1, least(1, 1 - 2 * (x * x + y * y))))), 3) + 0.0 AS tilt FROM m
""")
def rotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles to matrix, matrix to quaternion and back; the SQL goes from angles to the quaternion directly."""
    y, p, r = F.col("yaw"), F.col("pitch"), F.col("roll")
    s = _poses(spark, sf_dir).select("id", rotation.euler_to_quaternion(y, p, r).alias("direct"), rotation.euler_to_matrix(y, p, r).alias("m"))
    s = s.withColumn("q", rotation.matrix_to_quaternion(F.col("m"))).withColumn("back", rotation.quaternion_to_matrix(F.col("q")))
    s = s.withColumn("e", rotation.quaternion_to_euler(F.col("q")))
    cell = lambda i, j: F.element_at(F.flatten("back") if dict(s.dtypes)["back"].startswith("array<array") else F.col("back"), 3 * i + j + 1)
    tilt = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cell(2, 2)))))
    out = s.select("id", F.abs(F.get("q", F.lit(0))).alias("w"), cell(0, 0).alias("m00"), cell(1, 0).alias("m10"), cell(2, 0).alias("m20"), cell(2, 1).alias("m21"), F.col("e.pitch").alias("pitch"), tilt.alias("tilt"))
    return rounded(rounded(out, 5, "w", "m00", "m10", "m20", "m21"), 3, "pitch", "tilt")


_ECEF = f"SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) AS ex, (n + alt) * cos(radians(lat)) * sin(radians(lon)) AS ey, (n * (1 - {geodesy.E2!r}) + alt) * sin(radians(lat)) AS ez FROM (SELECT *, {geodesy.A!r} / sqrt(1 - {geodesy.E2!r} * sin(radians(lat)) ** 2) AS n FROM ({_C}))"


@query(f"""
WITH e AS ({_ECEF}), o AS (SELECT radians(18.5) AS p, radians(73.8) AS l, {geodesy.A!r} / sqrt(1 - {geodesy.E2!r} * sin(radians(18.5)) ** 2) AS n0), c AS (SELECT *, (n0 + 500) * cos(p) * cos(l) AS ox, (n0 + 500) * cos(p) * sin(l) AS oy, (n0 * (1 - {geodesy.E2!r}) + 500) * sin(p) AS oz FROM o)
SELECT id, round(ex, 3) + 0.0 AS x, round(ey, 3) + 0.0 AS y, round(ez, 3) + 0.0 AS z, round(-sin(l) * (ex - ox) + cos(l) * (ey - oy), 3) + 0.0 AS east, round(-sin(p) * cos(l) * (ex - ox) - sin(p) * sin(l) * (ey - oy) + cos(p) * (ez - oz), 3) + 0.0 AS north, round(cos(p) * cos(l) * (ex - ox) + cos(p) * sin(l) * (ey - oy) + sin(p) * (ez - oz), 3) + 0.0 AS up,
  round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, round(alt, 3) + 0.0 AS alt FROM e, c
""")
def geodetic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To ECEF, to local axes, and back to the same coordinates."""
    at = [F.lit(18.5), F.lit(73.8), F.lit(500.0)]
    s = _poses(spark, sf_dir).withColumn("e", geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    s = s.withColumn("u", geodesy.ecef_to_enu(F.col("e"), *at)).withColumn("g", geodesy.enu_to_geodetic(F.col("u"), *at))
    # 180 degrees west and east are one meridian.
    lon = F.round("g.lon", 6)
    lon = F.when(lon >= 180, lon - 360).otherwise(lon)
    return s.select("id", *_each(F.col("e"), "x y z", 3), *_each(F.col("u"), "east north up", 3), (F.round("g.lat", 6) + 0.0).alias("lat"), (lon + 0.0).alias("lon"), (F.round("g.alt", 3) + 0.0).alias("alt"))




def _rz() -> Column:
    return rotation.vector(0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1)


@query(f"""
WITH c AS (SELECT id, 0.8 * x - 0.6 * y + 0.1 AS cx, 0.6 * x + 0.8 * y - 0.2 AS cy, z + 2 AS cz, x, y, z FROM ({CLOUD}))
SELECT id, round(500 * cx / cz + 320, 6) AS u, round(500 * cy / cz + 240, 6) AS v, round(cz, 6) AS depth, round(sqrt((500 * cx / cz - id % 3) ** 2 + (500 * cy / cz) ** 2), 6) AS error, round(x, 6) + 0.0 AS wx, round(y, 6) + 0.0 AS wy, round(z, 6) + 0.0 AS wz, true AS in_front FROM c
""")
def pinhole_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project, reprojection error, back-project, cheirality."""
    k = (500.0, 500.0, 320.0, 240.0)
    t, p = rotation.vector(0.1, -0.2, 2.0), F.col("p")
    s = cloud(spark, sf_dir).select("id", F.array("x", "y", "z").alias("p")).withColumn("o", camera.project(p, _rz(), t, *k))
    s = s.withColumn("w", camera.backproject(F.col("o.u"), F.col("o.v"), F.col("o.z"), _rz(), t, *k))
    error = camera.reprojection_error(p, _rz(), t, *k, F.lit(320.0) + F.col("id") % 3, F.lit(240.0))
    return s.select("id", F.round("o.u", 6).alias("u"), F.round("o.v", 6).alias("v"), F.round("o.z", 6).alias("depth"), F.round(error, 6).alias("error"), *_each(F.col("w"), "wx wy wz"), camera.in_front(p, _rz(), t).alias("in_front"))


@query(f"SELECT id, round(x, 6) + 0.0 AS wx, round(y, 6) + 0.0 AS wy, round(z, 6) + 0.0 AS wz FROM ({CLOUD})")
def rectified_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World to rectified pixel and back."""
    k, t = (400.0, 410.0, 300.0, 200.0), rotation.vector(0.0, 0.1, 3.0)
    rect = rotation.euler_to_matrix(F.lit(3.0), F.lit(-2.0), F.lit(1.0))
    s = cloud(spark, sf_dir).select("id", F.array("x", "y", "z").alias("p")).withColumn("o", camera.project_rectified(F.col("p"), rect, _rz(), t, *k))
    return s.select("id", *_each(camera.backproject_rectified(F.col("o.u"), F.col("o.v"), F.col("o.z"), rect, _rz(), t, *k), "wx wy wz"))


@query(f"""
WITH p AS (SELECT id, x, y, x + 0.1 AS bx, y + z / 10 AS b_y FROM ({CLOUD})), f AS (SELECT *, [0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y, 1] AS a, [0.8 * bx + 0.6 * b_y, -0.6 * bx + 0.8 * b_y] AS g, bx * (0.8 * x - 0.6 * y) + b_y * (0.6 * x + 0.8 * y) + 1 AS r FROM p)
SELECT id, round(r, 6) AS residual, round(abs(r) / sqrt(a[1] ** 2 + a[2] ** 2 + g[1] ** 2 + g[2] ** 2), 4) AS sampson, round((x * 100 - 320) / 500, 6) AS nx, round((y * 100 - 240) / 500, 6) AS ny FROM f
""")
def epipolar_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algebraic and Sampson residuals, normalised pixels."""
    x, y, z = (F.col(c) for c in "xyz")
    a, b = camera.homogeneous(x, y), camera.homogeneous(x + 0.1, y + z / 10)
    s = cloud(spark, sf_dir).select("id", camera.epipolar_residual(_rz(), a, b).alias("residual"), camera.sampson(_rz(), a, b).alias("sampson"), camera.normalised(x * 100, y * 100, 500.0, 500.0, 320.0, 240.0).alias("n"))
    return s.select("id", F.round("residual", 6).alias("residual"), F.round("sampson", 4).alias("sampson"), *_each(F.col("n"), "nx ny"))


@query(f"SELECT id, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM ({CLOUD})")
def undistortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distorted by the Brown-Conrady model, then undistorted by fixed-point rounds."""
    x, y = F.col("x"), F.col("y")
    r2 = x * x + y * y
    radial = 1 + r2 * (-0.05 + r2 * 0.01)
    s = cloud(spark, sf_dir).select("id", (x * radial + 2 * 0.001 * x * y + 0.002 * (r2 + 2 * x * x)).alias("dx"), (y * radial + 0.001 * (r2 + 2 * y * y) + 2 * 0.002 * x * y).alias("dy"))
    return s.select("id", *_each(camera.undistorted(F.col("dx"), F.col("dy"), -0.05, 0.01, 0.001, 0.002, rounds=12), "x y", 5))


@query(f"""
SELECT id, round(2.5 * (0.8 * x - 0.6 * y) + 10, 6) AS gx, round(2.5 * (0.6 * x + 0.8 * y) - 20, 6) AS gy, round(2.5 * z + 5, 6) AS gz, round(x, 6) + 0.0 AS bx, round(y, 6) + 0.0 AS b_y, round(z, 6) + 0.0 AS bz, 6.25 AS scale2 FROM ({CLOUD})
""")
def similarity_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply, inverse and composition of similarity transforms."""
    s, r, t = F.lit(2.5), _rz(), rotation.vector(10, -20, 5)
    p = cloud(spark, sf_dir).select("id", F.array("x", "y", "z").alias("p")).withColumn("g", robust.sim3_apply(s, r, t, F.col("p")))
    p = p.withColumn("i", robust.sim3_inverse(s, r, t)).withColumn("c", robust.sim3_compose(s, r, t, s, r, t))
    return p.select("id", *_each(F.col("g"), "gx gy gz"), *_each(robust.sim3_apply(F.col("i.s"), F.col("i.r"), F.col("i.t"), F.col("g")), "bx b_y bz"), F.round("c.s", 6).alias("scale2"))


@query(f"""
WITH c AS (SELECT id, x, y, z, CASE WHEN id % 4 = 0 THEN NULL ELSE abs(x) * 10 END AS h, CASE WHEN id % 6 = 0 THEN 0 ELSE abs(y) * 10 END AS v, id % 5 = 0 AS rtk, [z * 3, 1, 0] AS vel FROM ({CLOUD})),
s AS (SELECT *, CASE WHEN rtk THEN CASE WHEN h > 0 THEN h ELSE 0.03 END WHEN h > 0 THEN h / 2.447746893674682 ELSE 3 END AS sh, CASE WHEN rtk THEN CASE WHEN v > 0 THEN v ELSE 0.05 END WHEN v > 0 THEN v / 1.959963984540054 ELSE 5 END AS sv, 0.0001 * (9 * z * z + 1) + 0.01 AS extra FROM c)
SELECT id, round(sh * sh + extra, 6) AS c_h, round(sv * sv + extra, 6) AS c_v, round(sqrt(x * x / (sh * sh + extra) + y * y / (sh * sh + extra) + z * z / (sv * sv + extra)), 5) AS mahalanobis, round(x + 0.2, 6) AS ax, round(y, 6) + 0.0 AS ay, round(z + 0.1, 6) AS az FROM s
""")
def gnss_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lever arm, covariance by the meaning of reported accuracies, Mahalanobis distance."""
    i, x, y, z = (F.col(c) for c in ("id", "x", "y", "z"))
    eye = rotation.vector(1, 0, 0, 0, 1, 0, 0, 0, 1)
    cov = robust.gnss_covariance(F.when(i % 4 != 0, F.abs(x) * 10), F.when(i % 6 == 0, 0.0).otherwise(F.abs(y) * 10), rotation.vector(z * 3, 1, 0), i % 5 == 0, "two_sigma_95", 0.01, robust.lever_covariance(eye, sigma=0.1))
    s = cloud(spark, sf_dir).select("id", F.array("x", "y", "z").alias("r"), cov.alias("c")).withColumn("a", robust.antenna(F.col("r"), eye, rotation.vector(0.2, 0, 0.1)))
    return s.select("id", F.round(F.col("c")[0], 6).alias("c_h"), F.round(F.col("c")[8], 6).alias("c_v"), F.round(robust.mahalanobis(F.col("r"), F.col("c")), 5).alias("mahalanobis"), *_each(F.col("a"), "ax ay az"))


@query(f"""
SELECT id, round(CASE WHEN abs(x) <= 0.1 THEN x * x / 2 ELSE 0.1 * (abs(x) - 0.05) END, 8) AS huber, round(CASE WHEN abs(x) <= 0.1 THEN 1 ELSE 0.1 / abs(x) END, 6) AS weight, round(CASE WHEN abs(y * 5) <= 1 THEN (1 - 25 * y * y) ** 2 ELSE 0 END, 6) AS tukey, round(abs(abs(x) - 0.2) / 0.2, 6) AS relative, round(4 * z, 6) + 0.0 AS c0, round(0.299 * x + 0.587 * y + 0.114 * z, 6) + 0.0 AS bt601, round(0.2126 * x + 0.7152 * y + 0.0722 * z, 6) + 0.0 AS bt709 FROM ({CLOUD})
""")
def robust_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huber, Tukey, relative scale error, covariance rescaling, luminance."""
    x, y, z = (F.col(c) for c in "xyz")
    out = cloud(spark, sf_dir).select("id", F.round(robust.huber_loss(x, 0.1), 8).alias("huber"), robust.huber_weight(x, 0.1).alias("weight"), robust.tukey_weight(y * 5).alias("tukey"), robust.relative_scale_error(F.abs(x), F.lit(0.2)).alias("relative"), robust.rescale_covariance(F.array(z), F.lit(2.0))[0].alias("c0"), robust.luminance(x, y, z).alias("bt601"), robust.luminance(x, y, z, "bt709").alias("bt709"))
    return rounded(out, 6, "weight", "tukey", "relative", "c0", "bt601", "bt709")


@query(f"""
WITH p AS (SELECT id, x, y, z FROM ({CLOUD})) SELECT id, round(sqrt((1 + x * 0) * 3) / 2, 6) AS circumradius, x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AS enters, CASE WHEN abs(x) < 0.5 AND abs(y) < 0.5 AND x + 0.5 >= 0 AND y + 0.5 >= 0 AND x + y + 1 <= 1 THEN 5.0 END AS hit FROM p
""")
def ray_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circumradius, ray against box, ray against triangle."""
    v = rotation.vector
    origin, down = v(F.col("x"), F.col("y"), 5.0), v(0, 0, -1)
    out = cloud(spark, sf_dir).select("id", camera.circumradius(v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)).alias("circumradius"), camera.ray_enters_box(origin, down, v(-0.2, -0.2, -1), v(0.2, 0.2, 1), F.lit(10.0)).alias("enters"), F.round(camera.ray_hits_triangle(origin, down, v(-0.5, -0.5, 0), v(0.5, -0.5, 0), v(-0.5, 0.5, 0)), 6).alias("hit"))
    return rounded(out, 6, "circumradius")


@query(f"""
WITH p AS (SELECT id, label % 25 AS frame, (x + 1) * 30 AS u, (y + 1) * 20 AS v FROM ({CLOUD})), f AS (SELECT *, floor(u)::INT AS c0, floor(v)::INT AS r0 FROM p),
q AS (SELECT id, u, v, c0, r0, sum((1 - abs(u - c0 - i)) * (1 - abs(v - r0 - j)) * (((r0 + j) * 7 + (c0 + i) * 13 + frame * 29) % 256)) AS value FROM f, range(2) a(i), range(2) b(j) GROUP BY id, u, v, c0, r0)
SELECT id, CASE WHEN c0 BETWEEN 0 AND 62 AND r0 BETWEEN 0 AND 46 THEN round(value, 5) END AS value FROM q
""")
def bilinear_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: values between pixels from their four neighbours, by equi-join; null near the border."""
    from tracklattice.operators.raster import bilinear
    from tracklattice.queries.aggregates import _pixels

    at = cloud(spark, sf_dir).select("id", (F.col("label") % 25).alias("frame"), ((F.col("x") + 1) * 30).alias("u"), ((F.col("y") + 1) * 20).alias("v"))
    return rounded(bilinear(at, _pixels(spark, sf_dir)), 5, "value")
