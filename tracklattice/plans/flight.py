"""Flights: frames and telemetry into one dataset, and its metric alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.functions import geodesy, robust, rotation
from tracklattice.operators import asof, metrology
from tracklattice.plans.shared import materialize


def origin(telemetry: DataFrame, policy: str = "first", key: str = "stream_id") -> DataFrame:
    """(key, lat0, lon0, alt0): the first record, the median of coordinates, or the upper median in ECEF by axis."""
    if policy == "first":
        first = F.min_by(F.struct("lat", "lon", "alt"), F.struct("t", "record_index")).alias("o")
        return telemetry.groupBy(key).agg(first).select(key, F.col("o.lat").alias("lat0"), F.col("o.lon").alias("lon0"), F.col("o.alt").alias("alt0"))
    if policy == "median":
        return telemetry.groupBy(key).agg(F.median("lat").alias("lat0"), F.median("lon").alias("lon0"), F.median("alt").alias("alt0"))
    if policy == "median_ecef":
        e = telemetry.select(key, geodesy.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")).alias("e")).select(key, *[F.col("e")[i].alias(a) for i, a in enumerate("xyz")])
        # The upper median of n values is the least one with a share above a half: percentile_disc just past it.
        upper = [F.expr(f"sort_array(collect_list({a}))[cast(count({a}) div 2 as int)]").alias(a) for a in "xyz"]
        g = e.groupBy(key).agg(*upper).select(key, geodesy.ecef_to_geodetic(F.array("x", "y", "z")).alias("g"))
        return g.select(key, F.col("g.lat").alias("lat0"), F.col("g.lon").alias("lon0"), F.col("g.alt").alias("alt0"))
    raise ValueError(f"unknown origin policy {policy!r}")


def build(frames: DataFrame, telemetry: DataFrame, cfg: asof.BracketConfig = asof.BracketConfig(same="datum"), policy: str = "first") -> DataFrame:
    """Frames (stream_id, frame_id, frame_index, t) with their position, attitude, speed and local coordinates.

    ``telemetry`` has stream_id, t, record_index, lat, lon, alt, datum, yaw, pitch, roll, speed. A frame is
    synchronized if its status says so and its position can be placed. Local coordinates are only given where the
    datum is the origin's.
    """
    synced = asof.bracket(frames, telemetry, cfg)
    rows = synced.select(*frames.columns, "status", "method", "alpha", "gap", asof.position().alias("position"), F.when(F.col("alpha").isNotNull(), asof.attitude()).alias("attitude"), asof.carried("speed").alias("speed"), asof.held("datum").alias("datum"))
    at = origin(telemetry, policy)
    first = telemetry.groupBy("stream_id").agg(F.min_by("datum", F.struct("t", "record_index")).alias("datum0"))
    o = at.join(first, "stream_id")  # one row a stream
    j = rows.join(o, "stream_id", "left")
    enu = geodesy.geodetic_to_enu(F.col("position.lat"), F.col("position.lon"), F.col("position.alt"), F.col("lat0"), F.col("lon0"), F.col("alt0"))
    j = j.withColumn("enu", F.when(F.col("position").isNotNull() & F.coalesce(F.col("datum").eqNullSafe(F.col("datum0")), F.lit(True)), enu))
    return j.withColumn("is_synchronized", asof.synchronized(F.col("status")) & F.col("position").isNotNull()).drop("lat0", "lon0", "alt0", "datum0")


def issues(dataset: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(stream_id, frames, synchronized, datums, findings, status) of each flight."""
    f = dataset.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("is_synchronized").alias("synchronized"))
    t = telemetry.groupBy("stream_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("datum").alias("datums"), F.count_if(F.col("yaw").isNull()).alias("no_attitude"), F.count_if(F.col("speed").isNull()).alias("no_speed"))
    j = f.join(t, "stream_id", "left").na.fill(0, ["records", "datums", "no_attitude", "no_speed"])
    found = F.filter(F.array(F.when(F.col("records") == 0, "ERROR:NO_TELEMETRY"), F.when(F.col("datums") > 1, "WARNING:MIXED_DATUMS"), F.when(F.col("no_attitude") > 0, "WARNING:MISSING_ATTITUDE"), F.when(F.col("no_speed") > 0, "WARNING:MISSING_SPEED"), F.when(F.col("synchronized") < F.col("frames"), "WARNING:UNSYNCHRONIZED_FRAMES")), lambda x: x.isNotNull())
    j = j.withColumn("findings", found)
    errors = F.exists("findings", lambda x: F.startswith(x, F.lit("ERROR")))
    return j.select("stream_id", "frames", "synchronized", "datums", "findings", F.when(errors | (F.col("synchronized") == 0), "INVALID").when(F.col("synchronized") < F.col("frames"), "PARTIALLY_VALID").otherwise("VALID").alias("status"))


@dataclass(frozen=True)
class AlignmentConfig:
    """Gap and tolerance of the join, thresholds of the consensus and of the state."""

    max_gap: float = 1.0
    exact: float = 1e-6
    offset: float = 0.0
    inlier: float = 3.0
    least_baseline: float = 10.0
    most_rmse: float = 5.0
    most_relative: float = 0.15
    interpretation: str = "one_sigma"
    timing: float = 0.01


def observations(frames: DataFrame, telemetry: DataFrame, anchor: tuple[float, float, float], cfg: AlignmentConfig = AlignmentConfig(), lever: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Frames (stream_id, frame_id, t, ax, ay, az) with the antenna in local axes (bx, by, bz), its covariance and a class.

    ``telemetry`` also has h_acc, v_acc, rtk and the angles. The bracket's ends give the velocity, the worse of their
    accuracies holds, and a fix counts only if both ends have it. Accuracies mean the same on exact hits and between them.
    """
    placed = telemetry.withColumn("enu", geodesy.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("alt"), *[F.lit(float(a)) for a in anchor]))
    b = asof.bracket(frames, placed, asof.BracketConfig(max_gap=cfg.max_gap, exact=cfg.exact, offset=cfg.offset))
    left, right = F.col("left"), F.coalesce("right", "left")
    alpha = F.col("alpha")
    span = right["t"] - left["t"]
    moved = rotation.subtract(right["enu"], left["enu"])
    z = F.when(alpha == 0, left["enu"]).when(alpha == 1, right["enu"]).when(alpha.isNotNull(), F.zip_with(left["enu"], right["enu"], lambda x, y: x + alpha * (y - x)))
    body = rotation.held(asof.attitude(), lambda e: rotation.euler_to_matrix(e["yaw"], e["pitch"], e["roll"]))
    arm = rotation.vector(*lever)
    hit = F.col("method") == "exact_match"
    speed = F.when(hit | (span <= 0), rotation.vector(0, 0, 0)).otherwise(F.transform(moved, lambda x: F.try_divide(x, span)))
    worst = lambda c: F.when(hit, F.when(alpha == 0, left[c]).otherwise(right[c])).otherwise(F.greatest(left[c], right[c]))
    fix = F.when(hit, F.when(alpha == 0, left["rtk"]).otherwise(right["rtk"])).otherwise(left["rtk"] & right["rtk"])
    rows = b.select(*frames.columns, "status", "gap", z.alias("z"), body.alias("body"), speed.alias("velocity"), worst("h_acc").alias("h_acc"), worst("v_acc").alias("v_acc"), fix.alias("rtk"))
    cov = robust.gnss_covariance(F.col("h_acc"), F.col("v_acc"), F.col("velocity"), F.col("rtk"), cfg.interpretation, cfg.timing)
    rows = rows.withColumn("camera", robust.camera_of(F.col("z"), F.col("body"), arm)).withColumn("covariance", cov)
    kind = F.when(F.col("z").isNotNull(), "VALID").when(F.col("status") == "UNSYNCHRONIZED", F.when(F.col("gap").isNull(), "INVALID_GNSS").otherwise("TEMPORAL_MISMATCH")).otherwise("TEMPORAL_MISMATCH")
    return rows.select(*frames.columns, "covariance", *[F.col("camera")[i].alias(f"b{a}") for i, a in enumerate("xyz")], kind.alias("classification"))


def align(obs: DataFrame, cfg: AlignmentConfig = AlignmentConfig()) -> dict:
    """Scale, rotation and translation of one flight's valid observations, with its state and the reasons of rejected ones.

    The observations stay a table; the driver gets counts, sums and a bounded draw of triplets.
    """
    obs = materialize(obs, "observations")
    rejected = {r["classification"]: r["n"] for r in obs.groupBy("classification").agg(F.count(F.lit(1)).alias("n")).collect()}
    valid = obs.filter("classification = 'VALID'").withColumnRenamed("frame_id", "id")
    out: dict = {"counts": rejected, "state": ["NOT_METRIC"]}
    if rejected.get("VALID", 0) < 4:
        return out | {"state": ["NOT_METRIC", "METRIC_ALIGNMENT_FAILED"], "reason": "INSUFFICIENT_TELEMETRY"}
    seen = metrology.observability(valid.select(*[F.col(f"b{a}").alias(a) for a in "xyz"]), cfg.least_baseline).first()
    if not seen["observable"]:
        return out | {"state": ["NOT_METRIC", "METRIC_ALIGNMENT_FAILED"], "reason": "SCALE_NOT_OBSERVABLE"}
    s, r, t, votes = metrology.consensus_similarity(valid, cfg.inlier, least_edge=1e-6)
    errors = metrology.aligned_errors(valid, s, r, t).filter(F.col("error") <= cfg.inlier)
    n, rmse = errors.agg(F.count(F.lit(1)), F.sqrt(F.avg(F.col("error") ** 2))).first()
    sigma = metrology.parameter_covariance(errors.drop("error"), s, r, t, F.sqrt(F.col("covariance")[0]))[0, 0] ** 0.5
    relative = sigma / s if s > 0 else float("inf")
    state = "METRIC_ALIGNMENT_FAILED" if n < 4 else "METRIC_SCALE_UNCERTAIN" if rmse > cfg.most_rmse or relative > cfg.most_relative else "METRIC_SCALE_ESTIMATED"
    return out | {"state": ["NOT_METRIC", state], "scale": s, "rotation": r, "translation": t, "inliers": n, "votes": votes, "rmse": rmse, "relative_sigma": relative}


def validate(alignment: dict, checkpoints: DataFrame) -> dict:
    """Alignment against surveyed checkpoints (ax.., bx.., sigma): RMSE by axis, within 3 times the mean sigma or not."""
    if alignment["state"][-1] not in ("METRIC_SCALE_ESTIMATED", "METRIC_SCALE_UNCERTAIN"):
        return alignment
    e = metrology.aligned_errors(checkpoints, alignment["scale"], alignment["rotation"], alignment["translation"])
    r = e.agg(F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg("sigma").alias("sigma"), F.count(F.lit(1)).alias("n")).first()
    ok = r["n"] > 0 and r["rmse"] <= 3 * r["sigma"]
    return alignment | {"checkpoint_rmse": r["rmse"], "state": [*alignment["state"], "METRIC_SCALE_VALIDATED" if ok else "METRIC_SCALE_UNCERTAIN"]}
