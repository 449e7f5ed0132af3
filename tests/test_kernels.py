"""Kernels and plans with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklattice.functions import geodesy, rotation, units
from tracklattice.operators import audits, fusion, geometry, imaging, mesh, metrology, neighbours, policy, raster, selection, summaries, surface
from tracklattice.plans import flight, runner, timing
from tracklattice.sources import isobmff, synthetic, telemetry


@pytest.mark.parametrize(("lat", "lon", "want"), [(0.0, 0.0, (geodesy.A, 0, 0)), (0.0, 90.0, (0, geodesy.A, 0)), (90.0, 0.0, (0, 0, geodesy.B))])
def test_ecef_anchors(spark, lat, lon, want):
    x = spark.range(1).select(geodesy.geodetic_to_ecef(F.lit(lat), F.lit(lon), F.lit(0.0)).alias("x")).first().x
    assert x == pytest.approx(want, abs=1e-3)


def test_out_of_range_is_null(spark):
    assert spark.range(1).select(geodesy.geodetic_to_ecef(F.lit(91.0), F.lit(0.0), F.lit(0.0)).alias("x")).first().x is None


def test_units_are_checked(spark):
    for f in (lambda: units.metres_per_second(F.lit(1.0), "mph"), lambda: units.shifted(F.lit(1.0), math.inf), lambda: telemetry.CsvMapping("a", "b", "c", "d", speed_unit="mph")):
        with pytest.raises(ValueError):
            f()


def test_halves_go_to_even(spark):
    assert spark.range(1).select(units.presentation_millis(F.lit(0.0025)).alias("x")).first().x == 2


def test_slerp_half_way(spark):
    a, b = rotation.euler_to_quaternion(F.lit(350.0), F.lit(0.0), F.lit(0.0)), rotation.euler_to_quaternion(F.lit(10.0), F.lit(0.0), F.lit(0.0))
    e = spark.range(1).select(rotation.quaternion_to_euler(rotation.slerp(a, b, F.lit(0.5))).alias("e")).first().e
    assert min(e.yaw, 360 - e.yaw) < 1e-9


OBS = "id long, frame string, u double, v double, x double, y double, z double, confidence double, support int"


def points(*rows):
    return [(i, f, 0.0, float(i), x, y, z, c, 1) for i, (f, x, y, z, c) in enumerate(rows)]


def test_fusion_known_answer(spark):
    o = spark.createDataFrame(points(("a", 1.0, 2.0, 10.0, 0.85), ("b", 1.01, 2.01, 10.01, 0.75)), OBS)
    for size in (0.05, 0.005 + 0.05):
        r = fusion.cluster_fusion(o, fusion.ClusterConfig(voxel=size)).collect()
        assert len(r) == 1 and (r[0].x, r[0].y, r[0].z) == pytest.approx((1.0046875, 2.0046875, 10.0046875)) and r[0].views == 2


def test_fusion_rejects_chains_and_single_views(spark):
    chain = points(*[(f"f{i}", 0.04 * i, 0.0, 0.0, 0.9) for i in range(8)])
    r = fusion.cluster_fusion(spark.createDataFrame(chain, OBS)).collect()
    assert len(r) > 1 and all(x.spread <= 0.1 for x in r)
    same = points(("a", 0.0, 0.0, 0.0, 0.9), ("a", 0.001, 0.0, 0.0, 0.9))
    assert fusion.cluster_fusion(spark.createDataFrame(same, OBS)).count() == 0


def test_fusion_equals_one_pass_in_any_order(spark):
    """Components clustered apart give what one greedy pass over everything gives."""
    rng = np.random.default_rng(5)
    rows = points(*[(f"f{rng.integers(6)}", *(rng.integers(0, 6, 3) * 0.2 + rng.normal(0, 0.01, 3)).tolist(), float(rng.uniform(0.5, 1))) for _ in range(200)])
    cfg = fusion.ClusterConfig()
    ordered = sorted(rows, key=lambda r: (r[1], round(r[2], 4), round(r[3], 4), round(r[4], 6), round(r[5], 6), round(r[6], 6), round(r[7], 4)))
    p = np.array([r[4:7] for r in ordered])
    want = sorted(len(m) for m in fusion._greedy(p, cfg) if len({ordered[i][1] for i in m}) >= 2)
    for parts in (1, 4, 17):
        got = fusion.cluster_fusion(spark.createDataFrame(rows, OBS).repartition(parts), cfg)
        assert sorted(r.n for r in got.collect()) == want


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 20, (60, 3))
    r = geometry.rotation_of(np.array([0.3, -0.4, 0.9]))
    b = 4.25 * a @ r.T + [1e5, -2e5, 500]
    b[::10] += 500
    pairs = spark.createDataFrame([(i, *map(float, a[i]), *map(float, b[i])) for i in range(60)], "id long, ax double, ay double, az double, bx double, by double, bz double")
    s, rot, t, votes = metrology.consensus_similarity(pairs, 0.5)
    assert s == pytest.approx(4.25) and np.allclose(rot, r, atol=1e-6) and votes == 54
    assert np.allclose(t, [1e5, -2e5, 500], atol=1e-2)
    scaled = metrology.fit_similarity(pairs.filter("id % 10 <> 0").selectExpr("id", *[f"{k}{c} * 1e6 AS {k}{c}" for k in "ab" for c in "xyz"]))
    assert scaled[0] == pytest.approx(4.25)


def test_half_turn_has_a_logarithm():
    v = np.array([0, np.pi, 0])
    assert np.allclose(np.abs(geometry.rotation_vector(geometry.rotation_of(v))), np.abs(v))


@pytest.mark.parametrize(("cell", "held"), [(0.01, 0), (1.0, 0), (50.0, 0), (1.0, 100)])
def test_nearest_equals_brute_force(spark, monkeypatch, cell, held):
    """Held references and rings of cells, with a dense cell, equal places, an outlier and rows without a place."""
    monkeypatch.setattr(neighbours, "MOST_HELD", held)
    monkeypatch.setattr(neighbours, "MOST_IN_CELL", 10)
    rng = np.random.default_rng(3)
    p, q = rng.normal(0, 5, (40, 3)), np.concatenate([rng.normal(0, 1, (30, 3)), np.zeros((12, 3)), [[400, 400, 400]]])
    p[0], p[1], q[50 - 10] = [0, 0, 0], [1, 1, 1], [2, 2, 2]
    odd = [(90, float("nan"), 0.0, 0.0), (91, None, 0.0, 0.0), (92, float("inf"), 0.0, 0.0)]
    make = lambda a: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)][::-1] + odd, "id long, x double, y double, z double")
    rows = neighbours.nearest(make(p), make(q), cell).collect()
    got = {r.id: (r.reference_id, r.distance) for r in rows}
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    assert len(rows) == 40 and {i: v[0] for i, v in got.items()} == {i: int(d[i].argmin()) for i in range(40)}
    assert all(math.isclose(got[i][1], d[i].min(), abs_tol=1e-12) for i in range(40))
    assert neighbours.nearest(make(p), make(q).limit(0), cell).count() == 0
    assert neighbours.nearest(make(p).limit(0), make(q), cell).count() == 0


def test_occlusion(spark):
    seg = spark.createDataFrame([(0, 9, [0.0, 0.0, 0.0], [0.0, 0.0, 5.0]), (1, 1, [0.0, 0.0, 0.0], [0.0, 0.0, 5.0]), (2, 9, [9.0, 9.0, 0.0], [9.0, 9.0, 5.0])], "id long, own_face long, a array<double>, b array<double>")
    tri = spark.createDataFrame([(1, [-1.0, -1.0, 2.0], [1.0, -1.0, 2.0], [0.0, 1.0, 2.0])], "face long, p0 array<double>, p1 array<double>, p2 array<double>")
    assert {r.id: r.occluded for r in neighbours.occluded(seg, tri, 1.0).collect()} == {0: True, 1: False, 2: False}


def test_many_cameras_meet_every_sample(spark, sf, monkeypatch):
    """Cameras in blocks give the rows that broadcast ones give."""
    from tracklattice.operators import texturing
    from tracklattice.queries.flights import texture_association

    rows = lambda: sorted(map(tuple, texture_association(spark, sf).collect()), key=str)
    want = rows()
    monkeypatch.setattr(texturing, "MOST_CAMERAS", 4)
    assert rows() == want and len(want) > 1000


def test_hull_stencils_and_correlation():
    assert imaging.hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)) == pytest.approx(4)
    flat = np.full((8, 8), 7.0)
    assert np.allclose(imaging.stencil(flat, imaging.LAPLACIAN), 0) and np.allclose(raster.blur(flat, 1.0), 7)
    edge = np.zeros((8, 8))
    edge[:, 4:] = 9
    assert np.abs(raster.motion_blur(edge, 3) - edge).max() > 1  # the image does change
    assert imaging.zncc(edge, edge * 2) == pytest.approx(1) and imaging.zncc(flat, flat + 50) == 0


def test_alpha_surface(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 50.0, 50.0, 50.0)], "v long, x double, y double, z double")
    t = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4)], "a long, b long, c long, d long")
    assert {(r.i0, r.i1, r.i2) for r in surface.alpha_surface(t, v, 2.0).collect()} == {(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)}


def test_errors_must_be_errors(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "e double")
    with pytest.raises(Exception, match="finite and not negative"):
        summaries.error_summary(df, F.col("e")).collect()
    got = summaries.error_summary(spark.createDataFrame([(float(i),) for i in range(11)], "e double"), F.col("e")).first()
    assert (got.median, got.p95, got.max) == (5.0, 9.5, 10.0)


def test_weighted_median_without_weight(spark):
    df = spark.createDataFrame([(float(i), 0.0, i) for i in range(5)], "v double, w double, i long")
    assert summaries.weighted_median(df, "v", "w", "i").first().weighted_median == 2.0


FRAME = "video_id string, frame_id string, frame_index long, t double, decoded boolean, severe boolean, static_fraction double, match_contamination double, match_ratio double, dynamic boolean, place array<double>, quat array<double>"


def frames(n, **change):
    base = {"decoded": True, "severe": False, "static_fraction": 1.0, "match_contamination": None, "match_ratio": 0.95, "dynamic": False}
    rows = []
    for i in range(n):
        r = base | {k: v[i] if isinstance(v, list) else v for k, v in change.items()}
        rows.append(("v", f"f{i}", i, i * 0.5, r["decoded"], r["severe"], r["static_fraction"], r["match_contamination"], r["match_ratio"], r["dynamic"], None, None))
    return rows


def test_keyframes(spark):
    run = lambda rows, **c: {r.frame_id: (r.decision, r.reason) for r in selection.select_keyframes(spark.createDataFrame(rows, FRAME), selection.KeyframeConfig(**c)).collect()}
    got = run(frames(12))
    assert got["f0"] == ("SELECTED", "INITIAL_ANCHOR") and got["f5"] == ("SELECTED", "TEMPORAL_GAP_COVERAGE") and got["f11"] == ("SELECTED", "FINAL_ANCHOR")
    assert got["f1"] == ("REJECTED", "HIGH_REDUNDANCY") and len(got) == 12
    got = run(frames(4, decoded=[False, True, True, False]))
    assert got["f1"] == ("SELECTED", "INITIAL_BOUNDARY_FALLBACK") and got["f2"][1] == "FINAL_BOUNDARY_FALLBACK" and got["f0"] == ("REJECTED", "UNSAFE_DECODE_FAILURE")
    assert run(frames(3, severe=True))["f0"] == ("SELECTED", "FALLBACK")
    got = run(frames(12, match_ratio=0.1), budget=3)
    assert sum(d == "SELECTED" for d, _ in got.values()) == 3 and sum(d == "REPLACED" for d, _ in got.values()) == 1


def by_hand(video, cfg):
    """Key frames of one video's rows by a plain loop."""
    unsafe = ["UNSAFE_DECODE_FAILURE" if not r[4] else "UNSAFE_SEVERELY_DEGRADED" if r[5] else "DYNAMIC_RISK_EXCLUSION" if 1 - r[6] > 0.6 and not (r[7] is not None and r[7] < 0.15) else None for r in video]
    offered = [i for i, u in enumerate(unsafe) if u is None] or [next((i for i, r in enumerate(video) if r[4]), 0)]
    fell, out, picks = None not in unsafe, {i: ("REJECTED", u, 0.0) for i, u in enumerate(unsafe) if u}, []
    for i in offered:
        if picks and cfg.budget and len(picks) >= cfg.budget:
            out[i] = ("REJECTED", "BUDGET_EXCEEDED", 0.0)
            continue
        r, p = video[i], video[picks[-1]] if picks else None
        if p is None:
            picks, out[i] = [i], ("SELECTED", "FALLBACK" if fell else "INITIAL_ANCHOR" if i == 0 else "INITIAL_BOUNDARY_FALLBACK", 1.0)
            continue
        dt = r[3] - p[3]
        moved = float(np.linalg.norm(np.subtract(r[10], p[10]))) if r[10] and p[10] else 0.0
        angle = float(np.degrees(2 * np.arccos(min(1.0, abs(float(np.dot(r[11], p[11]))))))) if r[11] and p[11] else 0.0
        new = 0.0 if r[8] is None else 1 - r[8]
        gain = max(0.0, 0.35 * min(1, dt / cfg.most_gap) + 0.3 * min(1, moved / (2 * cfg.least_baseline)) + 0.2 * min(1, angle / (2 * cfg.least_turn)) + 0.15 * new - 0.2 * r[9])
        if dt < cfg.least_spacing:
            out[i] = ("REJECTED", "BELOW_MIN_TEMPORAL_SPACING", 0.0)
        else:
            why = "TEMPORAL_GAP_COVERAGE" if dt >= cfg.most_gap else "TRAJECTORY_DIVERSITY" if moved >= cfg.least_baseline else "ORIENTATION_DIVERSITY" if angle >= cfg.least_turn else "FEATURE_NOVELTY" if new >= cfg.novelty else None
            out[i] = ("SELECTED" if why else "REJECTED", why or "HIGH_REDUNDANCY", gain)
            picks += [i] if why else []
    last = offered[-1]
    if cfg.anchors and len(offered) > 1 and out[last][0] != "SELECTED" and cfg.budget != 1:
        if cfg.budget and len(picks) >= cfg.budget:
            out[picks[-1]] = ("REPLACED", *out[picks[-1]][1:])
        out[last] = ("SELECTED", "FINAL_ANCHOR" if last == len(video) - 1 else "FINAL_BOUNDARY_FALLBACK", 1.0)
    return {(video[i][0], video[i][1]): v for i, v in out.items()}


@pytest.mark.parametrize("change", [{}, {"budget": 1}, {"budget": 4}, {"anchors": False, "budget": 6}])
def test_keyframes_equal_a_loop(spark, change):
    rng, rows = np.random.default_rng(5), []
    for v in range(12):
        for i in range(int(rng.integers(1, 90))):
            turn = rng.uniform(0, 0.3)
            maybe = lambda x, share=0.15: None if rng.random() < share else x  # noqa: E731, B023
            rows.append((f"v{v}", f"f{i:03}", i, i * 0.21, bool(rng.random() > 0.1 and v != 3), bool(rng.random() < 0.1 or v == 4), float(rng.uniform(0.2, 1)), maybe(float(rng.uniform(0, 0.3))), maybe(float(rng.uniform(0.5, 1))), bool(rng.random() < 0.3), maybe([float(x) for x in rng.uniform(0, 0.4, 3)]), maybe([float(np.cos(turn)), 0.0, 0.0, float(np.sin(turn))])))
    cfg = selection.KeyframeConfig(least_turn=20.0, **change)
    want = {}
    for v in {r[0] for r in rows}:
        want |= by_hand([r for r in rows if r[0] == v], cfg)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.video_id, r.frame_id): (r.decision, r.reason, r.gain) for r in selection.select_keyframes(spark.createDataFrame(rows, FRAME).repartition(6), cfg).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    for k in want:
        assert got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) <= 1e-4, (k, got[k], want[k])


def test_time_gated_needs_no_gap(spark):
    rows = [(0, i, i * 0.4) for i in range(20)]
    got = sorted(r.i for r in selection.time_gated(spark.createDataFrame(rows, "k long, i long, t double"), "k", "t", "i", 1.0).collect())
    want, last = [], -9.0
    for _, i, t in rows:
        if t - last >= 1.0:
            want.append(i)
            last = t
    assert got == want


def test_shelves_do_not_overlap(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, int(w), int(h)) for i, (w, h) in enumerate(rng.integers(3, 30, (40, 2)))]
    at = {r.chart: (r.x, r.y) for r in selection.shelves(spark.createDataFrame(rows, "atlas long, chart long, w int, h int"), 64).collect()}
    cells = [(at[c][0] + x, at[c][1] + y) for _, c, w, h in rows for x in range(w) for y in range(h)]
    assert len(cells) == len(set(cells)) and max(x for x, _ in cells) < 64


def movies(spark, *contents):
    return spark.createDataFrame([(f"/v/m{i}.mp4", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_containers(spark):
    t = synthetic.track(1, 64, 48, 1000, [(3, 40)], [(1, 80), (1, 0), (1, 0)], [1], 0)
    got = {r.path[-6:-4]: r for r in isobmff.tracks(movies(spark, synthetic.movie([t]), synthetic.movie([t], True), b"", b"\0\0\0\x64moov", synthetic.movie([t], wide=True), synthetic.movie([synthetic.track(1, 4, 4, 10, [(1, 1)], handler=b"soun")]))).collect()}
    assert [got[f"m{i}"].reason and got[f"m{i}"].reason.split(":")[0] for i in range(6)] == [None, "FRAGMENTED", "EMPTY_FILE", "CORRUPT", None, "NO_VIDEO_TRACK"]
    f = sorted(isobmff.timeline(isobmff.primary(isobmff.tracks(movies(spark, synthetic.movie([t]))))).collect(), key=lambda r: r.frame_index)
    assert [r.pts for r in f] == [40, 80, 80] and [r.dts for r in f] == [40, 0, 80] and [r.is_keyframe for r in f] == [False, True, False]
    short = synthetic.track(1, 64, 48, 1000, [(3, 40)], [(1, 80)])
    assert [r.pts for r in isobmff.timeline(isobmff.primary(isobmff.tracks(movies(spark, synthetic.movie([short]))))).orderBy("frame_index").collect()] == [0, 40, 80]


def test_srt_variants(spark):
    text = "1\n00:00:01,500 --> 00:00:01,533\n[lat: 18.5] [lon: 73.8] [rel_alt: 5 abs_alt: 560.2] [drone_yaw: 90 focal_len: 24] H.S 5.2m/s\n\n2\nno timecode\n\n3\n00:00:02.000 --> 00:00:02.033\nGPS(73.8, 18.5, 18) [rel_alt: 12,5m]\n\n4\n00:00:03,000 --> 00:00:03,033\n[lat: 99] [lon: 0] [alt: 1]"
    got = {r.record_index: r for r in telemetry.parse_srt(spark.createDataFrame([("a.srt", text)], "path string, content string")).collect()}
    assert (got[0].status, got[0].alt, got[0].altitude_reference, got[0].heading, got[0].speed, got[0].extras) == ("VALID", 560.2, "MSL", 90.0, 5.2, {"focal_len": "24"})
    assert (got[1].status, got[1].reason) == ("INVALID", "MISSING_TIMECODE")
    assert (got[2].status, got[2].lat, got[2].lon, got[2].satellites, got[2].alt, got[2].altitude_reference) == ("PARTIALLY_VALID", 18.5, 73.8, 18, 12.5, "RELATIVE_TO_TAKEOFF")
    assert got[3].reason == "POSITION_OUT_OF_RANGE"


def test_runner_refuses_what_it_should(spark):
    t = spark.createDataFrame([(1, 2.0)], "id long, v double")
    with pytest.raises(runner.DataLeakage):
        runner.admit("x", t, domain="EVALUATION_TRUTH")
    with pytest.raises(runner.DataLeakage):
        runner.admit("x", t.withColumnRenamed("v", "True_Depth"))
    with pytest.raises(runner.ContractViolation):
        runner.admit("x", t, unit="METRES")
    a = runner.admit("x", t)
    forged = runner.Artifact("x", t.withColumn("v", F.lit(3.0)), a.digest, a.rows)
    status, _, records = runner.run([runner.Stage("s", lambda d: d["x"], ("x",))], [forged])
    assert status == "FAILED" and records[0].status == "CONTRACT_VIOLATION"
    status, made, records = runner.run([runner.Stage("bad", lambda d: 1 / 0, (), runner.OPTIONAL), runner.Stage("s", lambda d: d["x"], ("x",))], [a])
    assert status == "DEGRADED" and made["s"].digest == a.digest and [r.status for r in records] == ["FAILED", "SUCCESS"]


def test_digests_see_every_value(spark):
    a = spark.range(1000).withColumn("v", F.col("id") % 7)
    one = audits.table_digest(a).first().digest
    assert audits.table_digest(a.repartition(9)).first().digest == one
    assert audits.table_digest(a.withColumn("v", F.when(F.col("id") == 500, 99).otherwise(F.col("v")))).first().digest != one
    assert runner.config_hash(selection.KeyframeConfig()) != runner.config_hash(selection.KeyframeConfig(novelty=0.5))


def test_claims_and_levels(spark):
    r = spark.createDataFrame([(i, i, True, False, True, True, False, False) for i in range(6)], "id long, level int, independent boolean, holdout boolean, geospatial boolean, surface boolean, radiometric boolean, probabilistic boolean")
    got = {x.id: set(x.allowed) for x in policy.authorise(r).collect()}
    assert "surveyed_3d_accuracy" not in got[4] and "segment_scale_accuracy" in got[4] and "surface_mesh_chamfer" in got[5]
    assert all("universal_drone_accuracy" not in x for x in got.values())


def test_timing():
    assert timing.profile(0, 1.0, 2.0)["tier"] == "NOT_CLASSIFIED" and timing.profile(60, 1.0, 2.0) == {"fps": 60.0, "real_time_factor": 0.5, "tier": "REAL_TIME"}


def test_noise_is_repeatable(spark):
    df = spark.range(2000).withColumn("x", F.lit(0.0))
    a = raster.gnss_noise(df, 2.0, ("x",), "id").agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    b = raster.gnss_noise(df.repartition(7), 2.0, ("x",), "id").agg(F.avg("x").alias("m")).first()
    assert abs(a.m) < 0.2 and abs(a.s - 2) < 0.15 and math.isclose(a.m, b.m, abs_tol=1e-9)
    assert 50 < raster.outliers(df, 0.05, 9.0, "x", "id").filter("is_outlier").count() < 150


def test_origins(spark):
    t = spark.createDataFrame([(0, float(i), i, 10.0 + i, 20.0, 100.0) for i in range(4)], "stream_id long, t double, record_index long, lat double, lon double, alt double")
    assert flight.origin(t).first().lat0 == 10.0 and flight.origin(t, "median").first().lat0 == 11.5
    assert flight.origin(t, "median_ecef").first().lon0 == pytest.approx(20.0)


def test_charts(spark):
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3), (2, 2, 3, 4)], "face long, i0 long, i1 long, i2 long")
    n = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0])], "face long, n array<double>")
    assert {r.face: r.chart for r in mesh.charts(f, n, 0.7).collect()} == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize(("in_block", "deepest"), [(1024, 14), (8, 14), (8, 2)])
def test_nearest_few_equal_brute_force(spark, monkeypatch, in_block, deepest):
    """Whole and in blocks, with a dense core, copies of a place, equal distances, outliers and rows without a place."""
    monkeypatch.setattr(neighbours, "IN_BLOCK", in_block)
    monkeypatch.setattr(neighbours, "DEEPEST", deepest)
    rng = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), axis=-1).reshape(-1, 3)
    p = rng.permutation(np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(0, 0.01, (80, 3)), grid, np.full((20, 3), 2.0), np.zeros((3, 3)), [[-0.0, 0.0, 0.0], [50, 0, 0], [50.5, 0, 0]]]))
    odd = [(990, float("nan"), 0.0, 0.0), (991, None, 0.0, 0.0), (992, float("inf"), 0.0, 0.0)]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)][::-1] + odd, "id long, x double, y double, z double")
    got = {(r.x, r.y, r.z): [(e.distance, e.id, e.x, e.y, e.z) for e in r.near] for r in neighbours.nearest_few(points, 1.0, 5).collect()}
    want = {}
    for x in p:
        d = np.sqrt(((p - x) ** 2).sum(axis=1))
        want[tuple(x + 0.0)] = [(d[j], j, *p[j]) for j in np.lexsort((np.arange(len(p)), d))[:5] if d[j] <= 1.0]
    assert got == want and {len(v) for v in want.values()} == {2, 5} | {len(v) for v in want.values()}
    assert neighbours.nearest_few(points.limit(0), 1.0, 5).count() == 0


def test_normals_list_no_pairs_within_the_radius(spark):
    """A dense cloud's pairs within the radius are the square of its points; the answers follow the points."""
    from tracklattice.operators.surface import pca_normals

    rng = np.random.default_rng(6)
    p = rng.normal(0, 0.02, (3000, 3)) * [1, 1, 0.01]
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = pca_normals(points, 0.5, 12)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert len(rows) == 3000 and {r.n for r in rows} == {12} and sum(r.nz > 0.9 for r in rows) > 2900
    assert plan.count("Join") == 1 and "block" in plan


@pytest.mark.parametrize(("triangles", "segments"), [(4096, 16384), (16, 16384), (16, 20)])
def test_occlusion_equals_brute_force(spark, monkeypatch, triangles, segments):
    """Whole cells and shared ones, with own faces, no face, nulls, a flat triangle and segments that lie in a triangle's plane."""
    monkeypatch.setattr(neighbours, "TRIANGLES", triangles)
    monkeypatch.setattr(neighbours, "SEGMENTS", segments)
    rng = np.random.default_rng(8)
    corners = rng.uniform(0, 2, (300, 1, 3)) + rng.normal(0, 0.12, (300, 3, 3))
    corners[:40] = rng.uniform(0.5, 0.6, (40, 1, 3)) + rng.normal(0, 0.02, (40, 3, 3))
    corners[0, 2] = corners[0, 1]
    a = rng.uniform(0, 2, (200, 3))
    b = a + rng.normal(0, 0.3, (200, 3))
    a[:5], b[:5] = corners[5:10].mean(axis=1) - [0, 0, 0.2], corners[5:10].mean(axis=1) + [0, 0, 0.2]
    a[5:9], b[5:9] = corners[20:24, 0], corners[20:24, 1]
    own = [None if i % 7 == 0 else i for i in range(200)]
    seg = [(f"s{i}", own[i], a[i].tolist(), b[i].tolist()) for i in range(200)]
    tri = [(None if i == 299 else i, *map(np.ndarray.tolist, c)) for i, c in enumerate(corners)]
    seg.append(("null", 1, [None, 1.0, 1.0], [1.0, 1.0, 1.5]))
    s = spark.createDataFrame(seg, "id string, own_face long, a array<double>, b array<double>").repartition(3)
    t = spark.createDataFrame(tri, "face int, p0 array<double>, p1 array<double>, p2 array<double>").repartition(3)
    from tracklattice.functions import camera, rotation

    at = camera.ray_hits_triangle(F.col("a"), rotation.subtract(F.col("b"), F.col("a")), F.col("p0"), F.col("p1"), F.col("p2"))
    pairs = s.crossJoin(t).filter(~F.col("own_face").eqNullSafe(F.col("face"))).filter((at > 1e-6) & (at < 1 - 1e-6))
    want = {r.id for r in pairs.select("id").distinct().collect()}
    got = {r.id: r.occluded for r in neighbours.occluded(s, t, 0.5).select("id", "occluded").collect()}
    assert len(got) == 201 and {i for i, o in got.items() if o} == want and 20 < len(want) < 180
    assert not any(r.occluded for r in neighbours.occluded(s, t.limit(0), 0.5).collect()) and neighbours.occluded(s.limit(0), t, 0.5).count() == 0


def test_cut_segments_meet_no_more_triangles(monkeypatch):
    """What is tested follows the segments, not their pairs with a full cell's triangles."""
    rng = np.random.default_rng(9)
    tested, real = [0], np.sqrt

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def sqrt(self, x):
            tested[0] += x.size
            return real(x)

    monkeypatch.setattr(neighbours, "np", Counting())
    n = 4000
    p0 = np.stack([rng.uniform(-0.5, 0.4, n), rng.uniform(-0.5, 0.4, n), rng.uniform(1, 2, n)])
    e1, e2 = np.tile([[0.6], [0.0], [0.0]], n), np.tile([[0.0], [0.6], [0.0]], n)
    a, d = np.zeros((3, 5000)), np.tile([[0.0], [0.0], [3.0]], 5000)
    a[0, :10] = 50
    cut = neighbours._any_cuts(a, d, np.full(5000, -1), p0, e1, e2, np.arange(n))
    assert not cut[:10].any() and cut[10:].all() and tested[0] < 1_000_000
