"""Pose, adjustment, mean rotation and rasterisation kernels on scenes with known answers."""

import numpy as np

from tracklattice.operators import geometry as g


def scene(seed=0, n=40):
    rng = np.random.default_rng(seed)
    points = rng.uniform(-2, 2, (n, 3)) + [0, 0, 8]
    poses = np.array([[0, 0, 0, 0, 0, 0], [0.02, -0.05, 0.01, -0.6, 0.02, 0.05], [-0.03, 0.08, 0.0, 0.7, -0.05, 0.1]], float)
    return points, poses


def see(points, pose):
    c = points @ g.rotation_of(pose[:3]).T + pose[3:]
    return c[:, :2] / c[:, 2:]


def test_pose_survives_outliers():
    points, poses = scene()
    rays = see(points, poses[1])
    rays[::7] += 0.3
    r, t, inside = g.resect(points, rays, 1e-3)
    assert np.allclose(r, g.rotation_of(poses[1, :3]), atol=1e-6) and np.allclose(t, poses[1, 3:], atol=1e-6)
    assert inside.sum() == len(points) - len(points[::7])


def test_pose_of_many_points_needs_little_memory(monkeypatch):
    """The left factor of the equations has the square of their number; whole or folded, they give one pose."""
    import tracemalloc

    points, poses = scene(n=3000)
    rays = see(points, poses[1])
    rays[::10] += 0.5
    tracemalloc.start()
    r, t, inside = g.resect(points, rays, 1e-3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert np.allclose(r, g.rotation_of(poses[1, :3]), atol=1e-6) and np.allclose(t, poses[1, 3:], atol=1e-6) and inside.sum() == 2700
    monkeypatch.setattr(g, "POINTS_AT_ONCE", 700)
    folded = g.resect(points, rays, 1e-3)
    assert np.allclose(folded[0], r, atol=1e-9) and np.allclose(folded[1], t, atol=1e-9) and (folded[2] == inside).all()


def test_adjustment_lowers_the_cost_to_nothing():
    points, poses = scene()
    seen = np.array([(c, p) for c in range(3) for p in range(len(points))])
    rays = np.concatenate([see(points, q) for q in poses])
    rng = np.random.default_rng(4)
    start = poses + np.r_[np.zeros((1, 6)), rng.normal(0, 0.01, (2, 6))]
    start[1, 3:] *= np.linalg.norm(poses[1, 3:]) / np.linalg.norm(start[1, 3:])
    got, x, costs = g.adjust(start, points + rng.normal(0, 0.03, points.shape), seen, rays)
    assert all(b < a for a, b in zip(costs, costs[1:])) and costs[-1] < 1e-6 * costs[0]
    assert np.allclose(got[0], 0) and np.allclose(got[2], poses[2], atol=1e-3) and np.allclose(x, points, atol=1e-2)


def test_windows_that_can_not_be_adjusted_keep_their_poses(spark):
    zero, away = [0.0] * 6, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    poses = spark.createDataFrame([("lone", 0, away), ("blind", 0, zero), ("blind", 1, away), ("odd", 0, zero), ("odd", 1, away)], "window string, camera int, pose array<double>")
    points = spark.createDataFrame([("lone", 5, [0.0, 0.0, 4.0]), ("odd", 6, [0.0, 0.0, 4.0])], "window string, point long, p array<double>")
    rays = spark.createDataFrame([("lone", 0, 5, 0.1, 0.0), ("odd", 9, 6, 0.0, 0.0), ("odd", 0, 7, 0.0, 0.0)], "window string, camera int, point long, x double, y double")
    got = {(r.window, r.camera): (r.pose, r.cost_after) for r in g.adjust_windows(poses, points, rays).collect()}
    assert got == {(r.window, r.camera): (r.pose, None) for r in poses.collect()}
    assert g.adjust_windows(poses.limit(0), points, rays).count() == 0


def test_mean_and_axis():
    rng = np.random.default_rng(2)
    true = g.rotation_of(np.array([0.2, 0.4, -0.3]))
    noisy = np.stack([true @ g.rotation_of(rng.normal(0, 0.01, 3)) for _ in range(200)])
    assert np.allclose(g.mean_rotation(noisy), true, atol=5e-3)
    axis = np.array([1.0, 0.0, 0.0])
    wrong = g.rotation_of(axis * 1.1) @ true
    camera = np.stack([g.rotation_of(rng.normal(0, 1, 3)) for _ in range(5)])
    assert np.allclose(g.resolve_axis(wrong, axis, true @ camera, camera), true, atol=1e-9)


def test_texels_cover_a_square_once(spark):
    f = spark.createDataFrame([(0, 0, [0.0, 0.0, 8.0, 0.0, 0.0, 8.0]), (0, 1, [8.0, 0.0, 8.0, 8.0, 0.0, 8.0])], "chart long, face long, uv array<double>")
    got = g.texels(f).collect()
    assert len(got) == 64 == len({(r.row, r.col) for r in got})
    assert all(abs(r.a + r.b + r.c - 1) < 1e-12 for r in got)
