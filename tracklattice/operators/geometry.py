"""Two-view geometry kernels: one frame pair, or one track, a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _normalise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
    t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
    return np.c_[p, np.ones(len(p))] @ t.T, t


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eight points or more, normalised, rank 2."""
    x, ta = _normalise(a)
    y, tb = _normalise(b)
    _, _, v = np.linalg.svd(np.einsum("ni,nj->nij", y, x).reshape(len(a), 9))
    u, s, w = np.linalg.svd(v[-1].reshape(3, 3))
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ w) @ ta
    return f / max(np.linalg.norm(f), 1e-300)


def sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = np.c_[a, np.ones(len(a))], np.c_[b, np.ones(len(b))]
    l, m = x @ f.T, y @ f  # noqa: E741
    below = l[:, 0] ** 2 + l[:, 1] ** 2 + m[:, 0] ** 2 + m[:, 1] ** 2
    return np.where(below > 1e-12, np.abs((y * l).sum(axis=1)) / np.sqrt(np.maximum(below, 1e-300)), 0.0)


def ransac(a: np.ndarray, b: np.ndarray, threshold: float, seed: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(F, inliers) by seeded samples of eight and a refit."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(rounds):
        pick = rng.choice(len(a), 8, replace=False)
        inside = sampson(fundamental(a[pick], b[pick]), a, b) <= threshold
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 8:
        return np.zeros((3, 3)), best
    f = fundamental(a[best], b[best])
    return f, sampson(f, a, b) <= threshold


def two_view(matches: DataFrame, threshold: float = 1.0, seed: int = 42) -> DataFrame:
    """(frame_a, frame_b, n, inliers, f, status) of matches (frame_a, frame_b, idx, ua, va, ub, vb); below 8 nothing is estimated."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        a, b = pdf[["ua", "va"]].to_numpy(float), pdf[["ub", "vb"]].to_numpy(float)
        f, inside = ransac(a, b, threshold, seed) if len(a) >= 8 else (np.zeros((3, 3)), np.zeros(len(a), bool))
        status = "TOO_FEW_MATCHES" if len(a) < 8 else "ESTIMATED" if inside.sum() >= 8 else "NO_CONSENSUS"
        return pd.DataFrame([(pdf["frame_a"].iloc[0], pdf["frame_b"].iloc[0], len(a), int(inside.sum()), f.ravel().tolist(), status)], columns=["frame_a", "frame_b", "n", "inliers", "f", "status"])

    kinds = dict(matches.dtypes)
    return matches.groupBy("frame_a", "frame_b").applyInPandas(run, f"frame_a {kinds['frame_a']}, frame_b {kinds['frame_b']}, n int, inliers int, f array<double>, status string")


def triangulate(cameras: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Point seen by 3x4 ``cameras`` at ``pixels``, by the direct linear transform."""
    rows = np.concatenate([pixels[:, :1] * cameras[:, 2] - cameras[:, 0], pixels[:, 1:] * cameras[:, 2] - cameras[:, 1]])
    x = np.linalg.svd(rows)[2][-1]
    return x[:3] / x[3] if abs(x[3]) > 1e-12 else np.full(3, np.nan)


def triangulated(tracks: DataFrame, most_error: float = 4.0) -> DataFrame:
    """(track_id, x, y, z, views, error, status) of tracks (track_id, p: 3x4 row by row, u, v); gates: views, front, error."""

    def one(track_id, obs) -> tuple:
        p = np.array([o["p"] for o in obs], float).reshape(-1, 3, 4)
        uv = np.array([(o["u"], o["v"]) for o in obs], float)
        if len(p) < 2:
            return track_id, None, None, None, len(p), None, "TOO_FEW_VIEWS"
        x = triangulate(p, uv)
        c = p @ np.append(x, 1)
        if not np.isfinite(x).all() or (c[:, 2] <= 1e-6).any():
            return track_id, None, None, None, len(p), None, "BEHIND_A_CAMERA"
        error = float(np.sqrt(((c[:, :2] / c[:, 2:] - uv) ** 2).sum(axis=1)).mean())
        return track_id, *x.tolist(), len(p), error, "TRIANGULATED" if error <= most_error else "REPROJECTION_ERROR"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(t, o) for t, o in zip(pdf["track_id"], pdf["obs"], strict=True)], columns=["track_id", "x", "y", "z", "views", "error", "status"])

    kind = dict(tracks.dtypes)["track_id"]
    lists = tracks.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "p", "u", "v"))).alias("obs"))
    return lists.mapInPandas(run, f"track_id {kind}, x double, y double, z double, views int, error double, status string")


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """Logarithm of a rotation; the half turn has its own branch."""
    cosine = np.clip((np.trace(r) - 1) / 2, -1, 1)
    angle = np.arccos(cosine)
    if angle < 1e-12:
        return np.zeros(3)
    if np.pi - angle < 1e-6:
        m = (r + np.eye(3)) / 2
        axis = m[:, np.argmax(np.diag(m))]
        return angle * axis / np.linalg.norm(axis)
    return angle / (2 * np.sin(angle)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])


def rotation_of(v: np.ndarray) -> np.ndarray:
    """Exponential of a rotation vector."""
    angle = np.linalg.norm(v)
    if angle < 1e-12:
        return np.eye(3)
    k = v / angle
    x = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * x + (1 - np.cos(angle)) * x @ x


def tangent_basis(d: np.ndarray) -> np.ndarray:
    """Two unit vectors (3 x 2) that span the plane across a unit direction; the axis least along it leads."""
    lead = np.eye(3)[np.argmin(np.abs(d))]
    one = lead - (lead @ d) * d
    one /= np.linalg.norm(one)
    return np.stack([one, np.cross(d, one)], axis=1)


def direction_at(d: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The unit direction at ``u`` (two numbers, radians) of the chart around ``d``: along a great circle by the length of ``u``."""
    angle = np.linalg.norm(u)
    return np.cos(angle) * d + np.sinc(angle / np.pi) * (tangent_basis(d) @ u)


def chart_of(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Where ``e`` lies in the chart around ``d``; the opposite direction has no place and raises."""
    across = tangent_basis(d).T @ e
    size, along = np.linalg.norm(across), d @ e
    if size < 1e-12 and along < 0:
        raise ValueError("the opposite direction has no place in the chart")
    return across * (np.arctan2(size, along) / size if size > 1e-12 else 1.0)


def mean_rotation(rotations: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The rotation with the least squared chordal distance to the given ones."""
    w = np.ones(len(rotations)) if weights is None else weights
    u, _, v = np.linalg.svd((rotations * w[:, None, None]).sum(axis=0))
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v))]) @ v


def resolve_axis(rotation: np.ndarray, axis: np.ndarray, body: np.ndarray, camera: np.ndarray) -> np.ndarray:
    """A rotation that collinear positions leave free about ``axis``, turned so that it agrees with attitudes.

    ``body`` are attitudes in the world, ``camera`` the same in the reconstruction; each pair proposes a rotation, and
    of their chordal mean only the turn about the axis is taken.
    """
    wanted = mean_rotation(body @ camera.transpose(0, 2, 1))
    k = axis / np.linalg.norm(axis)
    turn = wanted @ rotation.T
    c = np.trace(turn) - k @ turn @ k
    s = k @ np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]])
    return rotation_of(k * np.arctan2(s, c)) @ rotation


#: Points whose equations ``pose_from_points`` holds at once.
POINTS_AT_ONCE = 16_384


def pose_from_points(points: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t) of a camera that sees ``points`` along normalised ``rays`` (x, y), six or more, by the direct linear transform.

    The equations of more than ``POINTS_AT_ONCE`` points are folded into a triangle of 12 rows, which has their null vector.
    """
    shift, spread = points.mean(axis=0), max(points.std(), 1e-12)
    x = np.c_[(points - shift) / spread, np.ones(len(points))]
    rows = np.zeros((0, 12))
    for i in range(0, len(x), POINTS_AT_ONCE):
        y, ray = x[i : i + POINTS_AT_ONCE], rays[i : i + POINTS_AT_ONCE]
        zero = np.zeros_like(y)
        rows = np.concatenate([rows, np.c_[y, zero, -ray[:, :1] * y], np.c_[zero, y, -ray[:, 1:] * y]])
        if len(x) > POINTS_AT_ONCE:
            rows = np.linalg.qr(rows, mode="r")
    # Rows beyond the twelfth add nothing to the null vector, so the left factor is never made whole.
    p = np.linalg.svd(rows, full_matrices=len(rows) < 12)[2][-1].reshape(3, 4)
    if ((x @ p.T)[:, 2] < 0).sum() * 2 > len(x):
        p = -p
    u, s, v = np.linalg.svd(p[:, :3])
    r = u @ v
    if np.linalg.det(r) < 0:
        r = -r
    t = p[:, 3] / s.mean()
    return r, t * spread - r @ shift


def resect(points: np.ndarray, rays: np.ndarray, threshold: float, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R, t, inliers) by seeded samples of six and a refit."""
    rng, best = np.random.default_rng(seed), np.zeros(len(points), bool)

    def inside(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        c = points @ r.T + t
        ok = c[:, 2] > 1e-6
        return ok & (np.sqrt(((c[:, :2] / np.where(ok, c[:, 2], 1)[:, None] - rays) ** 2).sum(axis=1)) <= threshold)

    for _ in range(rounds):
        pick = rng.choice(len(points), 6, replace=False)
        found = inside(*pose_from_points(points[pick], rays[pick]))
        if found.sum() > best.sum():
            best = found
    if best.sum() < 6:
        raise ValueError("no pose has six inliers")
    r, t = pose_from_points(points[best], rays[best])
    return r, t, inside(r, t)


def adjust(poses: np.ndarray, points: np.ndarray, seen: np.ndarray, rays: np.ndarray, delta: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(poses, points, costs): bundle adjustment of poses (rotation vector, translation) and points to normalised rays.

    ``seen`` has (camera, point) of each ray. Huber costs, Levenberg steps on the reduced camera system (points are eliminated),
    the first pose and the scale (second camera's distance) held. A step that doesn't lower the cost isn't taken, so the result
    is never worse than the start. For windows of a few dozen cameras; one window is one task.
    """
    poses, points, damp, costs = poses.copy(), points.copy(), 1e-3, []
    n, m = len(poses), len(points)

    def residuals(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        r = np.stack([rotation_of(v[:3]) for v in q])
        c = np.einsum("kij,kj->ki", r[seen[:, 0]], x[seen[:, 1]]) + q[seen[:, 0], 3:]
        return c[:, :2] / np.where(np.abs(c[:, 2:]) > 1e-9, c[:, 2:], 1e-9) - rays

    def cost(e: np.ndarray) -> float:
        a = np.sqrt((e * e).sum(axis=1))
        return float(np.where(a <= delta, a * a / 2, delta * (a - delta / 2)).sum())

    base = np.linalg.norm(poses[1, 3:]) if n > 1 else 1.0
    e = residuals(poses, points)
    costs.append(cost(e))
    for _ in range(rounds):
        a = np.sqrt((e * e).sum(axis=1))
        w = np.where(a <= delta, 1.0, delta / np.maximum(a, 1e-300))
        h = 1e-6
        jc, jp = np.zeros((len(e), 2, 6)), np.zeros((len(e), 2, 3))
        for k in range(6):
            moved = poses.copy()
            moved[:, k] += h
            jc[:, :, k] = (residuals(moved, points) - e) / h
        for k in range(3):
            moved = points.copy()
            moved[:, k] += h
            jp[:, :, k] = (residuals(poses, moved) - e) / h
        jc[seen[:, 0] == 0] = 0
        u, v, wc = np.zeros((n, 6, 6)), np.zeros((m, 3, 3)), np.zeros((n, m, 6, 3))
        gc, gp = np.zeros((n, 6)), np.zeros((m, 3))
        np.add.at(u, seen[:, 0], np.einsum("k,kij,kil->kjl", w, jc, jc))
        np.add.at(v, seen[:, 1], np.einsum("k,kij,kil->kjl", w, jp, jp))
        np.add.at(wc, (seen[:, 0], seen[:, 1]), np.einsum("k,kij,kil->kjl", w, jc, jp))
        np.add.at(gc, seen[:, 0], np.einsum("k,kij,ki->kj", w, jc, e))
        np.add.at(gp, seen[:, 1], np.einsum("k,kij,ki->kj", w, jp, e))
        inv = np.linalg.inv(v + np.eye(3) * (damp * np.trace(v, axis1=1, axis2=2)[:, None, None] + 1e-12))
        reduced = -np.einsum("amij,mjk,bmlk->aibl", wc, inv, wc)
        for c in range(n):
            reduced[c, :, c, :] += u[c] + np.eye(6) * (damp * np.trace(u[c]) + 1e-9)
        right = -(gc - np.einsum("amij,mjk,mk->ai", wc, inv, gp))
        dc = np.linalg.lstsq(reduced.reshape(6 * n, 6 * n), right.ravel(), rcond=None)[0].reshape(n, 6)
        dc[0] = 0
        dp = np.einsum("mij,mj->mi", inv, -gp - np.einsum("amij,ai->mj", wc, dc))
        trial, moved = poses + dc, points + dp
        if n > 1:
            s = base / max(np.linalg.norm(trial[1, 3:]), 1e-12)
            trial[:, 3:] *= s
            moved = moved * s
        after = residuals(trial, moved)
        if cost(after) < costs[-1]:
            gain = costs[-1] - cost(after)
            poses, points, e, damp = trial, moved, after, damp / 3
            costs.append(cost(e))
            if gain < 1e-14:
                break
        else:
            damp *= 5
            if damp > 1e8:
                break
    return poses, points, costs


def adjust_windows(poses: DataFrame, points: DataFrame, rays: DataFrame) -> DataFrame:
    """(window, camera, pose, cost_before, cost_after) of windows, each adjusted by itself in one task.

    ``poses`` (window, camera, pose: rotation vector and translation), ``points`` (window, point, p: three numbers), ``rays``
    (window, camera, point, x, y), normalised. The first camera of a window is held. A window's size is bounded by whoever cuts
    the windows; rays whose camera or point is missing are left out, a window without rays or with one camera keeps its poses.
    """
    by = lambda df, name, *c: df.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    sets = by(poses, "poses", "camera", "pose").join(by(points, "points", "point", "p"), "window", "left").join(by(rays, "rays", "camera", "point", "x", "y"), "window", "left")

    def one(w, cams, places, seen) -> list[tuple]:
        at, of = {c["camera"]: i for i, c in enumerate(cams)}, {p["point"]: i for i, p in enumerate(places if places is not None else ())}
        met = [(at[r["camera"]], of[r["point"]], r["x"], r["y"]) for r in (seen if seen is not None else ()) if r["camera"] in at and r["point"] in of]
        q, costs = np.array([c["pose"] for c in cams], float), [None, None]
        if met and len(cams) > 1:
            m = np.array(met, float)
            q, _, costs = adjust(q, np.array([p["p"] for p in places], float), m[:, :2].astype(int), m[:, 2:])
        return [(w, c["camera"], v.tolist(), costs[0], costs[-1]) for c, v in zip(cams, q, strict=True)]

    def run(batches):
        for pdf in batches:
            rows = [r for t in pdf.itertuples() for r in one(t.window, t.poses, t.points, t.rays)]
            yield pd.DataFrame(rows, columns=["window", "camera", "pose", "cost_before", "cost_after"])

    kinds = dict(poses.dtypes)
    return sets.select("window", "poses", "points", "rays").mapInPandas(run, f"window {kinds['window']}, camera {kinds['camera']}, pose array<double>, cost_before double, cost_after double")


def rasterise(triangle: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(row, column, and the three barycentric weights) of the texels whose centres a triangle (3 x (u, v)) covers."""
    (x0, y0), (x1, y1), (x2, y2) = triangle
    det = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
    if abs(det) < 1e-12:
        return []
    out = []
    for row in range(int(np.floor(triangle[:, 1].min())), int(np.ceil(triangle[:, 1].max()))):
        for column in range(int(np.floor(triangle[:, 0].min())), int(np.ceil(triangle[:, 0].max()))):
            x, y = column + 0.5, row + 0.5
            a = ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / det
            b = ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / det
            if a >= 0 and b >= 0 and a + b <= 1:
                out.append((row, column, float(a), float(b), float(1 - a - b)))
    return out


def texels(faces: DataFrame) -> DataFrame:
    """(chart, face, row, col, a, b, c): texels of faces (chart, face, uv: six numbers), each face rasterised alone; a texel
    that two faces of a chart cover goes to the smaller face."""
    from pyspark.sql import Window
    def run(batches):
        for pdf in batches:
            rows = [(c, f, *t) for c, f, uv in zip(pdf["chart"], pdf["face"], pdf["uv"], strict=True) for t in rasterise(np.array(uv, float).reshape(3, 2))]
            yield pd.DataFrame(rows, columns=["chart", "face", "row", "col", "a", "b", "c"])

    kinds = dict(faces.dtypes)
    found = faces.select("chart", "face", "uv").mapInPandas(run, f"chart {kinds['chart']}, face {kinds['face']}, row int, col int, a double, b double, c double")
    first = F.row_number().over(Window.partitionBy("chart", "row", "col").orderBy("face"))
    return found.withColumn("_n", first).filter("_n = 1").drop("_n")
