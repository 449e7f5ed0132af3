"""Clouds, trajectories and similarity transforms against references."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.operators.neighbours import nearest, within


def compare_clouds(estimate: DataFrame, reference: DataFrame, first_cell: float, tau: float) -> DataFrame:
    """One row: Chamfer, Hausdorff (both ways, 95 %), precision, recall and F1 at ``tau`` (inclusive)."""
    forward = nearest(estimate, reference, first_cell).select(F.lit("f").alias("way"), "distance")
    backward = nearest(reference, estimate, first_cell).select(F.lit("b").alias("way"), "distance")
    d, f, b = F.col("distance"), F.col("way") == "f", F.col("way") == "b"
    hit = lambda way: F.avg(F.when(way, (d <= tau).cast("double")))
    rows = forward.unionByName(backward).agg(F.avg(F.when(f, d)).alias("mf"), F.avg(F.when(b, d)).alias("mb"), F.max(F.when(f, d)).alias("hausdorff_forward"), F.max(F.when(b, d)).alias("hausdorff_backward"), F.percentile("distance", 0.95).alias("hausdorff95"), hit(f).alias("precision_at"), hit(b).alias("recall_at"))
    p, r = F.col("precision_at"), F.col("recall_at")
    return rows.select(((F.col("mf") + F.col("mb")) / 2).alias("chamfer"), "hausdorff_forward", "hausdorff_backward", F.greatest("hausdorff_forward", "hausdorff_backward").alias("hausdorff"), "hausdorff95", "precision_at", "recall_at", F.when(p + r > 1e-12, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def completeness(estimate: DataFrame, reference: DataFrame, tau: float) -> DataFrame:
    """One row: reference points and how many have an estimate within ``tau``; no reference is complete, no estimate isn't."""
    near = within(reference, estimate, tau).select(F.col("p.id").alias("id")).distinct().withColumn("near", F.lit(1))
    rows = reference.select("id").join(near, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_reference"), F.count("near").alias("n_complete")).withColumn("completeness", F.when(F.col("n_reference") == 0, 1.0).otherwise(F.try_divide(F.col("n_complete").cast("double"), F.col("n_reference").cast("double"))))


def in_box(low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    """Whether x, y, z lie in a box, bounds included; plain comparisons, so they reach the scan."""
    out = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        out = out & F.col(c).between(a, b)
    return out


_AXES = ("x", "y", "z")


def moments(pairs: DataFrame, weight: Column | None = None) -> dict[str, float]:
    """Sums over pairs of points (ax, ay, az) and (bx, by, bz) that a similarity fit needs: one pass, 17 numbers to the driver."""
    w = F.lit(1.0) if weight is None else weight
    sums = {"w": F.sum(w)}
    for i in _AXES:
        sums[f"a{i}"], sums[f"b{i}"] = F.sum(w * F.col(f"a{i}")), F.sum(w * F.col(f"b{i}"))
        for j in _AXES:
            sums[f"{i}{j}"] = F.sum(w * F.col(f"b{i}") * F.col(f"a{j}"))
    sums["aa"] = F.sum(w * sum((F.col(f"a{i}") ** 2 for i in _AXES), F.lit(0.0)))
    sums["n"] = F.count(F.lit(1))
    return pairs.agg(*[v.alias(k) for k, v in sums.items()]).first().asDict()


def fit_similarity(pairs: DataFrame, weight: Column | None = None, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(s, R, t) that takes points a to points b with the least (weighted) squared error, in closed form."""
    m = moments(pairs, weight)
    if m["n"] < 3:
        raise ValueError("a similarity needs three pairs")
    w = m["w"]
    ma, mb = (np.array([m[f"{k}{i}"] for i in _AXES]) / w for k in "ab")
    cov = np.array([[m[f"{i}{j}"] for j in _AXES] for i in _AXES]) / w - np.outer(mb, ma)
    var = m["aa"] / w - ma @ ma
    u, d, vt = np.linalg.svd(cov)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ flip @ vt
    s = float(np.trace(np.diag(d) @ flip) / var) if with_scale and var > 0 else 1.0
    return s, r, mb - s * r @ ma


def aligned_errors(pairs: DataFrame, s: float, r: np.ndarray, t: np.ndarray) -> DataFrame:
    """``pairs`` with ``error``: distance of b to the transformed a."""
    moved = [s * (r[i, 0] * F.col("ax") + r[i, 1] * F.col("ay") + r[i, 2] * F.col("az")) + float(t[i]) for i in range(3)]
    return pairs.withColumn("error", F.sqrt(sum(((F.col(f"b{c}") - m) ** 2 for c, m in zip(_AXES, moved, strict=True)), F.lit(0.0))))


def robust_similarity(pairs: DataFrame, delta: float, rounds: int = 10) -> tuple[float, np.ndarray, np.ndarray]:
    """Similarity by iteratively reweighted least squares with Huber weights; one pass over the pairs a round."""
    s, r, t = fit_similarity(pairs)
    for _ in range(rounds):
        e = aligned_errors(pairs, s, r, t)
        weight = F.when(F.col("error") <= delta, 1.0).otherwise(delta / F.col("error"))
        s2, r2, t2 = fit_similarity(e, weight)
        done = abs(s2 - s) + np.abs(r2 - r).max() + np.abs(t2 - t).max() < 1e-10
        s, r, t = s2, r2, t2
        if done:
            break
    return s, r, t


def _votes(pairs: DataFrame, proposed: list[tuple[float, np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """How many pairs each proposed transform brings within ``threshold``, in one pass; a task returns one row a proposal."""
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(len(proposed), np.int64)
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
            for k, (s, r, t) in enumerate(proposed):
                total[k] += int((((x[:, 3:] - (s * x[:, :3] @ r.T + t)) ** 2).sum(axis=1) <= threshold * threshold).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(proposed), dtype=np.int32)), pa.array(total)], schema=schema)

    columns = pairs.select(*[F.col(f"{k}{i}").cast("double").alias(f"{k}{i}") for k in "ab" for i in _AXES])
    out = np.zeros(len(proposed), np.int64)
    for row in columns.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[row["k"]] = row["n"]
    return out


def consensus_similarity(pairs: DataFrame, threshold: float, triplets: int = 200, seed: int = 42, least_edge: float = 1.0, least_roundness: float = 0.05) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Similarity by consensus: seeded triplets propose transforms, all pairs vote in one pass, the winner's inliers are refitted.

    Triplets come from the rows of smallest hash (a bounded draw of ids, not of votes); flat or tiny ones are skipped.
    """
    ids = [c for c in pairs.columns if c == "id"]
    drawn = pairs.orderBy(F.xxhash64(F.lit(seed), *ids), *ids).limit(64).collect()
    rng = np.random.default_rng(seed)
    a, b = (np.array([[x[f"{k}{i}"] for i in _AXES] for x in drawn]) for k in "ab")
    proposed = []
    for _ in range(triplets):
        pick = rng.choice(len(drawn), 3, replace=False) if len(drawn) > 3 else np.arange(len(drawn))
        p = a[pick]
        edges = [np.linalg.norm(p[i] - p[(i + 1) % 3]) for i in range(3)]
        area = np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) / 2
        if min(edges) < least_edge or 4 * np.pi * area / sum(edges) ** 2 < least_roundness:
            continue
        ma, mb = p.mean(axis=0), b[pick].mean(axis=0)
        u, d, vt = np.linalg.svd((b[pick] - mb).T @ (p - ma))
        flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
        r = u @ flip @ vt
        s = np.trace(np.diag(d) @ flip) / ((p - ma) ** 2).sum()
        t = mb - s * r @ ma
        proposed.append((float(s), r, t))
    if not proposed:
        raise ValueError("no triplet spans a triangle")
    count = _votes(pairs, proposed, threshold)
    best = int(np.argmax(count))
    inliers = aligned_errors(pairs, *proposed[best]).filter(F.col("error") <= threshold)
    s, r, t = robust_similarity(inliers, threshold)
    return s, r, t, int(count[best])


def directions(n: int = 64) -> np.ndarray:
    """Directions spread over the sphere; of 64, the nearest one or its opposite has a cosine of ``REACH`` at least with any."""
    k = np.arange(n)
    zed = 1 - (2 * k + 1) / n
    turn = k * np.pi * (3 - np.sqrt(5))
    flat = np.sqrt(1 - zed * zed)
    return np.stack([flat * np.cos(turn), flat * np.sin(turn), zed], axis=1)


REACH = 0.95
#: Points of a block of the exact comparison.
BLOCK = 4096


def _widest(points: DataFrame) -> float:
    """Largest distance between two of ``points`` (x, y, z), by blocks against blocks."""
    points = points.distinct()
    blocks = max(1, -(-points.count() // BLOCK))
    block, other = F.pmod(F.xxhash64(*_AXES), F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = points.withColumn("own", block.cast("int")).withColumn("other", other)
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def run(table: pa.Table) -> pa.Table:
        at = np.stack([table[c].to_numpy() for c in _AXES], axis=1)
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        a, b = at[own == i], at[own == j]
        most = max((float(((a[k : k + 256, None] - b[None]) ** 2).sum(axis=2).max(initial=0.0)) for k in range(0, len(a), 256)), default=0.0)
        return pa.table({"most": [float(np.sqrt(most))]})

    return dealt.groupBy("i", "j").applyInArrow(run, "most double").agg(F.max("most")).first()[0] or 0.0


def observability(points: DataFrame, least_baseline: float = 10.0, least_points: int = 4, least_ratio: float = 1e-3) -> DataFrame:
    """One row: points, dispersion, extent, eigenvalue ratio and whether a scale can be observed.

    The extent is the largest distance between two points. The extremes of 64 directions give a lower bound (4 % short at
    most); a point of a wider pair reaches at least ``REACH`` of it from the far end in some direction, and the points
    that do are compared. They are few unless the points lie about evenly on a sphere; then the cost is quadratic.
    """
    rows = points.select(*[F.col(c).cast("double").alias(c) for c in _AXES])
    n, ways = 64, directions()
    along = [float(d[0]) * F.col("x") + float(d[1]) * F.col("y") + float(d[2]) * F.col("z") for d in ways]
    here = F.struct("x", "y", "z")
    cov = [(i, j) for i in range(3) for j in range(i, 3)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.covar_pop(_AXES[i], _AXES[j]).alias(f"c{i}{j}") for i, j in cov], *[F.max_by(here, a).alias(f"h{m}") for m, a in enumerate(along)], *[F.min_by(here, a).alias(f"l{m}") for m, a in enumerate(along)]]
    r = rows.agg(*aggs).first()
    c = np.zeros((3, 3))
    for i, j in cov:
        c[i, j] = c[j, i] = r[f"c{i}{j}"] or 0.0
    ends = np.array([tuple(r[f"{s}{m}"]) for s in "hl" for m in range(n) if r[f"{s}{m}"] is not None]).reshape(-1, 3)
    extent = max((float(np.sqrt(((ends - p) ** 2).sum(axis=1)).max()) for p in ends), default=0.0)
    if extent > 0:
        least = REACH * extent * (1 - 1e-9)
        reach = [(*w.tolist(), float(ends[m] @ w) - least, float(ends[n + m] @ w) + least) for m, w in enumerate(ways)]
        known = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("uvwab", row, strict=True)]) for row in reach])
        along = lambda d: d["u"] * F.col("x") + d["v"] * F.col("y") + d["w"] * F.col("z")
        extent = max(extent, _widest(rows.filter(F.exists(known, lambda d: (along(d) <= d["a"]) | (along(d) >= d["b"])))))
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    ratio = float(values[1] / values[0]) if values[0] > 0 else 0.0
    ok = r["n"] >= least_points and extent >= least_baseline and ratio >= least_ratio
    return points.sparkSession.createDataFrame([(r["n"], float(np.sqrt(values.sum())), extent, ratio, bool(ok))], "n long, dispersion double, extent double, eigen_ratio double, observable boolean")


def parameter_covariance(pairs: DataFrame, s: float, r: np.ndarray, t: np.ndarray, sigma: Column, delta: float = 1.345) -> np.ndarray:
    """7x7 covariance (scale, rotation, translation) from Huber-weighted Fisher information; 28 sums in one pass."""
    moved = [float(r[i, 0]) * F.col("ax") + float(r[i, 1]) * F.col("ay") + float(r[i, 2]) * F.col("az") for i in range(3)]
    p = [s * m for m in moved]
    zero, one = F.lit(0.0), F.lit(1.0)
    # d(s R a + t) by scale, by a small turn (w x s R a), by translation.
    rows = [[moved[0], zero, p[2], -p[1], one, zero, zero], [moved[1], -p[2], zero, p[0], zero, one, zero], [moved[2], p[1], -p[0], zero, zero, zero, one]]
    e = aligned_errors(pairs, s, r, t)
    white = F.col("error") / sigma
    w = F.when(white <= delta, 1.0).otherwise(delta / white) / (sigma * sigma)
    cells = [(i, j) for i in range(7) for j in range(i, 7)]
    sums = e.agg(*[F.sum(w * sum((row[i] * row[j] for row in rows), zero)).alias(f"c{i}{j}") for i, j in cells]).first()
    info = np.zeros((7, 7))
    for i, j in cells:
        info[i, j] = info[j, i] = sums[f"c{i}{j}"]
    scale = 1 / np.sqrt(np.maximum(np.diag(info), 1e-300))
    return scale[:, None] * np.linalg.inv(info * scale[:, None] * scale[None, :]) * scale[None, :]


def _middle_eigenvalue(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Second eigenvalue of the symmetric matrix with diagonal (a, b, c) and off it (ab: d, ac: e, bc: f), in closed form."""
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6)
    det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0))))) / 3
    return q + 2 * p * F.cos(turn - 2 * math.pi / 3)


def segment_scale(segments: DataFrame, markers: DataFrame, by: str, scale: float = 1.0, least: int = 3, least_spread: float = 1e-3) -> DataFrame:
    """Errors of measured segments (by, segment_id, a, b, reference) against markers (marker, x, y, z), one row for each ``by``.

    Columns: segments, missing, non_collinear, status, and the summaries of relative and absolute errors, which are null unless the
    status is OK: at least ``least`` segments, all markers there, references positive, and directions that
    span two dimensions (the second singular value of the centred unit directions is above ``least_spread``).
    """
    end = lambda name: markers.select(F.col("marker").alias(name), F.struct("x", "y", "z").alias(f"p{name}"))
    s = segments.join(end("a"), "a", "left").join(end("b"), "b", "left")
    v = [F.col(f"pb.{c}") - F.col(f"pa.{c}") for c in "xyz"]
    s = s.select(by, "reference", *[x.alias(n) for x, n in zip(v, "xyz", strict=True)]).withColumn("length", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    unit = lambda c: F.when(F.col("length") > 1e-9, F.col(c) / F.col("length"))
    s = s.withColumns({"ux": unit("x"), "uy": unit("y"), "uz": unit("z"), "off": F.abs(F.col("length") * scale - F.col("reference"))}).withColumn("rel", F.try_divide(F.col("off"), F.col("reference")))
    spread = lambda i, j: F.sum(F.col(i) * F.col(j)) - F.sum(i) * F.sum(j) / F.count("ux")
    pairs = {"xx": ("ux", "ux"), "yy": ("uy", "uy"), "zz": ("uz", "uz"), "xy": ("ux", "uy"), "xz": ("ux", "uz"), "yz": ("uy", "uz")}
    five = lambda c: [F.avg(c).alias(f"{c}_mae"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_rmse"), F.median(c).alias(f"{c}_median"), F.percentile(c, 0.95).alias(f"{c}_p95"), F.max(c).alias(f"{c}_max")]
    g = s.groupBy(by).agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("length").isNull()).alias("missing"), F.count_if(~(F.col("reference") > 0)).alias("unusable"), F.count("ux").alias("n"), *[spread(*ij).alias(k) for k, ij in pairs.items()], *five("rel"), *five("off"))
    middle = _middle_eigenvalue(*[F.col(k) for k in pairs])
    g = g.withColumn("non_collinear", (F.col("n") >= 2) & (middle > least_spread * least_spread))
    status = F.when(F.col("missing") > 0, "MISSING_MARKER").when(F.col("unusable") > 0, "BAD_REFERENCE").when(F.col("segments") < least, "TOO_FEW_SEGMENTS").when(~F.col("non_collinear"), "COLLINEAR").otherwise("OK")
    g = g.withColumn("status", status)
    return g.select(by, "segments", "missing", "non_collinear", "status", *[F.when(F.col("status") == "OK", F.col(f"{c}_{k}")).alias(f"{c}_{k}") for c in ("rel", "off") for k in ("mae", "rmse", "median", "p95", "max")])
