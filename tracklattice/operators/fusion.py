"""Fusion of point observations and colours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.functions.units import finite
from tracklattice.operators.graphs import connected
from tracklattice.operators.neighbours import cell

REASONS = ("NON_FINITE_COORDINATES", "NON_FINITE_CONFIDENCE", "OUT_OF_BOUNDS_CONFIDENCE", "LOW_CONFIDENCE", "DYNAMIC_RISK_EXCEEDED")


def reject_reason(least_confidence: float, most_risk: float) -> Column:
    """First reason to reject an observation (x, y, z, confidence, dynamic_risk), else null. A missing risk is none."""
    c = F.col("confidence")
    return F.when(~(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))), REASONS[0]).when(~finite(c), REASONS[1]).when((c < 0) | (c > 1), REASONS[2]).when(c < least_confidence, REASONS[3]).when(F.coalesce("dynamic_risk", F.lit(0.0)) > most_risk, REASONS[4])


def voxel_fusion(observations: DataFrame, size: float, least_confidence: float, least_views: int) -> DataFrame:
    """(i, j, k, x, y, z, confidence, views, n, frames): confidence-weighted centroid of each voxel that enough frames see."""
    keyed = observations.filter(F.col("confidence") >= least_confidence).withColumns({n: cell(F.col(a), size) for n, a in zip("ijk", "xyz", strict=True)})
    w = F.col("confidence")
    mean = lambda a: (F.sum(w * F.col(a)) / F.sum(w)).alias(a)
    out = keyed.groupBy("i", "j", "k").agg(*[mean(a) for a in "xyz"], F.avg(w).alias("confidence"), F.array_sort(F.collect_set("frame")).alias("frames"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("views", F.size("frames").cast("long")).filter(F.col("views") >= least_views)


@dataclass(frozen=True)
class ClusterConfig:
    """Greedy clustering: reach from the centroid, largest distance between members, voxel of the search, weighting."""

    threshold: float = 0.05
    diameter: float = 0.10
    voxel: float = 0.05
    least_views: int = 2
    keep_single: bool = False
    weighting: str = "confidence"


def _greedy(points: np.ndarray, cfg: ClusterConfig) -> list[list[int]]:
    """Clusters of points in their order: each joins the nearest centroid in reach whose members are all close, else founds one."""
    grid: dict[tuple[int, int, int], list[int]] = {}
    members: list[list[int]] = []
    sums: list[np.ndarray] = []
    for i, p in enumerate(points):
        v = tuple(np.floor(p / cfg.voxel).astype(int).tolist())
        near = {c for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1) for c in grid.get((v[0] + a, v[1] + b, v[2] + d), ())}
        best, least = None, np.inf
        for c in sorted(near):
            reach = float(np.linalg.norm(p - sums[c] / len(members[c])))
            if reach <= cfg.threshold and reach < least and np.linalg.norm(points[members[c]] - p, axis=1).max() <= cfg.diameter:
                best, least = c, reach
        if best is None:
            best = len(members)
            members.append([])
            sums.append(np.zeros(3))
        members[best].append(i)
        sums[best] = sums[best] + p
        if best not in grid.setdefault(v, []):
            grid[v].append(best)
    return members


def cluster_fusion(observations: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """Fused points (x, y, z, confidence, views, n, spread, status, frames) of observations (frame, u, v, x, y, z, confidence, support).

    The greedy rule depends on order, so observations are taken by frame, pixel, place and confidence. It looks no
    further than the neighbouring voxels: voxels that touch are joined into components, and each component is
    clustered alone, with the same result as in one pass over everything.
    """
    own = ("_i", "_j", "_k")
    keyed = observations.withColumns({n: cell(F.col(a), cfg.voxel) for n, a in zip(own, "xyz", strict=True)})
    voxels = keyed.select(*own).distinct().withColumn("id", F.xxhash64(*own))
    around = voxels.select(F.col("id").alias("a"), *[F.explode(F.array(*[F.col(n) + d for d in (-1, 0, 1)])).alias(n) if n == own[0] else F.col(n) for n in own])
    for n in own[1:]:
        around = around.withColumn(n, F.explode(F.array(*[F.col(n) + d for d in (-1, 0, 1)])))
    edges = around.join(voxels, list(own)).filter("a < id").select("a", F.col("id").alias("b"))
    found = connected(edges).withColumnRenamed("node", "_voxel")
    rows = keyed.withColumn("_voxel", F.xxhash64(*own)).join(found, "_voxel", "left").withColumn("_component", F.coalesce("component", "_voxel")).drop(*own, "component", "_voxel")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.assign(_u=pdf["u"].round(4), _v=pdf["v"].round(4), _x=pdf["x"].round(6), _y=pdf["y"].round(6), _z=pdf["z"].round(6), _c=pdf["confidence"].round(4))
        pdf = pdf.loc[key.sort_values(["frame", "_u", "_v", "_x", "_y", "_z", "_c"], kind="stable").index].reset_index(drop=True)
        points = pdf[["x", "y", "z"]].to_numpy(float)
        out = []
        for m in _greedy(points, cfg):
            frames = sorted(set(pdf["frame"].iloc[m]))
            if len(frames) < cfg.least_views and not cfg.keep_single:
                continue
            c = pdf["confidence"].to_numpy(float)[m]
            w = {"uniform": np.ones(len(m)), "confidence": np.maximum(1e-4, c)}.get(cfg.weighting, np.maximum(1e-4, c * np.maximum(1, pdf["support"].to_numpy()[m])))
            at = (points[m] * w[:, None]).sum(axis=0) / w.sum()
            out.append((*at, float(np.clip((c * w).sum() / w.sum(), 0, 1)), len(frames), len(m), float(points[m].std(axis=0).mean()), "VALIDATED" if len(frames) >= cfg.least_views else "OBSERVED", frames))
        return pd.DataFrame(out, columns=["x", "y", "z", "confidence", "views", "n", "spread", "status", "frames"])

    return rows.groupBy("_component").applyInPandas(run, "x double, y double, z double, confidence double, views int, n int, spread double, status string, frames array<string>")


def _median_by_weight(values: np.ndarray, weights: np.ndarray) -> int:
    order = np.argsort(values, kind="stable")
    run = np.cumsum(np.maximum(weights[order], 0))
    if not len(run) or run[-1] <= 0:
        return int(order[len(order) // 2])
    return int(order[np.searchsorted(run, run[-1] / 2)])


def tukey_colours(candidates: DataFrame, tuning: float = 4.685, rounds: int = 5, conflict: float = 0.5) -> DataFrame:
    """(texel, r, g, b, n, inliers, state): robust colour of candidates (texel, candidate, r, g, b, weight).

    Starts at the candidate of weighted-median luminance; scale is the median absolute deviation; weights are Tukey's. A
    texel whose inliers have less than ``conflict`` of the weight is CONFLICTING; just that much, up to the rounding of sums,
    is enough. Candidates a texel are bounded by the views.
    """

    def one(texel, rows) -> tuple:
        colours, weights = np.array([(c["r"], c["g"], c["b"]) for c in rows], float), np.array([c["weight"] for c in rows], float)
        at = colours[_median_by_weight(colours @ np.array([0.2126, 0.7152, 0.0722]), weights)]
        inside = np.ones(len(colours), bool)
        for _ in range(rounds):
            d = np.sqrt(((colours - at) ** 2).sum(axis=1))
            scale = max(1.4826 * float(np.median(d)), 1.0)
            u = d / (tuning * scale)
            w = np.where(u <= 1, (1 - u * u) ** 2, 0) * weights
            inside = w > 0
            if w.sum() <= 0:
                break
            after = (colours * w[:, None]).sum(axis=0) / w.sum()
            done = np.abs(after - at).max() < 1e-6
            at = after
            if done:
                break
        share = weights[inside].sum() / weights.sum() if weights.sum() > 0 else 0.0
        return (texel, *at, len(colours), int(inside.sum()), "SINGLE_VIEW" if len(colours) == 1 else "CONFLICTING" if share < conflict - 1e-9 else "FUSED")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(t, c) for t, c in zip(pdf["texel"], pdf["rows"], strict=True)], columns=["texel", "r", "g", "b", "n", "inliers", "state"])

    kind = dict(candidates.dtypes)["texel"]
    lists = candidates.groupBy("texel").agg(F.array_sort(F.collect_list(F.struct("candidate", "r", "g", "b", "weight"))).alias("rows"))
    return lists.mapInPandas(run, f"texel {kind}, r double, g double, b double, n int, inliers int, state string")
