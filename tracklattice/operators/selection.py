"""Ordered selection: key frames by marginal gain, time-gated subsets, shelves, sessions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.operators import folds
from tracklattice.operators.quality import keyframe_gate

SELECTION = "video_id string, frame_id string, frame_index long, t double, decision string, reason string, gain double"


@dataclass(frozen=True)
class KeyframeConfig:
    """Spacing, gap, baselines and weights of the greedy selection."""

    least_spacing: float = 0.25
    most_gap: float = 2.5
    least_baseline: float = 0.5
    least_turn: float = 10.0
    novelty: float = 0.40
    budget: int | None = None
    anchors: bool = True
    most_dynamic: float = 0.60


# What time, place, turn and novelty weigh in a frame's gain, and what a dynamic frame loses.
WEIGHTS = (0.35, 0.30, 0.20, 0.15)
DYNAMIC_LOSS = 0.20


@dataclass(frozen=True)
class _Offered:
    """Arrays of a run of offered frames; unknown places and attitudes are NaN, unknown matches have no novelty."""

    t: np.ndarray
    place: np.ndarray
    quat: np.ndarray
    novelty: np.ndarray
    dynamic: np.ndarray

    def cut(self, at: slice) -> _Offered:
        return _Offered(*[getattr(self, f.name)[at] for f in fields(self)])


def _measured(run: _Offered, pick: _Offered, cfg: KeyframeConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen, reason, gain) of each frame of a run, were ``pick`` the last one selected."""
    known = lambda x: np.nan_to_num(x, nan=0.0)
    dt, moved = run.t - pick.t, known(np.sqrt(((run.place - pick.place) ** 2).sum(axis=1)))
    angle = known(np.degrees(2 * np.arccos(np.minimum(1.0, np.abs((run.quat * pick.quat).sum(axis=1))))))
    scales = (cfg.most_gap, 2 * cfg.least_baseline, 2 * cfg.least_turn, 1.0)
    shares = [np.minimum(1.0, x / max(s, 0.1)) for x, s in zip((dt, moved, angle, run.novelty), scales, strict=True)]
    soon = dt < cfg.least_spacing
    gain = np.maximum(0.0, sum(w * x for w, x in zip(WEIGHTS, shares, strict=True)) - DYNAMIC_LOSS * run.dynamic)
    tests = {"TEMPORAL_GAP_COVERAGE": dt >= cfg.most_gap, "TRAJECTORY_DIVERSITY": moved >= cfg.least_baseline, "ORIENTATION_DIVERSITY": shares[2] >= 0.5, "FEATURE_NOVELTY": run.novelty >= cfg.novelty}
    reason = np.select([soon, *tests.values()], ["BELOW_MIN_TEMPORAL_SPACING", *tests], "HIGH_REDUNDANCY").astype(object)
    return ~soon & np.any(list(tests.values()), axis=0), reason, np.where(soon, 0.0, np.round(gain, 4))


def _jumps(run: _Offered, pick: _Offered | None, room: float, cfg: KeyframeConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Offered | None]:
    """(chosen, reason, gain, last pick) of a run after ``pick``, with ``room`` for so many more picks.

    From pick to pick: the frames after one are measured in blocks that double until one of them is chosen.
    """
    n, i, block = len(run.t), 0, 32
    chosen, reason, gain = np.zeros(n, bool), np.full(n, "BUDGET_EXCEEDED", object), np.zeros(n)
    if pick is None and n:
        chosen[0], reason[0], gain[0], i, room, pick = True, "INITIAL_ANCHOR", 1.0, 1, room - 1, run.cut(slice(0, 1))
    while i < n and room > 0:
        ok, why, worth = _measured(run.cut(slice(i, i + block)), pick, cfg)
        hit = np.flatnonzero(ok)
        m = int(hit[0]) + 1 if len(hit) else len(ok)
        chosen[i : i + m], reason[i : i + m], gain[i : i + m] = ok[:m], why[:m], worth[:m]
        i, block = i + m, 32 if len(hit) else 2 * block
        if len(hit):
            pick, room = run.cut(slice(i - 1, i)), room - 1
    return chosen, reason, gain, pick


def select_keyframes(frames: DataFrame, cfg: KeyframeConfig = KeyframeConfig()) -> DataFrame:
    """One decision for every frame (video_id, frame_id, frame_index, t, decoded, severe, static_fraction, match_contamination,
    match_ratio, dynamic, place: array, quat: array).

    Unsafe frames are sorted out first, by columns; the greedy rule then folds over each video's safe frames in order.
    The first and last safe frames are anchors; if nothing is safe, the first decoded frame is the fallback. An anchor
    that replaces the last pick under a full budget leaves it REPLACED, so every frame has exactly one row.

    A video is sorted and read once by one task, batch by batch; the state is the last pick. Where the anchors lie is
    known beforehand, from windows over the same sort.
    """
    gate = keyframe_gate(F.col("decoded"), F.col("severe"), F.col("static_fraction"), F.col("match_contamination"), cfg.most_dynamic)
    budget = cfg.budget or math.inf
    part = lambda c, n: [F.when(F.col(c).isNotNull(), F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))).cast("double").alias(f"{c}{i}") for i in range(n)]
    ratio = F.coalesce(F.nanvl(F.col("match_ratio"), F.lit(1.0)), F.lit(1.0))
    novelty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio))
    rows = frames.select(F.col("video_id").cast("string"), F.col("frame_id").cast("string"), F.col("frame_index").cast("long"), F.col("t").cast("double"), gate.alias("unsafe"), F.coalesce("decoded", F.lit(False)).alias("decoded"), *part("place", 3), *part("quat", 4), novelty.alias("novelty"), F.coalesce(F.col("dynamic"), F.lit(False)).cast("double").alias("dynamic"))
    order = ("frame_index", "frame_id")
    one = rows.repartition("video_id").sortWithinPartitions("video_id", *order)
    video = Window.partitionBy("video_id").orderBy(*order)
    one = one.withColumn("at", F.row_number().over(video) - 1)
    whole = video.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"first_safe": F.min(F.when(F.col("unsafe").isNull(), F.col("at"))), "last_safe": F.max(F.when(F.col("unsafe").isNull(), F.col("at"))), "first_decoded": F.min(F.when(F.col("decoded"), F.col("at"))), "end": F.max("at")}
    one = one.withColumns({k: c.over(whole) for k, c in ends.items()})
    fallback = F.coalesce("first_decoded", F.lit(0))
    one = one.withColumns({"first": F.coalesce("first_safe", fallback), "last": F.coalesce("last_safe", fallback), "offered": F.when(F.col("first_safe").isNotNull(), F.col("unsafe").isNull()).otherwise(F.col("at") == fallback)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pick, count = object(), None, 0
        for batch in batches:
            names = batch.column("video_id").to_pylist()
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            offered, at, first, last, end = (get(c) for c in ("offered", "at", "first", "last", "end"))
            fell = np.asarray(batch.column("first_safe").is_null())
            every = _Offered(get("t"), np.stack([get(f"place{i}") for i in range(3)], axis=1), np.stack([get(f"quat{i}") for i in range(4)], axis=1), get("novelty"), get("dynamic"))
            decision, reason, gain = np.full(len(names), "REJECTED", object), get("unsafe").astype(object), np.zeros(len(names))
            a = 0
            while a < len(names):
                b = a + 1
                while b < len(names) and names[b] == names[a]:
                    b += 1
                if names[a] != of:
                    of, pick, count = names[a], None, 0
                mine = a + np.flatnonzero(offered[a:b])
                chosen, reason[mine], gain[mine], pick = _jumps(every.cut(mine), pick, budget - count, cfg)
                decision[mine[chosen]] = "SELECTED"
                picks, count = count + np.cumsum(chosen), count + int(chosen.sum())
                anchored = cfg.anchors and budget > 1 and first[a] != last[a]
                if anchored:  # the pick that fills the budget gives way to the last frame
                    decision[mine[chosen & (picks == budget) & (at[mine] != last[a])]] = "REPLACED"
                for i in mine[at[mine] == first[a]]:
                    reason[i] = "FALLBACK" if fell[i] else "INITIAL_ANCHOR" if first[i] == 0 else "INITIAL_BOUNDARY_FALLBACK"
                for i in mine[(at[mine] == last[a]) & ~chosen] if anchored else ():
                    decision[i], reason[i], gain[i] = "SELECTED", "FINAL_ANCHOR" if last[i] == end[i] else "FINAL_BOUNDARY_FALLBACK", 1.0
                a = b
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("video_id", "frame_id", "frame_index", "t")], pa.array(decision, pa.string()), pa.array(reason, pa.string()), pa.array(gain)], names=["video_id", "frame_id", "frame_index", "t", "decision", "reason", "gain"])

    return one.select("video_id", "frame_id", "frame_index", "t", "unsafe", *[f"place{i}" for i in range(3)], *[f"quat{i}" for i in range(4)], "novelty", "dynamic", "at", "first", "last", "end", "first_safe", "offered").mapInArrow(run, SELECTION)


def time_gated(rows: DataFrame, key: str, t: str, tie: str, least: float) -> DataFrame:
    """Rows at least ``least`` after the last one kept, the first one included: (key, tie, t)."""
    return folds.spaced(rows.select(key, F.col(tie), F.col(t).cast("double").alias(t)), [key], t, [tie], least)


def sessions(rows: DataFrame, key: str, t: str, tie: str, gap: float) -> DataFrame:
    """Rows with ``session``: a new one after a step beyond ``gap``."""
    w = Window.partitionBy(key).orderBy(t, tie)
    return rows.withColumn("_new", F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def shelves(charts: DataFrame, width: int) -> DataFrame:
    """(atlas, chart, x, y): charts (atlas, chart, w, h) by falling height on shelves of ``width``; a new shelf below when one is full."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "w", "chart"], ascending=[False, False, True], kind="stable")
        x = y = shelf = 0
        out = []
        for r in pdf.itertuples():
            if x and x + r.w > width:
                x, y, shelf = 0, y + shelf, 0
            out.append((r.atlas, r.chart, x, y))
            x, shelf = x + r.w, max(shelf, r.h)
        return pd.DataFrame(out, columns=["atlas", "chart", "x", "y"])

    kinds = dict(charts.dtypes)
    return charts.groupBy("atlas").applyInPandas(run, f"atlas {kinds['atlas']}, chart {kinds['chart']}, x int, y int")


def metric_state(success: Column, observable: Column, inliers: Column, rmse: Column, relative: Column, validated: Column, most_rmse: float = 5.0, most_relative: float = 0.15) -> Column:
    """Array of states from NOT_METRIC on: estimation, then validation where there was one (``validated`` may be null)."""
    failed = ~success | ~observable | (inliers < 4)
    estimated = F.when(failed, "METRIC_ALIGNMENT_FAILED").when((rmse > most_rmse) | (relative > most_relative), "METRIC_SCALE_UNCERTAIN").otherwise("METRIC_SCALE_ESTIMATED")
    after = F.when(validated, "METRIC_SCALE_VALIDATED").otherwise("METRIC_SCALE_UNCERTAIN")
    start = F.array(F.lit("NOT_METRIC"), estimated)
    return F.when(failed | validated.isNull(), start).otherwise(F.concat(start, F.array(after)))
