"""Texture association and incremental registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions import camera
from tracklattice.functions.rotation import dot, subtract
from tracklattice.plans.shared import materialize, shuffle_partitions

#: Cameras that are broadcast to the samples: a flight's key frames, counted before. More are dealt out in blocks.
MOST_CAMERAS = 10_000


def associate(samples: DataFrame, cameras: DataFrame, keep: int = 8, least_cosine: float = 0.2) -> DataFrame:
    """(sample, frame, decision, score, rank) for every sample (sample, p, n) and camera (frame, r_cw, t_cw, c_w, fx, fy, cx, cy, width, height).

    Every pair gets a row that says what became of it; that is the audit. The ``keep`` best of a sample are ACCEPTED, further
    ones ACCEPTED_NOT_RETAINED. Back faces aren't culled: the angle counts from either side. Cameras beyond
    ``MOST_CAMERAS`` meet the samples in blocks, by a join on the block and a part of the samples.
    """
    blocks = -(-cameras.count() // MOST_CAMERAS)
    if blocks <= 1:
        j = samples.join(F.broadcast(cameras))
    else:
        parts = shuffle_partitions(samples.sparkSession)
        dealt = samples.withColumn("_part", F.pmod(F.xxhash64("sample"), F.lit(parts))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        copies = cameras.withColumn("_block", F.pmod(F.xxhash64("frame"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        j = dealt.join(copies.hint("merge"), ["_part", "_block"])
    seen = camera.project(F.col("p"), F.col("r_cw"), F.col("t_cw"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    j = j.withColumn("o", seen).withColumn("ray", subtract(F.col("c_w"), F.col("p")))
    length = F.sqrt(dot(F.col("ray"), F.col("ray"), 3) * dot(F.col("n"), F.col("n"), 3))
    j = j.withColumn("cosine", F.abs(F.try_divide(dot(F.col("ray"), F.col("n"), 3), length)))
    inside = F.col("o.u").between(0.0, F.col("width") - 1) & F.col("o.v").between(0.0, F.col("height") - 1)
    reason = F.when(F.col("o").isNull(), "BEHIND_CAMERA").when(~inside, "OUTSIDE_IMAGE").when(F.col("cosine") < least_cosine, "GRAZING_ANGLE")
    score = F.when(reason.isNull(), F.round(F.col("cosine") / F.col("o.z"), 9))
    j = j.select("sample", "frame", reason.alias("reason"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("score").desc_nulls_last(), "frame"))
    j = j.withColumn("rank", F.when(F.col("score").isNotNull(), rank))
    return j.select("sample", "frame", F.coalesce("reason", F.when(F.col("rank") <= keep, "ACCEPTED").otherwise("ACCEPTED_NOT_RETAINED")).alias("decision"), "score", "rank")


def registration_order(observed: DataFrame, seed: tuple, least: int = 6) -> DataFrame:
    """(step, frame, shared): frames (frame, track_id) in the order in which they can be registered.

    A track counts once two registered frames see it; each step takes the frame that sees most such tracks, ties to the
    smaller frame, until none sees ``least``. The driver holds frames and counts, never tracks.
    """
    spark = observed.sparkSession
    rows = materialize(observed.select("frame", "track_id").distinct(), "observed")
    done, steps = list(seed), [(i, f, 0) for i, f in enumerate(seed)]
    while True:
        ready = rows.filter(F.col("frame").isin(done)).groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
        best = rows.filter(~F.col("frame").isin(done)).join(ready, "track_id", "left_semi").groupBy("frame").agg(F.count(F.lit(1)).alias("shared")).orderBy(F.col("shared").desc(), "frame").first()
        if best is None or best["shared"] < least:
            return spark.createDataFrame(steps, f"step int, frame {dict(observed.dtypes)['frame']}, shared long")
        steps.append((len(steps), best["frame"], best["shared"]))
        done.append(best["frame"])
