"""Folds over ordered streams against a plain loop, and the as-of fills without a frame that looks ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklattice.operators import asof, folds


def by_hand(times, least, strict):
    kept, last = [], None
    for t in times:
        ok = last is None or (t - last > least if strict else t - last >= least)
        kept.append(ok)
        last = t if ok else last
    return kept


@pytest.mark.parametrize("strict", [False, True])
def test_kept_equals_a_loop(strict):
    r = np.random.default_rng(3)
    for _ in range(300):
        t = np.sort(np.round(r.uniform(0, 5, r.integers(0, 60)), int(r.integers(0, 4))))
        least = float(r.choice([0.0, 0.1, 0.3, 1.0]))
        whole, _ = folds._kept(t, -np.inf, least, strict)
        assert whole.tolist() == by_hand(t, least, strict)
        cut, last, parts = int(r.integers(0, len(t) + 1)), -np.inf, []
        for part in (t[:cut], t[cut:]):  # the state goes on from batch to batch
            keep, last = folds._kept(part, last, least, strict)
            parts += keep.tolist()
        assert parts == whole.tolist()


def test_spaced_streams(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), float(t), i, 7) for i, (k, t) in enumerate(zip(r.integers(0, 4, 300), np.round(r.uniform(0, 30, 300), 1)))] + [(9, None, 400, 7)]
    df = spark.createDataFrame(rows, "s int, t double, i int, _at int").repartition(5).withColumnRenamed("_at", "row")
    got = sorted((x.s, x.t, x.i) for x in folds.spaced(df, ["s"], "t", ["i"], 2.0).collect())
    want = []
    for s in range(4):
        mine = sorted((t, i) for k, t, i, _ in rows if k == s)
        want += [(s, t, i) for (t, i), ok in zip(mine, by_hand([t for t, _ in mine], 2.0, False)) if ok]
    assert got == sorted(want)
    assert folds.spaced(df.limit(0), ["s"], "t", ["i"], 2.0).count() == 0


@pytest.mark.parametrize("bucket", [None, 10.0])
def test_no_frame_of_the_fill_looks_ahead(spark, bucket):
    """A window that ends in the last row is evaluated afresh for each row, which is quadratic."""
    f = spark.range(5).select(F.lit(0).alias("stream_id"), F.col("id").cast("double").alias("t"))
    rec = f.withColumn("record_index", F.lit(1).cast("long"))
    plan = asof.nearest(f, rec, 1.0, bucket=bucket)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
