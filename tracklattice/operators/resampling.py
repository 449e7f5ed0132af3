"""Resampling that never moves rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap_mean(df: DataFrame, id_col: str, value: str, resamples: int = 500, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """One row (mean, low, high, n): percentile interval of the mean by a Poisson bootstrap.

    Each row's weight in each resample is a Poisson(1) draw from a generator seeded by the row's hash, so any
    partitioning gives the same result; tasks return two sums a resample.
    """
    schema = pa.schema([("k", pa.int32()), ("w", pa.float64()), ("wv", pa.float64())])

    def run(batches):
        w, wv = np.zeros(resamples), np.zeros(resamples)
        table = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])
        for batch in batches:
            h, v = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i in range(0, len(h), 4096):
                x = h[i : i + 4096, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
                draws = np.searchsorted(table, u).astype(float)
                w += draws.sum(axis=0)
                wv += draws.T @ v[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(w), pa.array(wv)], schema=schema)

    rows = df.filter(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), id_col).alias("h"), F.col(value).cast("double").alias("v"))
    means = rows.mapInArrow(run, "k int, w double, wv double").groupBy("k").agg((F.sum("wv") / F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    interval = means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return rows.agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).crossJoin(interval)  # one row each
