"""Streaming forms: windowed statistics, sessions, interval joins, stateful selection.

Each takes a streaming DataFrame with an event time and a watermark and returns a streaming DataFrame; ``drain`` runs
one to the end of what is available and gives the result as a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.plans.shared import shared_path


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table's files as a stream, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def window_statistics(stream: DataFrame, ts: str, value: str, width: str, slide: str | None, late: str, *by: str) -> DataFrame:
    """(by, start, end, n, sum, min, max) over tumbling or sliding windows; rows later than ``late`` are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum", "min", "max")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *by: str) -> DataFrame:
    """(by, start, end, n) of runs of rows no further apart than ``gap``."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, reach: str, late: str) -> DataFrame:
    """S3: rows of two streams with one key no further apart than ``reach``; state is kept for ``reach`` plus ``late`` only."""
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    span = F.expr(f"INTERVAL {reach}")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}") - span) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + span)
    return a.join(b, near, "inner")


def time_gated(stream: DataFrame, key: str, t: str, tie: str, least: float, late: float) -> DataFrame:
    """(key, tie, t, decision): rows at least ``least`` after the last one SELECTED of their key, else REDUNDANT.

    The state is the last time selected and the latest time seen. A row more than ``late`` behind the latest is
    OUT_OF_RANGE: a decision that has been given out isn't taken back.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values([t, tie], kind="stable")
        out = []
        for at, i in zip(rows[t], rows[tie], strict=True):
            if seen is not None and at < seen - late:
                out.append((k[0], i, at, "OUT_OF_RANGE"))
                continue
            seen = at if seen is None else max(seen, at)
            if last is None or at - last >= least:
                last = at
                out.append((k[0], i, at, "SELECTED"))
            else:
                out.append((k[0], i, at, "REDUNDANT"))
        state.update((last, seen))
        yield pd.DataFrame(out, columns=[key, tie, t, "decision"])

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {t} double, decision string"
    return stream.select(key, tie, F.col(t).cast("double").alias(t)).groupBy(key).applyInPandasWithState(run, schema, "last double, seen double", "append", "NoTimeout")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available. "append" goes to a file sink, exactly once; "complete" replaces the result each batch."""
    spark = stream.sparkSession
    root = shared_path(spark, "stream")
    out, schema = f"{root}/out", stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)
