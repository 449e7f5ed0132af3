"""Streaming queries, run to the end and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.queries.ordered import keyframes_time_gated
from tracklattice.queries.registry import SQL, query, rounded
from tracklattice.streaming import operators as s


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A glob, as the file source takes a plain path for a folder, and the table may be either.
    return s.read(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000000 AS start, count(*) AS n, round(sum(value), 2) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def stream_window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour tumbling windows with a watermark."""
    out = s.drain(s.window_statistics(_stream(spark, sf_dir), "ts", "value", "6 hours", None, "1 hour", "event_type"), "complete")
    return rounded(out.select("event_type", F.unix_seconds("start").alias("start"), "n", "sum", "min", "max"), 2, "sum")


@query("""
WITH e AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts), INTERVAL 1 YEAR) >= INTERVAL 8 HOUR)::INT AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, g
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows with an eight-hour gap."""
    out = s.drain(s.sessions(_stream(spark, sf_dir), "ts", "8 hours", "1 hour", "user_id"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c ON v.user_id = c.user_id AND c.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND c.event_type = 'click'")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: views and clicks of a user within an hour of each other."""
    e = _stream(spark, sf_dir)
    v = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    c = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return s.drain(s.interval_join(v, c, "user_id", "view_ts", "click_ts", "1 HOUR", "2 hours").select("view_id", "click_id"))


@query(SQL[keyframes_time_gated.__name__])
def stream_time_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful selection; the same rows as the batch form."""
    e = _stream(spark, sf_dir).select("user_id", "event_id", s.epoch(F.col("ts")).alias("t"))
    out = s.drain(s.time_gated(e, "user_id", "t", "event_id", 21600.0, 1e9))
    return rounded(out.filter("decision = 'SELECTED'").select("user_id", "event_id", "t"), 3, "t")


