"""Names, callables and SQL of the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a zoneless timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, t."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds().alias("t"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' first three dimensions as points: id, label, x, y, z."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


#: The same points in SQL.
CLOUD = "SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
EVENTS = "SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded, and -0 as 0, so that engines agree."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})
