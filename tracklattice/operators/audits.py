"""Audits: disjointness, completeness of runs, isolation, reproducibility, and content digests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def disjointness(members: DataFrame, roles: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """(role_a, role_b, shared, disjoint) for every pair of roles. An id's roles meet in one row, so nothing is joined."""
    per = members.groupBy(id_col).agg(F.collect_set("role").alias("roles"))
    pairs = sorted(tuple(sorted(p)) for p in combinations(roles, 2))
    sums = per.agg(*[F.count_if(F.array_contains("roles", a) & F.array_contains("roles", b)).alias(f"{a}/{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("role_a"), F.lit(b).alias("role_b"), F.col(f"`{a}/{b}`").alias("shared")) for a, b in pairs]))
    return sums.select(rows.alias("r")).select("r.*").withColumn("disjoint", F.col("shared") == 0)


def completeness(executed: DataFrame, reported: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, finding): MISSING were executed but not reported, SPURIOUS the other way round."""
    missing = executed.join(reported, id_col, "left_anti").withColumn("finding", F.lit("MISSING"))
    return missing.unionByName(reported.join(executed, id_col, "left_anti").withColumn("finding", F.lit("SPURIOUS")))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's JSON with its columns in order of their names; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): the same for the same rows in any order. Row digests are added up in four lanes, not collected."""
    d = row_digest(df.columns)
    lanes = [F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*[x.alias(f"l{i}") for i, x in enumerate(lanes)]).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(4)]).cast("binary"), 256).alias("digest"))


def reproducibility(first: DataFrame, second: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """One row: same rows (R2), same values within a tolerance (R1), largest difference, level R0 to R3."""
    renamed = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    both = first.join(renamed, keys, "full_outer")
    gap = F.greatest(*[F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")), F.when(F.col(v).isNull() & F.col(f"_{v}").isNull(), 0.0).otherwise(float("inf"))) for v in values]) if len(values) > 1 else F.coalesce(F.abs(F.col(values[0]) - F.col(f"_{values[0]}")), F.when(F.col(values[0]).isNull() & F.col(f"_{values[0]}").isNull(), 0.0).otherwise(float("inf")))
    worst = both.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_difference"), F.count(F.lit(1)).alias("n"))
    same = F.col("largest_difference") == 0
    return worst.withColumn("level", F.when(same, "R2").when(F.col("largest_difference") <= tolerance, "R1").otherwise("R0"))
