"""Mixing sources to target weights, with DataFrame functions only.

One pass over the texts gives a narrow table of sizes, from which the sizes per source are added up and the targets
derived. A document's copies are the floor of its source's rate plus one Bernoulli draw, seeded by a hash of its id. A source of
few or very uneven documents could miss its target by a third in one draw, so ``SEEDS`` fixed seeds are scored in one aggregate
over the narrow table, and each source draws with the seed whose words come nearest its target (ties: the first).
Rows of one source are never brought together: sums are pre-aggregated where the rows lie, and the rates, one row a source, are
joined back to them salted, as one source may hold a third of all rows.

The targets are found in two windows over one row a source, in one task: sources are names, not documents.

Defined cases: a null or empty text has size 0; null sources are one source, the last in order; an
empty table gives an empty mix; a null id draws as the text "null" would; rows that repeat an id draw alike.
Columns of the input may have any names: they travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Seeds that each source may draw with, four to a digest.
SEEDS = 64
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column, seed: str, number: Column) -> Column:
    """The ``number``-th draw in [0, 1) of the key: the same on every run, and in any SQL engine that has MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"), F.floor(number / 4).cast("string")).cast("binary"))
    return F.conv(F.substr(digest, (number % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of (source, source_size): shares by weight, held at ``most`` times the size.

    Raising a common level until the shares add up to the total gives the same as sharing the excess
    again and again: a source is held where its bound over its weight lies below the level. With sources
    sorted by that ratio, the level without the first k is (total - their bounds) / (weight of the rest). It
    rises with k as long as held sources go and falls from there on, so the level sought is the largest.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    every, before = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.max("level").over(every)
    return rows.withColumn("target", F.least(F.col("bound"), level * F.col("weight"))).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))).select("source", "source_size", "target", "rate")


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Tables (id, source, size) and (source, source_size, target, rate, draw) of ``docs``; draw is the seed of the source's draws."""
    sizes = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")), "mix-sizes")
    sources = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-sources")
    rated = _joined(sizes, sources, F.col("source"), F.col("id")).filter("size > 0")
    extra = F.col("rate") - F.floor("rate")
    # All draws of a document at once: the sum over a source, for each seed, of the words that its draws add.
    drawn = rated.select("source", (F.col("target") - F.col("source_size") * F.floor("rate")).alias("short"), *[F.when(uniform(F.col("id"), seed, F.lit(k)) < extra, F.col("size")).otherwise(0).alias(f"s{k}") for k in range(SEEDS)])
    sums = drawn.groupBy("source").agg(F.first("short").alias("short"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(SEEDS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("short")).alias("off"), F.lit(k).alias("draw")) for k in range(SEEDS)]))
    best = sums.select(F.col("source").alias("of"), best["draw"].alias("draw"))
    chosen = sources.join(best, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "rate", F.coalesce("draw", F.lit(0)).alias("draw"))
    return sizes, materialize(chosen, "mix-rates")


def _joined(rows: DataFrame, sources: DataFrame, source: Column, key: Column) -> DataFrame:
    """``rows`` with what is known of their source; no hint, as the planner knows the size of ``sources``."""
    salted = sources.withColumnRenamed("source", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = source.eqNullSafe(F.col("of")) & (F.pmod(F.xxhash64(key), F.lit(SALTS)) == F.col("salt"))
    return rows.join(salted, match).drop("of", "salt")


def _copies(key: Column, seed: str) -> Column:
    return F.floor("rate") + (uniform(key, seed, F.col("draw")) < F.col("rate") - F.floor("rate")).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies."""
    sizes, chosen = rates(docs, id_col, text_col, source_col, weights, most, seed)
    rated = _joined(sizes, chosen, F.col("source"), F.col("id"))
    return rated.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "rate", _copies(F.col("id"), seed).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each repeated as often as drawn, with the columns of ``docs``.

    A second pass over the documents draws from the rates, so no text is shuffled.
    """
    _, chosen = rates(docs, id_col, text_col, source_col, weights, most, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda name: F.col("row").getField(name)
    joined = _joined(rows, chosen, field(source_col), field(id_col))
    copies = joined.select("row", _copies(field(id_col), seed).alias("copies")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS bound, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(bound, max(level) OVER () * weight) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t),
x AS (SELECT d.doc_id, d.size, q.*, k, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix' || (k // 4)), (k % 4 * 8 + 1)::INTEGER, 8))::BIGINT::DOUBLE / 4294967296 < rate - floor(rate) AS more
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source CROSS JOIN range({SEEDS}) r(k)),
e AS (SELECT source, k, abs(sum(CASE WHEN more THEN size ELSE 0 END) - (min(target) - min(source_size) * floor(min(rate)))) AS off FROM x GROUP BY source, k),
c AS (SELECT source, arg_min(k, (off, k)) AS k FROM e GROUP BY source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN more THEN 1 ELSE 0 END) AS taken
FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND x.k = c.k
"""
