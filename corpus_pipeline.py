"""The corpus pipeline: language, exact dedup, near dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's rows as Parquet in the shared folder, reads them back as the next one's, and deletes
what the stage before left there.

Defined cases, of all stages: columns may have any names, as rows travel as one struct; an empty table passes empty. Language: a null,
empty or letterless text goes. Exact: null counts as the empty text; of rows with one id and one text a single one stays; a null
id stays only where no other row has its text. Near: rows without words stay; rows without an id stay if no row with an id is
in their group. Mix and packing: as their operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.llm import exactdedup, langid, minhash, mixing
from tracklattice.llm.queries import pack_documents
from tracklattice.plans.shared import made, materialize, sweep


def _kept(docs: DataFrame, verdict: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id has ``kept`` in ``verdict``; with ``once``, a single one of the rows that share id and text.

    Ids are unique keys but for repeated rows, so the join has no hot one. They are as many as rows, so it is never a broadcast. Only rows that do repeat are brought together by
    their id and text; no other text is shuffled for their sake.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ids = verdict.filter("kept").groupBy(F.col("doc_id").alias("kept_id")).agg((F.count(F.lit(1)) > 1).alias("again"))
    rows = docs.select(columns, F.col("doc_id").alias("of")).join(ids.hint("merge"), F.col("of").eqNullSafe(F.col("kept_id"))).select("row", "again")
    if not once:
        return rows.select("row.*")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    repeats = rows.filter("again").groupBy(F.col("row.doc_id").alias("id"), F.sha2(text.cast("binary"), 256).alias("sha")).agg(F.first("row").alias("row"))
    return rows.filter("not again").select("row").unionByName(repeats.select("row")).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach."""
    return langid.accepted(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return _kept(docs, materialize(exactdedup.dedup(docs).select("doc_id", "kept"), "exact-verdict"), once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): the one with the smallest id."""
    return _kept(docs, minhash.near_duplicates(docs, shingle=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]
#: SQL expresses neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = made()
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        after = made()
        # What the stage wrote for itself, and the table that it read, but not its result.
        sweep(spark, [p for p in after if p not in before and p != after[-1]] + [p for p in before if "/pipeline-" in p])
    return docs
