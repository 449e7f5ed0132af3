"""The queries of the llm operators, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.llm import exactdedup, flac, langid, licenses, minhash, mixing, packing, secrets, substrings, warc
from tracklattice.plans.shared import shared_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 3-word shingles, Jaccard at least 0.85."""
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source's size and target, and the words taken of every document."""
    out = mixing.plan(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` by the public byte-level BPE tokenizer."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    return pack_documents(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, from trees fitted on the rows that aren't held out."""
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeper and size of every document's group of equal texts."""
    return exactdedup.dedup(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return licenses.digest(licenses.find(_documents(spark, sf_dir)))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC archives and read back."""
    root = shared_path(spark, "warc")
    manifest = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return warc.read(spark, root, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a FLAC stream, read back and described."""
    return flac.store_and_read(_documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a new ledger of blobs."""
    return secrets.digest(secrets.scan_documents(_documents(spark, sf_dir)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that start in a smaller document too."""
    return substrings.remove_repeats(_documents(spark, sf_dir), with_text=False).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_mix_sources, op3_pack_documents, op4_language_id, op5_exact_dedup, op6_license_scan, op7_warc_round_trip, op8_flac_media, op9_secret_scan, op10_substring_dedup)}
SQL: dict[str, str] = {"op2_mix_sources": mixing.SQL, "op5_exact_dedup": exactdedup.SQL, "op10_substring_dedup": substrings.SQL}
