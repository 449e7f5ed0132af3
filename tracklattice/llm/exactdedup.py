"""Exact dedup: counting quotient filters built per partition, merged by sorted remainders.

A text's 64-bit fingerprint splits into a quotient (its home slot) and a remainder. Each task builds a filter
of its texts' fingerprints for every range of fingerprints: ``occupied`` marks quotients in use, ``ends``
the last remainder of each quotient's run, and the remainders of a run lie sorted, each with its count. All 64
bits are kept, so filters of one range merge losslessly by merging their sorted remainders, whatever the order
or number of filters. Fingerprints counted more than once go to byte verification: only rows that carry one of
them are grouped by their text. Everything else is already known to be unique.

Defined cases: null counts as the empty text; of equal texts the largest id stays (a null id only if
there is no other); an empty table gives an empty result; rows that repeat both id and text are one group whose
rows all have the keeper's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk
from tracklattice.plans.shared import materialize, shuffle_partitions

SALTS = 16
FILTER = "range int, bits int, occupied binary, ends binary, remainders binary, counts binary"
_SCHEMA = pa.schema([("range", pa.int32()), ("bits", pa.int32()), ("occupied", pa.binary()), ("ends", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])
#: Fingerprints a task gathers before it emits its filters.
HELD = 4_000_000


def range_of(fingerprints: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a fingerprint, by its high 32 bits; ranges are contiguous and of equal width."""
    return ((fingerprints >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def build(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, bytes, bytes, bytes]:
    """A filter of sorted distinct fingerprints: (occupied, ends, remainders, counts).

    The quotient is the ``bits`` high bits after the fingerprint's range has been folded out by rank order:
    as runs are stored in quotient order, sorted fingerprints are already in slot order.
    """
    quotients = (fingerprints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fingerprints), np.int64)
    base = int(quotients[0]) if len(quotients) else 0
    home = quotients - base
    occupied = np.zeros(int(home[-1]) + 1 if len(home) else 0, np.uint8)
    occupied[home] = 1
    last = np.append(home[1:] != home[:-1], True) if len(home) else np.zeros(0, bool)
    remainders = fingerprints & np.uint64((1 << (64 - bits)) - 1)
    width = (64 - bits + 7) // 8
    packed = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return base.to_bytes(8, "little") + np.packbits(occupied).tobytes(), np.packbits(last.astype(np.uint8)).tobytes(), packed.tobytes(), counts.astype("<u4").tobytes()


def read(bits: int, occupied: bytes, ends: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and their counts, from the parts of a filter."""
    held = np.frombuffer(counts, "<u4")
    width = (64 - bits + 7) // 8
    wide = np.zeros((len(held), 8), np.uint8)
    wide[:, :width] = np.frombuffer(remainders, np.uint8).reshape(-1, width)
    base = int.from_bytes(occupied[:8], "little")
    homes = np.flatnonzero(np.unpackbits(np.frombuffer(occupied[8:], np.uint8))) + base
    last = np.unpackbits(np.frombuffer(ends, np.uint8))[: len(held)]
    run = np.cumsum(last) - last
    quotients = homes[run].astype(np.uint64)
    return (quotients << np.uint64(64 - bits) if bits else np.uint64(0)) | wide.view("<u8").ravel(), held


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of fingerprints with the sums of their counts."""
    prints, counts = np.concatenate([f for f, _ in filters]), np.concatenate([c for _, c in filters])
    order = np.argsort(prints, kind="stable")  # merges the sorted runs
    prints, counts = prints[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[at], np.add.reduceat(counts, at) if len(at) else counts


def _filters(ranges: int):
    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        part = range_of(prints, ranges)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = []
        for a, b in zip(at, np.append(at[1:], len(part)), strict=True):
            bits = min(40, max(1, int(ranges).bit_length() + int(b - a).bit_length()))
            rows.append((int(part[a]), bits, *build(prints[a:b], counts[a:b], bits)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                n += batch.num_rows
            if n >= HELD:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    filters = [read(r["bits"], r["occupied"], r["ends"], r["remainders"], r["counts"]) for r in table.to_pylist()]
    prints, counts = merge(filters)
    again = counts > 1
    return pa.table({"fp": pa.array(prints[again].view(np.int64)), "n": pa.array(counts[again])})


def repeated_fingerprints(fingerprints: DataFrame, ranges: int | None = None) -> DataFrame:
    """(fp, n) of the fingerprints (one long column) that occur more than once."""
    ranges = ranges or 2 * shuffle_partitions(fingerprints.sparkSession)
    filters = fingerprints.mapInArrow(tk.released(_filters(ranges)), FILTER)
    return filters.groupBy("range").applyInArrow(_repeated, "fp long, n long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    again = materialize(repeated_fingerprints(rows.select("fp")).select(F.col("fp").alias("again")), "repeated")
    # No hint: the planner broadcasts the repeated fingerprints, 8 bytes each, where they are few, and unique texts then stay in place.
    # Byte verification: rows are grouped by the text itself; partial aggregation takes in large groups of copies.
    sha = F.sha2(F.col("text").cast("binary"), 256)
    groups = rows.join(again, F.col("fp") == F.col("again"), "left_semi").groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select(sha.alias("text_sha256"), "keep_id", "group_size")
    groups = materialize(groups, "copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.select("doc_id", sha.alias("text_sha256")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = keyed.join(groups.hint("merge"), ["text_sha256", "salt"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
