"""Folds over ordered streams: rows are sorted by stream and read once, batch by batch, with a state of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(t: np.ndarray, last: float, least: float, strict: bool) -> tuple[np.ndarray, float]:
    """Which of one stream's ascending times are kept after ``last``, and the last one kept; jumps from one to the next."""
    out = np.zeros(len(t), bool)
    i = 0
    while i < len(t):
        # last + least is rounded, so the search begins a float earlier and the difference itself decides.
        i = max(i, int(np.searchsorted(t, np.nextafter(last + least, -np.inf), "left"))) if last > -np.inf else i
        while i < len(t) and not (t[i] - last > least if strict else t[i] - last >= least):
            i += 1
        if i < len(t):
            out[i], last = True, float(t[i])
            i += 1
    return out, last


def spaced(rows: DataFrame, keys: list[str], t: str, ties: list[str], least: float, strict: bool = False) -> DataFrame:
    """Rows at least ``least`` (with ``strict``: more) after the last one kept of their stream; the first of each is kept.

    A stream is read by one task, but never held: memory is one batch. Rows without a time are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = object(), -np.inf
        for batch in batches:
            times = batch.column("_at").to_numpy()
            names = list(zip(*[batch.column(f"_key{i}").to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * batch.num_rows
            keep = np.zeros(batch.num_rows, bool)
            a = 0
            while a < batch.num_rows:
                b = a + 1
                while b < batch.num_rows and names[b] == names[a]:
                    b += 1
                if names[a] != of:
                    of, last = names[a], -np.inf
                keep[a:b], last = _kept(times[a:b], last, least, strict)
                a = b
            yield pa.RecordBatch.from_struct_array(batch.column("row").filter(pa.array(keep)))

    columns = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    named = rows.filter(F.col(f"`{t}`").isNotNull()).select(columns, F.col(f"`{t}`").cast("double").alias("_at"), *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])
    order = [f"_key{i}" for i in range(len(keys))]
    dealt = named.repartition(*order) if keys else named.coalesce(1)
    return dealt.sortWithinPartitions(*order, "_at", *[F.col("row").getField(c) for c in ties]).mapInArrow(run, rows.schema)
