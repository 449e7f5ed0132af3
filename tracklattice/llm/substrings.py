"""Substring dedup: word windows that also start in an earlier document, found by difference-cover anchors.

The residues {0, 1, 3} modulo 7 differ by every residue. So of two equal runs of 13 words, wherever they
start, some offset below 7 is a cover position in both: hashing 7-word anchors at cover positions only (3 of 7)
misses no match. Anchors seen in one document only go no further. Around the others each document extends to the
full windows that hold the anchor, and each window's smallest document is found by its hash. A window's equality
is that of two independent hashes of its words, of 64 and 32 bits: two different windows are taken for one with
probability 2^-80 at most, as no words travel that could be compared.

Anchors, windows and results travel as arrays, dealt by hash or by document, in parts of bounded size; no group is
brought together, as a very common passage is only a run of equal numbers in one array.

Defined cases: null, empty and blank texts have no words; a document shorter than the window has nothing to remove;
rows without an id are never an earlier document and lose nothing; rows that repeat an id count as one document for
"earlier" and get results of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk
from tracklattice.plans.shared import planned_bytes, shuffle_partitions

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Bytes of an anchor's hash that travel, besides its part: a false match only makes a candidate. Windows' hashes travel whole.
SHORT = 5
#: Bytes of the text column, as the planner estimates them, to a part. Larger tables have more parts, so tasks stay as they are.
PART_BYTES = 16 << 20
_SHORT = np.uint64((1 << (8 * SHORT)) - 1)
_PAIRS = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())])
PAIRS = "part int, hashes binary, docs binary"
#: A window's two hashes, 96 bits together.
WIDE = np.dtype([("one", "<u8"), ("two", "<u4")])


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    """Part of a document: ``pmod(xxhash64(id), parts)`` of the column."""
    u = np.uint64
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    # The public constants of XXH64 for one number of 8 bytes, and Spark's seed.
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = turn((u(42 + 8) + p5) ^ (turn(ids.astype(np.int64).view(u) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
    return np.mod((h ^ (h >> u(32))).view(np.int64), parts)


def wide_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Both hashes of the windows that begin at the words ``wanted``."""
    out = np.empty(len(wanted), WIDE)
    out["one"] = tk.windows(tk.hash_ranges(data, starts, ends), WINDOW)[wanted]
    out["two"] = tk.windows(tk.hash_ranges(data, starts, ends, 1), WINDOW, 1)[wanted] >> np.uint64(32)
    return out


def _shorten(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :SHORT].copy().view(f"V{SHORT}").ravel()


def _lengthen(blob: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(blob) // SHORT, 8), np.uint8)
    wide[:, :SHORT] = blob.reshape(-1, SHORT)
    return wide.view(np.uint64).ravel()


def _anchor_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the anchors of each text with at least a window's words, and the text each lies in."""
    n = np.diff(first)
    fit = np.where(n >= WINDOW, n - ANCHOR + 1, 0)
    text = np.repeat(np.arange(len(n)), fit)
    place = np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit)
    ok = _COVERED[place % PERIOD]
    text, place = text[ok], place[ok]
    return first[:-1][text] + place, text


def _groups(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs sorted by hash, where each hash begins, and its smallest and largest document."""
    wide = hashes.dtype == WIDE
    order = np.argsort(hashes["one"] if wide else hashes)
    hashes, docs = hashes[order], docs[order]
    begin = np.flatnonzero(_different(hashes["one"] if wide else hashes))
    if wide and len(begin) < int(_different(hashes).sum()):  # one first hash, different second ones
        order = np.lexsort((hashes["two"], hashes["one"]))
        hashes, docs = hashes[order], docs[order]
        begin = np.flatnonzero(_different(hashes))
    return hashes, docs, begin, *((f.reduceat(docs, begin) for f in (np.minimum, np.maximum)) if len(begin) else (docs, docs))


def _spread(groups: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """What is known of each group, for its rows."""
    return np.repeat(groups, np.diff(np.append(begin, n)))


def _anchors(parts: int, held: int = 500_000):
    """Anchors as (hash, document), dealt by hash. Of an anchor that several documents of a gathering have, only the smallest and
    largest go on; all of them are shared, and go straight to their documents' parts (numbered from ``parts`` on)."""

    def deal(gathered: list[tuple], blobs: tk.Blobs) -> Iterator[pa.RecordBatch]:
        hashes, docs, begin, low, high = _groups(*(np.concatenate(c) for c in zip(*gathered, strict=True)))
        most = low != high
        ends, of = np.concatenate([low, high[most]]), np.concatenate([hashes[begin], hashes[begin[most]]])
        yield from _by_hash(blobs, of, of, _shorten, ends, parts)
        many = _spread(most, begin, len(docs))
        yield from _by_doc(blobs, docs[many], _shorten(hashes[many]), parts, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, gathered, n = tk.Blobs(2 * parts, _PAIRS), [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, data, offsets in tk.chunks(batch, "text"):
                starts, ends, first = tk.words(data, offsets)
                at, text = _anchor_starts(first)
                if len(at):
                    gathered.append((tk.windows(tk.hash_ranges(data, starts, ends), ANCHOR)[at], ids[a + text]))
                    n += len(at)
                if n >= held:
                    yield from deal(gathered, blobs)
                    gathered, n = [], 0
        if n:
            yield from deal(gathered, blobs)
        yield from blobs.flush()

    return run


def _shared(parts: int):
    """Anchors of a part that at least two documents have, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= parts:  # known to be shared
            return table.set_column(0, "part", pc.cast(pc.subtract(table["part"], parts), pa.int32()))
        hashes, docs, begin, low, high = _groups(_lengthen(tk.gather(table["hashes"], np.uint8)), tk.gather(table["docs"], np.int64))
        many = _spread(low != high, begin, len(docs))
        return _by_document(docs[many], _shorten(hashes[many]), parts)

    return run


def _by_hash(blobs: tk.Blobs, keys: np.ndarray, hashes: np.ndarray, coded, docs: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Deals pairs by hash. They lie by document, as shuffles compress runs of equal ids well."""
    order = np.argsort(docs, kind="stable")
    yield from blobs.add(((keys[order] >> np.uint64(40)) % np.uint64(parts)).astype(np.int32), coded(hashes[order]), docs[order])


def _by_doc(blobs: tk.Blobs, docs: np.ndarray, hashes: np.ndarray, parts: int, base: int = 0) -> Iterator[pa.RecordBatch]:
    order = np.argsort(docs, kind="stable")
    yield from blobs.add((doc_part(docs[order], parts) + base).astype(np.int32), hashes[order], docs[order])


def _by_document(docs: np.ndarray, hashes: np.ndarray, parts: int) -> pa.Table:
    blobs = tk.Blobs(parts, _PAIRS, 1 << 62)
    list(_by_doc(blobs, docs, hashes, parts))
    return pa.Table.from_batches(list(blobs.flush()), _PAIRS)


def _different(x: np.ndarray) -> np.ndarray:
    """Where a sorted array begins a new value."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


class _Sets:
    """Hashes by document, for membership of many (document, hash) pairs at once: exact, as all are numbered."""

    def __init__(self, docs: np.ndarray, hashes: np.ndarray):
        self.docs = tk.sorted_unique(docs)
        columns = self._columns(hashes)
        self.hashes = [tk.sorted_unique(c) for c in columns]
        self.keys, (key, _) = [], self._number(self.docs, docs)
        for known, column in zip(self.hashes, columns, strict=True):  # (document, one), then ((document, one), two)
            key = key * len(known) + self._number(known, column)[0]
            self.keys.append(tk.sorted_unique(key))
            key = self._number(self.keys[-1], key)[0]

    @staticmethod
    def _columns(hashes: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(hashes[n]) for n in hashes.dtype.names] if hashes.dtype.names else [hashes]

    @staticmethod
    def _number(known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each value among those known, and whether it is one."""
        at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
        return at, known[at] == x if len(known) else np.zeros(len(x), bool)

    def has(self, docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out, left, key = np.zeros(len(docs), bool), np.arange(len(docs)), None
        for values, keys, column in zip(self.hashes, self.keys, self._columns(hashes), strict=True):
            number, known = self._number(values, column[left])  # most hashes aren't known at all
            number, left = number[known], left[known]
            if key is None:
                key, known = self._number(self.docs, docs[left])
            else:
                key, known = key[known], np.ones(len(left), bool)
            number, left, key = number[known], left[known], key[known]
            key, known = self._number(keys, key * len(values) + number)
            key, left = key[known], left[known]
        out[left] = True
        return out


def _window_texts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which windows start, and the text each lies in."""
    fit = np.maximum(np.diff(first) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(fit)), fit)
    return first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit), text


def _candidates(parts: int):
    """Windows around shared anchors, dealt by hash: (hash, the smallest document of this part that has it). The part's
    other documents that have it lose it, whatever other parts hold; they stay here, in parts numbered from ``parts`` on."""

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        blobs, gathered = tk.Blobs(2 * parts, _PAIRS, 1 << 62), []
        sets = _Sets(tk.gather(shared["docs"], np.int64), _lengthen(tk.gather(shared["hashes"], np.uint8)))
        if len(sets.docs):
            for batch in texts.to_batches():
                ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                named = np.isin(ids, sets.docs) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                batch, ids = batch.filter(pa.array(named)), ids[named]
                for a, _, data, offsets in tk.chunks(batch, "text"):
                    starts, ends, first = tk.words(data, offsets)
                    hashes = tk.hash_ranges(data, starts, ends)
                    at, text = _anchor_starts(first)
                    hit = at[sets.has(ids[a + text], tk.windows(hashes, ANCHOR)[at] & _SHORT)] if len(at) else at
                    near = np.zeros(len(hashes) + 1, np.int32)  # +1 where a window may start, -1 past the last
                    np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
                    np.add.at(near, hit + 1, -1)
                    begin, of = _window_texts(first)
                    if not len(begin):
                        continue
                    wanted = np.cumsum(near)[begin] > 0
                    begin, of = begin[wanted], of[wanted]
                    gathered.append((wide_windows(data, starts, ends, begin), ids[a + of]))
        if gathered:
            hashes, docs, begin, low, _ = _groups(*(np.concatenate(c) for c in zip(*gathered, strict=True)))
            list(_by_hash(blobs, hashes["one"][begin], hashes[begin], lambda x: x, low, parts))
            later = docs > _spread(low, begin, len(docs))
            list(_by_doc(blobs, docs[later], hashes[later], parts, parts))
        return pa.Table.from_batches(list(blobs.flush()), _PAIRS)

    return run


def _later(parts: int):
    """Windows that a smaller document has too, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= parts:  # known to be later
            return table.set_column(0, "part", pc.cast(pc.subtract(table["part"], parts), pa.int32()))
        hashes, docs, begin, low, _ = _groups(tk.gather(table["hashes"], WIDE), tk.gather(table["docs"], np.int64))
        later = docs > _spread(low, begin, len(docs))
        return _by_document(docs[later], hashes[later], parts)

    return run


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(with_text: bool):
    def run(texts: pa.Table, later: pa.Table) -> pa.Table:
        sets, out = _Sets(tk.gather(later["docs"], np.int64), tk.gather(later["hashes"], WIDE)), []
        for batch in texts.to_batches():
            ids = batch.column("doc_id")
            numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
            touched = np.isin(numbers, sets.docs) & ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in tk.chunks(batch, "text"):
                starts, ends, first = tk.words(data, offsets)
                keep = np.ones(len(starts), bool)
                if touched[a:b].any():
                    begin, of = _window_texts(first)
                    some = touched[a + of]
                    begin, of = begin[some], of[some]
                    if len(begin):
                        gone = begin[sets.has(numbers[a + of], wide_windows(data, starts, ends, begin))]
                        cover = np.zeros(len(starts) + 1, np.int32)
                        np.add.at(cover, gone, 1)
                        np.add.at(cover, gone + WINDOW, -1)
                        keep = np.cumsum(cover)[:-1] == 0
                raw = data.tobytes()
                kept = []
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    if keep[lo:hi].all():
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                    else:
                        left = np.flatnonzero(keep[lo:hi]) + lo
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]))
                total = np.concatenate(([0], np.cumsum(~keep)))
                removed = total[first[1:]] - total[first[:-1]]
                out.append(pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept]) if with_text else pa.nulls(b - a, pa.string())], schema=_REMOVED))
        return pa.Table.from_batches(out, _REMOVED)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, parts: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each document without the words of repeated windows.

    ``parts``: parts of every exchange, one for each ``PART_BYTES`` of the input unless given, but no fewer than shuffle
    partitions; a part's texts and windows are held in one task's memory. Results don't depend on it. Both passes that
    need the texts by document read one exchange.
    """
    spark = docs.sparkSession
    parts = parts or max(shuffle_partitions(spark), -(-planned_bytes(docs) // PART_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    texts = rows.select(F.pmod(part, F.lit(parts)).cast("int").alias("part"), "doc_id", "text").repartition(parts, "part")
    shared = rows.filter("doc_id is not null").mapInArrow(tk.released(_anchors(parts)), PAIRS).groupBy("part").applyInArrow(_shared(parts), PAIRS)
    windows = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_candidates(parts), PAIRS)
    later = windows.groupBy("part").applyInArrow(_later(parts), PAIRS)
    return texts.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS h, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT h, m, min(doc_id) AS d FROM s GROUP BY h, m),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM s JOIN f USING (h, m) WHERE d < doc_id),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
