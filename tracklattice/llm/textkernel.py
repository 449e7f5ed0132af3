"""Vectorised text kernels over Arrow batches: words, rolling hashes, blobs for columnar shuffles.

A batch's texts lie in one byte buffer. The kernels work on that buffer in chunks of about
``CHUNK`` bytes (a longer text is a chunk of its own), so memory is bounded by the chunk and the
longest text, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Bytes of a block: longer ranges are hashed by blocks, and the blocks' hashes then by their places.
BLOCK = 4096
#: Odd multipliers of the words of a window, by position.
WORD_AT = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes of text."""
    data, offsets = utf8(batch.column(text))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross from one text to the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and each text's first word (one more than texts)."""
    starts, ends = runs(~_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def _multipliers(n: int, salt: int) -> np.ndarray:
    """One multiplier for each place; ``salt`` picks one of many independent families."""
    return mix(mix(np.arange(n, dtype=np.uint64)) + U64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


_AT = {salt: _multipliers(BLOCK, salt) for salt in (0, 1)}


def _places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each element of the ranges in the data, and in its own range."""
    total = np.cumsum(lengths)
    own = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - lengths, lengths)
    return np.repeat(starts, lengths) + own, own


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` modulo 2^64; empty runs add up to 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand.

    A multilinear hash: each byte times the multiplier of its place in the range. The multipliers are independent of each
    other (no powers of one base, whose hash modulo 2^64 has pairs of words that collide whatever the base), so two
    ranges collide with probability 2^-56 at most, and with two salts at 2^-112. ``data`` may be any unsigned numbers below 2^32.
    """
    lengths = ends - starts
    if len(lengths) and int(lengths.max()) > BLOCK:
        many = np.maximum(-(-lengths // BLOCK), 1)
        of, number = _places(np.arange(len(many)), many)
        of = np.repeat(np.arange(len(many)), many)
        begin = starts[of] + number * BLOCK
        own = hash_ranges(data, begin, np.minimum(begin + BLOCK, ends[of]), salt)
        out = _sums(own * _multipliers(int(many.max()), salt + 16)[number], many)
        return np.where(many > 1, mix(out + lengths.astype(np.uint64)), own[np.cumsum(many) - many])
    out, ends = np.empty(len(lengths), np.uint64), np.cumsum(lengths)
    for low, high in _steps(ends):
        at, own = _places(starts[low:high], lengths[low:high])
        values = data[at].astype(np.uint64)
        values += U64(1)
        values *= _AT[salt][own]
        out[low:high] = _sums(values, lengths[low:high])
    return mix(out + lengths.astype(np.uint64))


def _steps(ends: np.ndarray, step: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of ranges (first, end) of about ``step`` elements, or of one range; ``ends`` are the sums of their lengths."""
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + step, "right")))
        yield low, high
        low = high


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array begins a new value."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges that begin at ``a`` and ``b`` hold the same bytes."""
    out = np.ones(len(a), bool)
    for low, high in _steps(np.cumsum(lengths)):
        one, _ = _places(a[low:high], lengths[low:high])
        two = one + np.repeat(b[low:high] - a[low:high], lengths[low:high])
        out[low:high] = _sums((data[one] != data[two]).astype(np.uint64), lengths[low:high]) == 0
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a range of each number, number of each range): two have the same number if and only if their bytes are the same.

    Hashes only propose: every range is compared with one of its hash. What differs is numbered by its bytes.
    """
    order = np.argsort(hashes)
    new = _new(hashes[order])
    first, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    lengths, head = ends - starts, first[which]
    differ = np.flatnonzero((lengths[head] != lengths) | ~same_ranges(data, starts, starts[head], np.minimum(lengths, lengths[head])))
    if len(differ):
        names: dict[tuple[int, bytes], int] = {}
        for i in differ.tolist():
            name = (int(which[i]), data[starts[i] : ends[i]].tobytes())
            which[i] = names.setdefault(name, len(first) + len(names))
        new, at = np.unique(which[differ], return_index=True)
        first = np.append(first, differ[at])
        assert len(first) == which.max() + 1 and len(new) == len(names)
    return first, which


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive words, by the first one; also those that cross texts, which callers leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = WORD_AT if salt == 0 else mix(WORD_AT + U64(salt)) | U64(1)
    out = hashes[:n] * at[0]
    for j in range(1, k):
        out += hashes[j : j + n] * at[j]
    return mix(out + U64(k))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def released(run):
    """A batch function that hands freed memory back to the system when its task ends.

    Spark reuses Python workers: without it a worker stays as large as the largest task it ever ran, beside the
    workers and the JVM of the next stage.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def _release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Blobs:
    """Gathers columns of numbers, and deals them out by part as one row of binary columns per part.

    A shuffle then moves a few thousand arrays rather than millions of rows.
    """

    def __init__(self, parts: int, schema: pa.Schema, most: int = 500_000):
        self.parts, self.schema, self.most, self.held, self.columns = parts, schema, most, 0, []

    def add(self, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.columns.append((part, *columns))
        self.held += len(part)
        if self.held >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part, *columns = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        self.columns, self.held = [], 0
        order = np.argsort(part, kind="stable")
        part = part[order]
        columns = [c[order] for c in columns]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(at[1:], len(part))
        out = [pa.array(part[at].astype(np.int32))]
        out += [pa.array([c[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays(out, schema=self.schema)


def gather(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The numbers of a column of blobs."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def batches_of(table: Iterable[dict] | dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(table, schema=schema)
