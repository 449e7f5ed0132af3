"""Packing tokenised documents into windows: best-fit decreasing over a segment tree of remaining capacities.

Each task tokenises its documents, cuts those beyond a window into full windows, and deals with the rests a batch
of ``HELD`` at a time: longest first, each goes to the open window with the least room that still holds it. The
tree's leaves are capacities 0..window; a node says whether any open window below it has room left, so the tightest
fit is found in log2(window) steps and windows of equal room wait on one stack. A batch leaves at most one window's
padding more than the packing of all rows would, and no row moves between tasks: nothing is shuffled, and a
lost task is made again from its input alone. Sequence ids are task * 2**36 + number, so they're unique.

Tokens: byte-level BPE. Texts are cut into pieces as the vocabulary's pattern does it, on arrays of code points,
and each different piece, told apart by all its code points, is encoded once; texts with code points beyond Latin letters and common punctuation, or
with a special token's string, go whole to the tokenizer's own library.

Defined cases: null counts as the empty text, whose only id is the end id; rows that repeat an id are packed each;
an empty table gives an empty result; a document of exactly a window is a sequence of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk

WINDOW = 1024
END = 0
#: Rests that a task packs at a time.
HELD = 500_000
#: Different pieces whose ids a worker remembers.
REMEMBERED = 200_000
#: Bytes of text that are cut into pieces at a time.
CHUNK = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_LETTER, _NUMBER, _SPACE, _OTHER, _BREAK, _FAR = range(6)


class Capacities:
    """Open windows by remaining capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.stacks: list[list] = [[] for _ in range(window + 1)]

    def _set(self, i: int, value: bool) -> None:
        i += self.size
        while i and self.any[i] != value:
            self.any[i] = value
            i //= 2
            if i:
                value = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, room: int, x) -> None:
        if room > 0:
            self.stacks[room].append(x)
            self._set(room, True)

    def tightest(self, least: int):
        """Takes out (room, window) with the least room that is at least ``least``; None if there is none."""
        i = least + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        x = self.stacks[room].pop()
        if not self.stacks[room]:
            self._set(room, False)
        return room, x


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset) of each length, and the number of windows. Longest first; equal lengths in their order."""
    order = np.argsort(-lengths, kind="stable")
    at, offset, n, rooms = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, Capacities(window)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = rooms.tightest(length)
        if found is None:
            found, n = (window, n), n + 1
        room, x = found
        at[i], offset[i] = x, window - room
        rooms.push(room - length, x)
    return at, offset, n


def _classes() -> np.ndarray:
    """Class of each code point that is cut here; others are far."""
    import unicodedata

    out = np.full(0x110000, _FAR, np.uint8)
    for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _SPACE if chr(c).isspace() and c not in range(0x1C, 0x20) else _OTHER if kind != "Cn" else _FAR
    out[0] = _OTHER
    return out


class Encoder:
    """Ids of texts, as the tokenizer file's library gives them."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.classes = _classes()
        core = getattr(self.fast, "_core_bpe", None)
        self._piece = (lambda x: core.encode_single_piece(x.encode())) if hasattr(core, "encode_single_piece") else self.fast.encode_ordinary
        self._forget()

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        joined = "\0".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts])
        begin = np.cumsum(lengths + 1) - lengths - 1
        kinds = self.classes[codes]
        breaks = begin[1:] - 1
        kinds[breaks] = _BREAK
        far = np.add.reduceat(np.append(kinds == _FAR, False), begin).astype(bool) if len(codes) else np.zeros(len(texts), bool)
        far &= lengths > 0
        for s in self.special:
            if s in joined:
                far |= np.array([s in t for t in texts])
        kinds[np.repeat(far, lengths + 1)[: len(kinds)] & (kinds != _BREAK)] = _BREAK
        starts, ends = self._cut(codes, kinds)
        ids, of = self._encode(joined, codes, starts, ends)
        piece_of = np.searchsorted(starts, np.append(begin, len(codes) + 1))
        at = np.concatenate(([0], np.cumsum(of)))
        for i, text in enumerate(texts):
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32) if far[i] else ids[at[piece_of[i]] : at[piece_of[i + 1]]]

    @staticmethod
    def _cut(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces.

        Runs of one kind are pieces, with these exceptions. The last blank of white space before something else is cut
        off, and if it is a space it belongs to what follows. An apostrophe that starts a piece and is followed by s, t,
        re, ve, m, ll or d takes these letters, and the letters after them are a piece of their own.
        """
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.append(True, kinds[1:] != kinds[:-1])
        is_start = new & (kinds != _BREAK)
        after_space = np.append(False, codes[:-1] == 0x20)
        is_start &= ~(after_space & (kinds != _SPACE))
        space_ends = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & (kinds[1:] != _BREAK))
        is_start[space_ends] = True
        marks = np.flatnonzero((codes == 0x27) & is_start)
        if len(marks):
            look = np.append(codes, [0, 0, 0]).astype(np.int64)
            kind = np.append(kinds, [_BREAK] * 3)
            one, two = look[marks + 1], look[marks + 2]
            pair = np.isin(one * 256 + np.minimum(two, 255), [ord("r") * 256 + ord("e"), ord("v") * 256 + ord("e"), ord("l") * 256 + ord("l")]) & (kind[marks + 2] == _LETTER)
            takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0)) * (kind[marks + 1] == _LETTER)
            marks, takes = marks[takes > 0], takes[takes > 0]
            is_start[marks + 1] = False
            rest = marks + 1 + takes
            rest = rest[rest < n]
            is_start[rest[kinds[rest] == _LETTER]] = True
        starts = np.flatnonzero(is_start)
        # A piece ends at the next piece's start, or at a break before it.
        ends = np.append(starts[1:], n)
        stops = np.append(np.flatnonzero(kinds == _BREAK), n)
        return starts, np.minimum(ends, stops[np.searchsorted(stops, starts)])

    def _encode(self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, which, names = self._different(joined, codes, starts, ends)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            found = [self._piece(joined[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = np.arange(len(new)) + len(self.begin) - 1
            self.known.update((names[i], n) for i, n in zip(new.tolist(), at[new].tolist(), strict=True))
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        of = (self.begin[at + 1] - self.begin[at])[which]
        place = np.repeat(self.begin[at][which] - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
        return self.pool[place], of

    @staticmethod
    def _different(joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(a piece of each kind, kind of each piece, name of each kind): the same kind if and only if all code points are the same.

        A piece of up to seven code points below 255 is named by the number that they make with its length, others by their text.
        """
        n, lengths = len(codes), ends - starts
        far = np.zeros(n + 1, np.int64)
        np.cumsum(codes >= 255, out=far[1:])
        short = (lengths <= 7) & (far[ends] == far[starts])
        # Eight bytes from each place on.
        narrow = np.append(np.minimum(codes, 255).astype(np.uint8), np.zeros(8, np.uint8))
        eight = np.ndarray((n + 1,), "<u8", narrow, 0, (1,))
        some = np.flatnonzero(short)
        size = lengths[some].astype(np.uint64)
        number = (eight[starts[some]] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))
        order = np.argsort(number)
        number = number[order]
        new = np.append(True, number[1:] != number[:-1])[: len(number)]
        which, kinds = np.empty(len(starts), np.int64), int(new.sum())
        which[some[order]] = np.cumsum(new) - 1
        first, names = some[order][new], number[new].tolist()
        rest = np.flatnonzero(~short)
        if len(rest):
            head, of = tk.exact_ids(codes, starts[rest], ends[rest], tk.hash_ranges(codes, starts[rest], ends[rest]))
            which[rest] = kinds + of
            first = np.append(first, rest[head])
            names += [joined[a:b] for a, b in zip(starts[rest[head]].tolist(), ends[rest[head]].tolist(), strict=True)]
        return first, which, names

    def _forget(self) -> None:
        """Known pieces: their number by name, where the ids of each begin, and all ids in a row."""
        self.known: dict[int | str, int] = {}
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    key = (json_path, ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _pack(paths: tuple[str, str, str], window: int, end: int):
    def emit(rests: list[tuple], task: int, numbered: int) -> tuple[pa.RecordBatch, int]:
        columns = [np.array(c, np.int64) for c in list(zip(*rests, strict=True))[1:]]
        at, offset, n = best_fit(columns[1], window)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rests], pa.int64()), *map(pa.array, columns), pa.array(at + (task << 36) + numbered), pa.array(offset)], schema=_PIECES), numbered + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, numbered = encoder(*paths), TaskContext.get().partitionId(), 0
        rests: list[tuple] = []
        for batch in batches:
            full: list[tuple] = []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encode.ids(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                total = len(ids)
                for start in range(0, total, window):
                    piece = ids[start : start + window]
                    row = (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), total)
                    if len(piece) == window:
                        full.append((*row, (task << 36) + numbered, 0))
                        numbered += 1
                    else:
                        rests.append(row)
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*full, strict=True)], schema=_PIECES)
            if len(rests) >= HELD:
                out, numbered = emit(rests, task, numbered)
                rests = []
                yield out
        if rests:
            yield emit(rests, task, numbered)[0]

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece of each document: where it starts, its ids' checksum, its sequence and offset there."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tk.released(_pack((json_path, ranks_path, pattern), window, end)), PIECES)
