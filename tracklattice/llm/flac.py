"""Media columns: FLAC streams in binary columns, encoded and decoded in batches.

Decoding reads Rice residuals and linear predictors (constant, verbatim, fixed and LPC subframes), verifies the CRC-8 of
every frame header, the CRC-16 of every frame and the MD5 of the samples, and gives PCM blocks with the number of their
first sample. Streams whose seek table names every frame are decoded a batch of frames at a time: residual i of all frames
is read in one step. Other streams (partitions, escapes, stereo, up to 24 bits) are decoded frame by frame.

The encoder writes mono 8-bit streams: frames of ``BLOCK`` samples, the cheapest of constant, fixed 0 to 2, LPC 2 and
verbatim, one Rice parameter each, a seek point for each frame.

Defined cases: a null payload gives a null stream; an empty payload a stream without frames; a damaged stream raises, naming
the checksum that failed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk

BLOCK = 1024
RATE = 8000
#: Bytes of samples that are coded at a time.
CHUNK = 1 << 19
_LPC_SHIFT, _LPC_BITS = 9, 12


def _crc_table(bits: int, poly: int) -> np.ndarray:
    """CRC of each ``bits``-bit word, from a CRC of 0."""
    crc = np.arange(1 << bits, dtype=np.int64)
    if bits == 8:
        for _ in range(8):
            crc = ((crc << 1) ^ np.where(crc & 0x80, poly, 0)) & 0xFF
    else:
        for _ in range(16):
            crc = ((crc << 1) ^ np.where(crc & 0x8000, poly, 0)) & 0xFFFF
    return crc


_CRC8 = _crc_table(8, 0x07).tolist()
_CRC16 = _crc_table(16, 0x8005).astype(np.uint16)


def crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = _CRC8[crc ^ x]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of byte ranges, all in step. Leading zeros don't change it, so the ranges are aligned at their ends."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    order = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[order], ends[order]
    length = ends - starts
    wide = int(length[0] + 1) // 2 * 2
    at = ends[None, :] - wide + np.arange(wide)[:, None]
    grid = np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0).astype(np.uint16)
    pairs = (grid[0::2] << 8) | grid[1::2]
    crc = np.zeros(len(starts), np.uint16)
    for row in pairs:
        crc = _CRC16[crc ^ row]
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    for extra in range(1, 7):
        if n < 1 << (5 * extra + 6):
            lead = (0xFF << (7 - extra)) & 0xFF if extra < 6 else 0xFE
            return bytes([lead | (n >> (6 * extra)), *[0x80 | (n >> (6 * i)) & 0x3F for i in range(extra - 1, -1, -1)]])
    raise ValueError("frame number")


_headers: dict[tuple[int, int], bytes] = {}


def _header(number: int, size: int) -> bytes:
    """Frame header of a mono 8-bit frame."""
    key = (number, size)
    if key not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        head = b"\xff\xf8" + bytes([0xA0 if size == 1024 else 0x70, 0x02]) + _utf8_number(number) + (b"" if size == 1024 else struct.pack(">H", size - 1))
        _headers[key] = head + bytes([crc8(head)])
    return _headers[key]


#: Bytes as samples byte - 128, in two's complement.
_SIGNED = bytes(i ^ 0x80 for i in range(256))


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter of each frame's folded residuals (frames, BLOCK; zeros past the size) and the bits it takes."""
    mean = u.sum(axis=1) / np.maximum(sizes, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 13).astype(np.int32)
    best, bits = k, sizes * (1 + k) + (u >> k[:, None]).sum(axis=1)
    other = k + 1
    more = sizes * (1 + other) + (u >> other[:, None]).sum(axis=1)
    return np.where(more < bits, other, best), np.minimum(more, bits)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream of each payload's bytes, as samples byte - 128."""
    out: list[bytes] = []
    group: list[bytes] = []
    size = 0
    for x in payloads:
        if len(x) > 2 * CHUNK:  # by itself, a run of frames at a time
            out += _encode(group) if group else []
            out.append(_encode_long(x))
            group, size = [], 0
            continue
        group.append(x)
        size += len(x)
        if size >= CHUNK:
            out += _encode(group)
            group, size = [], 0
    return out + (_encode(group) if group else [])


def _frames(payloads: list[bytes], skip: int = 0) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames of the payloads in a row: bytes, where each frame starts and how long it is, frames of each payload, and the
    frames' numbers (from ``skip`` on in each payload) and samples."""
    lengths = np.array([len(x) for x in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    of = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(lengths) - lengths, per) + number * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(lengths, per) - number * BLOCK).astype(np.int32)
    inside = np.arange(BLOCK)[None, :] < sizes[:, None]
    at = np.minimum(first[:, None] + np.arange(BLOCK)[None, :], max(len(data) - 1, 0))
    x = np.where(inside, data[at].astype(np.int32) - 128, 0) if total else np.zeros((0, BLOCK), np.int32)

    # Candidates: (type, order, residuals, bits, parameter); residuals before the order and past the size are zero.
    choice = []
    lead = np.zeros((total, BLOCK + 2), np.int32)
    lead[:, 2:] = x
    one, two = lead[:, 1:-1], lead[:, :-2]
    energy = lambda a, b: np.einsum("ij,ij->i", a.astype(np.float32), b.astype(np.float32)).astype(np.float64)
    r0, r1, r2 = energy(x, x), energy(x, one), energy(x, two)
    base = np.maximum(r0 * r0 - r1 * r1, 1e-6)
    limit = (1 << (_LPC_BITS - 1)) - 1
    c1 = np.clip(np.round(r1 * (r0 - r2) / base * (1 << _LPC_SHIFT)), -limit, limit).astype(np.int32)
    c2 = np.clip(np.round((r0 * r2 - r1 * r1) / base * (1 << _LPC_SHIFT)), -limit, limit).astype(np.int32)
    residuals = [x, x - one, x - 2 * one + two, x - ((c1[:, None] * one + c2[:, None] * two) >> _LPC_SHIFT)]
    orders, extra = [0, 1, 2, 2], [0, 0, 0, 9 + 2 * _LPC_BITS]
    for r, order, more in zip(residuals, orders, extra, strict=True):
        u = np.where(inside, _fold(r), 0)
        u[:, :order] = 0
        k, bits = _rice(u, sizes - order)
        choice.append((u, k, bits + 8 + 8 * order + more + 10))
    cost = np.stack([c[2] for c in choice] + [8 + 8 * sizes])
    kind = cost.argmin(axis=0)  # 0 to 2 fixed, 3 LPC, 4 verbatim
    kind[(x == x[:, :1]).all(axis=1, where=inside) if total else np.zeros(0, bool)] = 5
    kind[sizes < 3] = 4

    number = number + skip
    heads = [_header(n, s) for n, s in zip(number.tolist(), sizes.tolist(), strict=True)]
    head_bytes = np.array([len(h) for h in heads], np.int64)
    body_bits = np.where(kind == 5, 16, cost[np.minimum(kind, 4), np.arange(total)])
    frame_bytes = head_bytes + (body_bits + 7) // 8 + 2
    start = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[where + j] = (value >> (width - 1 - j)) & 1

    at = (start + head_bytes) * 8
    types = np.array([8, 9, 10, 32 + 1, 1, 0])
    put(at, types[kind] << 1, 8)
    rows = np.flatnonzero(kind == 5)
    put(at[rows] + 8, x[rows, 0] & 255, 8)
    rows = np.flatnonzero(kind == 4)
    if len(rows):
        i, j = np.nonzero(inside[rows])
        put(at[rows][i] + 8 + 8 * j, x[rows[i], j] & 255, 8)
    for c in range(4):
        u, k, _ = choice[c]
        chosen, order = np.flatnonzero(kind == c), orders[c]
        for i in range(order):
            put(at[chosen] + 8 + 8 * i, x[chosen, i] & 255, 8)
        body = at[chosen] + 8 + 8 * order
        if c == 3:
            put(body, np.full(len(chosen), _LPC_BITS - 1), 4)
            put(body + 4, np.full(len(chosen), _LPC_SHIFT), 5)
            put(body + 9, c1[chosen], _LPC_BITS)
            put(body + 9 + _LPC_BITS, c2[chosen], _LPC_BITS)
            body = body + extra[c]
        put(body, k[chosen], 10)  # method 0, partition order 0, parameter
        body = body + 10
        for p in np.unique(k[chosen]):
            of_p = np.flatnonzero(k[chosen] == p)
            rows = chosen[of_p]
            values, coded = u[rows, order:], inside[rows, order:]
            quotient = values >> p
            width = np.where(coded, quotient + 1 + p, 0)
            ends = np.cumsum(width, axis=1) + body[of_p][:, None]
            mark = (ends - p - 1)[coded]
            bits[mark] = 1
            values = values[coded]
            for j in range(int(p)):
                on = mark[(values >> (p - 1 - j)) & 1 == 1]
                bits[on + 1 + j] = 1
    flat = np.packbits(bits)
    if total:
        joined = np.frombuffer(b"".join(heads), np.uint8)
        head_at = np.cumsum(head_bytes) - head_bytes
        flat[np.repeat(start - head_at, head_bytes) + np.arange(len(joined))] = joined
        crc = crc16(flat, start, start + frame_bytes - 2)
        flat[start + frame_bytes - 2], flat[start + frame_bytes - 1] = crc >> 8, crc & 255
    return flat.tobytes(), start, frame_bytes, per, number, sizes


def _stream(payload: bytes, number: np.ndarray, offset: np.ndarray, sizes: np.ndarray, frames: bytes) -> bytes:
    """Metadata, with a seek point for every frame, and frames."""
    points = np.zeros(len(number), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points["sample"], points["offset"], points["n"] = number * BLOCK, offset, sizes
    md5 = hashlib.md5(payload.translate(_SIGNED)).digest()
    info = struct.pack(">HH", BLOCK, BLOCK) + bytes(6) + ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + md5
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + points.tobytes() + frames


def _encode(payloads: list[bytes]) -> list[bytes]:
    raw, start, size, per, number, samples = _frames(payloads)
    out, ends = [], np.cumsum(per)
    for payload, x, y in zip(payloads, (ends - per).tolist(), ends.tolist(), strict=True):
        a, b = (int(start[x]), int(start[y - 1] + size[y - 1])) if y > x else (0, 0)
        out.append(_stream(payload, number[x:y], start[x:y] - a, samples[x:y], raw[a:b]))
    return out


def _encode_long(payload: bytes) -> bytes:
    """The same stream as ``_encode``'s, CHUNK bytes at a time: memory is a chunk's, beside the payload and the stream."""
    body, columns = bytearray(), []
    for at in range(0, len(payload), CHUNK):
        raw, start, _, _, number, samples = _frames([payload[at : at + CHUNK]], at // BLOCK)
        columns.append((number, start + len(body), samples))
        body += raw
    return _stream(payload, *(np.concatenate(c) for c in zip(*columns, strict=True)), bytes(body))


class Stream:
    """Metadata of a stream: rate, channels, bits, samples, md5, seek points, where its frames begin."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            if kind == 0:
                x = int.from_bytes(body[10:18], "big")
                self.block, self.rate, self.channels, self.bits, self.samples, self.md5 = int.from_bytes(body[2:4], "big"), x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & ((1 << 36) - 1), body[18:34]
            elif kind == 3:
                self.points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            at += 4 + size
        self.frames_at = at

    def complete(self) -> bool:
        """Whether the seek table names every frame, so that frames can be read side by side."""
        p = self.points
        if p is None or self.channels != 1 or self.bits != 8:
            return False
        n = p["n"].astype(np.int64)
        return bool(n.sum() == self.samples and (p["sample"].astype(np.int64) == np.cumsum(n) - n).all())


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(raw: bytes, at: int) -> tuple[int, int, int, int]:
    """(samples, channel code, bits or 0, header's length); verifies the CRC-8."""
    if raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should be")
    code, rate = raw[at + 2] >> 4, raw[at + 2] & 15
    p = at + 4
    lead = raw[p]
    p += 1 if lead < 0x80 else next(i for i in range(2, 8) if not lead & (0x80 >> i)) if lead < 0xFE else 7
    if code in (6, 7):
        size = int.from_bytes(raw[p : p + code - 5], "big") + 1
        p += code - 5
    else:
        size = _SIZES[code]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(raw[at:p]) != raw[p]:
        raise ValueError("CRC-8 of a frame header")
    return size, raw[at + 3] >> 4, _BITS.get(raw[at + 3] >> 1 & 7, 0), p + 1 - at


class _Bits:
    """Bits of a byte string, one field after another."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at * 8

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        x = int.from_bytes(self.raw[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return x & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(b: _Bits, size: int, bits: int) -> np.ndarray:
    b.take(1)
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    bits -= wasted
    if kind == 0:
        return np.full(size, b.signed(bits), np.int64) << wasted
    if kind == 1:
        return np.array([b.signed(bits) for _ in range(size)], np.int64) << wasted
    order = kind & 7 if kind < 32 else (kind & 31) + 1
    x = [b.signed(bits) for _ in range(order)]
    if kind < 32:
        coefs, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
    else:
        precision, shift = b.take(4) + 1, b.signed(5)
        coefs = [b.signed(precision) for _ in range(order)]
    wide, parts = (4, 5)[b.take(2)], b.take(4)
    for i in range(1 << parts):
        k = b.take(wide)
        escape = b.take(5) if k == (1 << wide) - 1 else None
        for _ in range((size >> parts) - (order if i == 0 else 0)):
            if escape is None:
                u = b.unary() << k | (b.take(k) if k else 0)
                r = (u >> 1) ^ -(u & 1)
            else:
                r = b.signed(escape)
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    return np.array(x, np.int64) << wasted


def _decode_slow(raw: bytes, stream: Stream) -> np.ndarray:
    """Samples (samples, channels) of any stream, frame by frame."""
    at, out, n = stream.frames_at, [], 0
    while n < stream.samples if stream.samples else at < len(raw):
        size, code, bits, head = _frame_header(raw, at)
        bits, b = bits or stream.bits, _Bits(raw, at + head)
        side = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(code, (0,) * (code + 1))
        x = [_subframe(b, size, bits + s) for s in side]
        if code == 8:
            x = [x[0], x[0] - x[1]]
        elif code == 9:
            x = [x[0] + x[1], x[1]]
        elif code == 10:
            mid = (x[0] << 1) | (x[1] & 1)
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        end = (b.at + 7) // 8
        if int(crc16(np.frombuffer(raw, np.uint8), np.array([at]), np.array([end]))[0]) != int.from_bytes(raw[end : end + 2], "big"):
            raise ValueError("CRC-16 of a frame")
        out.append(np.stack(x, axis=1))
        at, n = end + 2, n + size
    return np.concatenate(out) if out else np.zeros((0, stream.channels), np.int64)


def _pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(*x.shape, 8)[..., :width].tobytes()


def decode(streams: list[bytes]) -> list[bytes]:
    """PCM of each stream: little-endian samples as MD5 covers them. Every checksum is verified."""
    out: list[bytes] = []
    group: list[bytes] = []
    size = 0
    for x in streams:
        if len(x) > 2 * CHUNK:  # by itself, a run of frames at a time
            out += _decode(group) if group else []
            out.append(_decode_long(x))
            group, size = [], 0
            continue
        group.append(x)
        size += len(x)
        if size >= CHUNK:
            out += _decode(group)
            group, size = [], 0
    return out + (_decode(group) if group else [])


def _run(raw: bytes, info: Stream, a: int, b: int) -> bytes | None:
    """PCM of the frames a to b of a stream with a complete seek table; None if one of them isn't of the kinds read at once."""
    offsets = np.append(info.points["offset"][a:b].astype(np.int64), int(info.points["offset"][b]) if b < len(info.points) else len(raw) - info.frames_at)
    base = info.frames_at + int(offsets[0])
    part = raw[base : info.frames_at + int(offsets[-1])]
    data, at, end = np.frombuffer(part, np.uint8), offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    if (crc16(data, at, end - 2) != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise ValueError("CRC-16 of a frame")
    size = info.points["n"].astype(np.int64)[a:b]
    heads = []
    for p, n in zip(at.tolist(), size.tolist(), strict=True):
        samples, code, bits, head = _frame_header(part, p)
        if samples != n or code or bits not in (0, 8):
            raise ValueError("a frame differs from its seek point")
        heads.append(head)
    x, odd = _samples(data, at + np.array(heads, np.int64), size)
    if odd.any():
        return None
    flat = x.astype(np.int8)
    return b"".join([flat[i, :n].tobytes() for i, n in enumerate(size.tolist())])


def _decode_long(raw: bytes) -> bytes:
    """The same samples as ``_decode``'s, about CHUNK bytes of frames at a time: the decoder holds some 64 bytes for each of them."""
    info = Stream(raw)
    pcm: bytes | bytearray = bytearray()
    if info.complete():
        offsets, a = info.points["offset"].astype(np.int64), 0
        while a < len(offsets):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            b = len(offsets) if offsets[-1] - offsets[a] <= CHUNK else b
            run = _run(raw, info, a, b)
            if run is None:
                break
            pcm += run
            a = b
        done = a == len(offsets)
    else:
        done = False
    if not done:
        pcm = _pcm_bytes(_decode_slow(raw, info), info.bits)
    if info.md5 != bytes(16) and hashlib.md5(pcm).digest() != info.md5:
        raise ValueError("MD5 of the samples")
    return bytes(pcm)


def _decode(streams: list[bytes]) -> list[bytes]:
    infos = [Stream(x) for x in streams]
    base, starts, heads, sizes, where = 0, [], [], [], {}
    for i, (raw, info) in enumerate(zip(streams, infos, strict=True)):
        if info.complete():
            first = len(starts)
            for offset, n in zip(info.points["offset"].tolist(), info.points["n"].tolist(), strict=True):
                size, code, bits, head = _frame_header(raw, info.frames_at + offset)
                if size != n or code or bits not in (0, 8):
                    raise ValueError("a frame differs from its seek point")
                starts.append(base + info.frames_at + offset)
                heads.append(head)
                sizes.append(n)
            where[i] = (first, len(starts), base + len(raw))
        base += len(raw)
    start, head, size = (np.array(x, np.int64) for x in (starts, heads, sizes))
    end = np.append(start[1:], 0)
    for _, b, stop in where.values():
        if b:
            end[b - 1] = stop
    for i in where:  # the next frame of the same stream, or the stream's end
        a, b, stop = where[i]
        if b > a:
            end[b - 1] = stop
    data = np.frombuffer(b"".join(streams), np.uint8)
    stored = (data[end - 2].astype(np.uint16) << 8 | data[end - 1]) if len(start) else np.zeros(0, np.uint16)
    if (crc16(data, start, end - 2) != stored).any():
        raise ValueError("CRC-16 of a frame")
    x, odd = _samples(data, start + head, size)
    out = []
    flat = x.astype(np.int8)
    for i, (raw, info) in enumerate(zip(streams, infos, strict=True)):
        if i in where and not odd[where[i][0] : where[i][1]].any():
            a, b, _ = where[i]
            pcm = b"".join([flat[j, :n].tobytes() for j, n in zip(range(a, b), sizes[a:b], strict=True)])
        else:
            pcm = _pcm_bytes(_decode_slow(raw, info), info.bits)
        if info.md5 != bytes(16) and hashlib.md5(pcm).digest() != info.md5:
            raise ValueError("MD5 of the samples")
        out.append(pcm)
    return out


def _samples(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, most samples) of mono 8-bit frames whose subframes begin at bytes ``at``, and which frames can't be read so."""
    n = len(at)
    most = int(size.max()) if n else 0
    x = np.zeros((n, most), np.int32)
    if not n:
        return x, np.zeros(0, bool)
    wide = np.append(data, np.zeros(8, np.uint8)).astype(np.uint32)
    word = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]

    def field(pos: np.ndarray, width) -> np.ndarray:
        return ((word[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(1)).astype(np.int64) >> (31 - width)

    signed = lambda v, width: v - ((v >> (width - 1)) << width)
    kind, wasted = data[at] >> 1, data[at] & 1
    order = np.where((kind >= 8) & (kind <= 12), kind & 7, np.where(kind >= 32, (kind & 31) + 1, 0)).astype(np.int64)
    rice = (kind >= 8) & (kind <= 12) | (kind >= 32)
    odd = (wasted == 1) | ~(rice | (kind < 2))
    pos = (at + 1) * 8
    rows = np.flatnonzero(~odd & (kind == 0))
    x[rows] = data[at[rows] + 1].view(np.int8)[:, None]
    rows = np.flatnonzero(~odd & (kind == 1))
    if len(rows):
        places = np.minimum(at[rows, None] + 1 + np.arange(most)[None, :], len(data) - 1)
        x[rows] = data[places].view(np.int8)
    top = int(order.max())
    for i in range(top):
        has = np.flatnonzero(rice & (order > i))
        x[has, i] = data[at[has] + 1 + i].view(np.int8)
    pos = pos + 8 * order
    lpc = np.flatnonzero(~odd & (kind >= 32))
    shift, coefs = np.zeros(n, np.int64), np.zeros((top, n), np.int64)
    for o, row in enumerate(([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])):
        for j, c in enumerate(row[:top]):
            coefs[j, kind == 8 + o] = c
    if len(lpc):
        precision = field(pos[lpc], 4) + 1
        shift[lpc] = signed(field(pos[lpc] + 4, 5), 5)
        p = pos[lpc] + 9
        for j in range(int(order[lpc].max())):
            has = order[lpc] > j
            coefs[j, lpc[has]] = signed(field(p, precision), precision)[has]
            p = p + np.where(has, precision, 0)
        pos[lpc] = p
    k = np.where(rice, field(pos + 6, 4), 0)
    odd |= rice & ((field(pos, 6) != 0) | (k == 15) | (shift < 0))
    pos = pos + 10
    rows = np.flatnonzero(rice & ~odd)
    rows = rows[np.argsort(-(size - order)[rows], kind="stable")]
    if len(rows):
        ones = np.unpackbits(data)
        places = np.where(ones, np.arange(len(ones), dtype=np.int32), np.int32(len(ones)))
        following = np.minimum.accumulate(places[::-1])[::-1]
        coded = (size - order)[rows]
        steps = int(coded[0])
        active = np.searchsorted(-coded, -np.arange(steps), "left")
        begin = np.zeros((steps, len(rows)), np.int32)
        marks = np.zeros((steps, len(rows)), np.int32)
        here, skip = pos[rows].astype(np.int32), (k[rows] + 1).astype(np.int32)
        last = np.int32(len(following) - 1)
        for i in range(steps):
            m = active[i]
            begin[i, :m] = here[:m]
            marks[i, :m] = following[np.minimum(here[:m], last)]
            here[:m] = marks[i, :m] + skip[:m]
        parameter = k[rows][None, :]
        low = np.where(parameter > 0, field(np.minimum(marks + 1, last), np.maximum(parameter, 1)), 0)
        u = ((marks - begin).astype(np.int64) << parameter) | low
        r = (u >> 1) ^ -(u & 1)
        for o in np.unique(order[rows]):
            mine = np.flatnonzero(order[rows] == o)
            which = rows[mine]
            own = r[:, mine].astype(np.int32)
            if o == 0 and (kind[which] == 8).all():
                x[which, :steps] = np.where(np.arange(steps)[None, :] < size[which][:, None], own.T, 0)
                continue
            y = np.zeros((steps + o, len(mine)), np.int32)
            y[:o] = x[which, :o].T
            c, s = coefs[:, which].astype(np.int32), shift[which].astype(np.int32)
            for i in range(steps):
                p = c[0] * y[i + o - 1]
                for j in range(1, o):
                    p = p + c[j] * y[i + o - 1 - j]
                y[i + o] = own[i] + (p >> s)
            y = y[:most].T
            x[which, : y.shape[1]] = np.where(np.arange(y.shape[1])[None, :] < size[which][:, None], y, 0)
    return x, odd


def blocks(raw: bytes, first: int, n: int) -> tuple[int, bytes]:
    """PCM of the blocks of a stream that hold samples ``first`` to ``first + n``, and the number of their first sample.

    Seeks by the table: only the frames wanted are decoded. Streams without a complete table are decoded from the start.
    """
    info = Stream(raw)
    if not info.complete():
        return 0, _pcm_bytes(_decode_slow(raw, info), info.bits)
    samples = info.points["sample"].astype(np.int64)
    a = max(0, int(np.searchsorted(samples, first, "right")) - 1)
    b = max(a + 1, int(np.searchsorted(samples, first + n, "left")))
    pcm = _run(raw, info, a, b)
    return (int(samples[a]), pcm) if pcm is not None else (0, _pcm_bytes(_decode_slow(raw, info), info.bits))


def encode_column(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """``df`` with the binary column ``media``: a FLAC stream of each payload (binary)."""
    schema = df.drop(media).withColumn(media, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in tk.chunks(batch, payload, CHUNK):
                some = batch.slice(a, b - a)
                raw = some.column(payload).to_pylist()
                done = iter(encode([x for x in raw if x is not None]))
                names = [n for n in some.schema.names if n != media]
                yield pa.RecordBatch.from_arrays([*[some.column(n) for n in names], pa.array([None if x is None else next(done) for x in raw], pa.binary())], [*names, media])

    return df.mapInArrow(tk.released(run), schema)


DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DECODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def feature(pcm: np.ndarray) -> str:
    """Least, greatest and mean absolute sample and zero crossings, of 8-bit samples."""
    if not len(pcm):
        return "0:0:0.000:0"
    return f"{pcm.min()}:{pcm.max()}:{np.abs(pcm.astype(np.int16)).sum() / len(pcm):.3f}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, _ in tk.chunks(batch, "media", CHUNK):
            media = batch.column("media").slice(a, b - a).to_pylist()
            rows = []
            for stream, pcm in zip(media, decode(media), strict=True):
                samples = np.frombuffer(pcm, np.int8)
                payload = (samples.view(np.uint8) ^ 0x80).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DECODED.types[2:], strict=True)]], schema=_DECODED)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: UTF-8 bytes, zeros up to a positive multiple of 64, encoded as FLAC, decoded again and described."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length("raw").cast("long")
    padded = F.when(n == 0, 64).otherwise(F.ceil(n / 64) * 64).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw")).select("doc_id", n.alias("n_bytes"), F.rpad("raw", padded, F.lit(b"\0")).alias("payload"))
    return encode_column(rows, "payload").select("doc_id", "n_bytes", "media").mapInArrow(tk.released(_read_back), DECODED)
