"""Small containers written by rule, for tests and queries of the readers."""

from __future__ import annotations

import struct


def box(kind: bytes, body: bytes, wide: bool = False) -> bytes:
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, body: bytes, version: int = 0) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]) + body)


def track(track_id: int, width: int, height: int, timescale: int, stts: list[tuple[int, int]], ctts: list[tuple[int, int]] = (), stss: list[int] | None = None, empty_edit: int = 0, handler: bytes = b"vide") -> bytes:
    n = sum(c for c, _ in stts)
    run = lambda rows, fmt: struct.pack(">I", len(rows)) + b"".join(struct.pack(fmt, *r) for r in rows)
    tables = full(b"stsd", struct.pack(">I", 1) + box(b"avc1", bytes(78))) + full(b"stts", run(stts, ">II"))
    if ctts:
        tables += full(b"ctts", run(ctts, ">Ii"), 1)
    if stss is not None:
        tables += full(b"stss", run([(s,) for s in stss], ">I"))
    tables += full(b"stsz", struct.pack(">II", 0, n) + struct.pack(f">{n}I", *[100] * n))
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, track_id, 0, 0) + bytes(52) + struct.pack(">II", width << 16, height << 16))
    mdia = full(b"mdhd", struct.pack(">IIII", 2082844800, 0, timescale, sum(c * d for c, d in stts)) + bytes(4)) + full(b"hdlr", bytes(4) + handler + bytes(12)) + box(b"minf", box(b"stbl", tables))
    edts = box(b"edts", full(b"elst", struct.pack(">I", 1) + struct.pack(">IiHH", empty_edit, -1, 1, 0))) if empty_edit else b""
    return box(b"trak", tkhd + edts + box(b"mdia", mdia))


def movie(tracks: list[bytes], fragmented: bool = False, wide: bool = False) -> bytes:
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, 0) + bytes(80))
    return box(b"ftyp", b"isom" + bytes(4)) + box(b"moov", mvhd + b"".join(tracks) + (box(b"mvex", b"") if fragmented else b""), wide) + box(b"mdat", bytes(16))
