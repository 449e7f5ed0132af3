"""MP4/MOV containers: box walker, sample tables, timelines.

A file is one row of Spark's ``binaryFile`` source; its tracks come back as rows with run-length tables, and
timelines are derived from those by windows, without decoding a sample.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACKS = "path string, reason string, brand string, track_id long, codec string, width int, height int, timescale long, duration long, created_unix long, sample_count long, empty_edit double, stts array<struct<count:long,delta:long>>, ctts array<struct<count:long,offset:long>>, stss array<long>, has_stss boolean"
#: Seconds from 1904, the format's epoch, to 1970.
EPOCH = 2082844800
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, box end) of the boxes in a range; 64-bit sizes; size 0 reaches to the end."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a 64-bit size is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} reaches beyond its parent")
        yield kind, at + head, at + size
        at += size


def _table(data: bytes, at: int, fields: str) -> list[tuple]:
    n = struct.unpack_from(">I", data, at + 4)[0]
    step = struct.calcsize(">" + fields)
    return [struct.unpack_from(">" + fields, data, at + 8 + i * step) for i in range(n)]


def _track(data: bytes, start: int, end: int, movie_scale: int) -> dict:
    t: dict = {"codec": None, "stts": [], "ctts": [], "stss": [], "has_stss": False, "empty_edit": 0.0, "sample_count": 0, "width": 0, "height": 0, "track_id": 0, "handler": b"", "timescale": 0, "duration": 0, "created": 0}

    def walk(a: int, b: int) -> None:
        for kind, body, stop in boxes(data, a, b):
            if kind in _CONTAINERS:
                walk(body, stop)
            elif kind == b"tkhd":
                long = data[body] == 1
                t["track_id"] = struct.unpack_from(">I", data, body + (20 if long else 12))[0]
                t["width"], t["height"] = (x >> 16 for x in struct.unpack_from(">II", data, stop - 8))
            elif kind == b"mdhd":
                if data[body] == 1:
                    created, _, t["timescale"], t["duration"] = struct.unpack_from(">QQIQ", data, body + 4)
                else:
                    created, _, t["timescale"], t["duration"] = struct.unpack_from(">IIII", data, body + 4)
                t["created"] = created - EPOCH
            elif kind == b"hdlr":
                t["handler"] = data[body + 8 : body + 12]
            elif kind == b"stsd":
                t["codec"] = data[body + 12 : body + 16].decode("latin-1")
            elif kind == b"stts":
                t["stts"] = _table(data, body, "II")
            elif kind == b"ctts":
                t["ctts"] = _table(data, body, "Ii" if data[body] == 1 else "II")
            elif kind == b"stss":
                t["stss"], t["has_stss"] = [x[0] for x in _table(data, body, "I")], True
            elif kind == b"stsz":
                t["sample_count"] = struct.unpack_from(">I", data, body + 8)[0]
            elif kind == b"elst":
                for duration, media, *_ in _table(data, body, "QqHH" if data[body] == 1 else "IiHH"):
                    if media != -1:
                        break
                    t["empty_edit"] += duration / movie_scale if movie_scale else 0.0

    walk(start, end)
    return t


def parse(path: str, data: bytes) -> list[tuple]:
    """Rows of a file's video tracks, or one row with the reason why there is none."""
    fail = lambda reason: [(path, reason, None, None, None, None, None, None, None, None, None, None, [], [], [], None)]
    try:
        top = list(boxes(data, 0, len(data)))
        if not top:
            return fail("EMPTY_FILE")
        kinds = [k for k, _, _ in top]
        brand = next((data[a : a + 4].decode("latin-1") for k, a, _ in top if k == b"ftyp"), None)
        moov = next(((a, b) for k, a, b in top if k == b"moov"), None)
        if moov is None:
            return fail("NO_MOVIE_BOX")
        inside = list(boxes(data, *moov))
        if b"moof" in kinds or any(k == b"mvex" for k, _, _ in inside):
            return fail("FRAGMENTED")
        scale = next((struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0] for k, a, _ in inside if k == b"mvhd"), 0)
        tracks = [t for t in (_track(data, a, b, scale) for k, a, b in inside if k == b"trak") if t["handler"] == b"vide"]
        if not tracks:
            return fail("NO_VIDEO_TRACK")
        return [(path, None, brand, t["track_id"], t["codec"], t["width"], t["height"], t["timescale"], t["duration"], t["created"], t["sample_count"], t["empty_edit"], t["stts"], t["ctts"], t["stss"], t["has_stss"]) for t in tracks]
    except (ValueError, struct.error, IndexError) as e:
        return fail(f"CORRUPT: {e}")


def read(spark: SparkSession, path: str, glob: str = "*.{mp4,mov,MP4,MOV}") -> DataFrame:
    """(path, content) of the files; other extensions aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def tracks(files: DataFrame) -> DataFrame:
    """Video tracks of (path, content), or rows with a reason."""

    def run(batches):
        names = [f.split(" ")[0] for f in TRACKS.replace("array<struct<count:long,delta:long>>", "a").replace("array<struct<count:long,offset:long>>", "a").split(", ")]
        for pdf in batches:
            yield pd.DataFrame([row for p, c in zip(pdf["path"], pdf["content"], strict=True) for row in parse(p, bytes(c))], columns=names)

    return files.select("path", "content").mapInPandas(run, TRACKS)


def primary(found: DataFrame) -> DataFrame:
    """The largest video track of each file; of equals the first."""
    w = Window.partitionBy("path").orderBy((F.col("width") * F.col("height")).desc(), "track_id")
    return found.filter("reason is null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def timeline(track: DataFrame) -> DataFrame:
    """Frames of tracks: path, frame_id, frame_index, timestamp_seconds, pts, dts, timescale, is_keyframe, variable_rate.

    Decode times are an exclusive running sum of the deltas; presentation times add the offsets, or are the decode
    times if the offsets don't cover the samples. Frames are numbered by (pts, sample).
    """
    runs = F.flatten(F.transform("stts", lambda r: F.array_repeat(r["delta"], r["count"].cast("int"))))
    offsets = F.flatten(F.transform("ctts", lambda r: F.array_repeat(r["offset"], r["count"].cast("int"))))
    t = track.withColumn("deltas", runs).withColumn("offsets", offsets).withColumn("variable_rate", F.size(F.array_distinct("deltas")) > 1)
    t = t.withColumn("covered", F.size("offsets") == F.size("deltas"))
    s = t.select("path", "timescale", "empty_edit", "variable_rate", "stss", "has_stss", "offsets", "covered", F.posexplode("deltas").alias("sample", "delta"))
    w = Window.partitionBy("path").orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("dts", F.sum("delta").over(w) - F.col("delta"))
    s = s.withColumn("pts", F.col("dts") + F.when(F.col("covered"), F.get("offsets", F.col("sample"))).otherwise(F.lit(0)))
    index = F.row_number().over(Window.partitionBy("path").orderBy("pts", "sample")) - 1
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    key = ~F.col("has_stss") | F.array_contains("stss", (F.col("sample") + 1).cast("long"))
    return s.select("path", F.format_string("%s_%06d", stem, index).alias("frame_id"), index.alias("frame_index"), (F.col("pts") / F.col("timescale") + F.col("empty_edit")).alias("timestamp_seconds"), "pts", "dts", "timescale", key.alias("is_keyframe"), "variable_rate")


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))
