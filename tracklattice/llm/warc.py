"""WARC archives: a deterministic sharded writer and a reader.

Rows are range-partitioned by key into shards of about equal bytes. The bounds come from exact sums over cells of the
key; a cell of more bytes than a shard is cut again, down to a single key, so an outlying key can't gather the others in one
cell. Rows without a key, or of one key with more bytes than a shard, are dealt to several shards by their payload's digest. So
the same rows give the same shards, files and bytes on every run, and each shard is one task. Each task writes its shard's
records in key order, a gzip member each, and starts a new file when the compressed size reaches the limit. Files are
written under temporary names that hold the attempt; only the attempts whose rows reach the driver are renamed, and
the manifest, itself renamed into place last, names the files of the archive. What lost or repeated attempts wrote is
swept with the temporary folder.

Headers are regenerated from the rows: record ids from key and digest, digests over payload and block, a fixed date
where the table has none. Of records with equal payloads the smallest key's is a response, the others revisit it.

Defined cases: a null payload counts as empty; a null URL becomes urn:page:<key>; rows without a key come last, are
responses unless a keyed row has their payload, and rows that repeat the smallest key are responses all; an empty table gives an
archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk
from tracklattice.plans.shared import discard, materialize

SHARD_BYTES = 16 << 20
#: Compressed bytes at which a file is full: less than a shard of pages, which compress to about half, so that shards roll.
FILE_BYTES = 4 << 20
#: Cells that a range of the key is cut into for each shard that its bytes fill, and at least. The driver sees one row a cell.
CELLS, LEAST_CELLS = 8, 1024
SALTS = 16
#: zlib level of the records.
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, temporary string, records long, bytes long, sha256 string"
_FILES = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"WARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    packed = zlib.compressobj(level, wbits=31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


def _uri(url: str | None, key: object) -> str:
    clean = "".join(c for c in url or "" if c > " " and c != "\x7f")
    return clean or f"urn:page:{key}"


def _write(root: str, file_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        attempt = uuid.uuid4().hex
        done: list[tuple] = []
        out = shard = name = None
        part = records = size = 0
        sha = hashlib.sha256()
        at, links = None, {}

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            sha.update(data)
            size += len(data)

        def close() -> None:
            out.close()
            done.append((name, f"_temporary/{name}.{attempt}", records, size, sha.hexdigest()))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["page_id"]) != at:
                    at, links = (row["shard"], row["page_id"]), {}
                if row["kind"] == 0:
                    links[row["digest"]] = (row["to"], row["to_url"])
                    continue
                if out is None or row["shard"] != shard or size >= file_bytes:
                    if out is not None:
                        close()
                    part = part + 1 if row["shard"] == shard else 0
                    shard = row["shard"]
                    name, records, size, sha = f"pages-{shard:06d}-{part:04d}.warc.gz", 0, 0, hashlib.sha256()
                    store.create_dir(f"{base}/_temporary", recursive=True)
                    out = store.open_output_stream(f"{base}/_temporary/{name}.{attempt}", compression=None)
                    put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                key, payload = row["page_id"], row["payload"]
                digest = base32_sha1(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                headers = [("WARC-Record-ID", _record_id(key, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(row["url"], key)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                headers += [("WARC-Page-ID", str(key))] if key is not None else []
                if row["digest"] not in links:
                    put(_record([("WARC-Type", "response"), *headers], http + payload, level))
                else:
                    to, to_url = links[row["digest"]]
                    put(_record([("WARC-Type", "revisit"), *headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(to, digest)), ("WARC-Refers-To-Target-URI", _uri(to_url, to)), ("WARC-Refers-To-Page-ID", str(to))], http, level))
                records += 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _FILES.types, strict=True)], schema=_FILES)

    return run


_CELLS = pa.schema([("cell", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("bytes", pa.int64())])


def _cut(sizes: DataFrame, ranges: list[tuple[int, int, int]], shard_bytes: int) -> list[tuple[int, int, int]]:
    """(smallest key, largest key, bytes) of the cells of disjoint sorted ranges, of which only cells with rows are left."""
    lo, hi = (np.array([r[i] for r in ranges], np.int64) for i in (0, 1))
    n = np.array([max(LEAST_CELLS, CELLS * -(-r[2] // shard_bytes)) for r in ranges], np.int64)
    base = np.cumsum(n) - n
    width = (hi.astype(np.float64) - lo.astype(np.float64) + 1) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, weight = batch.column("page_id").to_numpy(), batch.column("bytes").to_numpy()
            at = np.maximum(np.searchsorted(lo, key, "right") - 1, 0)
            inside = (key >= lo[at]) & (key <= hi[at])
            key, weight, at = key[inside], weight[inside], at[inside]
            cell = base[at] + np.minimum(((key.astype(np.float64) - lo[at].astype(np.float64)) / width[at]).astype(np.int64), n[at] - 1)
            order = np.lexsort((key, cell))
            key, weight, cell = key[order], weight[order], cell[order]
            begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
            if len(begin):
                last = np.append(begin[1:], len(cell)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell[begin], key[begin], key[last], np.add.reduceat(weight, begin))], schema=_CELLS)

    cells = sizes.mapInArrow(tk.released(run), "cell long, lo long, hi long, bytes long").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"))
    return sorted((r["lo"], r["hi"], r["bytes"]) for r in cells.collect())


def _sharded(sizes: DataFrame, rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with the column shard, and how many there are; ``sizes`` has each record's key and bytes."""
    total = {r["none"]: r for r in sizes.groupBy(F.col("page_id").isNull().alias("none")).agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.sum("bytes").alias("bytes")).collect()}
    done, todo = [], [(total[False]["lo"], total[False]["hi"], total[False]["bytes"])] if False in total else []
    while todo:
        cells = _cut(sizes.filter("page_id is not null"), todo, shard_bytes) if any(lo < hi for lo, hi, _ in todo) else todo
        done += [c for c in cells if c[2] <= shard_bytes or c[0] == c[1]]
        todo = [c for c in cells if c[2] > shard_bytes and c[0] < c[1]]
    starts, firsts, ways, shard, held = [], [], [], 0, 0
    for lo, _, n in sorted(done):
        if held and held + n > shard_bytes:
            shard, held = shard + 1, 0
        starts.append(lo)
        firsts.append(shard)
        ways.append(-(-n // shard_bytes) or 1)
        held += n
        if n > shard_bytes:
            shard, held = shard + ways[-1], 0
    shard += bool(held)
    unkeyed = -(-total[True]["bytes"] // shard_bytes) or 1 if True in total else 0
    bounds = np.array(starts, np.int64), np.array(firsts, np.int64), np.array(ways, np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series, by: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(bounds[0], key.to_numpy(), "right") - 1, 0)
        return pd.Series(bounds[1][at] + by.to_numpy() % bounds[2][at] if len(bounds[0]) else np.zeros(len(key), np.int64))

    by = F.pmod(F.xxhash64("digest"), F.lit(1 << 40))
    keyed = place(F.coalesce("page_id", F.lit(0).cast("long")), by)
    return rows.withColumn("shard", F.when(F.col("page_id").isNull(), F.lit(shard) + by % max(unkeyed, 1)).otherwise(keyed).cast("int")), max(1, shard + unkeyed)


def _links(rows: DataFrame) -> DataFrame:
    """(page_id, digest, to, to_url) of the rows (page_id, url, digest) whose payload a smaller key has.

    Payloads that occur once need no link; the others' first keys are salted, as one payload may have many copies.
    """
    first = rows.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    linked = salted.join(first.hint("merge"), ["digest", "salt"]).filter(F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to")))
    return linked.select("page_id", "digest", "to", "to_url").distinct()


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL, date: str = DATE) -> list[dict]:
    """Writes an archive below ``root`` (a URI of a store that all executors reach) and returns its manifest.

    Payloads of at least ``least`` bytes are stored once. The driver holds one row a file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    links = _links(rows.filter(F.length("payload") >= least).select("page_id", "url", "digest"))
    # Links travel as rows of their own before the records that they belong to, so that payloads are shuffled once.
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("page_id", "url", "payload", "digest", F.lit(1).alias("kind"), none("long").alias("to"), none("string").alias("to_url"))
    both = both.unionByName(links.select("page_id", none("string").alias("url"), none("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "to", "to_url"))
    sizes = materialize(rows.select("page_id", (F.length("payload") + 400).cast("long").alias("bytes")), "warc-sizes")
    sharded, n = _sharded(sizes, both, shard_bytes)
    discard(sizes)
    ordered = sharded.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "digest", "url")
    files = ordered.select("shard", "page_id", "kind", "url", "payload", "digest", "to", "to_url").mapInArrow(tk.released(_write(root, file_bytes, level, date)), FILES).collect()
    return _commit(spark, root, [r.asDict() for r in files])


def _commit(spark: SparkSession, root: str, files: list[dict]) -> list[dict]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path(root))
    manifest = sorted(({k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in files), key=lambda f: f["name"])
    for f in files:
        if not store.rename(path(f"{root}/{f['temporary']}"), path(f"{root}/{f['name']}")):
            raise OSError(f"can't commit {f['name']}")
    out = store.create(path(f"{root}/_manifest.tmp"), True)
    out.write(bytearray(json.dumps(manifest, indent=0).encode()))
    out.close()
    if not store.rename(path(f"{root}/_manifest.tmp"), path(f"{root}/MANIFEST.json")):
        raise OSError("can't commit the manifest")
    store.delete(path(f"{root}/_temporary"), True)
    return manifest


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip'd WARC file."""
    held, unpack, raw = b"", zlib.decompressobj(wbits=31), bytearray()
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            if raw:
                raise ValueError("a record is cut off")
            return
        raw += unpack.decompress(held)
        held = unpack.unused_data
        if unpack.eof:
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(headers["Content-Length"])]
            if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
            yield headers, block
            unpack, raw = zlib.decompressobj(wbits=31), bytearray()


def _read(root: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        rows.append((number("WARC-Page-ID"), h["WARC-Target-URI"], h["WARC-Type"], number("WARC-Refers-To-Page-ID"), n, digest, payload if with_payload and h["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if len(rows) >= 2000 or size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

    return run


def read(spark: SparkSession, root: str, manifest: list[dict], with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files, a file a task at a time; every digest is verified. Revisits have no payload."""
    if not manifest:
        return spark.createDataFrame([], RECORDS)
    files = spark.createDataFrame([(f["name"],) for f in manifest], "name string").repartition(len(manifest))
    return files.mapInArrow(tk.released(_read(root, with_payload)), RECORDS)
