"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard verification.

Signatures. A shingle's hash, by a first permutation, takes a place in a circle of ``PLACES``; a second
permutation ``pi`` of the circle, shifted by k, gives coordinate k: min over places x of pi[(x + k) mod PLACES].
The K values of one shingle are then K neighbours in memory. Sets beyond ``CROWD`` shingles would crowd that circle: they
use one of 2^32 places whose permutation is computed, and sets near the limit use both, so that any two that can link share one.

Links. Documents with the same words are one class, named by its smallest id. Classes that share a band are candidates, and
are verified on their full texts: words are numbered by their bytes, shingles by their words' numbers, so no hash decides.

1. Stars. Each bucket has a centre, its first class in some order, and each class is compared with the centre that it
   shares most buckets with, one comparison each. What links gets a common label. Buckets are reduced where their members
   lie (a member and its local centre are a pair at once, and only the centre goes on), so a hot bucket is one row a gathering,
   and a large group mostly collapses into one label. While a component of step 2 has too many labels and a round still
   saves a tenth of them, another round follows in another order.
2. The rest. Buckets that hold one label only are done. The others link labels; in each component of labels all classes
   of different labels are compared, in blocks of ``BLOCK``: a label of more than half a block has blocks of its own, which meet
   the others' blocks but not each other. Components of more than ``MANY_LABELS`` labels are not compared as a whole, which would
   be quadratic in them, but bucket by bucket, so the work follows the pairs that share a band.

A comparison task returns a spanning forest of the links it found, never all pairs. Nothing is capped: larger groups only
make more blocks, and every pair of classes that shares a band is either verified or in one component already.

A pair at 0.85 shares none of 40 bands of 7 rows with probability 2e-7, one at 0.80 none of 46 bands of 6 rows with
probability 9e-7, were the coordinates independent; tests measure the recall of circulant signatures. Thresholds below
80 percent are refused.

Defined cases: null, empty or blank texts have the empty set (n_shingles 0) and link with nothing; with fewer than
``shingle`` words the whole sequence is the only shingle; rows without an id take their class's component, or null and
kept if it has no id at all; rows that repeat an id are one document of that id if their texts are alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.llm import textkernel as tk
from tracklattice.llm.components import components
from tracklattice.plans.shared import discard, materialize, shuffle_partitions

#: Coordinates of a signature: 40 bands of 7 rows, or 46 of 6 for thresholds below 85 percent.
K = 280
PLACES = 1 << 20
#: Shingles of a set beyond which it uses the circle of 2^32 places.
CROWD = 1 << 17
#: Classes, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Labels of a component beyond which it is compared bucket by bucket.
MANY_LABELS = 8 * BLOCK
#: Classes that a star's task compares with its centre, and shingles of the small groups that share a task.
RAYS, BUNDLE_SHINGLES = 256, 300_000
SALTS = 16
_pi: list[np.ndarray] = []


def _circle() -> np.ndarray:
    if not _pi:
        pi = np.random.Generator(np.random.PCG64(851)).permutation(PLACES).astype(np.uint32)
        _pi.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:K]]), K))
    return _pi[0]


def _windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and each text's first word (one more than texts); letters A-Z count as lower case."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, offsets)
    return tk.windows(tk.hash_ranges(data, starts, ends), k), first


def signature(shingles: np.ndarray) -> np.ndarray:
    """K coordinates of a set that isn't empty."""
    places = (tk.mix(shingles) & np.uint64(PLACES - 1)).astype(np.int64)
    circle = _circle()
    out = circle[places[:2048]].min(axis=0)
    for i in range(2048, len(places), 2048):
        np.minimum(out, circle[places[i : i + 2048]].min(axis=0), out=out)
    return out


def wide_signature(shingles: np.ndarray) -> np.ndarray:
    """The same on a circle of 2^32 places, whose second permutation is computed rather than looked up."""
    places, out = (tk.mix(shingles) >> np.uint64(32)).astype(np.uint32), np.empty(K, np.uint32)
    for k in range(K):
        x = places + np.uint32(k)  # modulo 2^32
        for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(odd)
        out[k] = (x ^ (x >> np.uint32(16))).min()
    return out


def rows_of(percent: int) -> int:
    """Rows of a band for a threshold."""
    return 7 if percent >= 85 else 6


def bands(signatures: np.ndarray, rows: int, wide: bool = False) -> np.ndarray:
    """(documents, bands) bucket hashes."""
    n = K // rows
    values = signatures[:, : n * rows].astype(np.uint64).reshape(len(signatures), n, rows)
    at = tk.WORD_AT[rows : 2 * rows] if wide else tk.WORD_AT[:rows]
    return tk.mix((values * at).sum(axis=2, dtype=np.uint64) * np.uint64(64) + np.arange(n, dtype=np.uint64))


SIGNED = "doc_id long, n long, d1 long, d2 long, bands binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.binary())])
_LOWER = tk.LOWER.tobytes()


def normal(raw: bytes) -> bytes:
    """Words of a text, letters A-Z lowered, joined by one space. ``bytes.split`` cuts at the same six blanks."""
    return b" ".join(raw.translate(_LOWER).split())


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _sign(k: int, band_rows: int, percent: int):
    def buckets(s: np.ndarray) -> bytes:
        out = bands(signature(s)[None, :], band_rows).tobytes() if len(s) <= CROWD else b""
        return out + (bands(wide_signature(s)[None, :], band_rows, True).tobytes() if 100 * len(s) >= percent * CROWD else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.chunks(batch, "text"):
                windows, first = _windows(data, offsets, k)
                raw, n, digests, out = data.tobytes(), [], [], []
                for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    digests.append(digest(normal(raw[offsets[i] : offsets[i + 1]])))
                    s = tk.sorted_unique(windows[x : max(x, y - k + 1)])
                    n.append(len(s) or int(y > x))
                    out.append(buckets(s) if len(s) else None)
                keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(out, pa.binary())], schema=_SIGNED)

    return run


_BUCKETS = pa.schema([("part", pa.int32()), ("buckets", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
BUCKETS = "part int, buckets binary, ids binary, counts binary"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _starred(buckets: np.ndarray, ids: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different (bucket, id), and the first id of each one's bucket; each turn has its own order of ids."""
    rank = tk.mix(ids.view(np.uint64) ^ tk.mix(np.full(1, turn, np.uint64))) if turn else ids
    order = np.lexsort((rank, buckets))
    buckets, ids = buckets[order], ids[order]
    new = np.append(True, buckets[1:] != buckets[:-1])[: len(ids)]
    own = new | np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    buckets, ids, new = buckets[own], ids[own], new[own]
    return buckets, ids, ids[np.flatnonzero(new)][np.cumsum(new) - 1]


def _pairs(centre: np.ndarray, ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of a centre and another id, and in how many buckets each was."""
    far = centre != ids
    pairs, which = np.unique(np.stack([centre[far], ids[far]], axis=1), axis=0, return_inverse=True)
    return pairs[:, 0], pairs[:, 1], np.bincount(which.ravel(), None if counts is None else counts[far], len(pairs)).astype(np.int64)


def _deal(parts: int, turn: int, held: int = 500_000):
    """Deals (bucket, id) out by bucket. Of a bucket that several ids of a gathering are in, only the centre goes on; the
    others' pairs with it are known, and travel in parts numbered from ``parts`` on."""

    def deal(gathered: list[tuple], blobs: tk.Blobs) -> Iterator[pa.RecordBatch]:
        buckets, ids, centre = _starred(*(np.concatenate(c) for c in zip(*gathered, strict=True)), turn)
        first = ids == centre
        yield from blobs.add(((buckets[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), buckets[first], ids[first], np.ones(int(first.sum()), np.uint8))
        a, b, n = _pairs(centre, ids)
        yield from blobs.add((parts + b % parts).astype(np.int32), a.view(np.uint64), b, n.astype(np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, gathered, n = tk.Blobs(2 * parts, _BUCKETS), [], 0
        for batch in batches:
            column = batch.column("bands")
            ids = np.repeat(batch.column("id").to_numpy(), np.array([len(x.as_buffer()) // 8 for x in column], np.int64))
            gathered.append((tk.gather(column, np.uint64), ids))
            n += len(ids)
            if n >= held:
                yield from deal(gathered, blobs)
                gathered, n = [], 0
        if n:
            yield from deal(gathered, blobs)
        yield from blobs.flush()

    return run


def _stars(parts: int, turn: int):
    """Different pairs (a, b) of buckets' centres and members, and how many buckets they share so."""

    def run(table: pa.Table) -> pa.Table:
        buckets, ids, counts = tk.gather(table["buckets"], np.uint64), tk.gather(table["ids"], np.int64), tk.gather(table["counts"], np.uint8)
        if table["part"][0].as_py() >= parts:  # pairs already
            out = _pairs(buckets.view(np.int64), ids, counts)
        else:
            _, ids, centre = _starred(buckets, ids, turn)
            out = _pairs(centre, ids)
        return pa.Table.from_arrays([pa.array(x) for x in out], schema=_PAIRS)

    return run


def stars(ids: DataFrame, parts: int, turn: int = 0) -> DataFrame:
    """Pairs (a, b, n) that connect the ids (id, bands) of each bucket, once for each part that finds them."""
    return ids.mapInArrow(tk.released(_deal(parts, turn)), BUCKETS).groupBy("part").applyInArrow(_stars(parts, turn), "a long, b long, n long")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal texts of the classes' representatives; rows that repeat an id with another text go."""
    schema = pa.schema([("rep", pa.int64()), ("words", pa.binary())])
    for batch in batches:
        for a, b, data, offsets in tk.chunks(batch, "text"):
            raw = data.tobytes()
            found = [normal(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            wanted = batch.column("d1").slice(a, b - a).to_numpy()
            same = [int.from_bytes(digest(x)[:8], "little", signed=True) == d for x, d in zip(found, wanted.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a).filter(pa.array(same, pa.bool_())), pa.array([x for x, ok in zip(found, same, strict=True) if ok], pa.binary())], schema=schema)


def exact_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's shingles as sorted numbers: equal numbers if and only if the words are the same, byte by byte."""
    column = pa.array(texts, pa.large_binary())
    data, offsets = tk.utf8(column)
    starts, ends, first = tk.words(data, offsets)
    _, word = tk.exact_ids(data, starts, ends, tk.hash_ranges(data, starts, ends))
    n = max(len(word) - k + 1, 0)
    many = int(word.max()) + 1 if len(word) else 1
    number = word[:n].astype(np.int64)
    for j in range(1, k):
        if number.size and int(number.max()) + 1 > (1 << 62) // many:
            _, number = np.unique(number, return_inverse=True)
        number = number * many + word[j : j + n]
    return [tk.sorted_unique(number[a : b - k + 1]) if b - a >= k else number[:0] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def links_between(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``a`` (rows) and ``b`` link: 100 * intersection >= percent * union. Exact."""
    size = lambda x: np.array([len(s) for s in x], np.float64)
    total = size(a)[:, None] + size(b)[None, :]
    inter = np.zeros((len(a), len(b)), np.float32)
    if len(a) * len(b) <= 64:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                inter[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return ((100 + percent) * inter.astype(np.float64) >= percent * total) & (total > 0)
    flat = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    value = np.cumsum(new) - 1
    shared = np.bincount(value)[value] > 1 if len(value) else new
    value, owner = np.cumsum(new & shared)[shared] - 1, owner[shared]
    step = 4096
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, step):
        i, j = np.searchsorted(value, [low, low + step])
        grid = np.zeros((len(a) + len(b), step), np.float32)
        grid[owner[i:j], value[i:j] - low] = 1
        inter += grid[: len(a)] @ grid[len(a) :].T
    return ((100 + percent) * inter.astype(np.float64) >= percent * total) & (total > 0)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between labels that connect what ``linked`` connects, less than labels; rows and columns may share labels."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    near = np.zeros((len(names), len(names)), bool)
    i, j = np.nonzero(linked)
    near[at[i], at[len(left) + j]] = True
    near |= near.T
    seen, out = np.zeros(len(names), bool), []
    for root in np.flatnonzero(near.any(axis=1)).tolist():
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & ~seen)
            seen[found] = True
            out += [(int(names[x]), int(names[y])) for y in found.tolist()]
            todo += found.tolist()
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(k: int, percent: int):
    """Links of a task's groups: between the rows of side 0 and those of side 1, or among all rows of side 2, as labels."""

    def run(table: pa.Table) -> pa.Table:
        grp, side, rep, label = (table[c].to_numpy() for c in ("grp", "side", "rep", "label"))
        order = np.lexsort((rep, side, grp))
        same = (grp[order][1:] == grp[order][:-1]) & (side[order][1:] == side[order][:-1]) & (rep[order][1:] == rep[order][:-1])
        order = order[np.append(True, ~same)]  # rows that repeat an id
        words = table["words"].to_pylist()
        sets = exact_sets([words[i] for i in order.tolist()], k)
        grp, side, label = grp[order], side[order], label[order]
        cuts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
        edges: list[tuple[int, int]] = []
        for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(grp)).tolist(), strict=True):
            middle = x + int(np.searchsorted(side[x:y], 1))
            left, right = ((x, middle), (middle, y)) if side[y - 1] < 2 else ((x, y), (x, y))
            if left[0] < left[1] and right[0] < right[1]:
                linked = links_between(sets[slice(*left)], sets[slice(*right)], percent)
                edges += forest(linked, label[slice(*left)], label[slice(*right)])
        found = np.array(edges, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_EDGES)

    return run


def _salted(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """A join whose hot keys are dealt to SALTS tasks: rows of ``left`` by ``by``, what ``right`` knows of a key to all.

    Never a broadcast: the planner's estimate of ``right`` doesn't see its copies.
    """
    one = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return one.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [*on, "salt"], how).drop("salt")


def _part(by: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(by), n.cast("long")).cast("int")


def _verified(placed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between labels, of placed rows (task, grp, side, rep, label)."""
    return placed.join(texts, "rep").select("task", "grp", "side", "rep", "label", "words").groupBy("task").applyInArrow(_verify(shingle, percent), "a long, b long")


def _bundles(sized: DataFrame) -> int:
    """Tasks that small groups are dealt to, by the shingles they have altogether: one number comes to the driver."""
    return max(1, -(-int(sized.agg(F.sum("n")).first()[0] or 0) // BUNDLE_SHINGLES))


def _rays(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each class with the centre that it shares most buckets with: placed rows, RAYS a group."""
    rays = pairs.groupBy("b", "a").agg(F.sum("n").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    counts = rays.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RAYS).alias("s"))
    rays = _salted(rays, counts, ["a"], "b").select("a", "b", _part("b", F.col("s")).alias("p"))
    rays = materialize(rays.join(sizes.select(F.col("rep").alias("b"), "n"), "b").select("a", "b", "p", "n", F.xxhash64("a", "p").alias("grp")), "rays")
    tasks = F.pmod("grp", F.lit(_bundles(rays))).cast("string").alias("task")
    centre = rays.select("grp", F.col("a").alias("rep")).distinct()
    return centre.select(tasks, "grp", F.lit(0).alias("side"), "rep", F.col("rep").alias("label")).unionByName(rays.select(tasks, "grp", F.lit(1).alias("side"), F.col("b").alias("rep"), F.col("b").alias("label")))


def _around(labelled: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(node, component, labels) of the labels that share a bucket with another, and the labels of the largest component."""
    around = components(stars(labelled.select(F.col("label").alias("id"), "bands"), parts))
    around = materialize(_salted(around, around.groupBy("component").agg(F.count(F.lit(1)).alias("labels")), ["component"], "node"), "around")
    return around, around.agg(F.max("labels")).first()[0] or 0


def _grouped(labelled: DataFrame, around: DataFrame) -> DataFrame:
    """(grp, rep, label, n) of the classes (rep, label, n, bands) that share a bucket with another label."""
    named = _salted(labelled, around.withColumnRenamed("node", "label"), ["label"], "rep")
    named = materialize(named.select("rep", "label", "n", "bands", "component", (F.col("labels") > MANY_LABELS).alias("many")), "named")
    whole = named.filter("not many").select(F.col("component").alias("grp"), "rep", "label", "n")
    # Bands of 8 bytes each; a bucket of one label has nothing left to compare.
    bucket = F.expr("transform(sequence(0, cast(length(bands) div 8 as int) - 1), i -> cast(conv(hex(substring(bands, i * 8 + 1, 8)), 16, -10) as long))")
    each = named.filter("many").select(F.explode(bucket).alias("grp"), "rep", "label", "n")
    mixed = each.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("grp")
    return materialize(whole.unionByName(_salted(each, mixed, ["grp"], "rep")), "grouped")


def _placed(members: DataFrame) -> DataFrame:
    """Members (grp, rep, label, n), each once for every pair of blocks that its block takes part in: task, grp, side, rep, label.

    A group that fits one block is one task, and small ones share tasks.
    """
    total = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    small = (F.col("m") <= BLOCK) & (F.col("w") <= BLOCK_SHINGLES)
    sized = materialize(_salted(members, total.select("grp", small.alias("small")), ["grp"], "rep"), "sized")
    few = sized.filter("small")
    bundled = few.select(F.pmod(F.xxhash64("grp"), F.lit(_bundles(few))).cast("string").alias("task"), "grp", F.lit(2).alias("side"), "rep", "label")
    large = sized.filter("not small")
    own = large.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    own = own.select("grp", "label", ((F.col("m") > BLOCK // 2) | (F.col("w") > BLOCK_SHINGLES // 2)).alias("pure"))
    celled = _salted(large, own, ["grp", "label"], "rep").select("grp", "rep", "label", "n", F.when(F.col("pure"), F.col("label")).alias("cell"), "pure")
    cells = celled.groupBy("grp", "pure", "cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("s"))
    cells = materialize(cells, "cells")
    name = lambda kind, cell, part: F.concat_ws(":", F.lit(kind), cell.cast("string"), part.cast("string"))
    every = lambda cells: cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    pure, rest = cells.filter("pure"), cells.filter("not pure")
    blocks, mixed = every(pure).select("grp", "cell", name("p", F.col("cell"), F.col("part")).alias("block")), every(rest).select("grp", "part", "s", name("m", F.lit("-"), F.col("part")).alias("block"))
    among = mixed.withColumn("other", F.explode(F.sequence("part", F.col("s") - 1))).select("grp", F.col("block").alias("one"), name("m", F.lit("-"), F.col("other")).alias("two"))
    across = mixed.select("grp", F.col("block").alias("one")).join(blocks.select("grp", F.col("block").alias("two")), "grp")
    cell = pure.select("grp", "cell", "s")
    other = cell.select("grp", F.col("cell").alias("cell2"), F.col("s").alias("s2"))
    between = cell.join(other, "grp").filter("cell < cell2").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s2") - 1)))
    between = between.select("grp", name("p", F.col("cell"), F.col("i")).alias("one"), name("p", F.col("cell2"), F.col("j")).alias("two"))
    pairs = among.unionByName(across).unionByName(between).withColumn("task", F.concat_ws("/", F.col("grp").cast("string"), "one", "two"))
    sides = pairs.filter("one <> two").select("grp", "task", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("block")), F.struct(F.lit(1).alias("side"), F.col("two").alias("block")))).alias("x")).select("grp", "task", "x.side", "x.block")
    sides = sides.unionByName(pairs.filter("one = two").select("grp", "task", F.lit(2).alias("side"), F.col("one").alias("block")))
    # A cell's members are dealt to its parts; cells are few, and what is known of one is dealt to SALTS tasks.
    parted = _salted(celled.withColumn("cell", F.coalesce("cell", F.lit(0).cast("long"))), cells.select("grp", "pure", F.coalesce("cell", F.lit(0).cast("long")).alias("cell"), "s"), ["grp", "pure", "cell"], "rep")
    block = F.when(F.col("pure"), name("p", F.col("cell"), _part("rep", F.col("s")))).otherwise(name("m", F.lit("-"), _part("rep", F.col("s"))))
    placed = parted.select("grp", "rep", "label", block.alias("block")).join(sides, ["grp", "block"]).select("task", "grp", "side", "rep", "label")
    return bundled.unionByName(placed)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_copies): groups of documents linked by near-equal shingle sets.

    Documents link if 100 * |A & B| >= percent * |A | B|, over sets of ``shingle``-word shingles.
    n_copies counts the rows with exactly the document's words.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    parts = 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(rows.mapInArrow(tk.released(_sign(shingle, rows_of(percent), percent)), SIGNED), "signed")
    classes = signed.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    named = classes.filter("rep is not null and bands is not null").select("rep", "n", "d1", "bands")
    pairs = materialize(stars(named.select(F.col("rep").alias("id"), "bands"), parts), "pairs")
    crowd = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    crowd = materialize(named.join(crowd, "rep"), "crowd")
    # No hint: the planner broadcasts the picked ids where the table is small, and shuffles texts once where it isn't.
    texts = materialize(rows.join(crowd.select("rep", "d1"), F.col("doc_id") == F.col("rep")).select("rep", "d1", "text").mapInArrow(tk.released(_texts), "rep long, words binary"), "texts")
    labelled, turn, labels = crowd.select("rep", "n", "bands", F.col("rep").alias("label")), 0, None
    while True:
        links = _verified(_rays(pairs, crowd), texts, shingle, percent)
        known = labelled.filter("rep <> label").select(F.col("label").alias("a"), F.col("rep").alias("b"))
        linked = components(links.unionByName(known))
        labelled = crowd.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "bands", F.coalesce("component", "rep").alias("label"))
        labelled = materialize(labelled, "labelled")
        around, most = _around(labelled, parts)
        before, labels = labels, around.count()
        if most <= MANY_LABELS or (before and labels > 0.9 * before):
            break
        turn += 1
        pairs = materialize(stars(labelled.join(around.select(F.col("node").alias("label")), "label", "left_semi").select(F.col("rep").alias("id"), "bands"), parts, turn), "pairs")
    members = _grouped(labelled, around)
    rest = components(_verified(_placed(members), texts, shingle, percent))
    found = _salted(labelled.select("rep", "label"), rest.withColumnRenamed("node", "label"), ["label"], "rep", "left").select("rep", F.coalesce("component", "label").alias("component"))
    # Classes (unique keys) take their component first; rows of a class then join it once, salted, as one class may be large.
    grouped = classes.select("d1", "d2", "n", "rep", "copies").join(found, "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"), "rep", "copies")
    grouped = materialize(grouped.filter("copies > 1 or component <> rep or rep is null"), "grouped")
    discard(classes, pairs, crowd, texts, labelled, members)
    out = _salted(signed.select("doc_id", "n", "d1", "d2"), grouped, ["d1", "d2", "n"], "doc_id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"))
