"""Nearest-neighbour and descriptor joins without cross joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.plans.shared import materialize, shuffle_partitions

AXES = ("x", "y", "z")


def cell(column: Column, size: float) -> Column:
    return F.floor(column / F.lit(float(size))).cast("long")


def _cells(df: DataFrame, size: float, names: tuple[str, ...], around: bool) -> DataFrame:
    """``df`` by grid cell; with ``around``, once for each of the 27 cells around its own."""
    if not around:
        return df.withColumns({n: cell(F.col(a), size) for n, a in zip(names, AXES, strict=True)})
    for n, a in zip(names, AXES, strict=True):
        c = cell(F.col(a), size)
        df = df.withColumn(n, F.explode(F.array(c - 1, c, c + 1)))
    return df


def distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def within(points: DataFrame, reference: DataFrame, radius: float) -> DataFrame:
    """Pairs (points' columns as struct p, reference's as struct r, distance) no further apart than ``radius``: a grid equi-join."""
    names = ("_i", "_j", "_k")
    p = _cells(points, radius, names, False).select(*names, F.struct(*points.columns).alias("p"))
    r = _cells(reference, radius, names, True).select(*names, F.struct(*reference.columns).alias("r"))
    return p.join(r, list(names)).withColumn("distance", distance("p", "r")).filter(F.col("distance") <= radius).drop(*names)


#: References that are handed to every task of ``nearest``, 0.5 MB; more are met by the grid.
MOST_HELD = 16_384
#: Different references that a grid cell of ``nearest`` may hold at first; fuller ones make the cells smaller.
MOST_IN_CELL = 4_096


def nearest(points: DataFrame, reference: DataFrame, first_cell: float, id_col: str = "id") -> DataFrame:
    """(id, reference_id, distance) of each point's nearest reference point; ties go to the smallest reference id.

    Up to ``MOST_HELD`` references are compared in each task of the points. More are met in rings of grid cells: a point
    whose best neighbour in the 27 cells around it is no further than a cell's size is done; the others go on with larger
    cells. Rounds grow with the logarithm of the largest distance. ``first_cell`` is about the typical distance; it is
    halved until no cell holds too many places, and references in one place count as one. Points and references
    without three finite coordinates are left out.
    """
    finite = lambda df: df.filter(" and ".join(f"abs({a}) < double('Infinity')" for a in AXES))
    todo = finite(points.select(F.col(id_col).alias("id"), *[F.col(a).cast("double") for a in AXES]))
    ref = finite(reference.select(F.col(id_col).alias("reference_id"), *[F.col(a).cast("double") for a in AXES]))
    few = ref.limit(MOST_HELD + 1).toArrow()
    return _compared(todo, few, dict(ref.dtypes)['reference_id']) if few.num_rows <= MOST_HELD else _ringed(todo, ref, first_cell)


def _compared(points: DataFrame, held: pa.Table, kind: str) -> DataFrame:
    """Each point with each held reference, a few points at a time."""
    held = held.sort_by("reference_id").combine_chunks()
    ids, at = held.column("reference_id"), [held.column(a).to_numpy() for a in AXES]
    schema = f"id {dict(points.dtypes)['id']}, reference_id {kind}, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if held.num_rows else ():
            p = [batch.column(a).to_numpy() for a in AXES]
            best, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            step = max(1, 1_000_000 // held.num_rows)
            for i in range(0, batch.num_rows, step):
                d = [x[i : i + step, None] - y for x, y in zip(p, at, strict=True)]
                between = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
                best[i : i + step] = between.argmin(axis=1)
                far[i : i + step] = between[np.arange(len(between)), best[i : i + step]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids.take(pa.array(best)).combine_chunks(), pa.array(far)], names=["id", "reference_id", "distance"])

    return points.mapInArrow(run, schema)


def _ringed(todo: DataFrame, ref: DataFrame, size: float) -> DataFrame:
    names = ("_i", "_j", "_k")
    ref = materialize(ref.groupBy(*AXES).agg(F.min("reference_id").alias("reference_id")), "places")
    span = ref.agg(*[F.max(F.abs(a)).alias(a) for a in AXES]).first()
    reach = todo.agg(*[F.max(F.abs(a)).alias(a) for a in AXES]).first()
    widest = 2 * (sum(span[a] or 0 for a in AXES) + sum(reach[a] or 0 for a in AXES)) + size
    for _ in range(40):  # cells of different places, so they do come apart
        if _cells(ref, size, names, False).groupBy(*names).count().agg(F.max("count")).first()[0] <= MOST_IN_CELL:
            break
        size /= 2
    done = None
    while True:
        p = _cells(todo, size, names, True).select(*names, "id", F.struct(*AXES).alias("p"))
        r = _cells(ref, size, names, False).select(*names, "reference_id", F.struct(*AXES).alias("r"))
        best = p.join(r, list(names)).groupBy("id").agg(F.min(F.struct(distance("p", "r").alias("distance"), "reference_id")).alias("best"))
        ring = materialize(todo.join(best, "id", "left"), "nearest")
        settled = F.coalesce(F.lit(size > widest) | (F.col("best.distance") <= size), F.lit(False))
        found = ring.filter(settled & F.col("best").isNotNull()).select("id", "best.reference_id", "best.distance")
        done = found if done is None else done.unionByName(found)
        todo = ring.filter(~settled).select("id", *AXES)
        rest = ring.filter(~settled).agg(F.count(F.lit(1)).alias("n"), F.count("best").alias("met"), F.max("best.distance").alias("farthest")).first()
        if size > widest or not rest["n"]:
            return done
        # Where all have met someone, cells as large as the farthest of them settle everything.
        size = max(2 * size, rest["farthest"]) if rest["met"] == rest["n"] else 2 * size


#: Places that a block of ``nearest_few`` holds, about; blocks are cut at medians of a sample of so many places a block.
IN_BLOCK, SAMPLED = 1_024, 64
#: Cuts from the whole to a block, at most; the driver holds the sample and the cuts.
DEEPEST = 14

_NEAR = "near array<struct<distance: double, id: bigint, x: double, y: double, z: double>>"


def nearest_few(points: DataFrame, radius: float, k: int) -> DataFrame:
    """(x, y, z, near): each place of ``points`` (id, x, y, z) with its ``k`` nearest points within ``radius``, by distance and id.

    A place holds its ``k`` smallest ids, as no more can be among anyone's nearest. Places are dealt to blocks of about
    ``IN_BLOCK``. The k-th distance in a place's own block bounds how far its nearest can be, so it asks only the blocks that
    this distance reaches, and each answers with ``k`` at most: pairs within the radius are never listed. Points without
    three finite coordinates are left out.
    """
    from pyspark.sql import Window

    spark = points.sparkSession
    finite = points.filter(" and ".join(f"abs({a}) < double('Infinity')" for a in AXES))
    own = finite.select(F.col("id").cast("long").alias("id"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in AXES])
    few = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))).filter(F.col("_rank") <= k)
    places = materialize(few.groupBy(*AXES).agg(F.array_sort(F.collect_list("id")).alias("ids")), "places")
    n = places.count()
    depth = min(DEEPEST, max(0, n - 1).bit_length() - IN_BLOCK.bit_length() + 1) if n > IN_BLOCK else 0
    every = max(1, n // (SAMPLED << depth))
    sample = places.filter(F.pmod(F.xxhash64(*AXES), F.lit(every)) == 0).select(*AXES).toArrow() if depth else None
    axes, cuts = _cuts(np.stack([sample.column(a).to_numpy() for a in AXES], axis=1), depth) if depth else (np.zeros(0, np.int64), np.zeros(0))
    deal, among = shuffle_partitions(spark), lambda df: df.repartition(deal, "block").groupBy("block")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, node = _at(b), np.zeros(b.num_rows, np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (at[np.arange(len(at)), axes[node]] >= cuts[node])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], names=[*b.schema.names, "block"])

    def reaching(table: pa.Table) -> pa.Table:
        """Each place of a block by the blocks that its k-th distance there, or else the radius, reaches."""
        at, ref, ids = _block(table)
        reach = np.full(len(at), float(radius))
        if len(ids) >= k:
            for i, d in _distances(at, ref):
                reach[i : i + len(d)] = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], radius)
        row, node, far = np.arange(len(at)), np.zeros(len(at), np.int64), reach * (1 + 1e-9)
        for _ in range(depth):
            beyond = at[row, axes[node]] - cuts[node]
            low, high = beyond <= far[row], -beyond <= far[row]
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
        return pa.table([*[pa.array(at[row, c]) for c in range(3)], pa.array(reach[row]), pa.array(node)], names=[*AXES, "reach", "block"])

    def answered(asked: pa.Table, table: pa.Table) -> pa.Table:
        p, reach = _at(asked), asked.column("reach").to_numpy()
        _, ref, ids = _block(table)
        rows, cols, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, d in _distances(p, ref) if len(ids) else ():
            r, c = np.nonzero(d <= reach[i : i + len(d), None])
            r, c, f = _first(r, c, d[r, c], k)
            rows, cols, far = [*rows, r + i], [*cols, c], [*far, f]
        row, col, d = (np.concatenate(x) for x in (rows, cols, far))
        near = pa.StructArray.from_arrays([pa.array(d), pa.array(ids[col]), *[pa.array(ref[col, c]) for c in range(3)]], names=["distance", "id", *AXES])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(p)))]).astype(np.int32)
        return pa.table([*[pa.array(p[:, c]) for c in range(3)], pa.ListArray.from_arrays(pa.array(ends), near)], names=[*AXES, "near"])

    dealt = places.mapInArrow(placed, "x double, y double, z double, ids array<bigint>, block bigint")
    asked = among(dealt).applyInArrow(reaching, "x double, y double, z double, reach double, block bigint")
    answers = among(asked).cogroup(among(dealt)).applyInArrow(answered, f"x double, y double, z double, {_NEAR}")
    return answers.groupBy(*AXES).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of each cut, in the order of a heap: at the median of the widest axis."""
    axes, cuts, held = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), {0: sample}
    for node in range(len(cuts)):
        s = held.pop(node)
        if len(s):
            axes[node] = np.argmax(np.ptp(s, axis=0))
            cuts[node] = np.median(s[:, axes[node]])
        high = s[:, axes[node]] >= cuts[node]
        held[2 * node + 1], held[2 * node + 2] = s[~high], s[high]
    return axes, cuts


def _at(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([rows.column(a).to_numpy() for a in AXES], axis=1)


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's places; the places and ids of its points, by id."""
    at, ids = _at(table), table.column("ids").combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    flat = ids.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    return at, np.repeat(at, np.diff(ids.offsets.to_numpy()), axis=0)[order], flat[order]


def _distances(p: np.ndarray, ref: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some points at a time, with the first one's number."""
    step = max(1, 500_000 // max(1, len(ref)))
    for i in range(0, len(p), step):
        x, y, z = (p[i : i + step, None, c] - ref[None, :, c] for c in range(3))
        yield i, np.sqrt(x * x + y * y + z * z)


def _first(row: np.ndarray, col: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` entries of the least (d, col)."""
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], d[kept]


def descriptor_matches(features: DataFrame, pairs: DataFrame, metric: str = "l2", ratio: float = 0.75, most: float | None = None, mutual: bool = True) -> DataFrame:
    """(frame_a, frame_b, idx_a, idx_b, distance): nearest descriptors of frame pairs that pass the ratio test.

    ``features`` (frame, idx, descriptor: array of numbers, or of bytes as numbers for "hamming"), ``pairs`` (frame_a, frame_b).
    The nearest has to be at most ``ratio`` times the second nearest (squared for "l2", whose distances are squared) and at
    most ``most``; with ``mutual`` it must be so from both sides. One frame pair is one group: features a frame are bounded
    by the extractor. Ties go to the smaller idx.
    """
    limit = ratio * ratio if metric == "l2" else ratio

    def match(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple[int, int, float]]:
        x, y = (np.stack(d["descriptor"].to_numpy()).astype(np.float64 if metric == "l2" else np.uint8) for d in (a, b))
        if metric == "l2":
            between = np.stack([((row - y) ** 2).sum(axis=1) for row in x])
        else:
            between = np.stack([np.bitwise_count(row ^ y).sum(axis=1) for row in x]).astype(np.float64)

        def one_way(d: np.ndarray) -> dict[int, int]:
            first = d.argmin(axis=1)
            least = d[np.arange(len(d)), first]
            second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(d), np.inf)
            ok = (least <= limit * second) & (least <= (np.inf if most is None else most))
            return {int(i): int(first[i]) for i in np.flatnonzero(ok)}

        there, back = one_way(between), one_way(between.T) if mutual else {}
        return [(int(a["idx"].iloc[i]), int(b["idx"].iloc[j]), float(between[i, j])) for i, j in there.items() if not mutual or back.get(j) == i]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = match(a.sort_values("idx").reset_index(drop=True), b.sort_values("idx").reset_index(drop=True)) if len(a) and len(b) else []
        return pd.DataFrame([(key[0], key[1], *m) for m in found], columns=["frame_a", "frame_b", "idx_a", "idx_b", "distance"])

    # New names for old columns, as both sides have one lineage.
    side = lambda own: pairs.join(features.select(F.col("frame").alias(own), "idx", "descriptor"), own).select(*[F.col(c).alias(c) for c in ("frame_a", "frame_b", "idx", "descriptor")])
    keys = ["frame_a", "frame_b"]
    kinds = dict(features.dtypes)
    schema = f"frame_a {kinds['frame']}, frame_b {kinds['frame']}, idx_a long, idx_b long, distance double"
    return side("frame_a").groupBy(*keys).cogroup(side("frame_b").groupBy(*keys)).applyInPandas(run, schema)


def row_pairs(frames: DataFrame, back: int, keys: tuple[str, ...], order: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """Each row with each of the ``back`` rows before it: keys, steps, carried columns as a_* (earlier) and b_*.

    By window, not by join: a row sees its predecessors in one pass.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    earlier = F.array(*[F.struct(F.lit(k).alias("steps"), F.lag(F.struct(*carry), k).over(w).alias("a")) for k in range(1, back + 1)])
    rows = frames.select(*keys, F.struct(*carry).alias("b"), earlier.alias("es")).select(*keys, "b", F.explode("es").alias("e")).filter("e.a is not null")
    return rows.select(*keys, F.col("e.steps").alias("steps"), *[F.col(f"e.a.{c}").alias(f"a_{c}") for c in carry], *[F.col(f"b.{c}").alias(f"b_{c}") for c in carry])


def nearest_in_frame(observations: DataFrame, features: DataFrame, radius: float = 1.5) -> DataFrame:
    """(frame, track_id, idx, distance): nearest feature of each track observation within ``radius`` pixels, in the same frame."""
    size = F.lit(float(radius))
    around = lambda c: F.explode(F.array(*[F.floor(F.col(c) / size) + d for d in (-1, 0, 1)]))
    o = observations.select("frame", "track_id", F.col("u").alias("ou"), F.col("v").alias("ov")).withColumn("i", F.floor(F.col("ou") / size)).withColumn("j", F.floor(F.col("ov") / size))
    f = features.select("frame", "idx", "u", "v").withColumn("i", around("u")).withColumn("j", around("v"))
    d = F.sqrt((F.col("ou") - F.col("u")) ** 2 + (F.col("ov") - F.col("v")) ** 2)
    best = o.join(f, ["frame", "i", "j"]).withColumn("distance", d).filter(F.col("distance") < radius)
    return best.groupBy("frame", "track_id").agg(F.min(F.struct("distance", "idx")).alias("m")).select("frame", "track_id", "m.idx", "m.distance")


def overlapping_tiles(regions: DataFrame, rows: int, columns: int, width: float, height: float) -> DataFrame:
    """Regions (x0, y0, x1, y1, half-open) with each tile of a grid that they overlap: tiles are enumerated, not joined."""
    tw, th = width / columns, height / rows
    first = lambda a, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(a) / size))).cast("int")
    last = lambda a, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(F.col(a) / size) - 1)).cast("int")
    out = regions.filter(f"x1 > 0 and y1 > 0 and x0 < {width} and y0 < {height} and x1 > x0 and y1 > y0")
    return out.withColumn("tile_row", F.explode(F.sequence(first("y0", th, rows), last("y1", th, rows)))).withColumn("tile_column", F.explode(F.sequence(first("x0", tw, columns), last("x1", tw, columns))))


def inside_any_box(points: DataFrame, boxes: DataFrame, key: str, size: float) -> DataFrame:
    """Points of a frame with ``inside``: whether any of the frame's boxes (x0, y0, x1, y1, inclusive) holds them. A grid semi-join."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    b = boxes.select(F.col(key).alias("_key"), "x0", "y0", "x1", "y1").withColumn("_i", span("x0", "x1")).withColumn("_j", span("y0", "y1"))
    p = points.withColumn("_pi", F.floor(F.col("u") / size)).withColumn("_pj", F.floor(F.col("v") / size))
    hit = (F.col(key) == F.col("_key")) & (F.col("_pi") == F.col("_i")) & (F.col("_pj") == F.col("_j")) & F.col("u").between(F.col("x0"), F.col("x1")) & F.col("v").between(F.col("y0"), F.col("y1"))
    inside = p.join(b, hit, "left_semi").withColumn("inside", F.lit(True))
    return inside.unionByName(p.join(b, hit, "left_anti").withColumn("inside", F.lit(False))).drop("_pi", "_pj")


#: Triangles, and segments, of a grid cell that ``occluded`` brings together at once; fuller cells are shared out.
TRIANGLES, SEGMENTS = 4_096, 16_384


def occluded(segments: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """Segments (id, own_face, ax..bz) with ``occluded``: whether a triangle (face, p0, p1, p2) other than their own cuts them.

    Both are dealt to the grid cells that their boxes touch. A cell's triangles are tested a few at a time, and only with the
    segments that none has cut yet; the tests are those of ``camera.ray_hits_triangle``. A cell with more than ``TRIANGLES``
    has them in shares: the first is tested at once, the others with the segments that are still uncut in all cells.
    """
    names = ["_i", "_j", "_k"]

    def dealt(df: DataFrame, columns: list[str], corners: list[str]) -> DataFrame:
        for i, n in enumerate(names):
            ends = [F.col(c)[i] for c in corners]
            df = df.withColumn(n, F.explode(F.sequence(cell(F.least(*ends), size), cell(F.greatest(*ends), size))))
        return df.select(*names, *columns, *[F.col(c)[i].cast("double").alias(f"{c}_{i}") for c in corners for i in range(3)])

    def shares(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name)).filter(F.col(name) > 1)

    t = dealt(triangles, ["face"], ["p0", "p1", "p2"])
    full = materialize(shares(t, TRIANGLES, "_shares"), "full")
    # New names for old columns, as both sides have one lineage.
    t = t.join(full, names, "left").withColumn("_share", F.pmod(F.xxhash64("face", *[f"p{c}_{i}" for c in range(3) for i in range(3)]), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    s = dealt(segments, ["id", "own_face"], ["a", "b"])
    hits = materialize(_cut(s.withColumn("_share", F.lit(0)), t.filter("_share = 0"), shares(s, SEGMENTS, "_parts"), names), "cut")
    if not full.isEmpty():
        left = s.join(hits, s["id"] == hits["_hit"], "left_anti").join(full, names)
        left = left.withColumn("_share", F.explode(F.sequence(F.lit(1), F.col("_shares") - 1))).drop("_shares")
        hits = hits.unionByName(_cut(left, t.filter("_share > 0"), shares(left.filter("_share = 1"), SEGMENTS, "_parts"), names))
    return segments.join(hits.distinct(), F.col("id") == F.col("_hit"), "left").withColumn("occluded", F.col("_hit").isNotNull()).drop("_hit")


def _cut(segments: DataFrame, triangles: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """(_hit): ids of segments that a triangle of their cell and share cuts. A cell's segments come in ``_parts``, its triangles to each."""
    deal = shuffle_partitions(segments.sparkSession)
    many = F.coalesce("_parts", F.lit(1))
    at = [*names, "_share", "_part"]
    group = F.pmod(F.xxhash64(*at), F.lit(8 * deal)).alias("_group")
    s = segments.join(parts, names, "left").withColumn("_part", F.pmod(F.xxhash64("id"), many).cast("int")).drop("_parts").select("*", group)
    t = triangles.join(parts, names, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts").select("*", group)

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        # Own faces and faces as numbers of one dictionary, in which null is a value.
        faces = pa.chunked_array([*s.column("own_face").chunks, *t.column("face").cast(s.schema.field("own_face").type).chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        cells = np.concatenate([np.stack([x.column(c).to_numpy() for c in at], axis=1) for x in (s, t)])
        codes = np.unique(cells, axis=0, return_inverse=True)[1].ravel()
        n = s.num_rows
        by, other = np.argsort(codes[:n], kind="stable"), np.argsort(codes[n:], kind="stable")
        corner = lambda x, c: np.stack([x.column(f"{c}_{i}").to_numpy().astype(float) for i in range(3)])
        a, b, p0, p1, p2 = corner(s, "a")[:, by], corner(s, "b")[:, by], *(corner(t, c)[:, other] for c in ("p0", "p1", "p2"))
        own, face, cut = faces[:n][by], faces[n:][other], np.zeros(n, bool)
        shared = np.intersect1d(codes[:n], codes[n:])
        span = lambda c: zip(np.searchsorted(c, shared), np.searchsorted(c, shared, side="right"), strict=True)
        for (i, j), (k, m) in zip(span(codes[:n][by]), span(codes[n:][other]), strict=True):
            cut[i:j] = _any_cuts(a[:, i:j], b[:, i:j] - a[:, i:j], own[i:j], p0[:, k:m], p1[:, k:m] - p0[:, k:m], p2[:, k:m] - p0[:, k:m], face[k:m])
        return pa.table({"_hit": s.column("id").take(pa.array(by[cut]))})

    kind = dict(segments.dtypes)["id"]
    among = lambda df: df.repartition(deal, "_group").groupBy("_group")
    return among(s).cogroup(among(t)).applyInArrow(run, f"_hit {kind}").distinct()


def _any_cuts(a: np.ndarray, d: np.ndarray, own: np.ndarray, p0: np.ndarray, e1: np.ndarray, e2: np.ndarray, face: np.ndarray) -> np.ndarray:
    """Whether each segment (3 x n: from ``a`` by ``d``) is cut by any of the triangles (3 x m: corner, edges) of other faces."""
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    cross = lambda x, y: (x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])
    alive, at, step = np.arange(a.shape[1]), 0, 16
    longs = dot(e1, e1) * dot(e2, e2)
    while at < e1.shape[1] and len(alive):
        few = slice(at, at + step)
        u1, u2, o = e1[:, None, few], e2[:, None, few], p0[:, None, few]
        cut = np.zeros(len(alive), bool)
        each = max(1, 100_000 // step)
        for i in range(0, len(alive), each):
            rows = alive[i : i + each]
            ray, start = d[:, rows, None], a[:, rows, None] - o
            p, q = cross(ray, u2), cross(start, u1)
            det = dot(u1, p)
            with np.errstate(all="ignore"):
                u, v, t = dot(start, p) / det, dot(ray, q) / det, dot(u2, q) / det
                hit = (np.abs(det) > 1e-9 * np.sqrt(longs[few] * dot(ray, ray))) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-6) & (t < 1 - 1e-6)
            cut[i : i + each] = (hit & (own[rows, None] != face[few])).any(axis=1)
        alive, at, step = alive[~cut], at + step, min(2 * step, 512)
    found = np.ones(a.shape[1], bool)
    found[alive] = False
    return found
