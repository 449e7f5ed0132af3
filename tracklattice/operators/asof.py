"""As-of joins: bracketing, nearest within a tolerance, and the time series they align.

Both are one union and one window per stream: frames and records are sorted together once, and the last record
before and the first one after each frame are carried along. A very long stream is split into time buckets, whose
edge records are handed to the neighbours, so no stream has to fit one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions import geodesy, rotation, units
from tracklattice.operators import folds

SYNCHRONIZED = ("EXACT", "INTERPOLATED", "NEAREST", "OFFSET_APPLIED", "OFFSET_ESTIMATED", "OFFSET_VALIDATED")


@dataclass(frozen=True)
class BracketConfig:
    """What may be joined: widest bracket, tolerance of an exact hit, held ends, a clock's offset."""

    max_gap: float = 2.0
    exact: float = 1e-4
    extrapolate: bool = False
    offset: float = 0.0
    #: Seconds of a time bucket; None keeps a stream in one window.
    bucket: float | None = None
    #: Column of the records that both ends of a bracket must share, such as the altitude's datum.
    same: str | None = None
    keys: tuple[str, ...] = field(default=("stream_id",))


def bracket(frames: DataFrame, records: DataFrame, cfg: BracketConfig = BracketConfig()) -> DataFrame:
    """Each frame with the records around it: columns of ``frames``, then t, left, right (structs), n_records, status, method, alpha, gap.

    ``frames`` has the keys and t; ``records`` has the keys, t, record_index and what is to be carried. Of records with
    equal times the one with the largest record_index is the left one. The order of the tests is: no records, out of
    range, exact on the left, exact on the right, gap, different datum, interpolated.
    """
    keys = list(cfg.keys)
    payload = F.struct(*[F.col(c) for c in records.columns if c not in keys])
    f = frames.select(*keys, units.shifted(F.col("t"), cfg.offset).alias("_t"), F.lit(1).alias("_is_frame"), F.lit(None).cast("long").alias("_index"), F.struct(*frames.columns).alias("_frame"), F.lit(None).cast(records.select(payload.alias("p")).schema["p"].dataType).alias("_rec"))
    r = records.select(*keys, F.col("t").cast("double").alias("_t"), F.lit(0).alias("_is_frame"), F.col("record_index").cast("long").alias("_index"), F.lit(None).cast(f.schema["_frame"].dataType).alias("_frame"), payload.alias("_rec"))
    rows = f.unionByName(r)
    part = keys
    if cfg.bucket:
        rows, part = _bucketed(rows, r, keys, cfg.bucket), [*keys, "_bucket"]
    # Both fills run up to the current row, in either order: a frame that ends in the last row would be evaluated afresh for each row.
    order = Window.partitionBy(*part).orderBy(F.col("_t").asc(), F.col("_is_frame").asc(), F.col("_index").asc())
    back = Window.partitionBy(*part).orderBy(F.col("_t").desc(), F.col("_is_frame").desc(), F.col("_index").desc())
    so_far = lambda w: F.last("_rec", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("*", so_far(order).alias("left"), so_far(back).alias("right"))
    found = rows.filter("_is_frame = 1").select("_frame.*", F.col("_t").alias("at"), "left", "right")
    return _classified(found, cfg)


def _bucketed(rows: DataFrame, records: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Rows by time bucket, each bucket led and followed by the nearest records of other buckets.

    Per key and bucket only the first and last record travel: the edges are filled forward and backward over
    buckets, one row each, not over records.
    """
    bucket = F.floor(F.col("_t") / width).cast("long")
    edges = records.groupBy(*keys, bucket.alias("_bucket")).agg(F.max_by(F.struct("_t", "_index", "_rec"), F.struct("_t", "_index")).alias("last"), F.min_by(F.struct("_t", "_index", "_rec"), F.struct("_t", F.col("_index"))).alias("first"))
    all_buckets = rows.select(*keys, bucket.alias("_bucket")).distinct().join(edges, [*keys, "_bucket"], "left")
    w = Window.partitionBy(*keys)
    other = lambda c, order: F.last(c, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    carried = all_buckets.select(*keys, "_bucket", other("last", F.col("_bucket").asc()).alias("a"), other("first", F.col("_bucket").desc()).alias("b"))
    extra = carried.select(*keys, "_bucket", F.explode(F.array("a", "b")).alias("e")).filter("e is not null")
    own = rows.withColumn("_bucket", bucket)
    none = F.lit(None).cast(rows.schema["_frame"].dataType)
    return own.unionByName(extra.select(*keys, F.col("e._t").alias("_t"), F.lit(0).alias("_is_frame"), F.col("e._index").alias("_index"), none.alias("_frame"), F.col("e._rec").alias("_rec"), "_bucket"))


def _classified(found: DataFrame, cfg: BracketConfig) -> DataFrame:
    left, right, at = F.col("left"), F.col("right"), F.col("at")
    none = left.isNull() & right.isNull()
    early = left.isNull() & ~none
    late = right.isNull() & ~none & (left["t"] < at)
    other = F.coalesce(right, left)
    gap = other["t"] - left["t"]
    hit = F.lit("OFFSET_APPLIED" if cfg.offset else "EXACT")
    on_left, on_right = F.abs(at - left["t"]) <= cfg.exact, F.abs(other["t"] - at) <= cfg.exact
    outside = F.lit("EXTRAPOLATED" if cfg.extrapolate else "OUT_OF_RANGE")
    mixed = ~left[cfg.same].eqNullSafe(other[cfg.same]) if cfg.same else F.lit(False)
    status = F.when(none, "UNSYNCHRONIZED").when(early | late, outside).when(on_left | on_right, hit).when(gap > cfg.max_gap, "UNSYNCHRONIZED").when(mixed, "INCOMPATIBLE_REFERENCE").otherwise("INTERPOLATED")
    method = F.when(none, "no_telemetry").when(early | late, F.lit("hold" if cfg.extrapolate else "out_of_range")).when(on_left | on_right, "exact_match").when(gap > cfg.max_gap, "gap_exceeded").when(mixed, "datum_mismatch").otherwise("interpolated")
    fraction = F.when(F.col("status").isin("EXACT", "OFFSET_APPLIED"), F.when(on_left, 0.0).otherwise(1.0)).when(F.col("status") == "INTERPOLATED", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(at - left["t"], gap))))
    out = found.withColumn("status", status).withColumn("method", method).withColumn("alpha", fraction)
    return out.withColumn("gap", F.when(F.col("method").isin("exact_match", "gap_exceeded", "datum_mismatch", "interpolated"), gap))


def carried(column: str) -> Column:
    """A scalar of the records at the frame: the hit, the held end, or the linear interpolation; null if unsynchronized."""
    left, right, alpha = F.col("left")[column], F.coalesce(F.col("right"), F.col("left"))[column], F.col("alpha")
    return F.when(F.col("status").isin("EXACT", "OFFSET_APPLIED"), F.when(alpha == 0, left).otherwise(right)).when(F.col("status") == "INTERPOLATED", units.lerp(left, right, alpha)).when(F.col("status") == "EXTRAPOLATED", F.coalesce(left, right))


def held(column: str) -> Column:
    """A value that isn't interpolated: of the nearer end."""
    left, right = F.col("left")[column], F.coalesce(F.col("right"), F.col("left"))[column]
    return F.when(F.col("status") == "EXTRAPOLATED", F.coalesce(left, F.col("right")[column])).when(F.col("alpha") < 0.5, left).when(F.col("alpha").isNotNull(), right)


def position(lat: str = "lat", lon: str = "lon", alt: str = "alt", earth_centred: bool = True) -> Column:
    """Struct (lat, lon, alt) at the frame, interpolated in ECEF or along the shorter geodetic arc."""
    left, right, alpha = F.col("left"), F.coalesce(F.col("right"), F.col("left")), F.col("alpha")
    one = lambda x: F.struct(x[lat].alias("lat"), x[lon].alias("lon"), x[alt].alias("alt"))
    if earth_centred:
        a, b = (geodesy.geodetic_to_ecef(x[lat], x[lon], x[alt]) for x in (left, right))
        between = geodesy.ecef_to_geodetic(F.zip_with(a, b, lambda x, y: x + alpha * (y - x)))
    else:
        between = F.struct(units.lerp(left[lat], right[lat], alpha).alias("lat"), units.lerp_longitude(left[lon], right[lon], alpha).alias("lon"), units.lerp(left[alt], right[alt], alpha).alias("alt"))
    return F.when(F.col("status") == "INTERPOLATED", between).when(F.col("status") == "EXTRAPOLATED", one(F.coalesce(F.col("left"), F.col("right")))).when(alpha == 0, one(left)).when(alpha == 1, one(right))


def attitude(yaw: str = "yaw", pitch: str = "pitch", roll: str = "roll") -> Column:
    """Struct (yaw, pitch, roll) by spherical interpolation where both ends have all three angles."""
    left, right = F.col("left"), F.coalesce(F.col("right"), F.col("left"))
    a, b = (rotation.euler_to_quaternion(x[yaw], x[pitch], x[roll]) for x in (left, right))
    return rotation.quaternion_to_euler(rotation.slerp(a, b, F.col("alpha")))


def synchronized(status: Column) -> Column:
    return status.isin(*SYNCHRONIZED)


def nearest(frames: DataFrame, records: DataFrame, tolerance: float, exact: float = 1e-9, keys: tuple[str, ...] = ("stream_id",), bucket: float | None = None) -> DataFrame:
    """Each frame with its nearest record within ``tolerance``, as the struct ``hit`` (null if there is none) and ``distance``.

    An exact hit needs no tolerance; of two records as near the earlier one is taken. ``bucket`` cuts long streams by time.
    """
    out = bracket(frames, records, BracketConfig(max_gap=float("inf"), exact=exact, extrapolate=True, keys=keys, bucket=bucket))
    left, right = F.col("left"), F.col("right")
    dl, dr = F.col("at") - left["t"], right["t"] - F.col("at")
    pick = F.when(left.isNull(), right).when(right.isNull(), left).when(dl <= dr, left).otherwise(right)
    distance = F.least(F.coalesce(dl, dr), F.coalesce(dr, dl))
    near = (distance <= tolerance) | (distance <= exact)
    return out.select(*frames.columns, F.when(near, pick).alias("hit"), F.when(near, distance).alias("distance"))


def without_near_repeats(records: DataFrame, least: float = 1e-9, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Records more than ``least`` after the last one kept of their stream.

    A record is compared with the last one that was kept: a fold over each stream in its order, with one number as its state.
    """
    return folds.spaced(records, list(keys), "t", ["record_index"], least, strict=True)
