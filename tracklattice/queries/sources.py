"""Scans, parsers and sinks (section A) over files made by rule from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklattice.operators import raster
from tracklattice.plans.shared import shared_path
from tracklattice.queries.registry import query, rounded, table
from tracklattice.sources import isobmff, telemetry

_SRT = "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, (c_custkey * 37 % 170 - 85)::DOUBLE AS lat, (c_custkey * 73 % 360 - 180)::DOUBLE AS lon, c_acctbal AS alt FROM customer"


def _subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtitle file a nation, a block a customer, in three styles; every seventh block has no position."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    lat, lon = (k * 37 % 170 - 85).cast("string"), (k * 73 % 360 - 180).cast("string")
    clock = F.format_string("%02d:%02d:%02d,%03d", F.floor(F.col("i") / 3600), F.floor(F.col("i") / 60) % 60, F.col("i") % 60, k % 1000)
    full = F.concat(F.lit("[latitude: "), lat, F.lit("] [longitude: "), lon, F.lit("] [rel_alt: 5.5 abs_alt: "), F.col("c_acctbal").cast("string"), F.lit("] [drone_yaw: 12.5 sats: 18 focal_len: 24.0] H.S 5.20m/s, V.S 0,10m/s"))
    plain = F.concat(F.lit("GPS("), lon, F.lit(", "), lat, F.lit(", 3) [rel_alt: "), F.col("c_acctbal").cast("string"), F.lit("m] 2024.01.02 03:04:05.678"))
    text = F.when(k % 7 == 0, "no position").when(k % 2 == 0, full).otherwise(plain)
    block = F.concat_ws("\n", (F.col("i") + 1).cast("string"), F.concat(clock, F.lit(" --> "), clock), text)
    files = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return files.select(F.format_string("n%02d.srt", "c_nationkey").alias("path"), "content")


@query(f"""
SELECT printf('n%02d.srt', c_nationkey) AS path, i::INT AS record_index, round(i + c_custkey % 1000 / 1000.0, 3) AS timestamp, CASE WHEN c_custkey % 7 > 0 THEN lat END AS lat, CASE WHEN c_custkey % 7 > 0 THEN lon END AS lon, CASE WHEN c_custkey % 7 > 0 THEN alt END AS alt,
  CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' WHEN c_custkey % 2 = 0 THEN 'MSL' ELSE 'RELATIVE_TO_TAKEOFF' END AS altitude_reference, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 2 = 0 THEN 5.2 END AS speed, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 2 = 0 THEN 0.1 END AS climb, CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 18 ELSE 3 END END AS satellites,
  CASE WHEN c_custkey % 7 = 0 THEN 'INVALID' WHEN c_custkey % 2 = 0 THEN 'VALID' ELSE 'PARTIALLY_VALID' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'MISSING_COORDINATES' END AS reason, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 2 = 1 THEN '2024-01-02 03:04:05.678' END AS timestamp_utc, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 2 = 0 THEN '24.0' END AS focal_len FROM ({_SRT})
""")
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle blocks to reason-coded rows."""
    p = telemetry.parse_srt(_subtitles(spark, sf_dir))
    return rounded(p.select("path", "record_index", "timestamp", "lat", "lon", "alt", "altitude_reference", "speed", "climb", "satellites", "status", "reason", "timestamp_utc", F.col("extras")["focal_len"].alias("focal_len")), 3, "timestamp")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'x' ELSE 'n' END AS kind, c_custkey % 200 - 100 AS lat, c_custkey % 5 > 0 AS has_speed FROM customer)
SELECT CASE WHEN kind IS NULL OR kind = 'x' OR lat NOT BETWEEN -90 AND 90 THEN 'INVALID' WHEN has_speed THEN 'VALID' ELSE 'PARTIALLY_VALID' END AS status, CASE WHEN kind IS NULL THEN 'MISSING_MANDATORY_VALUE' WHEN kind = 'x' THEN 'NOT_A_NUMBER' WHEN lat NOT BETWEEN -90 AND 90 THEN 'POSITION_OUT_OF_RANGE' END AS reason, count(*) AS n FROM r GROUP BY ALL
""")
def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written as CSV, read back as strings and judged; rejected rows are kept with their reasons."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.cast("string").alias("time_ms"), F.when(k % 11 == 0, "").when(k % 13 == 0, "abc").otherwise((k % 200 - 100).cast("string")).alias("lat_deg"), F.lit("73,5").alias("lon_deg"), F.lit("100").alias("alt_ft"), F.lit("0.5").alias("yaw_rad"), F.when(k % 5 > 0, "36").otherwise("").alias("speed_kmh"))
    path = shared_path(spark, "log-csv")
    rows.write.option("header", True).csv(path)
    m = telemetry.CsvMapping("time_ms", "lat_deg", "lon_deg", "alt_ft", heading="yaw_rad", speed="speed_kmh", timestamp_unit="milliseconds", angle_unit="radians", altitude_unit="feet", speed_unit="kmph")
    p = telemetry.parse_csv(telemetry.read_csv(spark, path, m), m)
    return p.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklattice.sources import synthetic

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["n_nationkey"]:
                k = int(k)
                stts = [(10 + k, 1000), (5, 500)] if k % 2 else [(10 + k, 1000)]
                n = sum(c for c, _ in stts)
                big = synthetic.track(1, 1920, 1080, 30000, stts, [(1, 2000), (1, 0)] * (n // 2) + [(1, 0)] * (n % 2) if k % 3 == 0 else [], [1, 6] if k % 4 else None, 500 if k % 5 == 0 else 0)
                small = synthetic.track(2, 640, 360, 1000, [(3, 40)])
                data = b"" if k == 7 else synthetic.movie([small, big] if k % 6 == 1 else [big], fragmented=k == 9, wide=k % 8 == 0)
                out.append((f"/v/n{k:02d}.mp4", data[:-30] if k == 11 else data))
            yield pd.DataFrame(out, columns=["path", "content"])

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "path string, content binary")


@query("SELECT printf('/v/n%02d.mp4', n_nationkey) AS path, CASE n_nationkey WHEN 7 THEN 'EMPTY_FILE' WHEN 9 THEN 'FRAGMENTED' WHEN 11 THEN 'CORRUPT' END AS reason, CASE WHEN n_nationkey NOT IN (7, 9, 11) THEN CASE WHEN n_nationkey % 6 = 1 THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS tracks, CASE WHEN n_nationkey NOT IN (7, 9, 11) THEN 10 + n_nationkey + CASE WHEN n_nationkey % 2 = 1 THEN 5 ELSE 0 END END::BIGINT AS samples FROM nation")
def container_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers walked, rejected with a reason, the primary track chosen."""
    t = isobmff.tracks(_movies(spark, sf_dir))
    p = isobmff.primary(t).select("path", F.col("sample_count").alias("samples"))
    g = t.groupBy("path").agg(F.max(F.regexp_extract("reason", "^[A-Z_]+", 0)).alias("reason"), F.count("track_id").alias("tracks"))
    return g.join(p, "path", "left").select("path", F.nullif("reason", F.lit("")).alias("reason"), "tracks", "samples")


@query("""
WITH s AS (SELECT n_nationkey AS k, i, CASE WHEN i < 10 + n_nationkey THEN i * 1000 ELSE (10 + n_nationkey) * 1000 + (i - 10 - n_nationkey) * 500 END AS dts, 10 + n_nationkey + CASE WHEN n_nationkey % 2 = 1 THEN 5 ELSE 0 END AS n FROM nation, range(60) r(i) WHERE n_nationkey NOT IN (7, 9, 11)), t AS (SELECT *, dts + CASE WHEN k % 3 = 0 AND i % 2 = 0 AND (i < n - 1 OR n % 2 = 0) THEN 2000 ELSE 0 END AS pts FROM s WHERE i < n), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pts, i) - 1 AS idx FROM t)
SELECT printf('n%02d_%06d', k, idx) AS frame_id, idx::INT AS frame_index, round(pts / 30000 + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END, 6) AS timestamp_seconds, pts::BIGINT AS pts, dts::BIGINT AS dts, k % 4 = 0 OR i IN (0, 5) AS is_keyframe, k % 2 = 1 AS variable_rate FROM f
""")
def container_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode and presentation times, key frames, variable rate, numbered frames."""
    f = isobmff.timeline(isobmff.primary(isobmff.tracks(_movies(spark, sf_dir))))
    return rounded(f.select("frame_id", "frame_index", "timestamp_seconds", "pts", "dts", "is_keyframe", "variable_rate"), 6, "timestamp_seconds")


@query("SELECT n_nationkey AS frame_index, 64 * 48 * 3 AS bytes, sha256('') <> '' AS hashed, ((20 * n_nationkey) % 255)::INT AS band FROM nation")
def synthetic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by rule, joined to their rows by id, hashed; the band's value read back from the raster."""
    n = table(spark, sf_dir, "nation").select(F.lit("v").alias("video_id"), F.col("n_nationkey").cast("long").alias("frame_index"))
    images = raster.synthetic_frames(n, 64, 48)
    band = F.conv(F.hex(F.substring("data", 24 * 64 * 3 + 1, 1)), 16, 10).cast("int")
    return images.join(n, ["video_id", "frame_index"]).select(F.col("frame_index").cast("int").alias("frame_index"), F.octet_length("data").alias("bytes"), (F.length(F.sha2("data", 256)) == 64).alias("hashed"), band.alias("band"))


@query("SELECT event_id, event_type, props FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines and read back with their schema; nested JSON stays as it is."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    path = shared_path(spark, "events-json")
    e.write.json(path)
    return spark.read.schema(e.schema).json(path)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 'BIASED' ELSE 'KEPT' END AS state, vec_id + 0.25 AS t FROM embeddings WHERE vec_id % 5 < 4 AND NOT vec_id BETWEEN 100 AND 120")
def perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropout window, clock bias, frame dropping; what is random is a hash of the row and tested apart."""
    i = F.col("vec_id")
    r = table(spark, sf_dir, "embeddings").select(i.alias("id"), i.cast("double").alias("t"), F.when(i % 4 == 0, "BIASED").otherwise("KEPT").alias("state"))
    return raster.clock_bias(raster.frame_dropping(raster.dropout(r, "t", 100.0, 120.0), "id", 5), "t", 0.25)
