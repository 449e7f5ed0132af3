"""Telemetry logs: subtitle (SRT) and CSV files as reason-coded rows.

Every block or row gives one output row with ``status`` VALID, PARTIALLY_VALID or INVALID and a reason; nothing is lost.
Parsing is built-in string functions over Spark's own readers, so any store that Spark reads will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import units

# Names that logs use for a quantity, and the quantity.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "lat": ("latitude", "lat"), "lon": ("longitude", "lon", "long"), "abs_alt": ("altitude", "alt", "abs_alt"), "rel_alt": ("rel_alt", "relative_alt", "height"),
    "heading": ("drone_heading", "heading", "yaw", "drone_yaw"), "pitch": ("drone_pitch", "pitch"), "roll": ("drone_roll", "roll"),
    "gimbal_pitch": ("gimbal_pitch", "gb_pitch"), "gimbal_roll": ("gimbal_roll", "gb_roll"), "gimbal_yaw": ("gimbal_yaw", "gb_yaw"),
    "speed": ("hspeed", "speed", "h_s", "h.s"), "climb": ("vspeed", "v_s", "v.s", "climb_rate"), "satellites": ("sats", "satellites", "gps_count"),
}
# The patterns of the log format, which decide what counts as a time code, a bracket, a pair, a position, a
# speed or a date. They are the notations that the recorders write and that rows have to be accepted by.
_TIMECODE = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}"
_BRACKET = r"\[([^\]]+)\]"
_PAIR = r"([a-zA-Z0-9_.]+)\s*[:=]\s*([-\d.,a-zA-Z_/]+)"
_GPS = r"(?i)GPS\s*\(\s*([-\d.]+)\s*,\s*([-\d.]+)(?:\s*,\s*(\d+))?\s*\)"
_SPEED = r"(?i)(?:H\.S|HS|H_S|Speed)\s*[:=]?\s*([-\d.,]+)(?:\s*m/s)?"
_CLIMB = r"(?i)(?:V\.S|VS|V_S|Vspeed)\s*[:=]?\s*([-\d.,]+)(?:\s*m/s)?"
_DATE = r"(\d{4}[-./]\d{2}[-./]\d{2})\s+(\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)"
_ANGLES = ("heading", "pitch", "roll", "gimbal_pitch", "gimbal_roll", "gimbal_yaw")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of subtitle files; whole files, as blocks span lines."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse_srt(files: DataFrame) -> DataFrame:
    """One row a block of (path, content): record_index, raw_text, quantities, extras, status, reason.

    Altitude is absolute (MSL) if there is one, else relative to takeoff. Of repeated keys the last stands. A date's
    separators are normalised, its fraction of a second is left alone.
    """
    trimmed = F.regexp_replace(F.regexp_replace(F.col("content"), "\r\n?", "\n"), r"^\s+|\s+$", "")
    blocks = files.select("path", F.posexplode(F.split(trimmed, r"\n\s*\n")).alias("record_index", "raw"))
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    b = blocks.withColumn("lines", lines).filter(F.size("lines") > 0).withColumn("raw_text", F.array_join("lines", "\n"))
    at = F.coalesce(F.array_min(F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(_TIMECODE)), i)), lambda x: x.isNotNull())), F.lit(-1))
    b = b.withColumn("at", at).withColumn("timestamp", F.when(F.col("at") >= 0, units.timecode_seconds(F.element_at("lines", F.col("at") + 1))))
    text = F.when(F.col("at") >= 0, F.array_join(F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines"), F.lit(1))), " ")).otherwise("")
    b = b.withColumn("text", text).withColumn("inside", F.array_join(F.regexp_extract_all("text", F.lit(_BRACKET), F.lit(1)), " ; "))
    keys = F.transform(F.regexp_extract_all("inside", F.lit(_PAIR), F.lit(1)), F.lower)
    # Reversed, so that the first of a key's entries is its last in the text.
    # A bracket without any pair may be a name and a value of one word each.
    tags = F.filter(F.transform(F.regexp_extract_all("text", F.lit(_BRACKET), F.lit(1)), lambda x: F.split(F.trim(x), r"\s+")), lambda x: (F.size(x) == 2) & ~F.rlike(F.array_join(x, " "), F.lit(_PAIR)))
    b = b.withColumn("tags", F.reverse(F.transform(tags, lambda x: F.struct(F.lower(x[0]).alias("k"), x[1].alias("v")))))
    b = b.withColumn("pairs", F.reverse(F.arrays_zip(keys.alias("k"), F.regexp_extract_all("inside", F.lit(_PAIR), F.lit(2)).alias("v"))))
    of = lambda name: units.clean_number(F.get(F.filter("pairs", lambda p: p["k"].isin(*SYNONYMS[name])), F.lit(0))["v"])
    b = b.withColumns({n: of(n) for n in SYNONYMS})
    gps = lambda i: F.nullif(F.regexp_extract("text", _GPS, i), F.lit("")).try_cast("double")
    token = lambda p: units.clean_number(F.nullif(F.regexp_extract("text", p, 1), F.lit("")))
    b = b.withColumns({"lon": F.coalesce("lon", gps(1)), "lat": F.coalesce("lat", gps(2)), "satellites": F.coalesce("satellites", gps(3)).cast("int"), "speed": F.coalesce("speed", token(_SPEED)), "climb": F.coalesce("climb", token(_CLIMB))})
    date = F.regexp_extract("text", _DATE, 1)
    clock = F.regexp_extract("text", _DATE, 2)
    b = b.withColumn("timestamp_utc", F.when(date != "", F.concat_ws(" ", F.regexp_replace(date, "[./]", "-"), clock)))
    known = [k for v in SYNONYMS.values() for k in v]
    # Of repeated keys the last stands; the pairs are in reverse order here.
    extras = F.aggregate(F.concat(F.filter("pairs", lambda p: ~p["k"].isin(*known)), "tags"), F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    b = b.withColumns({"alt": F.coalesce("abs_alt", "rel_alt"), "altitude_reference": F.when(F.col("abs_alt").isNotNull(), "MSL").when(F.col("rel_alt").isNotNull(), "RELATIVE_TO_TAKEOFF").otherwise("UNKNOWN"), "extras": extras, "fix_type": units.fix_type(F.col("satellites"))})
    return _judged(b, F.when(F.col("timestamp").isNull(), "MISSING_TIMECODE")).select("path", "record_index", "raw_text", *OUT, "extras")


OUT = ("timestamp", "timestamp_utc", "lat", "lon", "alt", "altitude_reference", *_ANGLES, "speed", "climb", "satellites", "fix_type", "status", "reason")


def _judged(rows: DataFrame, first: Column) -> DataFrame:
    missing = F.col("lat").isNull() | F.col("lon").isNull() | F.col("alt").isNull()
    bad = ~(units.valid_latitude(F.col("lat")) & units.valid_longitude(F.col("lon")) & units.finite(F.col("alt")))
    angles = F.exists(F.array(*_ANGLES), lambda x: x.isNotNull() & ~units.finite(x))
    speed = F.col("speed").isNotNull() & ~units.valid_speed(F.col("speed"))
    reason = F.coalesce(first, F.when(missing, "MISSING_COORDINATES").when(bad, "POSITION_OUT_OF_RANGE").when(angles, "BAD_ORIENTATION").when(speed, "BAD_SPEED").when(F.col("timestamp") < 0, "NEGATIVE_TIME"))
    moves = F.coalesce("speed", "climb").isNotNull()
    turned = F.coalesce(*_ANGLES).isNotNull()
    return rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "INVALID").when(moves & turned, "VALID").otherwise("PARTIALLY_VALID"))


@dataclass(frozen=True)
class CsvMapping:
    """Which columns hold which quantity, and in what unit. Unknown units are refused, that of speed too."""

    timestamp: str
    lat: str
    lon: str
    alt: str
    heading: str | None = None
    pitch: str | None = None
    roll: str | None = None
    gimbal_pitch: str | None = None
    gimbal_roll: str | None = None
    gimbal_yaw: str | None = None
    speed: str | None = None
    climb: str | None = None
    satellites: str | None = None
    timestamp_utc: str | None = None
    timestamp_unit: str = "seconds"
    angle_unit: str = "degrees"
    altitude_unit: str = "meters"
    speed_unit: str = "mps"
    altitude_reference: str = "UNKNOWN"

    def __post_init__(self) -> None:
        if not all((self.timestamp, self.lat, self.lon, self.alt)):
            raise ValueError("timestamp, lat, lon and alt need a column each")
        for unit, known in ((self.timestamp_unit, units.SECONDS_IN), (self.angle_unit, ("degrees", "radians")), (self.altitude_unit, ("meters", "feet")), (self.speed_unit, ("mps", "kmph", "knots"))):
            units._known(unit, known)


def read_csv(spark: SparkSession, path: str, mapping: CsvMapping, sep: str = ",") -> DataFrame:
    """All columns as strings, never inferred; mapped columns that the header lacks raise."""
    rows = spark.read.csv(path, header=True, inferSchema=False, sep=sep, mode="PERMISSIVE")
    missing = [c for c in (mapping.timestamp, mapping.lat, mapping.lon, mapping.alt) if c not in rows.columns]
    if missing:
        raise ValueError(f"the header lacks mapped columns: {missing}")
    return rows


def parse_csv(rows: DataFrame, mapping: CsvMapping) -> DataFrame:
    """One row a row: raw_text, quantities in metres, degrees and seconds, status, reason. Empty strings count as missing."""
    m = mapping
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c and c in rows.columns else F.lit(None).cast("string")
    number = lambda c: F.regexp_replace(text(c), ",", ".").try_cast("double")
    garbled = lambda c: text(c).isNotNull() & number(c).isNull()
    angle = lambda c: units.degrees(number(c), m.angle_unit)
    required = (m.timestamp, m.lat, m.lon, m.alt)
    optional = [c for c in (m.heading, m.pitch, m.roll, m.gimbal_pitch, m.gimbal_roll, m.gimbal_yaw, m.speed, m.climb, m.satellites) if c]
    first = F.when(F.greatest(*[text(c).isNull().cast("int") for c in required]) == 1, "MISSING_MANDATORY_VALUE").when(F.greatest(*[garbled(c).cast("int") for c in (*required, *optional)]) == 1, "NOT_A_NUMBER")
    out = rows.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in rows.columns]).alias("raw_text"), first.alias("_first"), units.timestamp_seconds(number(m.timestamp), m.timestamp_unit).alias("timestamp"), text(m.timestamp_utc).alias("timestamp_utc"), number(m.lat).alias("lat"), number(m.lon).alias("lon"), units.metres(number(m.alt), m.altitude_unit).alias("alt"), F.lit(m.altitude_reference).alias("altitude_reference"), *[angle(getattr(m, a)).alias(a) for a in _ANGLES], units.metres_per_second(number(m.speed), m.speed_unit).alias("speed"), units.metres_per_second(number(m.climb), m.speed_unit).alias("climb"), number(m.satellites).cast("int").alias("satellites"))
    return _judged(out.withColumn("fix_type", units.fix_type(F.col("satellites"))), F.col("_first")).select("raw_text", *OUT)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("status <> 'INVALID'")


def rejected(parsed: DataFrame) -> DataFrame:
    """The quarantine: rejected rows with their raw text and reason."""
    return parsed.filter("status = 'INVALID'")
