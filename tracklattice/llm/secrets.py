"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every text is addressed by its SHA-256. The ledger holds one row for each blob and rule version that has
been scanned. A run scans only pairs that the ledger lacks, adds them, and joins the findings back to every
row (path or historical version) that carries the blob, so copies are scanned once and re-runs only scan what is new.

Defined cases: a null text is the empty blob; an empty table scans nothing; rows that repeat an id each
get their findings; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.plans.shared import materialize, shared_path

# Kinds in the order of their listing; pattern, the group whose length counts, its least length.
RULES: list[tuple[str, str, int, int]] = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("keyblock", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("vcs", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
]
BASE = ("assign", "access", "hex")
#: What a text must contain for a rule to be able to match; cheaper than its pattern.
NEEDS = {"access": "AKIA", "keyblock": "PRIVATE KEY-----", "jwt": "eyJ"}
#: The rules' own digest: a ledger's rows are scanned again as soon as a rule changes.
VERSION = hashlib.sha256(json.dumps([RULES, NEEDS], sort_keys=True).encode()).hexdigest()[:16]
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches of a text that are folded at a time.
RUN = 256
SALTS = 16


def _spans(text: Column, k: int) -> Column:
    """Spans of rule k. The pieces between matches give the places: the built-in functions return no offsets.

    The patterns of access and hex ask for their least length at once: their matches are maximal runs, so
    a run too short can neither match nor hide another.
    """
    kind, pattern, group, least = RULES[k]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    graded = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["piece"])
        end = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["graded"]) >= least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    each = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("all"), graded.alias("graded"))
    none = F.array().cast(SPAN)

    def spans_of(matches: Column) -> Column:
        # A fold copies what it has gathered at each step, so matches are folded RUN at a time, and the runs' spans joined at the end.
        run = lambda at, i: F.aggregate(F.slice(matches, i * RUN + 1, F.lit(RUN)), F.struct(at.alias("at"), none.alias("spans")), step)
        first = F.array(F.struct(F.lit(0).alias("at"), none.alias("spans")))
        numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))
        runs = F.aggregate(numbers, first, lambda done, i: F.concat(done, F.array(run(F.element_at(done, -1)["at"], i))))
        return F.flatten(F.transform(runs, lambda r: r["spans"]))

    # As the argument of a lambda the matches are found once, not once a run.
    spans = F.element_at(F.transform(F.array(each), spans_of), 1)
    has = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.rlike(text, F.lit(pattern))
    return F.when(has, spans).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, text_col: str = "text") -> DataFrame:
    """``blobs`` with ``spans``: every span, by start, then kind as listed. The text column goes."""
    every = F.concat(*[_spans(F.col(text_col), k) for k in range(len(RULES))])
    return blobs.withColumn("spans", F.array_sort(every)).drop(text_col)


def update_ledger(docs: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text", version: str = VERSION) -> DataFrame:
    """Scan what the ledger lacks, add it, and return (id, blob) of every row of ``docs``.

    The ledger is a Parquet table (blob, version, spans) that only grows; each run appends by Spark's committer.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob")), "blobs")
    schema = f"blob string, version string, spans {SPAN}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    unseen = rows.groupBy("blob").agg(F.min("doc_id").alias("from_id"))
    if there:
        unseen = unseen.join(spark.read.schema(schema).parquet(ledger_path).filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    unseen = materialize(unseen, "unseen")
    if unseen.limit(1).count():
        pick = unseen.select("from_id", F.col("blob").alias("of"))
        texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        # A row is the blob's source if both its id and its digest match, so repeated or missing ids do no harm. No hint: the
        # planner knows the size of what is unseen, and keeps texts in place where an incremental run has little of it.
        todo = texts.join(pick, F.col("doc_id").eqNullSafe(F.col("from_id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("of")))
        scan(todo.select(F.col("of").alias("blob"), F.lit(version).alias("version"), "text")).write.mode("append").parquet(ledger_path)
    return rows


def findings(rows: DataFrame, ledger_path: str, version: str = VERSION) -> DataFrame:
    """(doc_id, spans) of every row. Blobs without findings aren't joined; the others are salted, as copies may be many."""
    ledger = rows.sparkSession.read.schema(f"blob string, version string, spans {SPAN}").parquet(ledger_path)
    found = ledger.filter((F.col("version") == version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(found.hint("merge"), ["blob", "salt"], "left").select("doc_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document, through the ledger at ``ledger_path`` (a new one if not given)."""
    path = ledger_path or shared_path(docs.sparkSession, "secret-ledger")
    rows = update_ledger(docs, path, id_col, text_col)
    return findings(rows, path) if docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)) else rows.select("doc_id", F.array().cast(SPAN).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter(spans, lambda s: s["kind"] < len(BASE)))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
