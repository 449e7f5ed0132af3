"""Policy and governance (section L), guards (D13 to D15), digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.operators import audits, policy
from tracklattice.queries.registry import query, table

_R = "SELECT p_partkey AS id, (p_partkey % 6)::INT AS level, p_size % 2 = 0 AS independent, p_size % 3 > 0 AS holdout, p_size % 5 > 0 AS geospatial, p_size % 7 > 0 AS surface, p_size % 4 = 0 AS radiometric, p_size % 9 > 3 AS probabilistic FROM part"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k % 6).cast("int").alias("level"), (s % 2 == 0).alias("independent"), (s % 3 > 0).alias("holdout"), (s % 5 > 0).alias("geospatial"), (s % 7 > 0).alias("surface"), (s % 4 == 0).alias("radiometric"), (s % 9 > 3).alias("probabilistic"))


_T = ", ".join(f"({k}, '{c}')" for k, v in policy.CLAIMS.items() for c in v)
_ALL = ", ".join(f"('{c}')" for c in sorted({c for v in policy.CLAIMS.values() for c in v} | set(policy.EXTRA_CLAIMS)))


@query(f"""
WITH r AS ({_R}), t(level, claim) AS (VALUES {_T}), a AS (
  SELECT r.id, claim FROM r JOIN t USING (level) WHERE NOT (level >= 3 AND NOT independent AND claim IN ('segment_scale_accuracy', 'surface_mesh_chamfer', 'horizontal_checkpoint_rmse', 'vertical_checkpoint_rmse', 'surveyed_3d_accuracy')) AND NOT ((NOT holdout OR NOT geospatial) AND claim IN ('horizontal_checkpoint_rmse', 'vertical_checkpoint_rmse', 'surveyed_3d_accuracy')) AND NOT (NOT surface AND claim = 'surface_mesh_chamfer')
  UNION ALL SELECT id, 'radiometric_color_accuracy' FROM r WHERE radiometric UNION ALL SELECT id, 'probabilistic_gaussian_coverage' FROM r WHERE probabilistic AND level >= 2)
SELECT r.id, coalesce((SELECT string_agg(claim, ',' ORDER BY claim) FROM a WHERE a.id = r.id), '') AS allowed, (SELECT string_agg(c, ',' ORDER BY c) FROM (VALUES {_ALL}) x(c) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = r.id AND a.claim = c)) AS blocked FROM r
""")
def claim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims allowed and blocked under evidence and prerequisites."""
    out = policy.authorise(_requests(spark, sf_dir))
    return out.select("id", F.array_join("allowed", ",").alias("allowed"), F.array_join("blocked", ",").alias("blocked"))


_CLAIMS = sorted({c for v in policy.CLAIMS.values() for c in v} | set(policy.EXTRA_CLAIMS))


@query(f"""
WITH r AS (SELECT r.*, p_size % 11 = 0 AS itself, {_CLAIMS}[p_size % {len(_CLAIMS)} + 1] AS asked FROM ({_R}) r JOIN part ON p_partkey = id), t(level, claim) AS (VALUES {_T}),
c AS (SELECT id, asked, itself, level, (asked = 'radiometric_color_accuracy' AND radiometric) OR (asked = 'probabilistic_gaussian_coverage' AND probabilistic AND level >= 2) OR (EXISTS (SELECT 1 FROM t WHERE t.level = r.level AND t.claim = r.asked) AND NOT (level >= 3 AND NOT independent AND asked IN ('segment_scale_accuracy', 'surface_mesh_chamfer', 'horizontal_checkpoint_rmse', 'vertical_checkpoint_rmse', 'surveyed_3d_accuracy')) AND NOT ((NOT holdout OR NOT geospatial) AND asked IN ('horizontal_checkpoint_rmse', 'vertical_checkpoint_rmse', 'surveyed_3d_accuracy')) AND NOT (NOT surface AND asked = 'surface_mesh_chamfer')) AS granted FROM r),
m AS (SELECT l_partkey AS id, l_linenumber % 7 AS axis, max(l_tax > 0.06) AS failed FROM lineitem GROUP BY ALL), a(axis, name, least) AS (VALUES (0, 'A_VISUAL', 0), (1, 'B_GEOMETRIC', 0), (2, 'C_METRIC_SCALE', 2), (3, 'D_GEOSPATIAL', 4), (4, 'E_TEXTURE', 0), (5, 'F_UNCERTAINTY', 0), (6, 'G_COMPLETENESS', 5)),
s AS (SELECT c.id, name, CASE WHEN NOT (level >= least OR (axis = 6 AND level = 2)) THEN 'NOT_EVALUABLE' WHEN failed IS NULL THEN 'NOT_MEASURED' WHEN failed THEN 'FAIL' ELSE 'PASS' END AS status FROM c CROSS JOIN a LEFT JOIN m USING (id, axis)),
x AS (SELECT id, string_agg(name || '=' || status, ',' ORDER BY name) AS axes, bool_or(status = 'FAIL') AS fails, bool_or(status = 'NOT_MEASURED') AS lacks FROM s GROUP BY id)
SELECT id, axes, CASE WHEN granted THEN '' ELSE asked END AS refused, CASE WHEN itself OR NOT granted THEN 'CONTRACT_VIOLATION' WHEN fails THEN 'FAIL' WHEN lacks THEN 'INCOMPLETE' ELSE 'PASS' END AS state FROM x JOIN c USING (id)
""")
def result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each run from its evidence, claims and measured metrics; unmeasured axes never pass."""
    size = F.col("p_size")
    more = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("a").alias("estimation"), F.when(size % 11 == 0, "a").otherwise("b").alias("evaluation"), F.array(F.element_at(F.array(*[F.lit(c) for c in _CLAIMS]), (size % len(_CLAIMS) + 1).cast("int"))).alias("requested"))
    axis = F.element_at(F.array(*[F.lit(a) for a in policy.AXES]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    measured = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), axis.alias("axis"), F.lit("tax").alias("metric"), F.col("l_tax").alias("value"), F.lit(0.06).alias("most"))
    out = policy.assemble(_requests(spark, sf_dir).join(more, "id"), measured)
    named = F.transform(F.array(*[F.lit(a) for a in policy.AXES]), lambda a: F.concat_ws("=", a, F.element_at("axes", a)))
    return out.select("id", F.array_join(named, ",").alias("axes"), F.array_join("refused", ",").alias("refused"), "state")


@query("""
WITH d AS (SELECT doc_id, source, doc_id % 4 = 0 AS telemetry, doc_id % 7 = 0 AS synthetic, doc_id % 3 > 0 AS truth, ['tls scan', 'GCP', 'tape measured', 'other'][doc_id % 4 + 1] AS kind FROM documents),
l AS (SELECT *, CASE WHEN synthetic THEN 2 WHEN NOT truth THEN telemetry::INT WHEN kind = 'tls scan' THEN 5 WHEN kind = 'GCP' THEN 4 WHEN kind = 'tape measured' THEN 3 ELSE telemetry::INT END AS level FROM d)
SELECT doc_id, level::INT AS level, 'A_VISUAL,B_GEOMETRIC,' || ['', '', 'C_METRIC_SCALE,', 'C_METRIC_SCALE,', 'C_METRIC_SCALE,D_GEOSPATIAL,', 'C_METRIC_SCALE,D_GEOSPATIAL,'][level + 1] || 'E_TEXTURE,F_UNCERTAINTY' || CASE WHEN level IN (2, 5) THEN ',G_COMPLETENESS' ELSE '' END AS axes FROM l
""")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence level from declarations, axes that it can evaluate."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tls scan", "GCP", "tape measured", "other")]), (i % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", policy.evidence_level(i % 7 == 0, i % 3 > 0, kind, i % 4 == 0).alias("level"))
    return d.select("doc_id", "level", F.array_join(policy.evaluable_axes(F.col("level")), ",").alias("axes"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'true_depth' WHEN doc_id % 15 = 3 THEN 'hidden_texture,true_scale' ELSE '' END AS leaked, doc_id % 3 = 0 AND doc_id % 4 < 3 AS unit_violation, doc_id % 5 = 0 AND doc_id % 2 = 0 AS texel_violation FROM documents")
def artifact_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden keys, units without a metric scale, observed texels without provenance."""
    i = F.col("doc_id")
    keys = F.when(i % 10 == 0, F.array(F.lit("True_Depth"), F.lit("lang"))).when(i % 15 == 3, F.array(F.lit("TRUE_SCALE"), F.lit("hidden_texture"))).otherwise(F.array(F.lit("lang")))
    states = F.element_at(F.array(*[F.lit(x) for x in ("NOT_METRIC", "METRIC_ALIGNMENT_FAILED", "METRIC_SCALE_UNCERTAIN", "METRIC_SCALE_VALIDATED")]), (i % 4 + 1).cast("int"))
    unit = F.when(i % 3 == 0, "METRES").otherwise("RECONSTRUCTION_UNITS")
    texel = policy.texel_violation(F.when(i % 5 == 0, "OBSERVED_TEXTURE").otherwise("UNOBSERVED"), F.when(i % 2 == 1, "view"), F.array("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(policy.leaked_keys(keys), ",").alias("leaked"), policy.metric_unit_violation(unit, states).alias("unit_violation"), texel.alias("texel_violation"))


@query("SELECT count(*) FILTER (doc_id % 20 = 0) AS truth_rows, count(*) FILTER (doc_id % 6 = 0) AS self_evaluated FROM documents")
def evidence_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the truth's domain, results evaluated against their own input."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.when(i % 20 == 0, "EVALUATION_TRUTH").otherwise("OBSERVATION").alias("domain"), policy.self_evaluation(i % 6, F.lit(0)).alias("own"))
    return d.agg(F.count_if(F.col("domain") == "EVALUATION_TRUTH").alias("truth_rows"), F.count_if("own").alias("self_evaluated"))


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS digest FROM region""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of canonical JSON, keys in order."""
    return table(spark, sf_dir, "region").select("r_regionkey", audits.row_digest(["r_regionkey", "r_name"]).alias("digest"))


@query("SELECT count(*) AS n, true AS order_free FROM lineitem")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's digest doesn't depend on the order or partitioning of its rows."""
    li = table(spark, sf_dir, "lineitem")
    a, b = audits.table_digest(li), audits.table_digest(li.repartition(17, "l_suppkey"))
    return a.select("n", F.col("digest").alias("d1")).join(b.select("n", F.col("digest").alias("d2")), "n").select("n", (F.col("d1") == F.col("d2")).alias("order_free"))


@query("SELECT count(*) AS n, 0.0 AS largest_difference, 'R2' AS level FROM orders")
def reproducibility_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one aggregation compared row by row."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return audits.reproducibility(o, o.repartition(5).select(F.col("o_orderkey"), F.col("o_totalprice")), ["o_orderkey"], ["o_totalprice"], 1e-9).select("n", "largest_difference", "level")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def turn_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered arrays of a group."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.size("x").cast("long").alias("turns"), F.array_join("x.role", ">").alias("roles"))
