"""Evidence levels, claims, guards: decision tables as joins and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Claims that evidence levels 0 to 5 allow at most.
CLAIMS: dict[int, tuple[str, ...]] = {
    0: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr"),
    1: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr", "gnss_fitting_residual"),
    2: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr", "gnss_fitting_residual", "synthetic_recovery_acc", "segment_scale_accuracy", "surface_mesh_chamfer"),
    3: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr", "gnss_fitting_residual", "segment_scale_accuracy"),
    4: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr", "gnss_fitting_residual", "segment_scale_accuracy", "horizontal_checkpoint_rmse", "vertical_checkpoint_rmse", "surveyed_3d_accuracy"),
    5: ("reprojection_consistency", "relative_motion_profile", "visual_appearance_psnr", "gnss_fitting_residual", "segment_scale_accuracy", "horizontal_checkpoint_rmse", "vertical_checkpoint_rmse", "surveyed_3d_accuracy", "surface_mesh_chamfer"),
}
# Claims that exist besides those of the table.
EXTRA_CLAIMS = ("radiometric_color_accuracy", "probabilistic_gaussian_coverage", "universal_drone_accuracy")
# The quality axes.
AXES = ("A_VISUAL", "B_GEOMETRIC", "C_METRIC_SCALE", "D_GEOSPATIAL", "E_TEXTURE", "F_UNCERTAINTY", "G_COMPLETENESS")
# The axes that evidence levels 0 to 5 can't evaluate.
UNEVALUABLE: dict[int, tuple[str, ...]] = {
    0: ("C_METRIC_SCALE", "D_GEOSPATIAL", "G_COMPLETENESS"), 1: ("C_METRIC_SCALE", "D_GEOSPATIAL", "G_COMPLETENESS"),
    2: ("D_GEOSPATIAL",), 3: ("D_GEOSPATIAL", "G_COMPLETENESS"), 4: ("G_COMPLETENESS",), 5: (),
}
# Keys that would leak evaluation truth.
FORBIDDEN_KEYS = (
    "true_camera_poses", "true_camera_pose", "true_depth_maps", "true_depth", "true_mesh", "true_landmarks", "true_normals", "true_visibility_masks", "true_visibility_mask", "true_visibility", "true_textures", "true_texture",
    "cad_mesh", "cad_points", "ground_truth_poses", "ground_truth_pose", "ground_truth_depth", "ground_truth_points", "ground_truth_mesh", "ground_truth_texture", "ground_truth_textures", "ground_truth_visibility", "ground_truth_scale",
    "hidden_camera_pose", "hidden_camera_poses", "hidden_gt_texture", "hidden_texture", "hidden_visibility_mask", "hidden_metric_scale", "true_scale", "validation_reference", "validation_checkpoint", "validation_checkpoints",
)
# Which prerequisite each claim needs.
_SURVEY = ("horizontal_checkpoint_rmse", "vertical_checkpoint_rmse", "surveyed_3d_accuracy")


def evidence_level(synthetic: Column, has_truth: Column, truth_type: Column, has_telemetry: Column) -> Column:
    """0 to 5 from what a dataset declares."""
    kind = F.upper(F.coalesce(truth_type, F.lit("")))
    names = lambda *parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(kind, p))
    without = F.when(has_telemetry, 1).otherwise(0)
    return F.when(synthetic, 2).when(~has_truth, without).when(names("TLS", "SCAN", "LIDAR"), 5).when(names("CHECKPOINT", "SURVEY", "GCP"), 4).when(names("MEASURED", "DISTANCE", "TAPE"), 3).otherwise(without)


def evaluable_axes(level: Column) -> Column:
    """Array of axes, by level."""
    return F.element_at(F.create_map(*[x for k, no in UNEVALUABLE.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in AXES if a not in no]))]), level)


def claim_table(spark: SparkSession) -> DataFrame:
    """(level, claim): the decision table, 33 rows."""
    return spark.createDataFrame([(k, c) for k, v in CLAIMS.items() for c in v], "level int, claim string")


def authorise(requests: DataFrame) -> DataFrame:
    """(id, allowed, blocked) of requests (id, level, independent, holdout, geospatial, surface, radiometric, probabilistic)."""
    level = F.col("level")
    base = F.element_at(F.create_map(*[x for k, v in CLAIMS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]), level)
    survey = F.array(*[F.lit(c) for c in _SURVEY])
    none = F.array().cast("array<string>")
    drop = F.concat(
        F.when((level >= 3) & ~F.col("independent"), F.concat(survey, F.array(F.lit("segment_scale_accuracy"), F.lit("surface_mesh_chamfer")))).otherwise(none),
        F.when(~F.col("holdout") | ~F.col("geospatial"), survey).otherwise(none),
        F.when(~F.col("surface"), F.array(F.lit("surface_mesh_chamfer"))).otherwise(none),
    )
    more = F.concat(F.when(F.col("radiometric"), F.array(F.lit(EXTRA_CLAIMS[0]))).otherwise(none), F.when(F.col("probabilistic") & (level >= 2), F.array(F.lit(EXTRA_CLAIMS[1]))).otherwise(none))
    every = F.array(*[F.lit(c) for c in sorted({c for v in CLAIMS.values() for c in v} | set(EXTRA_CLAIMS))])
    out = requests.withColumn("allowed", F.array_sort(F.concat(F.array_except(base, drop), more)))
    return out.withColumn("blocked", F.array_sort(F.array_except(every, F.col("allowed"))))


def assemble(runs: DataFrame, measured: DataFrame) -> DataFrame:
    """(id, state, axes, refused) of runs: those of ``authorise`` with estimation and evaluation digests and ``requested`` claims.

    ``measured`` (id, axis, metric, value, most) holds the metrics and their limits. ``axes`` maps each axis to its status:
    NOT_EVALUABLE by the evidence; NOT_MEASURED; FAIL where a value is beyond its limit or not finite; else PASS. Nothing
    passes that wasn't measured. A run that requests blocked claims (``refused``), or that is judged by what it was
    estimated from, is a CONTRACT_VIOLATION; else FAIL if an axis fails, INCOMPLETE if one lacks its metrics, else PASS.
    """
    off = ~F.coalesce((F.col("value") <= F.col("most")) & (F.abs("value") < float("inf")), F.lit(False))
    per = measured.groupBy("id", "axis").agg(F.max(off).alias("failed")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "failed"))).alias("failed"))  # seven axes at most
    judged = authorise(runs).join(per, "id", "left").withColumn("open", evaluable_axes(F.col("level")))
    status = lambda a: F.when(~F.coalesce(F.array_contains("open", a), F.lit(False)), "NOT_EVALUABLE").when(F.col("failed")[a].isNull(), "NOT_MEASURED").when(F.col("failed")[a], "FAIL").otherwise("PASS")
    judged = judged.withColumn("axes", F.create_map(*[x for a in AXES for x in (F.lit(a), status(a))]))
    judged = judged.withColumn("refused", F.array_sort(F.array_except(F.coalesce("requested", F.array().cast("array<string>")), "allowed")))
    has = lambda s: F.array_contains(F.map_values("axes"), s)
    broken = (F.size("refused") > 0) | (self_evaluation(F.col("estimation"), F.col("evaluation")) & F.col("evaluation").isNotNull())
    state = F.when(broken, "CONTRACT_VIOLATION").when(has("FAIL"), "FAIL").when(has("NOT_MEASURED"), "INCOMPLETE").otherwise("PASS")
    return judged.select("id", state.alias("state"), "axes", "refused")


def leaked_keys(keys: Column) -> Column:
    """Forbidden keys among an array of keys, whatever their case."""
    return F.array_sort(F.array_intersect(F.transform(keys, F.lower), F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])))


def metric_unit_violation(unit: Column, status: Column) -> Column:
    """METRES may only be stated for a scale that was estimated or validated."""
    return F.upper(unit).isin("METRES", "METERS", "M") & ~F.coalesce(status.isin("METRIC_SCALE_ESTIMATED", "METRIC_SCALE_VALIDATED"), F.lit(False))


def texel_violation(state: Column, provenance: Column, frames: Column) -> Column:
    """An observed texel needs a provenance and a contributing frame."""
    return (state == "OBSERVED_TEXTURE") & (provenance.isNull() | (F.coalesce(F.size(frames), F.lit(0)) <= 0))


def self_evaluation(estimation: Column, evaluation: Column) -> Column:
    """Whether a result is evaluated against what it was estimated from."""
    return estimation.eqNullSafe(evaluation)


# A stage and the one that it can't run without.
STAGE_NEEDS: tuple[tuple[str, str], ...] = (("texturing", "surface_meshing"), ("dense_point_generation", "dense_stereo"), ("dense_fusion", "dense_point_generation"), ("surface_meshing", "dense_fusion"))


def config_violations(enabled: dict[str, Column]) -> Column:
    """Array of "stage needs other" for each enabled stage whose need is off; empty for a valid configuration. An unknown flag is off."""
    on = lambda name: F.coalesce(enabled.get(name, F.lit(False)), F.lit(False))
    return F.filter(F.array(*[F.when(on(stage) & ~on(need), f"{stage} needs {need}") for stage, need in STAGE_NEEDS]), lambda x: x.isNotNull())
