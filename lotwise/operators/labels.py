"""Ground-truth labels and strata recomputed from measured values alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.robust import d
from lotwise.operators.ordered import group_sizes, lookup_join, quantiles

# Label thresholds
OUTLIER_Z = 3.0
DRIFT_DEFECT = 0.55
DRIFT_GRADUAL = 0.10
STEP_SHARE = 0.40


@dataclass(frozen=True)
class LabelLimit:
    high: float | None
    low: float | None = None
    direction: str = "increase"


def limit_table(spark: SparkSession, limits: dict[str, LabelLimit]) -> DataFrame:
    return spark.createDataFrame(
        [(p, x.high, x.low, x.direction) for p, x in limits.items()],
        "parameter string, abs_max double, abs_min double, direction string",
    )


def _breach() -> Column:
    v = F.col("value")
    return F.coalesce(v >= F.col("abs_max"), F.lit(False)) | F.coalesce(v <= F.col("abs_min"), F.lit(False))


def limit_violations(rows: DataFrame, limits: dict[str, LabelLimit]) -> DataFrame:
    """Readings at or beyond a limit (a label counts the limit itself as a breach)."""
    spec = F.broadcast(limit_table(rows.sparkSession, limits))
    return rows.join(spec, "parameter").filter(_breach()).select(
        "component_id", "lot_id", "parameter", "elapsed_hours", "value",
        F.when(F.col("value") >= F.col("abs_max"), ">= absolute_max").otherwise("<= absolute_min").alias("violation"),
    )


def drift_metrics(rows: DataFrame, limits: dict[str, LabelLimit]) -> DataFrame:
    """Per (part, parameter): v0, v24, v168, margin, drift ratio, step jump, breach flags.

    A missing 24 h reading counts as v0, a missing 168 h reading as the last one. The rows are unique per read-point,
    so a series holds no more rows than the read-point grid.
    """
    spec = F.broadcast(limit_table(rows.sparkSession, limits))
    keyed = rows.join(spec, "parameter", "left")
    high = F.when(F.col("abs_max").isNotNull() & (F.col("abs_max") != 0), F.col("abs_max")).otherwise(d(100.0))
    low = F.coalesce("abs_min", -high)
    w = Window.partitionBy("component_id", "lot_id", "parameter").orderBy("elapsed_hours")
    nxt = F.lead("value").over(w)
    keyed = keyed.withColumns({"_high": high, "_low": low, "_breach": _breach(), "_next": nxt})
    jump = (F.abs(F.col("_next") - F.col("value")) >= d(STEP_SHARE) * (F.col("_high") - F.col("_low"))) & (
        (F.col("_next") >= F.col("_high")) | (F.col("_next") <= F.col("_low"))
    )
    hour, value = F.col("elapsed_hours"), F.col("value")

    def at(h: int) -> Column:
        return F.max(F.when(hour == h, value))

    out = keyed.groupBy("component_id", "lot_id", "parameter").agg(
        F.coalesce(at(0), F.min_by("value", "elapsed_hours")).alias("v0"),
        at(24).alias("_v24"),
        F.coalesce(at(168), F.max_by("value", "elapsed_hours")).alias("v168"),
        F.max(F.coalesce(jump, F.lit(False))).alias("step_jump"),
        F.max(F.col("_breach")).alias("breach"),
        F.max(F.col("_breach") & hour.isin(0, 24)).alias("early_breach"),
        F.first("_high").alias("_high"),
        F.first("_low").alias("_low"),
        F.first(F.coalesce("direction", F.lit("increase"))).alias("direction"),
    )
    both = F.col("direction") == "bidirectional"
    delta = F.col("v168") - F.col("v0")
    margin = F.when(both, F.greatest(F.col("_high") - F.col("v0"), F.col("v0") - F.col("_low"), d(1.0))).otherwise(
        F.greatest(F.col("_high") - F.col("v0"), d(0.5))
    )
    out = out.withColumns({"has24": F.col("_v24").isNotNull(), "v24": F.coalesce("_v24", "v0"), "delta_168": delta, "margin": margin})
    ratio = F.when(both, F.abs("delta_168")).otherwise(F.greatest(d(0.0), F.col("delta_168"))) / F.col("margin")
    return out.withColumn("drift_ratio", ratio).drop("_v24", "_high", "_low", "direction")


def outliers_24h(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Parts whose 24 h reading lies three sigmas from its lot (the part itself included) on any parameter."""
    keys = ["lot_id", "parameter"]
    at24 = rows.filter("elapsed_hours = 24").select("component_id", *keys, "value")
    sizes = group_sizes(at24, keys)
    q = quantiles(at24, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit=limit, sizes=sizes)
    spread = at24.groupBy(*keys).agg(F.stddev_pop("value").alias("_std"))
    stats = q.join(spread, keys)
    iqr = F.col("q3") - F.col("q1")
    sigma = F.when(iqr > 1e-6, iqr / d(1.35)).otherwise(F.when(F.col("_std") == 0, d(1.0)).otherwise(F.col("_std")))
    enough = F.col("n") >= 3
    stats = stats.select(
        *keys,
        F.when(enough, F.col("median")).otherwise(d(0.0)).alias("_med"),
        F.when(enough, F.greatest(sigma, d(1e-6))).otherwise(d(1.0)).alias("_sigma"),
    )
    z = F.abs(F.col("value") - F.col("_med")) / F.col("_sigma")
    return lookup_join(at24, stats, keys, sizes, "inner", limit).groupBy("component_id", "lot_id").agg(
        F.max(z >= OUTLIER_Z).alias("is_24h_outlier")
    )


def labels(
    rows: DataFrame,
    limits: dict[str, LabelLimit],
    flags: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Failure label, stratum, degradation mode and escape flag of every part.

    ``flags`` may carry is_lot_shifted and has_sensor_artefact per (component_id, lot_id); both default to false.
    """
    part = ["component_id", "lot_id"]
    out = drift_metrics(rows, limits).groupBy(*part).agg(
        F.max(F.abs("delta_168")).alias("max_drift_168h"),
        F.greatest(d(0.0), F.max("drift_ratio")).alias("max_drift_ratio"),
        F.max("step_jump").alias("step_jump"),
        F.max("breach").alias("breach"),
        F.max("early_breach").alias("early_breach"),
    )
    out = out.join(outliers_24h(rows, limit), part, "left").withColumn(
        "is_24h_outlier", F.coalesce("is_24h_outlier", F.lit(False))
    )
    if flags is not None:
        out = out.join(flags, part, "left")
        shifted, artefact = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_lot_shifted", "has_sensor_artefact"))
    else:
        shifted, artefact = F.lit(False), F.lit(False)
    outlier, ratio, breach = F.col("is_24h_outlier"), F.col("max_drift_ratio"), F.col("breach")
    label = (
        F.when(F.col("step_jump"), "FAILED")
        .when(breach, F.when(F.col("early_breach"), "FAILED").otherwise("LATENT_DEFECT"))
        .when(artefact | shifted, "HEALTHY")
        .when(outlier | (ratio >= DRIFT_DEFECT), "LATENT_DEFECT")
        .otherwise("HEALTHY")
    )
    out = out.withColumn("failure_label", label)
    healthy = F.col("failure_label") == "HEALTHY"
    stratum = (
        F.when(breach, "S0_CLEAR_FAIL")
        .when(healthy & shifted, "S5_LOT_SHIFT")
        .when(healthy & artefact, "S4_DECOY_SENSOR")
        .when(healthy, "S3_DECOY_HEALTHY")
        .when(outlier, "S1_ESCAPE_ANOMALY")
        .otherwise("S2_ESCAPE_DRIFT")
    )
    mode = (
        F.when(F.col("step_jump"), "sudden_failure")
        .when(breach, F.when(F.col("failure_label") == "LATENT_DEFECT", "accelerated_drift").otherwise("sudden_failure"))
        .when(artefact, "sensor_noise_anomaly")
        .when(shifted, "lot_shift")
        .when(outlier, "early_latent_defect")
        .when(ratio >= DRIFT_DEFECT, "accelerated_drift")
        .when(ratio >= DRIFT_GRADUAL, "gradual_drift")
        .otherwise("healthy_stable")
    )
    out = out.withColumns({"stratum": stratum, "degradation_mode": mode, "is_escape": ~healthy & ~breach})
    return out.withColumn("must_flag", F.col("stratum").isin("S0_CLEAR_FAIL", "S1_ESCAPE_ANOMALY", "S2_ESCAPE_DRIFT")).select(
        *part, "failure_label", "stratum", "degradation_mode", "is_escape", "must_flag", "max_drift_168h",
        "max_drift_ratio", "is_24h_outlier", "step_jump", (~breach).alias("inside_limits"),
    )


def compare_labels(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Parts whose stored label or stratum differs from the recomputed one."""
    a = stored.select("component_id", F.col("failure_label").alias("stored_label"), F.col("stratum").alias("stored_stratum"))
    both = a.join(recomputed, "component_id", "full")
    same = F.col("stored_label").eqNullSafe(F.col("failure_label")) & F.col("stored_stratum").eqNullSafe(F.col("stratum"))
    return both.filter(~same).select("component_id", "stored_label", "failure_label", "stored_stratum", "stratum")


def escape_breaches(rows: DataFrame, labelled: DataFrame, limits: dict[str, LabelLimit]) -> DataFrame:
    """Limit breaches among escape parts; the escape set is sound when the count is 0."""
    escapes = labelled.filter("is_escape").select("component_id").distinct()
    found = limit_violations(rows, limits).join(escapes, "component_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("breaches"))


def stratum_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("stratum", "failure_label").agg(
        F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("is_escape")).alias("n_escapes")
    )


def decoy_check(labelled: DataFrame) -> DataFrame:
    """Per decoy stratum: parts, those not healthy, those marked as escapes; clean when both are none."""
    decoys = labelled.filter(F.col("stratum").startswith("S3") | F.col("stratum").startswith("S4") | F.col("stratum").startswith("S5"))
    counts = decoys.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("failure_label") != "HEALTHY").alias("n_unhealthy"), F.count_if("is_escape").alias("n_escapes")
    )
    return counts.withColumn("clean", (F.col("n_unhealthy") == 0) & (F.col("n_escapes") == 0))
