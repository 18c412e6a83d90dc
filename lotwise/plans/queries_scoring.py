"""Registered queries over the quality of screens, forecasts and work lists, and over leave-one-out joint distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import robust as R
from lotwise.operators import calibrate as C
from lotwise.operators import cohort as H
from lotwise.operators import labels as L
from lotwise.operators import multivariate as M
from lotwise.operators import scoring as S
from lotwise.operators.ordered import lookup_join
from lotwise.plans.queries_data import LIMITS
from lotwise.plans.queries_drift import N_MIN, _calibration, _split, evidence_frame
from lotwise.plans.reports import rounded
from lotwise.plans.views import TRAJECTORY_HIGH, table, trajectory_rows

# Miss rate and confidence of the threshold query, window of the ablation's screens, ridge penalty
MISS_RATE, CONFIDENCE = 0.1, 0.1
SCREEN_K = 2.0
PENALTY = 10.0
SETTINGS = {
    "absolute": ("absolute",), "mean_3_sigma": ("mean3",), "dpat": ("dpat",), "dpat_tukey": ("dpat", "tukey"),
    "dpat_tukey_skewed": ("dpat", "tukey", "mean3"), "all": ("absolute", "dpat", "tukey", "mean3"),
}
JOINT = ["e0", "e1", "e2"]


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = _calibration(spark, sf_dir)
    series = C.with_phi(_split(spark, sf_dir, "test"), cal.phi)
    series = series.withColumn("point", F.col("v0") + (F.col("v24") - F.col("v0")) * F.col("phi_168"))
    return C.conformal_bound(series, cal.bounds, "point", N_MIN).withColumn("group", F.concat_ws("/", *C.GROUP))


def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.forecast_metrics(_forecast(spark, sf_dir), "group"))


def _scored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part its largest 24 h reading and its label."""
    rows = trajectory_rows(spark, sf_dir)
    late = rows.filter("elapsed_hours = 24").groupBy("component_id", "lot_id").agg(F.max("value").alias("score"))
    truth = L.labels(rows, LIMITS).select("component_id", "lot_id", "failure_label", "is_escape")
    return late.join(truth, ["component_id", "lot_id"]).withColumn("bad", F.col("failure_label") != "HEALTHY")


def miss_rate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.miss_rate_threshold(_scored_parts(spark, sf_dir), "lot_id", "score", "bad", MISS_RATE, CONFIDENCE))


def curve_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _scored_parts(spark, sf_dir).withColumn("score", F.floor(F.col("score") / 4))
    return rounded(S.curve_areas(parts, "lot_id", "score", "bad"))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens of the 24 h readings within (lot, type, parameter), and what their unions find."""
    rows = trajectory_rows(spark, sf_dir)
    late = rows.filter("elapsed_hours = 24").select("component_id", "lot_id", "component_type", "parameter", "value")
    keys = ["lot_id", "component_type", "parameter"]
    plain = late.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    stats = H.lot_statistics(late, keys, "value").select(*keys, "n", "median", "robust_sigma", "tukey_mild_low", "tukey_mild_high")
    x = F.col("value")
    some = F.col("n") >= K.MIN_COHORT
    flags = lookup_join(lookup_join(late, plain, keys), stats, keys).select(
        "component_id", "lot_id", (x >= TRAJECTORY_HIGH).alias("absolute"), (F.abs(x - F.col("mean")) > 3 * F.col("sd")).alias("mean3"),
        (some & (F.abs(x - F.col("median")) > SCREEN_K * F.col("robust_sigma"))).alias("dpat"),
        (some & ((x < F.col("tukey_mild_low")) | (x > F.col("tukey_mild_high")))).alias("tukey"),
    )
    screens = ["absolute", "mean3", "dpat", "tukey"]
    parts = flags.groupBy("component_id", "lot_id").agg(*[F.max(s).alias(s) for s in screens])
    parts = parts.join(L.labels(rows, LIMITS).select("component_id", "lot_id", "failure_label", "is_escape"), ["component_id", "lot_id"])
    return rounded(S.ablation(parts.withColumn("bad", F.col("failure_label") != "HEALTHY"), screens, SETTINGS, "bad", "is_escape"))


def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the order of all evidence rows by risk holds under 200 draws of weights."""
    ev = evidence_frame(spark, sf_dir).filter("risk_code IS NULL")
    rows = ev.select(
        *[R.round6(F.col(f"risk_{c}")).alias(c) for c in ("anomaly", "drift", "margin", "quality")], (-F.col("risk_credit")).alias("credit"),
    )
    out = S.rank_stability(rows, K.WEIGHTS)
    return out.select("draw", "n", F.round("rho", 4).alias("rho"))


def drift_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a series at 24 h: readings, change, their place in the lot, temperature."""
    rows = trajectory_rows(spark, sf_dir)
    series = C.complete(C.trajectories(rows)).withColumn("delta_24", F.col("v24") - F.col("v0"))
    keys = ["lot_id", "component_type", "parameter"]
    out = series.withColumn("rel_delta_24", F.col("delta_24") / F.greatest(F.abs("v0"), R.d(1e-9)))
    for name in ("v0", "v24", "delta_24"):
        stats = H.lot_statistics(series, keys, name).select(
            *keys, F.col("n").alias(f"{name}_n"), F.col("median").alias(f"{name}_median"), F.col("robust_sigma").alias(f"{name}_sigma")
        )
        out = lookup_join(out, stats, keys)
        usable = (F.col(f"{name}_n") >= K.MIN_COHORT) & (F.col(f"{name}_sigma") > 0)
        out = out.withColumn(f"{name}_lot_z", F.when(usable, (F.col(name) - F.col(f"{name}_median")) / F.col(f"{name}_sigma")))
    out = out.withColumn("temperature_mean", (F.col("temp0") + F.col("temp24")) / 2)
    return rounded(
        out, "component_id", "lot_id", "component_type", "parameter", "v0", "v24", "delta_24", "rel_delta_24", "v0_lot_z", "v24_lot_z",
        "delta_24_lot_z", "temperature_mean",
    )


def ridge_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge correction of the shape forecast per parameter, fitted on training lots and tried on calibration lots."""
    phi = C.shape_phi(_split(spark, sf_dir, "train"))

    def with_residual(name: str) -> DataFrame:
        res = C.residuals(_split(spark, sf_dir, name), phi)
        return res.withColumn("delta_24", F.col("v24") - F.col("v0"))

    out = S.ridge_corrections(with_residual("train"), with_residual("calib"), ["parameter"], ["v0", "delta_24"], PENALTY)
    return rounded(out)


def cautious_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = C.shape_phi(_split(spark, sf_dir, "train"))
    return rounded(S.cautious_bounds(C.residuals(_split(spark, sf_dir, "calib"), phi)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every vector; its label is the lot."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("label").alias("lot_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(JOINT)])


def joint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust joint distance of every vector by the one fit of its label."""
    out = M.robust(_vectors(spark, sf_dir), ["lot_id"], JOINT)
    return rounded(out, "vec_id", "lot_id", "n", "d2", "p_value", *[f"c_{c}" for c in JOINT], "refusal_code")


def joint_distance_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust joint distance of every vector from the fit of all others of its label."""
    out = M.robust(_vectors(spark, sf_dir), ["lot_id"], JOINT, "exact")
    out = M.top_contributions(out, JOINT)
    return rounded(
        out.withColumn("top_parameter", F.col("top")[0]["parameter"]), "vec_id", "lot_id", "n", "d2", "p_value", *[f"c_{c}" for c in JOINT],
        "top_parameter", "adds_up", "refusal_code",
    )


QUERIES = {
    "forecast_metrics": forecast_metrics,
    "miss_rate_threshold": miss_rate_threshold,
    "curve_areas": curve_areas,
    "ablation": ablation,
    "rank_stability": rank_stability,
    "drift_features": drift_features,
    "ridge_corrections": ridge_corrections,
    "cautious_bounds": cautious_bounds,
    "joint_distance": joint_distance,
    "joint_distance_loo": joint_distance_loo,
}
