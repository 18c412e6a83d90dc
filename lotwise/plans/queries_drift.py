"""Registered queries over trajectories: shape, forecast, bound, guard, safety, risk, evidence, roll-ups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import drift as D
from lotwise.functions import robust as R
from lotwise.operators import attribute as A
from lotwise.operators import calibrate as C
from lotwise.operators import cohort as H
from lotwise.operators import guard as G
from lotwise.plans import evidence as E
from lotwise.plans.reports import rounded
from lotwise.plans.views import (
    COHORT_KEYS,
    COHORT_LIMITS,
    COHORT_PARAMETERS,
    TRAJECTORY_HIGH,
    cohort_view,
    dealt_cohorts,
    trajectory_rows,
)

# Event types in their evidence order, and the smallest calibration cell
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
N_MIN = 10
VIEW_K = 1.2
PROFILE = E.ScreeningProfile(
    limits={p: (None, TRAJECTORY_HIGH, "uA", None, 0.7) for p in EVENT_TYPES}, n_min=N_MIN, not_thermal=("view",)
)


def _split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = trajectory_rows(spark, sf_dir).filter(F.col("split") == name)
    return C.complete(C.trajectories(rows))


def _calibration(spark: SparkSession, sf_dir: str, alpha: float = PROFILE.alpha) -> E.Calibration:
    rows = trajectory_rows(spark, sf_dir)
    return E.Calibration.fit(rows.filter("split = 'train'"), rows.filter("split = 'calib'"), alpha)


def series_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.trajectories(trajectory_rows(spark, sf_dir)))


def shape_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes from the whole table with the training lots as the allowed ones."""
    rows = trajectory_rows(spark, sf_dir)
    series = C.complete(C.trajectories(rows))
    allowed = rows.filter("split = 'train'").select("lot_id").distinct()
    return rounded(C.shape_phi(series, allowed))


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape curves of each group at the reporting hours, for every family."""
    phi = C.shape_phi(_split(spark, sf_dir, "train"))
    hours = F.array(*[R.d(h) for h in (0, 6, 12, 24, 48, 96, 168)])
    tau = R.d(36.0)
    families = F.array(*[F.lit(f) for f in ("power_law", "linear", "log_time", "saturating")])
    grid = phi.select("component_type", "parameter", "phi_168", F.explode(hours).alias("hour")).withColumn(
        "family", F.explode(families)
    )
    param = F.when(F.col("family").isin("log_time", "saturating"), tau)
    value = D.phi_at(F.col("hour"), F.col("family"), F.col("phi_168"), param)
    return rounded(grid.select("component_type", "parameter", "family", "hour", value.alias("phi")))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory_rows(spark, sf_dir)
    series = C.with_phi(C.trajectories(rows), C.shape_phi(_split(spark, sf_dir, "train")))
    f = D.forecast(F.col("v0"), F.col("v24"), F.col("phi_168"), R.d(1.5), R.d(3.0), R.d(2.0), R.d(0.5))
    out = series.withColumn("f", f)
    return rounded(
        out.select(
            "component_id", "parameter", "f.point", "f.shape_point", "f.baseline_linear", "f.amplitude",
            "f.residual_applied", "f.refusal_code",
        )
    )


def conformal_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = C.residuals(_split(spark, sf_dir, "calib"), C.shape_phi(_split(spark, sf_dir, "train")))
    return rounded(res, "component_id", "parameter", "phi_168", "residual")


def conformal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_calibration(spark, sf_dir).bounds)


def _bounds(spark: SparkSession, sf_dir: str, alpha: float, n_min: int) -> DataFrame:
    cal = _calibration(spark, sf_dir, alpha)
    series = C.with_phi(C.trajectories(trajectory_rows(spark, sf_dir)), cal.phi)
    series = series.withColumn("point", F.col("v0") + (F.col("v24") - F.col("v0")) * F.col("phi_168"))
    out = C.conformal_bound(series, cal.bounds, "point", n_min)
    return rounded(
        out, "component_id", "parameter", "upper", "q_hat", "n_cal", "k", "mondrian_level", "mondrian_group",
        "attainable_alpha", "bound_code",
    )


def conformal_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, 0.10, N_MIN)


def conformal_bound_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller alpha and a larger minimum push the ladder to its coarser levels."""
    return _bounds(spark, sf_dir, 0.02, 50)


def calibration_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    calib = _split(spark, sf_dir, "calib")
    return rounded(C.calibration_capacity(calib, ("0", "1", "2", "3"), EVENT_TYPES, N_MIN, 0.10))


def calibration_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = _calibration(spark, sf_dir)
    return rounded(C.manifest(cal.phi, cal.bounds).drop("calibration_version"))


def _lots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, E.Calibration]:
    rows = trajectory_rows(spark, sf_dir).filter("elapsed_hours IN (0, 24)")
    pairs = E.readings(rows).select(*E.PART, "parameter", "v0", (F.col("v24") - F.col("v0")).alias("delta24"))
    return rows, pairs, _calibration(spark, sf_dir)


def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, cal = _lots(spark, sf_dir)
    return rounded(G.psi(pairs, cal.samples, G.LOT, G.GROUP, "delta24"))


def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, cal = _lots(spark, sf_dir)
    return rounded(G.ks(pairs, cal.samples, G.LOT, G.GROUP, "delta24"))


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, cal = _lots(spark, sf_dir)
    out = E.guard_table(rows, cal).withColumn("signals_fired", F.concat_ws(",", "signals_fired"))
    return rounded(
        out, "lot_id", "component_type", "parameter", "psi_v0", "psi_delta24", "centre_z", "ks_p", "mean_temperature",
        "signals_fired", "guarantee_status",
    )


def novel_testers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, cal = _lots(spark, sf_dir)
    return G.novel_testers(rows, cal.samples, cal.phi)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dealt = dealt_cohorts(spark, sf_dir)
    out = A.attribute(rows, source=cohort_view(spark, sf_dir), **dealt)
    return rounded(
        out.withColumn("setup_claims", F.concat_ws(",", "setup_claims")), "component_id", "lot_id", "parameter",
        "lot_n", "socket_n", "socket_offset_sigma", "z_socket", "socket_coherent_count", "zone_n",
        "zone_offset_sigma", "z_zone", "tester_n", "tester_offset_sigma", "z_tester", "setup_claims", "attribution",
        "attribution_code",
    )


def arrhenius_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration of each zone of a lot against its lot temperature, and field hours of the test."""
    lot, zone = E.temperatures(trajectory_rows(spark, sf_dir))
    both = zone.join(lot, "lot_id")
    ea = R.d(0.7)
    verdict = D.zone_consistency(F.col("zone_temp"), F.col("lot_temp"), ea, F.col("zone_temp") - F.col("lot_temp"))
    return rounded(
        both.select(
            "lot_id", "thermal_zone", "zone_temp", "lot_temp", verdict["af"].alias("af"),
            verdict["consistent"].alias("consistent"), verdict["refusal_code"].alias("refusal_code"),
            (D.field_hours(R.d(168.0), F.col("zone_temp"), R.d(55.0), ea) / 1000).alias("field_khours"),
        )
    )


def evidence_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectory_rows(spark, sf_dir)
    return E.evidence(rows, _calibration(spark, sf_dir), PROFILE)


EVIDENCE_COLUMNS = (
    "component_id", "lot_id", "parameter", "v0", "v24", "n", "median", "robust_sigma", "dpat_low", "dpat_high", "z",
    "dpat_verdict", "absolute_fail", "observed_margin_pct", "quality_score", "phi_168", "point", "upper",
    "mondrian_level", "guarantee_status", "band", "predicted_margin_pct", "slope_ratio", "safety_code", "attribution",
    "zone_consistent", "risk_index", "risk_code", "evidence_weak", "action", "severity",
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence_frame(spark, sf_dir), *EVIDENCE_COLUMNS)


def safety_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = _calibration(spark, sf_dir)
    series = C.with_phi(C.trajectories(trajectory_rows(spark, sf_dir)), cal.phi)
    series = series.withColumn("point", F.col("v0") + (F.col("v24") - F.col("v0")) * F.col("phi_168"))
    out = C.conformal_bound(series, cal.bounds, "point", N_MIN)
    s = D.safety(F.col("v0"), F.col("upper"), F.col("point"), F.col("v24"), R.d(TRAJECTORY_HIGH))
    return rounded(
        out.withColumn("s", s).select(
            "component_id", "parameter", "s.band", "s.headroom", "s.usable_margin", "s.safety_slope", "s.early_slope",
            "s.long_slope", "s.predicted_margin", "s.predicted_margin_pct", "s.slope_ratio", "s.safe_threshold",
            "s.refusal_code",
        )
    )


def evidence_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        E.worst_parameter(evidence_frame(spark, sf_dir), EVENT_TYPES), "component_id", "lot_id", "parameter",
        "severity", "band", "z", "dpat_verdict", "absolute_fail", "risk_index", "action",
    )


def drift_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = E.worst_parameter(evidence_frame(spark, sf_dir), EVENT_TYPES)
    return E.drift_queue(worst).select("component_id", "lot_id", "band", "band_rank", "parameter")


def pda_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.lot_rollup(E.worst_parameter(evidence_frame(spark, sf_dir), EVENT_TYPES)))


def _escape_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escapes(spark, *dealt_cohorts(spark, sf_dir))


def _escapes(spark: SparkSession, rows: DataFrame, dealt: dict[str, Any]) -> DataFrame:
    scored = H.dpat(rows, COHORT_KEYS, "value", "status", VIEW_K, **dealt)
    limits = E.ScreeningProfile(limits={p: (*v, None, 0.7) for p, v in COHORT_LIMITS.items()}).table(spark)
    out = scored.join(F.broadcast(limits.select("parameter", "low", "high")), "parameter", "left")
    x = F.col("value")
    fail = F.coalesce(x > F.col("high"), F.lit(False)) | F.coalesce(x < F.col("low"), F.lit(False))
    severity = F.when(fail, "ABSOLUTE_FAIL").when(F.col("z").isNull(), "NOMINAL").otherwise(R.severity(F.col("z")))
    return (
        out.withColumn("absolute_fail", fail)
        .withColumn("severity", severity)
        .withColumn("band", F.lit(None).cast("string"))
        .withColumn("risk_index", R.d(0.0))
        .withColumn("action", F.lit(None).cast("string"))
        .withColumn("dpat_verdict", F.col("verdict"))
    )


def escape_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings outside their lot's window although inside the absolute limits, worst first."""
    out = _escape_frame(spark, sf_dir).filter("verdict = 'FAIL' AND NOT absolute_fail")
    return rounded(
        out.orderBy(F.desc(F.abs("z")), "component_id", "parameter"), "component_id", "lot_id", "parameter", "value",
        "median", "robust_sigma", "z",
    )


def escape_spotlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first escape by lot and part."""
    out = _escape_frame(spark, sf_dir).filter("verdict = 'FAIL' AND NOT absolute_fail")
    return out.orderBy("lot_id", "component_id", "parameter").limit(1).select("lot_id", "component_id", "parameter")


def worst_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.worst_parameter(_escape_frame(spark, sf_dir), COHORT_PARAMETERS)
    return rounded(out, "component_id", "lot_id", "parameter", "severity", "z", "dpat_verdict", "absolute_fail")


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = E.worst_parameter(_escape_frame(spark, sf_dir), COHORT_PARAMETERS)
    return E.worklist(worst).select("component_id", "lot_id", "severity", "severity_rank", "parameter")


def lot_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lot_ranking(E.worst_parameter(_escape_frame(spark, sf_dir), COHORT_PARAMETERS))


def pda_rollup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = E.worst_parameter(_escape_frame(spark, sf_dir), COHORT_PARAMETERS)
    return rounded(E.lot_rollup(worst))


QUERIES = {
    "escape_list": escape_list,
    "escape_spotlight": escape_spotlight,
    "worst_parameter": worst_parameter,
    "worklist": worklist,
    "lot_ranking": lot_ranking,
    "pda_rollup_items": pda_rollup_items,
    "series_pivot": series_pivot,
    "shape_phi": shape_phi,
    "shape_points": shape_points,
    "forecast": forecast,
    "conformal_residuals": conformal_residuals,
    "conformal_ladder": conformal_ladder,
    "conformal_bound": conformal_bound,
    "conformal_bound_coarse": conformal_bound_coarse,
    "calibration_capacity": calibration_capacity,
    "calibration_manifest": calibration_manifest,
    "psi": psi,
    "ks_statistic": ks_statistic,
    "guard": guard,
    "novel_testers": novel_testers,
    "attribution": attribution,
    "arrhenius_zone": arrhenius_zone,
    "safety_band": safety_band,
    "evidence": evidence,
    "evidence_worst": evidence_worst,
    "drift_queue": drift_queue,
    "pda_rollup": pda_rollup,
}
