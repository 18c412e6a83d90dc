"""Registered queries over lots: robust statistics, DPAT, histograms, worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import cohort as C
from lotwise.plans.reports import rounded
from lotwise.plans.views import COHORT_KEYS, cohort_view, dealt_cohorts, small_view

# Fixed value: six sigma flags nothing on the uniform test columns
VIEW_K = 1.2


def robust_stats_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dealt = dealt_cohorts(spark, sf_dir)
    stats = C.lot_statistics(rows, COHORT_KEYS, "value", "status", **dealt)
    return rounded(
        stats, "lot_id", "parameter", "n", "q1", "median", "q3", "iqr", "mad", "robust_sigma", "estimator",
        "reduced_power", "refusal_code", "tukey_mild_low", "tukey_mild_high", "tukey_extreme_low",
        "tukey_extreme_high",
    )


def robust_ladder_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.lot_statistics(small_view(spark, sf_dir), ["lot_id"], "value")
    return rounded(
        stats, "lot_id", "n", "q1", "median", "q3", "iqr", "mad", "c_n", "robust_sigma", "estimator",
        "reduced_power", "zero_iqr", "refusal_code",
    )


def dpat_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dealt = dealt_cohorts(spark, sf_dir)
    out = C.dpat(rows, COHORT_KEYS, "value", "status", VIEW_K, **dealt)
    return rounded(
        out, "component_id", "lot_id", "parameter", "value", "n", "q1", "median", "q3", "robust_sigma",
        "limit_low", "limit_high", "z", "verdict", "refusal_code",
    )


def dpat_loo_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.dpat(small_view(spark, sf_dir), ["lot_id"], "value", None, VIEW_K)
    return rounded(
        out, "component_id", "lot_id", "value", "n", "median", "mad", "robust_sigma", "z", "verdict",
        "refusal_code",
    )


def lot_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cohort_view(spark, sf_dir).filter("status = 'OK'")
    return rounded(C.histogram(members, ["lot_id", "parameter"], "value"))


def member_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dealt = dealt_cohorts(spark, sf_dir)
    view = rows.filter("status = 'OK'")
    stats = C.lot_statistics(view, COHORT_KEYS, "value", **dealt)
    out = C.whole_cohort_z(view, stats, COHORT_KEYS, "value", VIEW_K, **dealt)
    return rounded(out.filter("robust_sigma > 0"), "component_id", "lot_id", "parameter", "value", "z", "flagged")


QUERIES = {
    "robust_stats_lot": robust_stats_lot,
    "robust_ladder_small": robust_ladder_small,
    "dpat_loo": dpat_loo,
    "dpat_loo_small": dpat_loo_small,
    "lot_histogram": lot_histogram,
    "member_z": member_z,
}
