"""Registered queries over ordered series and skewed samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import cohort as C
from lotwise.operators import series as S
from lotwise.operators import skewness as M
from lotwise.operators.ordered import lookup_join
from lotwise.plans.reports import rounded
from lotwise.plans.views import COHORT_KEYS, SERIES_KEYS, cohort_view, series_view, small_view

# Plausible range of the event values in the quality queries
LOW, HIGH = 0.05, 400.0


def scaled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event series with the median and robust sigma of their event type."""
    rows = series_view(spark, sf_dir)
    stats = C.lot_statistics(rows, ["parameter"], "value").select("parameter", "median", "robust_sigma")
    return lookup_join(rows, stats, ["parameter"])


def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_series(spark, sf_dir)
    return rounded(S.cusum(rows, SERIES_KEYS, ["t", "seq"], "value", "median", "robust_sigma"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_series(spark, sf_dir).withColumn("gate", F.col("robust_sigma") / 16)
    return S.series_quality(
        rows, SERIES_KEYS, ["seq"], "value", time="t", scale="gate", low=F.lit(LOW), high=F.lit(HIGH)
    )


def series_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_quality(spark, sf_dir).drop("findings"))


def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.quality_rollup(_quality(spark, sf_dir), ["parameter"]))


def medcouple_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.medcouple(small_view(spark, sf_dir), ["lot_id"], "value"))


def medcouple_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.medcouple_leave_one_out(small_view(spark, sf_dir), ["lot_id"], "value")
    return rounded(out, "component_id", "lot_id", "medcouple", "medcouple_mode")


def adjusted_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = C.cohort_members(cohort_view(spark, sf_dir), COHORT_KEYS, "value", "status")
    stats = C.lot_statistics(members, COHORT_KEYS, "value")
    mc = M.medcouple(members, COHORT_KEYS, "value").drop("n")
    out = M.adjusted_boxplot(stats.join(mc, COHORT_KEYS))
    return rounded(out, "lot_id", "parameter", "n", "medcouple", "boxplot_low", "boxplot_high")


QUERIES = {
    "cusum": cusum,
    "series_quality": series_quality,
    "quality_rollup": quality_rollup,
    "medcouple_lot": medcouple_lot,
    "medcouple_loo": medcouple_loo,
    "adjusted_boxplot": adjusted_boxplot,
}
