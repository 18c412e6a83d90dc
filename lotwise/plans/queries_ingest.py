"""Registered queries over uploads: validation, findings, summaries, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import ingest as I
from lotwise.operators import series as S
from lotwise.plans.reports import rounded
from lotwise.plans.views import UPLOAD_LIMITS, upload_view
from lotwise.session import stage

PROFILE = I.Profile(limits=UPLOAD_LIMITS, parameters=tuple(UPLOAD_LIMITS))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate(upload_view(spark, sf_dir), PROFILE)


def ingest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("source_row", "finding_code", "finding_column", "censored")


def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        I.accepted(_validated(spark, sf_dir)), "source_row", "component_id", "lot_id", "component_type", "parameter",
        "elapsed_hours", "value", "unit", "status",
    )


def ingest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.findings(stage(I.occurrences(stage(_validated(spark, sf_dir).select(*I.OCCURRING)), PROFILE)))
    return found.select(
        "code", "severity", "count", "column",
        F.concat_ws(",", F.col("sample_rows").cast("array<string>")).alias("sample_rows"),
        F.concat_ws(",", "affected_lots").alias("affected_lots"),
    )


def rejection_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rejection_classes(_validated(spark, sf_dir))


def ingest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.grid_quality(_validated(spark, sf_dir), PROFILE)
    return rounded(
        out, "component_id", "lot_id", "parameter", "n_missing", "n_impossible", "n_censored", "n_valid",
        "n_flatline", "score",
    )


def lot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(_validated(spark, sf_dir))
    out = I.lot_summary(rows, stage(I.occurrences(rows, PROFILE)), I.grid_quality(rows, PROFILE))
    return rounded(out.withColumn("finding_codes", F.concat_ws(",", "finding_codes")))


def dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over lots of the lot means."""
    quality = I.grid_quality(_validated(spark, sf_dir), PROFILE)
    lots = S.quality_rollup(quality, ["lot_id"])
    return rounded(S.quality_rollup(lots.select("quality_score"), [], "quality_score"))


def validate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw upload checked as if it had been stored, against the number of rows validation accepts."""
    raw = I.structural_checks(upload_view(spark, sf_dir), PROFILE, spark)
    accepted_rows = I.accepted(_validated(spark, sf_dir)).count()
    return I.validate_store(raw, accepted_rows, F.col("data_provenance") != "SYNTHETIC")


def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest per lot over the fields whose text is the same in every engine."""
    rows = I.accepted(_validated(spark, sf_dir))
    text = F.sha2(F.concat_ws("|", "component_id", "lot_id", "component_type", "parameter", F.col("elapsed_hours").cast("string"), F.round(F.col("value") * 100).cast("long").cast("string"), "unit", "status"), 256)
    return I.dataset_digest(rows, ["lot_id"], text)


QUERIES = {
    "ingest_verdicts": ingest_verdicts,
    "ingest_accepted": ingest_accepted,
    "ingest_findings": ingest_findings,
    "rejection_classes": rejection_classes,
    "ingest_quality": ingest_quality,
    "lot_summary": lot_summary,
    "dataset_quality": dataset_quality,
    "validate_store": validate_store,
    "dataset_digest": dataset_digest,
}
