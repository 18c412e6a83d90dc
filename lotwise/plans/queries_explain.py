"""Registered queries over what is shown of the evidence: projections, narratives, payloads, audits, reports, posture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import formulas as T
from lotwise.functions.robust import round6
from lotwise.plans import evidence as E
from lotwise.plans import payload as P
from lotwise.plans.queries_drift import EVENT_TYPES, N_MIN, _calibration
from lotwise.plans.reports import rounded
from lotwise.plans.views import TRAJECTORY_HIGH, table, trajectory_rows
from lotwise.session import stage
from lotwise.streaming.jobs import new_base

# Native unit of each parameter; the last one can't be shown
UNITS = {"click": "uA", "error": "nA", "purchase": "mA", "signup": "ns", "view": "mV"}
PROFILE = E.ScreeningProfile(
    limits={p: (None, TRAJECTORY_HIGH, u, None, 0.7) for p, u in UNITS.items()}, n_min=N_MIN, not_thermal=("view",)
)


_STAGED: dict[tuple[str, str], DataFrame] = {}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence with joint distances, written once per application and folder; every view below reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        rows = trajectory_rows(spark, sf_dir)
        _STAGED[key] = stage(E.evidence(rows, _calibration(spark, sf_dir), PROFILE, joint=EVENT_TYPES))
    return _STAGED[key]


def anomaly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.anomaly_view(_evidence(spark, sf_dir), PROFILE))


def drift_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.drift_view(_evidence(spark, sf_dir), PROFILE))


def explanation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = P.explained(_evidence(spark, sf_dir).drop(*E.JOINT), PROFILE)
    out = P.explanation_view(told).drop("trigger")
    return rounded(out.withColumn("layers", F.concat_ws(",", "layers")))


def part_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.part_payload(P.explained(_evidence(spark, sf_dir).drop(*E.JOINT), PROFILE), EVENT_TYPES)
    return rounded(
        out.select(
            *E.PART, "worst.parameter", "worst.severity", "worst.band", "worst.action", "worst.risk_index", "worst.k_star",
            "worst.clearing_value", "n_blocks", "flagged", "narrative", F.concat_ws(",", "layers").alias("layers"),
        )
    )


def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each formula the whole evidence carries, and how many of them their formula reproduces."""
    ev = _evidence(spark, sf_dir)
    lots = E.lot_rollup(E.worst_parameter(ev, EVENT_TYPES))
    shape = ["formula_id", "value", "unit", "inputs", "parameters"]
    values = P.traced_values(ev, PROFILE).select(*shape).unionByName(P.traced_rollup(lots).select(*shape))
    return rounded(T.rederivation_rate(values, spark))


def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values some of which were altered, or carry another unit, after they had been computed."""
    values = P.traced_values(_evidence(spark, sf_dir).drop(*E.JOINT), PROFILE)
    part = F.col("component_id") % 97
    stored = values.withColumn("value", F.when(part == 5, F.col("value") + 0.5).otherwise(F.col("value"))).withColumn(
        "unit", F.when((part == 11) & (F.col("formula_id") == "dpat.z_v1"), "furlong").otherwise(F.col("unit"))
    )
    return rounded(T.rederivation_failures(stored, spark), "component_id", "parameter", "formula_id", "value", "recomputed", "error")


def _report_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ev = _evidence(spark, sf_dir)
    # Three of the tables hold worst blocks, and each is sampled before it is written in ranges.
    worst = stage(E.worst_parameter(ev, EVENT_TYPES))
    used = P.appendix(P.used_formulas(ev.drop(*E.JOINT), PROFILE, ["lot_id"]), spark, ["lot_id"])
    decided = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("component_id"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("reason"),
        F.col("o_custkey").cast("string").alias("actor"), F.col("o_orderdate").alias("created_at"),
    )
    decided = worst.select("component_id", "lot_id").join(decided, "component_id")
    return P.lot_report(worst, used, decided)


def lot_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report tables of all lots written and read back: rows of each table beside the lot's disposition."""
    base = new_base(spark)
    P.write_report(_report_tables(spark, sf_dir), f"{base}/report")
    read = {name: spark.read.parquet(f"{base}/report/{name}") for name in P.REPORT_ORDER}
    out = read["disposition"]
    for name in ("queue", "appendix", "dispositions"):
        out = out.join(read[name].groupBy("lot_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "lot_id", "left")
    return out.select(
        "lot_id", "n_tested", "n_reject", round6(F.col("pda_pct")).alias("pda_pct"), "lot_verdict", "pda_limit_pct", "n_queue", "n_appendix",
        F.coalesce("n_dispositions", F.lit(0)).alias("n_dispositions"),
    )


def risk_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.risk_posture(PROFILE, _calibration(spark, sf_dir), spark))


QUERIES = {
    "anomaly_view": anomaly_view,
    "drift_view": drift_view,
    "explanation_view": explanation_view,
    "part_payload": part_payload,
    "evidence_audit": evidence_audit,
    "audit_failures": audit_failures,
    "lot_reports": lot_reports,
    "risk_posture": risk_posture,
}
