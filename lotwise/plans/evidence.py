"""Full screening evidence for every (part, parameter) of every lot, and its roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import drift as D
from lotwise.functions import robust as R
from lotwise.operators import attribute as A
from lotwise.operators import calibrate as C
from lotwise.operators import guard as G
from lotwise.operators import multivariate as M
from lotwise.operators import series as S
from lotwise.operators.ordered import checked_broadcast, group_sizes, lookup_join
from lotwise.session import stage

PART = ["component_id", "lot_id", "component_type"]
SETUP = ["socket_id", "thermal_zone", "tester_id"]


@dataclass(frozen=True)
class ScreeningProfile:
    """Decision policy: limits as parameter -> (low, high, unit, delta_max, ea_ev)."""

    limits: dict[str, tuple]
    k: float = K.DPAT_K
    alpha: float = K.ALPHA
    margin_fraction: float = K.MARGIN_FRACTION
    horizon: float = K.HORIZON_H
    n_min: int = K.MONDRIAN_MIN
    pda_limit: float = K.PDA_LIMIT
    weights: dict[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    not_thermal: tuple[str, ...] = ("vth_shift",)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(p, *v) for p, v in self.limits.items()],
            "parameter string, low double, high double, unit string, delta_max double, ea_ev double",
        )


@dataclass(frozen=True)
class Calibration:
    """Shape per group, conformal table and guard reference; all derived from train and calibration lots."""

    phi: DataFrame
    bounds: DataFrame
    samples: DataFrame

    @staticmethod
    def fit(train_rows: DataFrame, calib_rows: DataFrame, alpha: float = K.ALPHA, limit: int | None = None) -> Calibration:
        train = stage(C.complete(C.trajectories(train_rows)))
        calib = stage(C.complete(C.trajectories(calib_rows)))
        phi = stage(C.shape_phi(train, limit=limit))
        return Calibration(
            phi=phi,
            bounds=stage(C.conformal_table(C.residuals(calib, phi), alpha, limit)),
            samples=stage(C.guard_samples(calib, phi, limit)),
        )


def readings(rows: DataFrame) -> DataFrame:
    """One row per (part, parameter) with its 0 h and 24 h value, status and temperature.

    A part read at several sockets or testers stays one row; its setup is that of its first reading.
    """
    aggs: list[Column] = [F.min_by(name, "source_row").alias(name) for name in SETUP]
    for hour in (0, 24):
        here = F.when(F.col("elapsed_hours") == hour, F.col("source_row"))
        for name, source in (("v", "value"), ("status", "status"), ("temp", "temperature_c"), ("row", "source_row")):
            aggs.append(F.min_by(source, here).alias(f"{name}{hour}"))
    return rows.filter(F.col("elapsed_hours").isin(0, 24)).groupBy(*PART, "parameter").agg(*aggs)


def temperatures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean temperature of each lot and of each (lot, zone)."""
    t = rows.filter(F.col("elapsed_hours").isin(0, 24) & F.col("temperature_c").isNotNull())
    lot = t.groupBy("lot_id").agg(F.avg("temperature_c").alias("lot_temp"))
    zone = t.filter("thermal_zone IS NOT NULL").groupBy("lot_id", "thermal_zone").agg(F.avg("temperature_c").alias("zone_temp"))
    return lot, zone


def absolute_check(parts: DataFrame) -> DataFrame:
    """Limit check at every available read-point, and the observed margin fraction."""

    def beyond(v: Column) -> Column:
        return F.coalesce(v > F.col("high"), F.lit(False)) | F.coalesce(v < F.col("low"), F.lit(False))

    v0, v24, high = F.col("v0"), F.col("v24"), F.col("high")
    headroom = high - F.coalesce(v0, v24)
    return (
        parts.withColumn("absolute_fail", beyond(v0) | beyond(v24))
        .withColumn("observed_margin", high - v24)
        .withColumn("observed_margin_pct", (high - v24) / F.nullif(headroom, R.d(0.0)))
    )


def pair_quality() -> Column:
    """Quality of the two-point series (v0, v24) within the limits."""
    v0, v24 = F.col("v0"), F.col("v24")

    def outside(v: Column) -> Column:
        return F.coalesce((v < F.col("low")) | (v > F.col("high")), F.coalesce(v > F.col("high"), v < F.col("low"), F.lit(False)))

    def count(c: Column) -> Column:
        return c.cast("int")

    out0, out24 = outside(v0), outside(v24)
    n_missing = count(v0.isNull()) + count(v24.isNull())
    n_out = count(out0) + count(out24)
    valid = F.lit(2) - n_missing - n_out
    flat = count(F.coalesce((valid == 2) & (v0 == v24), F.lit(False)))
    return S.quality_score(
        {"MISSING_OBSERVATION": n_missing, "IMPOSSIBLE_VALUE": n_out, "CENSORED_READING": F.col("n_censored"), "FLATLINE": flat},
        valid,
    )


def guard_table(rows: DataFrame, calibration: Calibration, limit: int | None = None) -> DataFrame:
    """Exchangeability of every (lot, type, parameter) from its OK readings."""
    ok = rows.filter((F.col("status") == "OK") & F.col("elapsed_hours").isin(0, 24))
    pairs = stage(readings(ok).select(*PART, "parameter", "v0", (F.col("v24") - F.col("v0")).alias("delta24")))
    heat = ok.select("lot_id", "component_type", "parameter", "temperature_c")
    return G.exchangeability(pairs, heat, calibration.samples, calibration.phi, limit)


JOINT = ["d2", "p_value", "joint_n", "joint_code", "top_parameter", "top_share", "parameter_share", "joint_adds_up"]


def joint_evidence(parts: DataFrame, parameters: Sequence[str], limit: int | None = None) -> DataFrame:
    """Robust joint distance of each part's complete OK 24 h vector from the others of its lot and type.

    One row per (part, parameter): the distance, the parameter that contributes most, and this parameter's share. Parts
    that lack a parameter have no row; refused fits have a code only.
    """
    ok = parts.filter(F.col("status24") == "OK").select(*PART, "parameter", F.col("v24").alias("value"))
    wide = M.complete_vectors(ok, PART, parameters)
    out = M.top_contributions(M.robust(wide, ["lot_id", "component_type"], list(parameters), "exact", limit), list(parameters))

    def of_total(contribution: Column) -> Column:
        return F.when(F.col("d2") > 0, contribution / F.col("d2")).otherwise(R.d(0.0))

    share = {p: of_total(F.col(f"c_{p}")) for p in parameters}
    blocks = F.array(*[F.struct(F.lit(p).alias("parameter"), share[p].alias("parameter_share")) for p in parameters])
    sound = F.col("joint_code").isNull()
    return (
        out.withColumn("joint_code", F.col("refusal_code"))
        .withColumn("_b", F.explode(blocks))
        .select(
            *PART, "_b.parameter", F.when(sound, F.col("d2")).alias("d2"), F.when(sound, F.col("p_value")).alias("p_value"),
            F.col("n").alias("joint_n"), "joint_code", F.when(sound, F.col("top")[0]["parameter"]).alias("top_parameter"),
            F.when(sound, of_total(F.col("top")[0]["contribution"])).alias("top_share"),
            F.when(sound, F.col("_b.parameter_share")).alias("parameter_share"), F.when(sound, F.col("adds_up")).alias("joint_adds_up"),
        )
    )


def evidence(
    rows: DataFrame,
    calibration: Calibration,
    profile: ScreeningProfile,
    limit: int | None = None,
    joint: Sequence[str] = (),
) -> DataFrame:
    """Evidence of every (part, parameter): statistics, bound, guard, attribution, risk and recommendation.

    ``rows`` are validated measurements with source_row. Filter the result to see one part; filter ``rows`` by lot
    to keep whole lots out of the job. With the names of the parameters in ``joint``, the joint distance is part of the
    evidence, and a part whose contributions do not add up to it is not attributed.
    """
    spark = rows.sparkSession
    parts = readings(rows)
    for name in ("v0", "v24"):
        parts = parts.withColumn(name, F.when(R.finite(F.col(name)), F.col(name)))
    censored = [F.coalesce(F.col(s).isin("BELOW_LOD", "OVERRANGE"), F.lit(False)).cast("int") for s in ("status0", "status24")]
    # Every cohort below reads the parts, so they are written once.
    parts = stage(parts.withColumn("n_censored", censored[0] + censored[1]))
    # The 24 h reading is what cohorts compare.
    scored = A.attribute(
        parts.withColumn("value", F.col("v24")).withColumn("status", F.col("status24")).withColumn("elapsed_hours", F.lit(24)),
        limit,
    )
    scored = scored.withColumn("attribution", F.when(F.col("v24").isNull(), "INDETERMINATE").otherwise(F.col("attribution")))
    if joint:
        # Complete vectors are as many as parts: both sides are hashed by part and parameter.
        scored = scored.join(stage(joint_evidence(parts, joint, limit)), [*PART, "parameter"], "left")
        split = ~F.coalesce("joint_adds_up", F.lit(True))
        scored = scored.withColumn("attribution", F.when(split, "INDETERMINATE").otherwise(F.col("attribution")))
    out = scored.join(F.broadcast(profile.table(spark)), "parameter", "left")
    code, med, sigma = F.col("lot_refusal_code"), F.col("lot_median"), F.col("lot_robust_sigma")
    window = code.isNull()
    out = (
        out.withColumn("dpat_low", F.when(window, med - R.d(profile.k) * sigma))
        .withColumn("dpat_high", F.when(window, med + R.d(profile.k) * sigma))
        .withColumn("z", F.when(F.coalesce(code, F.lit("")) != "INSUFFICIENT_COHORT", R.dpat_z(F.col("v24"), med, sigma)))
        .withColumn("dpat_verdict", R.dpat_verdict(F.col("v24"), code, med, sigma, R.d(profile.k)))
    )
    out = absolute_check(out).withColumn("quality_score", pair_quality())
    out = out.join(checked_broadcast(calibration.phi.select(*C.GROUP, "phi_168", F.col("n_used").alias("phi_n_used"))), C.GROUP, "left")
    out = out.withColumn("_f", D.forecast(F.col("v0"), F.col("v24"), F.col("phi_168"), status24=F.col("status24")))
    out = out.withColumn("point", F.col("_f.point")).withColumn("baseline_linear", F.col("_f.baseline_linear")).withColumn(
        "forecast_code", F.col("_f.refusal_code")
    )
    out = C.conformal_bound(out, calibration.bounds, "point", profile.n_min)
    out = out.withColumn(
        "_s",
        D.safety(
            F.col("v0"), F.col("upper"), F.col("point"), F.col("v24"), F.col("high"), profile.margin_fraction,
            profile.horizon, F.col("delta_max"),
        ),
    )
    guard = guard_table(rows, calibration, limit).select(
        "lot_id", "component_type", "parameter", "max_psi", F.col("signals_fired").alias("lot_signals"),
    )
    lot_keys = ["lot_id", "component_type", "parameter"]
    out = lookup_join(out, stage(guard), lot_keys, group_sizes(parts, lot_keys), limit=limit)
    novel = G.novel_testers(parts, calibration.samples, calibration.phi).withColumn("_novel", F.lit(True))
    testers = ["component_type", "parameter", "tester_id"]
    out = lookup_join(out, stage(novel), testers, group_sizes(parts, testers), limit=limit)
    signals = F.concat(
        F.coalesce("lot_signals", F.array().cast("array<string>")),
        F.when(F.col("_novel"), F.array(F.lit("tester_novelty"))).otherwise(F.array().cast("array<string>")),
    )
    out = out.withColumn("signals_fired", signals).withColumn(
        "guarantee_status", G.guarantee(F.size("signals_fired") > 0, F.col("max_psi"))
    )
    lot_temp, zone_temp = temperatures(rows)
    zones = ["lot_id", "thermal_zone"]
    out = lookup_join(out, lot_temp, ["lot_id"], group_sizes(parts, ["lot_id"]), limit=limit)
    out = lookup_join(out, zone_temp, zones, group_sizes(parts, zones), limit=limit)
    zone_c = F.when(F.col("thermal_zone").isNull(), F.col("lot_temp")).otherwise(F.col("zone_temp"))
    consistent = D.zone_consistency(zone_c, F.col("lot_temp"), F.col("ea_ev"), F.col("zone_offset_sigma"))
    thermal = ~F.col("parameter").isin(*profile.not_thermal) & F.col("v24").isNotNull()
    out = out.withColumn("zone_consistent", thermal & F.coalesce(consistent["consistent"], F.lit(False)))
    out = out.withColumn(
        "_r",
        D.risk(
            F.col("z"), F.col("_s.slope_ratio"), F.col("_s.predicted_margin_pct"), F.col("quality_score"),
            F.col("attribution"), F.col("zone_consistent"), F.col("_s.refusal_code"), profile.weights,
        ),
    )
    weak = (
        F.col("lot_reduced_power")
        | (F.col("n_censored") > 0)
        | (F.col("quality_score") < 0.5)
        | (F.col("mondrian_level") > 0)
        | (F.col("guarantee_status") != "VALID")
    )
    out = out.withColumn("evidence_weak", weak).withColumn(
        "_a",
        D.recommend(
            F.col("_s.band"), F.col("absolute_fail"), F.col("z"), F.col("attribution"), F.col("observed_margin_pct"),
            F.col("evidence_weak"), F.col("zone_consistent"),
        ),
    )
    severity = F.when(F.col("absolute_fail"), "ABSOLUTE_FAIL").otherwise(F.coalesce(F.col("_a.severity"), F.lit("NOMINAL")))
    return out.select(
        *PART, "parameter", *SETUP, "v0", "v24", "status24", F.col("unit"), F.col("low"), F.col("high"),
        F.col("lot_n").alias("n"), F.col("lot_q1").alias("q1"), med.alias("median"), F.col("lot_q3").alias("q3"),
        F.col("lot_mad").alias("mad"), sigma.alias("robust_sigma"), F.col("lot_estimator").alias("estimator"),
        F.col("lot_reduced_power").alias("reduced_power"), "dpat_low", "dpat_high", "z", "dpat_verdict",
        "absolute_fail", "observed_margin", "observed_margin_pct", "quality_score", "n_censored",
        F.col("row24").alias("source_row"), "delta_max", "phi_168", "phi_n_used", "point", "baseline_linear", "upper", "q_hat", "n_cal",
        F.col("k").alias("conformal_k"), "mondrian_level", "mondrian_group",
        "guarantee_status", "signals_fired", "max_psi",
        F.col("_s.band").alias("band"), F.col("_s.headroom").alias("headroom"),
        F.col("_s.usable_margin").alias("usable_margin"), F.col("_s.safety_slope").alias("safety_slope"),
        F.col("_s.early_slope").alias("early_slope"), F.col("_s.long_slope").alias("long_slope"),
        F.col("_s.predicted_margin").alias("predicted_margin"),
        F.col("_s.predicted_margin_pct").alias("predicted_margin_pct"), F.col("_s.slope_ratio").alias("slope_ratio"),
        F.col("_s.refusal_code").alias("safety_code"),
        "attribution", "socket_offset_sigma", "zone_offset_sigma", "tester_offset_sigma", "socket_coherent_count",
        "zone_consistent",
        F.col("_r.anomaly").alias("risk_anomaly"), F.col("_r.drift").alias("risk_drift"),
        F.col("_r.margin").alias("risk_margin"), F.col("_r.quality").alias("risk_quality"),
        F.col("_r.credit").alias("risk_credit"), F.col("_r.risk_index").alias("risk_index"),
        F.col("_r.refusal_code").alias("risk_code"), "evidence_weak",
        F.col("_a.action").alias("action"), F.col("_a.trigger").alias("trigger"), severity.alias("severity"),
        *(JOINT if joint else []),
    )


def severity_order(order: tuple[str, ...]) -> Column:
    """Sort key of one parameter's evidence: severity, band, |z|, then the fixed parameter order."""
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("parameter") == name, i).otherwise(place)
    return F.struct(
        R.ranked(F.col("severity"), K.SEVERITY_RANK).alias("severity_rank"),
        R.ranked(F.col("band"), K.BAND_RANK).alias("band_rank"),
        F.coalesce(F.abs("z"), R.d(-1.0)).alias("abs_z"),
        (-place).alias("place"),
    )


def parts_payload(ev: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row per part: the worst parameter and the blocks of all parameters (a closed set of names)."""
    block = F.struct(
        "parameter", "severity", "band", "z", "dpat_verdict", "absolute_fail", "risk_index", "attribution", "action",
        "upper", "guarantee_status", "quality_score",
    )
    return ev.groupBy(*PART).agg(
        F.max_by(block, severity_order(order)).alias("worst"),
        F.array_sort(F.collect_list(block)).alias("blocks"),
        F.max((F.col("dpat_verdict") == "FAIL") | F.col("absolute_fail")).alias("flagged"),
    )


def worst_parameter(ev: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The worst block of each part, chosen while combining before the shuffle."""
    block = F.struct("parameter", "severity", "band", "z", "dpat_verdict", "absolute_fail", "risk_index", "action")
    out = ev.groupBy(*PART).agg(F.max_by(block, severity_order(order)).alias("worst"))
    return out.select(*PART, F.col("worst.*"))


def worklist(worst: DataFrame) -> DataFrame:
    """Parts of all lots, most severe first; a range-partitioned sort."""
    rank = R.ranked(F.col("severity"), K.SEVERITY_RANK)
    return worst.withColumn("severity_rank", rank).orderBy(F.desc("severity_rank"), "component_id")


def refuse_small_lots(worst: DataFrame, least: int = K.MIN_COHORT, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(worst blocks of lots with enough parts to screen, refused lots with their number of parts).

    Blocks dealt ``by`` lot are counted where they are; others are computed once more for the counts of their lots.
    """
    sizes = worst.groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_parts"))
    small = sizes.filter(F.col("n_parts") < least).withColumn("refusal_code", F.lit("INSUFFICIENT_COHORT"))
    if by:
        counted = worst.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy("lot_id")))
        return counted.filter((F.col("_parts") >= least) | F.col("lot_id").isNull()).drop("_parts"), small
    return worst.join(small.select("lot_id"), "lot_id", "left_anti"), small


def drift_queue(worst: DataFrame) -> DataFrame:
    rank = R.ranked(F.col("band"), K.BAND_RANK)
    return worst.withColumn("band_rank", rank).orderBy(F.desc("band_rank"), "component_id")


def lot_rollup(worst: DataFrame, pda_limit: float = K.PDA_LIMIT) -> DataFrame:
    """Reject percentage and verdict of each lot from the worst block of its parts."""
    failed = F.coalesce(F.col("absolute_fail"), F.lit(False))
    band = F.col("band")
    known = band.isNull() | band.isin(*K.BAND_RANK)
    out = worst.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(failed | (band == "REJECT")).alias("n_reject"),
        F.count_if(~failed & (band == "EARLY_WARNING")).alias("n_early_warning"),
        F.count_if(~failed & band.isNull()).alias("n_excluded"),
        F.min(known | failed).alias("_known"),
    )
    tested = F.col("_n") - F.col("n_excluded")
    out = out.withColumn("n_tested", tested)
    code = F.when(~F.col("_known"), "INVALID_INPUT").when(F.col("n_tested") <= 0, "INSUFFICIENT_DATA")
    n = F.nullif(F.col("n_tested"), F.lit(0))
    pda = R.d(K.PERCENT) * F.col("n_reject") / n
    both = R.d(K.PERCENT) * (F.col("n_reject") + F.col("n_early_warning")) / n
    verdict = F.when(pda > pda_limit, "FAIL_LOT").when(pda > K.PDA_REVIEW * pda_limit, "REVIEW").otherwise("PASS_LOT")
    return out.select(
        "lot_id", "n_tested", "n_reject", "n_early_warning", "n_excluded",
        F.when(code.isNull(), pda).alias("pda_pct"),
        F.when(code.isNull(), both).alias("pda_pct_with_early_warning"),
        F.when(code.isNull(), verdict).alias("lot_verdict"),
        code.alias("refusal_code"),
    )


def lot_ranking(worst: DataFrame) -> DataFrame:
    """Programme totals per lot, most flagged first."""
    flagged = (F.col("dpat_verdict") == "FAIL") | F.col("absolute_fail")
    return (
        worst.groupBy("lot_id")
        .agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(flagged).alias("n_flagged"))
        .orderBy(F.desc("n_flagged"), "lot_id")
    )
