"""Column builders for the drift shape, forecast, safety band, risk index and recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions.robust import d, finite

FAMILIES = ("power_law", "log_time", "saturating", "linear", "empirical")


def null_double() -> Column:
    return F.lit(None).cast("double")


def _finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def phi_at(t: Column, family: Column | str, phi_168: Column | None = None, param: Column | None = None) -> Column:
    """Normalised shape at ``t`` hours: 0 at 0 h, exactly 1 at 24 h; NULL where the family's parameter is unusable."""
    family = F.lit(family) if isinstance(family, str) else family
    phi = phi_168 if phi_168 is not None else null_double()
    par = param if param is not None else null_double()
    span = d(K.EARLY_H)
    power = F.when(par.isNotNull(), F.when(finite(par) & (par > 0), par)).when(
        finite(phi) & (phi > 0), F.ln(phi) / F.ln(d(K.LINEAR_PHI))
    )
    anchored = (t == d(K.HORIZON_H)) & par.isNull() & finite(phi) & (phi > 0)
    curve = F.when(anchored, phi).otherwise(F.pow(t / span, power))
    tau = F.when(finite(par) & (par > 0), par)
    value = (
        F.when(family == "linear", t / span)
        .when(family.isin("power_law", "empirical"), curve)
        .when(family == "log_time", F.ln(1 + t / tau) / F.ln(1 + span / tau))
        .when(family == "saturating", (1 - F.exp(-t / tau)) / F.nullif(1 - F.exp(-span / tau), d(0.0)))
    )
    return F.when(~finite(t) | (t < 0), None).when(t == 0, d(0.0)).when(t == span, d(1.0)).otherwise(_finite_or_null(value))


def forecast(
    v0: Column,
    v24: Column,
    phi: Column,
    correction: Column | None = None,
    shape_mae: Column | None = None,
    residual_mae: Column | None = None,
    spread: Column | None = None,
    status24: Column | None = None,
) -> Column:
    """struct(point, shape_point, baseline_linear, amplitude, residual_applied, censored, refusal_code).

    A residual correction is adopted when its error plus the seed spread is below the shape's error; without the
    errors it is applied as given.
    """
    extra = F.coalesce(correction, d(0.0)) if correction is not None else d(0.0)
    bad_input = (v0.isNotNull() & ~finite(v0)) | (v24.isNotNull() & ~finite(v24))
    code = (
        F.when(bad_input, "INVALID_INPUT")
        .when(v0.isNull() | v24.isNull(), "INSUFFICIENT_DATA")
        .when(phi.isNull() | ~finite(phi) | ~finite(extra), "INVALID_INPUT")
    )
    if shape_mae is not None or residual_mae is not None:
        a = shape_mae if shape_mae is not None else null_double()
        b = residual_mae if residual_mae is not None else null_double()
        gap = F.coalesce(spread, d(0.0)) if spread is not None else d(0.0)
        sane = finite(a) & finite(b) & finite(gap) & (a >= 0) & (b >= 0) & (gap >= 0)
        code = F.coalesce(code, F.when(a.isNull() & b.isNull(), None).when(~F.coalesce(sane, F.lit(False)), "INVALID_INPUT"))
        applied = F.when(a.isNull() & b.isNull(), extra != 0).otherwise((b + gap < a) & (extra != 0))
    else:
        applied = extra != 0
    amplitude = v24 - v0
    shape_point = v0 + amplitude * phi
    ok = code.isNull()
    censored = status24.isin("BELOW_LOD", "OVERRANGE") if status24 is not None else F.lit(False)
    return F.struct(
        F.when(ok, F.when(applied, shape_point + extra).otherwise(shape_point)).alias("point"),
        F.when(ok, shape_point).alias("shape_point"),
        F.when(ok, v0 + amplitude * d(K.LINEAR_PHI)).alias("baseline_linear"),
        F.when(ok, amplitude).alias("amplitude"),
        F.when(ok, F.when(applied, extra).otherwise(d(0.0))).alias("residual_correction"),
        (ok & applied).alias("residual_applied"),
        F.coalesce(censored, F.lit(False)).alias("censored"),
        code.alias("refusal_code"),
    )


def safety(
    v0: Column,
    upper: Column,
    point: Column,
    v24: Column,
    high: Column,
    margin_fraction: float = K.MARGIN_FRACTION,
    horizon: float = K.HORIZON_H,
    delta_max: Column | None = None,
) -> Column:
    """struct of every safety quantity and the band; the order of the operations decides exact edges."""
    headroom = high - v0
    usable = headroom * (d(1.0) - d(margin_fraction))
    slope = headroom * (d(1.0) - d(margin_fraction)) / d(horizon)
    bad_delta = F.lit(False)
    if delta_max is not None:
        slope = F.when(delta_max.isNotNull(), delta_max / d(horizon)).otherwise(slope)
        bad_delta = delta_max.isNotNull() & (~finite(delta_max) | (delta_max <= 0))
    code = (
        F.when(upper.isNull(), "INSUFFICIENT_CALIBRATION")
        .when(v0.isNull(), "INSUFFICIENT_DATA")
        .when(~finite(v0) | ~finite(upper) | ~finite(point) | ~finite(high), "INVALID_INPUT")
        .when((headroom <= 0) | bad_delta, "INVALID_INPUT")
        .when(~finite(slope) | (slope <= 0), "INVALID_INPUT")
    )
    ok = code.isNull()
    threshold = high - usable
    long_slope = (point - v0) / d(horizon)
    ratio = long_slope / slope
    margin = high - upper
    band = (
        F.when(upper >= high, "REJECT")
        .when(ratio >= d(K.RATIO_EARLY_WARNING), "EARLY_WARNING")
        .when((ratio >= d(K.RATIO_WATCH)) | (upper >= threshold), "WATCH")
        .otherwise("SAFE")
    )
    return F.struct(
        F.when(ok, band).alias("band"),
        F.when(ok, headroom).alias("headroom"),
        F.when(ok, usable).alias("usable_margin"),
        F.when(ok, slope).alias("safety_slope"),
        F.when(ok & finite(v24), (v24 - v0) / d(K.EARLY_H)).alias("early_slope"),
        F.when(ok, long_slope).alias("long_slope"),
        F.when(ok, margin).alias("predicted_margin"),
        F.when(ok, margin / headroom).alias("predicted_margin_pct"),
        F.when(ok, ratio).alias("slope_ratio"),
        F.when(ok, threshold).alias("safe_threshold"),
        code.alias("refusal_code"),
    )


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, d(0.0)), d(1.0))


def credit(attribution: Column, zone_consistent: Column) -> Column:
    return (
        F.when(attribution.isin("SOCKET", "TESTER"), d(1.0))
        .when((attribution == "ZONE") & zone_consistent, d(K.ZONE_CREDIT))
        .when(attribution.isin("ZONE", "PART", "INDETERMINATE"), d(0.0))
    )


def risk(
    z: Column,
    slope_ratio: Column,
    margin_pct: Column,
    quality: Column,
    attribution: Column,
    zone_consistent: Column,
    safety_code: Column,
    weights: dict[str, float] | None = None,
) -> Column:
    """struct(anomaly, drift, margin, quality, credit, risk_index, sum_diff, refusal_code)."""
    w = {**K.WEIGHTS, **(weights or {})}
    anomaly = clamp01((F.abs(z) - d(K.Z_ELEVATED)) / d(K.Z_SEVERE - K.Z_ELEVATED))
    drift = clamp01(slope_ratio / d(K.RISK_RATIO_REF))
    margin = clamp01(d(1.0) - margin_pct)
    weak = d(1.0) - quality
    credited = credit(attribution, zone_consistent)
    total = (
        d(w["anomaly"]) * anomaly + d(w["drift"]) * drift + d(w["margin"]) * margin + d(w["quality"]) * weak
        - d(w["credit"]) * credited
    )
    parts = [
        d(w["anomaly"]) * anomaly, d(w["drift"]) * drift, d(w["margin"]) * margin, d(w["quality"]) * weak,
    ]
    added = parts[0]
    for part in parts[1:]:
        added = added + part
    code = (
        F.when(z.isNull(), "INSUFFICIENT_DATA")
        .when(~finite(z), "INVALID_INPUT")
        .when(safety_code.isNotNull(), safety_code)
        .when(slope_ratio.isNull() | margin_pct.isNull(), "INSUFFICIENT_DATA")
        .when(attribution.isNull(), "INSUFFICIENT_DATA")
        .when(credited.isNull(), "INVALID_INPUT")
        .when(quality.isNull(), "INSUFFICIENT_DATA")
        .when(~finite(quality) | (quality < 0) | (quality > 1), "INVALID_INPUT")
    )
    ok = code.isNull()
    return F.struct(
        F.when(ok, anomaly).alias("anomaly"),
        F.when(ok, drift).alias("drift"),
        F.when(ok, margin).alias("margin"),
        F.when(ok, weak).alias("quality"),
        F.when(ok, credited).alias("credit"),
        F.when(ok, total).alias("risk_index"),
        F.when(ok, F.abs(added - d(w["credit"]) * credited - total)).alias("sum_diff"),
        code.alias("refusal_code"),
    )


# Trigger text of each recommendation
TRIGGERS = {
    "no_band": "band missing or refused: no recommendation without the bound-driven band",
    "no_attribution": "attribution verdict missing or unknown: no recommendation without setup evidence",
    "no_z": "primary robust distance missing: anomaly evidence required",
    "no_margin": "predicted margin missing: drift evidence required",
    "absolute": "absolute limit violated: hard fail supersedes every other verdict",
    "setup": "the setup produced the signal, retest elsewhere",
    "zone": "zone shift coherent with recorded temperature: zonal limits apply",
    "zone_open": "zone shift without thermal consistency: uncertainty reported, not assumed",
    "bound": "conformal bound crosses the absolute limit and setup is not exonerated",
    "extend": "early warning with margin left: more oven time resolves the ambiguity",
    "watch": "watch band with a quiet anomaly channel: watch, do not scrap",
    "conflict": "modules disagree, evidence is weak, or attribution is indeterminate",
    "accept": "band SAFE with nominal anomaly evidence and strong provenance",
    "review": "no acceptance criteria met: requires human review",
}


def recommend(
    band: Column,
    absolute_fail: Column,
    z: Column,
    attribution: Column,
    margin_pct: Column,
    weak: Column,
    zone_consistent: Column,
) -> Column:
    """struct(action, trigger, severity) of the first rule that applies."""
    size = F.abs(z)
    alarm = size >= d(K.Z_ANOMALOUS)
    severity = (
        F.when(size >= d(K.Z_SEVERE), "SEVERE")
        .when(alarm, "ANOMALOUS")
        .when(size >= d(K.Z_ELEVATED), "ELEVATED")
        .otherwise("NOMINAL")
    )
    no_band = ~F.coalesce(band.isin(*K.BAND_RANK), F.lit(False))
    no_verdict = ~F.coalesce(attribution.isin("PART", "SOCKET", "ZONE", "TESTER", "INDETERMINATE"), F.lit(False))
    no_z = ~finite(z)
    vague = attribution == "INDETERMINATE"
    rules = [
        (no_band, "INSUFFICIENT_EVIDENCE", "no_band"),
        (no_verdict, "INSUFFICIENT_EVIDENCE", "no_attribution"),
        (no_z, "INSUFFICIENT_EVIDENCE", "no_z"),
        (margin_pct.isNull(), "INSUFFICIENT_EVIDENCE", "no_margin"),
        (absolute_fail, "REJECT", "absolute"),
        (attribution.isin("SOCKET", "TESTER"), "RETEST_DIFFERENT_SOCKET", "setup"),
        ((attribution == "ZONE") & zone_consistent, "ZONAL_REVIEW", "zone"),
        (attribution == "ZONE", "INVESTIGATE", "zone_open"),
        (band == "REJECT", "REJECT", "bound"),
        ((band == "EARLY_WARNING") & (margin_pct > 0), "EXTEND_BURN_IN", "extend"),
        ((band == "WATCH") & ~alarm & (attribution == "PART"), "MONITOR", "watch"),
        ((alarm & band.isin("SAFE", "WATCH")) | vague | ((band == "SAFE") & weak), "INVESTIGATE", "conflict"),
        ((band == "SAFE") & (severity == "NOMINAL") & ~weak, "ACCEPT", "accept"),
    ]
    action, trigger = F, F
    for condition, name, key in rules:
        action = action.when(condition, F.lit(name))
        trigger = trigger.when(condition, F.lit(TRIGGERS[key]))
    return F.struct(
        action.otherwise("INVESTIGATE").alias("action"),
        trigger.otherwise(TRIGGERS["review"]).alias("trigger"),
        F.when(~(no_band | no_verdict | no_z), severity).alias("severity"),
    )


def arrhenius_af(zone_c: Column, reference_c: Column, ea: Column) -> Column:
    zone_k, ref_k = zone_c + d(K.KELVIN), reference_c + d(K.KELVIN)
    factor = F.exp((ea / d(K.BOLTZMANN_EV)) * (d(1.0) / ref_k - d(1.0) / zone_k))
    sane = finite(zone_c) & finite(reference_c) & finite(ea) & (ea > 0) & (zone_k > 0) & (ref_k > 0)
    return F.when(sane & finite(factor) & (factor > 0), factor)


def zone_consistency(zone_c: Column, reference_c: Column, ea: Column, offset: Column, direction: int = 1) -> Column:
    """struct(consistent, af, refusal_code): does the sign of the zone offset agree with its temperature?"""
    af = arrhenius_af(zone_c, reference_c, ea)
    code = (
        F.when(zone_c.isNull() | reference_c.isNull() | ea.isNull() | offset.isNull(), "INSUFFICIENT_DATA")
        .when(af.isNull() | ~finite(offset), "INVALID_INPUT")
        .when(af == 1, "INSUFFICIENT_DATA")
    )
    expected = F.when(af > 1, F.lit(direction)).otherwise(F.lit(-direction))
    observed = F.when(offset > 0, 1).otherwise(-1)
    return F.struct(
        F.when(code.isNull(), F.when(offset == 0, F.lit(False)).otherwise(observed == expected)).alias("consistent"),
        af.alias("af"),
        code.alias("refusal_code"),
    )


def field_hours(test_hours: Column, stress_c: Column, use_c: Column, ea: Column) -> Column:
    """Equivalent field hours of ``test_hours`` at stress temperature."""
    return test_hours * arrhenius_af(stress_c, use_c, ea)
