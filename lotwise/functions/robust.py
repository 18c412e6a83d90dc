"""Column builders for robust scale, fences, DPAT verdicts and severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import constants as K


def d(x: float) -> Column:
    return F.lit(float(x))


def finite(x: Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < d(float("inf"))), F.lit(False))


def round6(x: Column) -> Column:
    return F.floor(x * d(1e6) + d(0.5)) / d(1e6)


def mad_correction(n: Column) -> Column:
    table = F.array(*[d(c) for c in K.MAD_CORRECTION])
    return F.when((n >= 1) & (n < K.SMALL_COHORT), F.element_at(table, n.cast("int"))).otherwise(d(1.0))


def refusal(n: Column, iqr: Column, mad: Column) -> Column:
    return F.when(n < K.MIN_COHORT, "INSUFFICIENT_COHORT").when((iqr == 0) & (mad == 0), "NO_VARIATION")


def estimator(n: Column, iqr: Column, mad: Column) -> Column:
    return (
        F.when(refusal(n, iqr, mad).isNotNull(), "none")
        .when((n < K.SMALL_COHORT) & (mad > 0), "mad")
        .otherwise("iqr")
    )


def robust_sigma(n: Column, iqr: Column, mad: Column) -> Column:
    kind = estimator(n, iqr, mad)
    return (
        F.when(kind == "none", d(0.0))
        .when(kind == "mad", d(K.MAD_SCALE) * mad_correction(n) * mad)
        .otherwise(iqr / d(K.IQR_DIVISOR))
    )


def boxplot_lower(q1: Column, iqr: Column, mc: Column) -> Column:
    power = F.when(mc >= 0, d(K.BOXPLOT_LOWER_POS)).otherwise(d(K.BOXPLOT_LOWER_NEG))
    return q1 - d(K.BOXPLOT_K) * F.exp(power * mc) * iqr


def boxplot_upper(q3: Column, iqr: Column, mc: Column) -> Column:
    power = F.when(mc >= 0, d(K.BOXPLOT_UPPER_POS)).otherwise(d(K.BOXPLOT_UPPER_NEG))
    return q3 + d(K.BOXPLOT_K) * F.exp(power * mc) * iqr


def dpat_z(x: Column, median: Column, sigma: Column) -> Column:
    return (
        F.when(~finite(x), F.lit(None))
        .when(sigma > 0, (x - median) / sigma)
        .when(x == median, d(0.0))
        .cast("double")
    )


def dpat_verdict(x: Column, code: Column, median: Column, sigma: Column, k: Column) -> Column:
    """PASS, FAIL or the refusal code; NULL when there is no value to judge."""
    inside = (x >= median - k * sigma) & (x <= median + k * sigma)
    return (
        F.when(F.coalesce(code, F.lit("")) == "INSUFFICIENT_COHORT", "INSUFFICIENT_COHORT")
        .when(x.isNull(), F.lit(None))
        .when(~finite(x), "FAIL")
        .when(F.coalesce(code, F.lit("")) == "NO_VARIATION", "NO_VARIATION")
        .when(inside, "PASS")
        .otherwise("FAIL")
    )


def dpat_warning(n: Column, kind: Column, code: Column) -> Column:
    small = F.format_string("small cohort, n=%d", n.cast("int"))
    return (
        F.when(code == "INSUFFICIENT_COHORT", F.format_string("cohort of %d, no limits", n.cast("int")))
        .when(code == "NO_VARIATION", "all cohort values equal, no window")
        .when((n < K.SMALL_COHORT) & (kind == "mad"), F.concat(small, F.lit(", MAD with c(n)")))
        .when(n < K.SMALL_COHORT, F.concat(small, F.lit(", MAD is 0, IQR used")))
    )


def severity(z: Column) -> Column:
    size = F.abs(z)
    return (
        F.when(size >= K.Z_SEVERE, "SEVERE")
        .when(size >= K.Z_ANOMALOUS, "ANOMALOUS")
        .when(size >= K.Z_ELEVATED, "ELEVATED")
        .otherwise("NOMINAL")
    )


def tukey_position(x: Column, q1: Column, q3: Column) -> Column:
    iqr = q3 - q1
    extreme = (x < q1 - d(K.TUKEY_EXTREME) * iqr) | (x > q3 + d(K.TUKEY_EXTREME) * iqr)
    mild = (x < q1 - d(K.TUKEY_MILD) * iqr) | (x > q3 + d(K.TUKEY_MILD) * iqr)
    return F.when(extreme, "EXTREME").when(mild, "MILD").when(x.isNotNull() & q1.isNotNull(), "INSIDE")


def ranked(name: Column, ranks: dict[str, int], default: int = -1) -> Column:
    out = F.lit(default)
    for key, rank in ranks.items():
        out = F.when(name == key, rank).otherwise(out)
    return out
