"""Is a lot exchangeable with the calibration sample? Six signals per (lot, type, parameter)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions.robust import d, finite
from lotwise.operators.cohort import lot_statistics
from lotwise.operators.ordered import GroupSizes, group_sizes, locate, lookup_join, quantiles, sorted_runs

GROUP = ["component_type", "parameter"]
LOT = ["lot_id", *GROUP]


def psi(
    lots: DataFrame,
    reference: DataFrame,
    lot_keys: Sequence[str],
    keys: Sequence[str],
    value: str,
    bins: int = K.PSI_BINS,
    lot_sizes: GroupSizes | None = None,
    reference_sizes: GroupSizes | None = None,
) -> DataFrame:
    """Population stability index of each lot against the reference of its group.

    Equal-width bins over the reference range. Lot values outside the range fall in no bin but stay in the
    denominator. Both sides are counted per bin before anything is shuffled.
    """
    keys, lot_keys = list(keys), list(lot_keys)
    lot_sizes = lot_sizes or group_sizes(lots, keys)
    reference_sizes = reference_sizes or group_sizes(reference, keys)
    ref = reference.filter(finite(F.col(value)))
    span = ref.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_ref_n")
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    width = (hi - lo) / d(float(bins))
    x = F.col(value)
    # Right edge of the last bin is inclusive; edges are lo + i * width.
    raw = F.floor((x - lo) / F.nullif(width, d(0.0)))
    raw = F.when(x < lo + raw * width, raw - 1).when((raw + 1 < bins) & (x >= lo + (raw + 1) * width), raw + 1).otherwise(raw)
    bin_of = F.when((x < lo) | (x > hi), None).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw))).cast("int")
    ref_bins = (
        lookup_join(ref.select(*keys, value), span, keys, reference_sizes, "inner")
        .withColumn("_bin", bin_of)
        .groupBy(*keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_ref"))
    )
    mine = lots.filter(finite(x)).select(*lot_keys, value)
    lot_bins = (
        lookup_join(mine, span, keys, lot_sizes, "inner")
        .withColumn("_bin", bin_of)
        .groupBy(*lot_keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_lot"))
    )
    shape = mine.groupBy(*lot_keys).agg(
        F.count(F.lit(1)).alias("_lot_n"), F.min(value).alias("_lot_lo"), F.max(value).alias("_lot_hi")
    )
    grid = lookup_join(shape, span, keys, lot_sizes, "inner").withColumn(
        "_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    both = grid.join(lot_bins, [*lot_keys, "_bin"], "left")
    both = lookup_join(
        both, ref_bins, [*keys, "_bin"], GroupSizes(lot_sizes.groups * bins, lot_sizes.largest, lot_sizes.rows)
    )
    p = F.coalesce(F.col("_lot"), F.lit(0)) / F.col("_lot_n")
    q = F.coalesce(F.col("_ref"), F.lit(0)) / F.col("_ref_n")
    p = F.when(p == 0, d(K.PSI_EPSILON)).otherwise(p)
    q = F.when(q == 0, d(K.PSI_EPSILON)).otherwise(q)
    flat = (lo == hi)
    same = (F.col("_lot_lo") == lo) & (F.col("_lot_hi") == lo)
    out = both.groupBy(*lot_keys).agg(
        F.sum((p - q) * F.ln(p / q)).alias("_psi"),
        F.max(flat).alias("_flat"),
        F.max(same).alias("_same"),
    )
    return out.select(
        *lot_keys,
        F.when(F.col("_flat"), F.when(F.col("_same"), d(0.0)).otherwise(d(K.PSI_FIRE + K.PSI_EPSILON)))
        .otherwise(F.col("_psi"))
        .alias("psi"),
    )


def ks_p_asymptotic(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Kolmogorov tail 2 * sum (-1)^(j-1) exp(-2 j^2 t^2) at t = D sqrt(nm / (n + m))."""
    t = statistic * F.sqrt(n * m / (n + m))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        d(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, d(1.0)).otherwise(d(-1.0)) * F.exp(d(-2.0) * j * j * t * t),
    )
    return F.when(t < 0.04, d(1.0)).otherwise(F.least(d(1.0), F.greatest(d(0.0), d(2.0) * tail)))


def ks(
    lots: DataFrame, reference: DataFrame, lot_keys: Sequence[str], keys: Sequence[str], value: str,
    limit: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each lot to the reference of its group, with asymptotic p.

    Between two neighbouring lot values the lot's distribution is flat and the reference's rises, so the largest
    distance lies at a lot value or just before one. The reference is ranked once for all lots; no lot copies it.
    """
    keys, lot_keys = list(keys), list(lot_keys)
    mine = lots.filter(finite(F.col(value))).select(*lot_keys, value)
    ref = reference.filter(finite(F.col(value))).select(*keys, value)
    runs = sorted_runs(mine, lot_keys, value, limit=limit)
    points = runs.join(locate(ref, mine, keys, value, limit=limit), [*keys, value])
    n, m = F.col("group_rows"), F.nullif(F.col("reference_rows"), F.lit(0))
    here = F.abs((F.col("run_start") + F.col("run_rows")) / n - F.col("upto") / m)
    before = F.abs(F.col("run_start") / n - F.col("below") / m)
    out = points.groupBy(*lot_keys).agg(
        F.max(F.greatest(here, before)).alias("ks"), F.max(n).alias("n_lot"), F.max(m).alias("n_reference")
    )
    out = out.filter("n_reference > 0")
    return out.withColumn("ks_p", ks_p_asymptotic(F.col("ks"), F.col("n_lot").cast("double"), F.col("n_reference").cast("double")))


def lot_centre(
    lots: DataFrame, samples: DataFrame, limit: int | None = None, lot_sizes: GroupSizes | None = None,
    reference_sizes: GroupSizes | None = None,
) -> DataFrame:
    """z of the lot median v0 against the calibration lot medians (one entry per calibration part)."""
    ref = lot_statistics(samples, GROUP, "lot_median", limit=limit, sizes=reference_sizes).select(
        *GROUP, F.col("median").alias("_rm"), F.col("robust_sigma").alias("_rs"), F.col("refusal_code").alias("_rc")
    )
    med = quantiles(lots.filter(finite(F.col("v0"))), LOT, "v0", {"_med": 0.5}, limit=limit)
    z = F.when(F.col("_rc").isNull() & (F.col("_rs") > 0), (F.col("_med") - F.col("_rm")) / F.col("_rs"))
    return lookup_join(med, ref, GROUP, lot_sizes).select(*LOT, z.alias("centre_z"))


def exchangeability(
    lots: DataFrame, temperatures: DataFrame, samples: DataFrame, groups: DataFrame, limit: int | None = None
) -> DataFrame:
    """Signals and status of every (lot, type, parameter).

    ``lots`` holds v0 and delta24 per part, ``temperatures`` the lot's readings (lot, type, parameter,
    temperature_c), ``samples`` the calibration reference and ``groups`` the fitted groups. A signal that cannot be
    evaluated does not fire. Tester novelty is a signal of the part; see ``novel_testers``.
    """
    lot_sizes, ref_sizes = group_sizes(lots, GROUP), group_sizes(samples, GROUP)
    p0 = psi(lots, samples, LOT, GROUP, "v0", K.PSI_BINS, lot_sizes, ref_sizes).withColumnRenamed("psi", "psi_v0")
    p24 = psi(lots, samples, LOT, GROUP, "delta24", K.PSI_BINS, lot_sizes, ref_sizes).withColumnRenamed("psi", "psi_delta24")
    dist = ks(lots, samples, LOT, GROUP, "delta24", limit)
    enough = (F.col("n_lot") >= K.MIN_COHORT) & (F.col("n_reference") >= K.MIN_COHORT)
    dist = dist.select(*LOT, "ks", F.when(enough, F.col("ks_p")).alias("ks_p"))
    centre = lot_centre(lots, samples, limit, lot_sizes, ref_sizes)
    mean = temperatures.groupBy(*LOT).agg(F.avg("temperature_c").alias("mean_temperature"))
    spread = samples.groupBy(*GROUP).agg(F.min("temperature_c").alias("_tlo"), F.max("temperature_c").alias("_thi"))
    base = mean
    for part in (p0, p24, dist, centre):
        base = base.join(part, LOT, "left")
    base = lookup_join(base, spread, GROUP, lot_sizes)
    known = groups.select(*GROUP).distinct().withColumn("_known", F.lit(True))
    base = lookup_join(base, known, GROUP, lot_sizes)

    def fired(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    t = F.col("mean_temperature")
    signals = {
        "feature_shift:v0": fired(F.col("psi_v0") > K.PSI_FIRE),
        "feature_shift:delta_24": fired(F.col("psi_delta24") > K.PSI_FIRE),
        "lot_centre_shift": fired(F.abs("centre_z") > K.LOT_CENTRE_Z),
        "amplitude_shift": fired(F.col("ks_p") < K.KS_P),
        "temperature_range": fired((t < F.col("_tlo")) | (t > F.col("_thi"))),
        "group_novelty": F.col("_known").isNull(),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in signals.items()]))
    out = base.withColumn("signals_fired", names).withColumn("max_psi", F.greatest("psi_v0", "psi_delta24"))
    return out.withColumn("guarantee_status", guarantee(F.size("signals_fired") > 0, F.col("max_psi"))).withColumn(
        "ks_method", F.lit("asymptotic")
    ).drop("_tlo", "_thi", "_known")


def guarantee(any_fired: Column, max_psi: Column) -> Column:
    return F.when(any_fired, "VOID").when(F.coalesce(max_psi >= K.PSI_WARN, F.lit(False)), "DEGRADED").otherwise("VALID")


def novel_testers(rows: DataFrame, samples: DataFrame, groups: DataFrame) -> DataFrame:
    """(type, parameter, tester) combinations that calibration never saw, in groups that calibration knows."""
    seen = samples.filter(F.col("tester_id").isNotNull()).select(*GROUP, "tester_id").distinct()
    here = rows.filter(F.col("tester_id").isNotNull()).select(*GROUP, "tester_id").distinct()
    return here.join(groups.select(*GROUP).distinct(), GROUP, "left_semi").join(seen, [*GROUP, "tester_id"], "left_anti")


def novel_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.select(*GROUP).distinct().join(groups.select(*GROUP), GROUP, "left_anti")


