"""Trajectories, drift shape, signed residuals and the conformal ladder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions.robust import d, finite
from lotwise.operators.ordered import GroupSizes, checked_broadcast, lookup_join, order_statistics, quantiles

GROUP = ["component_type", "parameter"]


def trajectories(rows: DataFrame, hours: Sequence[int] = (0, 24, 168)) -> DataFrame:
    """One row per (component, parameter): OK values and temperatures at each hour, first duplicate kept.

    ``min_by`` keeps the first source row of a key while combining before the shuffle.
    """
    aggs: list[Column] = []
    for hour in hours:
        first = F.when(F.col("elapsed_hours") == hour, F.col("source_row"))
        aggs.append(F.min_by("value", first).alias(f"v{hour}"))
        aggs.append(F.min_by("temperature_c", first).alias(f"temp{hour}"))
    return rows.filter("status = 'OK'").groupBy(
        "component_id", "lot_id", "component_type", "parameter", "tester_id"
    ).agg(*aggs)


def complete(series: DataFrame) -> DataFrame:
    return series.filter("v0 IS NOT NULL AND v24 IS NOT NULL AND v168 IS NOT NULL")


def shape_ratio() -> tuple[Column, Column]:
    """(ratio, kind): kind is used, zero_amplitude or nonfinite."""
    v0, v24, v168 = F.col("v0"), F.col("v24"), F.col("v168")
    seen = finite(v0) & finite(v24) & finite(v168)
    ratio = (v168 - v0) / F.nullif(v24 - v0, d(0.0))
    kind = (
        F.when(~seen, "nonfinite").when(v24 == v0, "zero_amplitude").when(~finite(ratio), "nonfinite").otherwise("used")
    )
    return ratio, kind


def shape_phi(
    train: DataFrame, allowed_lots: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Drift shape per (type, parameter): exact median of (v168 - v0) / (v24 - v0) over training lots.

    ``allowed_lots`` (one column, lot_id) counts and excludes parts of other lots.
    """
    ratio, kind = shape_ratio()
    rows = train
    if allowed_lots is not None:
        marks = allowed_lots.select("lot_id").distinct().withColumn("_allowed", F.lit(True))
        rows = lookup_join(rows, marks, ["lot_id"])
    else:
        rows = rows.withColumn("_allowed", F.lit(True))
    rows = rows.withColumn("_kind", F.when(F.col("_allowed"), kind).otherwise("excluded")).withColumn("_ratio", ratio)
    counts = rows.groupBy(*GROUP).agg(
        F.count_if(F.col("_kind") == "used").alias("n_used"),
        F.count_if(F.col("_kind") == "zero_amplitude").alias("n_zero_amplitude"),
        F.count_if(F.col("_kind") == "nonfinite").alias("n_nonfinite"),
        F.count_if(F.col("_kind") == "excluded").alias("n_excluded"),
    )
    lots = (
        rows.filter("_kind = 'used'").select(*GROUP, "lot_id").distinct()
        .groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_lots"))
    )
    medians = quantiles(rows.filter("_kind = 'used'"), GROUP, "_ratio", {"phi_168": 0.5}, limit=limit).drop("n")
    out = counts.join(medians, GROUP, "left").join(lots, GROUP, "left")
    used, zero, bad = F.col("n_used"), F.col("n_zero_amplitude"), F.col("n_nonfinite")
    code = F.when(
        used < K.MIN_COHORT,
        F.when((used == 0) & (zero > 0) & (zero + bad >= K.MIN_COHORT), "NO_VARIATION").otherwise("INSUFFICIENT_COHORT"),
    )
    phi = F.when(code.isNull(), F.col("phi_168"))
    return out.select(
        *GROUP,
        phi.alias("phi_168"),
        F.when(phi > 0, F.ln(phi) / F.ln(d(K.LINEAR_PHI))).alias("family_param"),
        "n_used",
        "n_zero_amplitude",
        "n_nonfinite",
        "n_excluded",
        F.coalesce("n_lots", F.lit(0)).alias("n_lots"),
        code.alias("refusal_code"),
    )


def shape_lots(train: DataFrame) -> DataFrame:
    """The lots behind each shape, one row per (type, parameter, lot)."""
    _, kind = shape_ratio()
    return train.filter(kind == "used").groupBy(*GROUP, "lot_id").agg(F.count(F.lit(1)).alias("n_used"))


def with_phi(series: DataFrame, phi: DataFrame) -> DataFrame:
    """Series with the fitted shape of their group (one row per type and parameter, a closed domain)."""
    return lookup_join(series, phi.select(*GROUP, "phi_168"), GROUP)


def residuals(calib: DataFrame, phi: DataFrame) -> DataFrame:
    """Signed residuals v168 - forecast of the calibration parts whose group has a shape."""
    rows = with_phi(calib, phi).filter(F.col("phi_168").isNotNull())
    point = F.col("v0") + (F.col("v24") - F.col("v0")) * F.col("phi_168")
    return rows.withColumn("residual", F.col("v168") - point).filter(finite(F.col("residual")))


def ladder_levels(res: DataFrame) -> DataFrame:
    """Each residual once per ladder level: 0 (type, parameter), 1 (parameter), 2 all."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.concat_ws("/", *GROUP).alias("level_key")),
        F.struct(F.lit(1).alias("level"), F.col("parameter").alias("level_key")),
        F.struct(F.lit(2).alias("level"), F.lit("marginal").alias("level_key")),
    )
    return res.select(F.explode(levels).alias("_l"), "residual").select("_l.level", "_l.level_key", "residual")


def rank_of(n: Column, alpha: Column) -> Column:
    """k = ceil((n + 1)(1 - alpha)), in double."""
    return F.ceil((n + 1).cast("double") * (d(1.0) - alpha))


def conformal_table(
    res: DataFrame, alpha: float = K.ALPHA, limit: int | None = None, sizes: GroupSizes | None = None
) -> DataFrame:
    """Per ladder level and key: n_cal, k, and q_hat = k-th smallest residual (NULL when k > n)."""
    a = d(alpha)
    stats = order_statistics(
        ladder_levels(res), ["level", "level_key"], "residual", {"q_hat": lambda n: rank_of(n, a) - 1},
        limit=limit, sizes=sizes,
    )
    k = rank_of(F.col("n"), a)
    usable = (k >= 1) & (k <= F.col("n"))
    return stats.select(
        "level", "level_key", F.col("n").alias("n_cal"), k.alias("k"), F.when(usable, F.col("q_hat")).alias("q_hat"),
        F.when(~usable, d(1.0) / (F.col("n") + 1)).alias("attainable_alpha"),
    )


def conformal_bound(
    rows: DataFrame, table: DataFrame, point: str, n_min: int = K.MONDRIAN_MIN
) -> DataFrame:
    """One-sided upper bound from the finest ladder level that supports it.

    The minimum size applies to the finest level of a ladder with several levels only; an absent level is skipped
    and the remaining ones are numbered from 0.
    """
    names = {0: F.concat_ws("/", *GROUP), 1: F.col("parameter"), 2: F.lit("marginal")}
    out = rows
    for level, key in names.items():
        part = table.filter(F.col("level") == level).select(
            F.col("level_key").alias("_key"), F.col("n_cal").alias(f"_n{level}"), F.col("k").alias(f"_k{level}"),
            F.col("q_hat").alias(f"_q{level}"),
        )
        out = out.withColumn("_key", key).join(checked_broadcast(part), "_key", "left").drop("_key")
    n = [F.col(f"_n{i}") for i in range(3)]
    q = [F.col(f"_q{i}") for i in range(3)]
    present = [c.isNotNull() for c in n]
    count = present[0].cast("int") + present[1].cast("int") + present[2].cast("int")
    first = F.when(present[0], 0).when(present[1], 1).when(present[2], 2)
    chosen = F.lit(None).cast("int")
    for i in (2, 1, 0):
        gate = (count > 1) & (first == i) & (n[i] < n_min)
        chosen = F.when(q[i].isNotNull() & ~gate, F.lit(i)).otherwise(chosen)
    out = out.withColumn("_at", chosen)
    at = F.col("_at")
    x = F.col(point)
    known = finite(x)

    def pick(prefix: str) -> Column:
        return F.when(at == 0, F.col(f"{prefix}0")).when(at == 1, F.col(f"{prefix}1")).when(at == 2, F.col(f"{prefix}2"))

    missing_before = F.when(at == 1, F.lit(1) - present[0].cast("int")).when(
        at == 2, F.lit(2) - present[0].cast("int") - present[1].cast("int")
    ).otherwise(0)
    marginal = F.coalesce(*reversed(n), F.lit(0))
    group = F.when(at == 0, names[0]).when(at == 1, names[1]).when(at == 2, names[2])
    code = F.when(~known, "INVALID_INPUT").when(at.isNull(), "INSUFFICIENT_CALIBRATION")
    return (
        out.withColumn("upper", F.when(known & at.isNotNull(), x + pick("_q")))
        .withColumn("q_hat", F.when(known, pick("_q")))
        .withColumn("n_cal", F.when(known, F.coalesce(pick("_n"), marginal)))
        .withColumn("k", F.when(known, pick("_k")))
        .withColumn(
            "mondrian_level", F.when(known & at.isNotNull(), at - missing_before).otherwise(K.MONDRIAN_NONE)
        )
        .withColumn("mondrian_group", F.when(known, group))
        .withColumn("attainable_alpha", F.when(known & at.isNull(), d(1.0) / (marginal + 1)))
        .withColumn("bound_code", code)
        .drop("_at", *[f"_{c}{i}" for c in "nkq" for i in range(3)])
    )


def calibration_capacity(
    calib: DataFrame, types: Sequence[str], parameters: Sequence[str], n_min: int = K.MONDRIAN_MIN, alpha: float = 0.05
) -> DataFrame:
    """Calibration size, attainable alpha and supported ladder level of every (type, parameter), empty ones too."""
    domain = calib.sparkSession.createDataFrame(
        [(t, p) for t in types for p in parameters], "component_type string, parameter string"
    )
    counts = calib.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    attainable = F.when(n > 0, d(1.0) / (n + 1)).otherwise(d(1.0))
    supported = (n >= n_min) & (attainable <= alpha)
    return domain.join(counts, GROUP, "left").select(
        *GROUP,
        n.alias("n_cal"),
        attainable.alias("attainable_alpha"),
        supported.alias("alpha_supported"),
        F.when(supported, 0).when(n > 0, 1).otherwise(3).alias("level_supported"),
    )


def guard_samples(calib: DataFrame, phi: DataFrame, limit: int | None = None) -> DataFrame:
    """Reference sample of each calibration part: v0, delta, the median v0 of its lot, mean temperature, tester."""
    keys = ["lot_id", *GROUP]
    rows = with_phi(calib, phi).filter(F.col("phi_168").isNotNull())
    medians = quantiles(calib, keys, "v0", {"lot_median": 0.5}, limit=limit).drop("n")
    rows = lookup_join(rows, medians, keys)
    temps = F.array_compact(F.array("temp0", "temp24"))
    mean_temp = F.when(F.size(temps) > 0, F.aggregate(temps, d(0.0), lambda a, x: a + x) / F.size(temps))
    return rows.select(
        *keys, "component_id", "tester_id", "v0", (F.col("v24") - F.col("v0")).alias("delta24"), "lot_median",
        mean_temp.alias("temperature_c"),
    )


def manifest(phi: DataFrame, table: DataFrame) -> DataFrame:
    """Calibration manifest: one row per group with its shape, sizes and the version of the whole calibration."""
    sizes = table.filter("level = 0").select(F.col("level_key").alias("group"), "n_cal")
    groups = phi.withColumn("group", F.concat_ws("/", *GROUP)).join(sizes, "group", "left")
    version = calibration_version(phi)
    return groups.select(
        "group", "phi_168", "family_param", F.col("n_used").alias("n_phi_used"),
        F.coalesce("n_cal", F.lit(0)).alias("n_cal"), "refusal_code",
    ).withColumn("calibration_version", F.lit(version))


def calibration_version(phi: DataFrame) -> str:
    """Version from the content: the groups are a closed domain, so their lines fit the driver."""
    line = F.concat_ws(":", F.concat_ws("/", *GROUP), F.col("phi_168").cast("string"), F.col("n_used").cast("string"))
    row = phi.select(line.alias("l")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("l"))), 256)).first()
    return f"cal-{row[0][:8]}"
