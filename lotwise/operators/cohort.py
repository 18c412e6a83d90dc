"""Lot statistics and exact leave-one-out cohort statistics.

A cohort is every other finite, OK reading with the same keys. Removing one reading from a sorted group moves an
order statistic by at most one place: position j of the rest is s[j] when the reading is above s[j], else s[j+1].
Three neighbouring order statistics per quantile therefore serve every member of a group, whatever its size, and
the per-reading work is a lookup and a CASE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import robust as R
from lotwise.operators.ordered import (
    GroupSizes,
    group_sizes,
    lookup_join,
    order_statistics,
    quantile_picks,
    type7,
)

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def cohort_members(df: DataFrame, keys: Sequence[str], value: str, status: str | None = None) -> DataFrame:
    """Finite readings with complete keys and, when a status column is named, status OK."""
    keep = R.finite(F.col(value))
    for key in keys:
        keep = keep & F.col(key).isNotNull()
    if status is not None:
        keep = keep & (F.col(status) == "OK")
    return df.filter(keep)


def lot_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    status: str | None = None,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Whole-group median, quartiles, IQR, MAD, robust sigma, Tukey fences, estimator and refusal code."""
    members = cohort_members(df, keys, value, status).select(*keys, value)
    sizes = sizes or group_sizes(members, keys)
    quarts = order_statistics(members, keys, value, quantile_picks(QUARTILES), limit=limit, sizes=sizes, around=list(QUARTILES.values()))
    n = F.col("n")
    quarts = quarts.select(
        *keys,
        "n",
        *[type7(n, p, F.col(f"{q}_lo"), F.col(f"{q}_hi")).alias(q) for q, p in QUARTILES.items()],
    )
    centred = lookup_join(members, quarts.select(*keys, "median"), keys, sizes, "inner", limit, by=by)
    centred = centred.select(*keys, F.abs(F.col(value) - F.col("median")).alias("_dev"))
    mads = order_statistics(centred, keys, "_dev", quantile_picks({"mad": 0.5}), limit=limit, sizes=sizes, around=[0.5])
    mads = mads.select(*keys, type7(n, 0.5, F.col("mad_lo"), F.col("mad_hi")).alias("mad"))
    return describe_ladder(quarts.join(mads, list(keys)))


def describe_ladder(stats: DataFrame) -> DataFrame:
    """Add everything the estimator ladder derives from n, q1, median, q3 and mad."""
    n, q1, med, q3 = (F.col(c) for c in ("n", "q1", "median", "q3"))
    few = n < K.MIN_COHORT
    flat = F.when(few, med)
    out = stats.withColumn("q1", F.coalesce(flat, q1)).withColumn("q3", F.coalesce(flat, q3))
    out = out.withColumn("mad", F.when(few, R.d(0.0)).otherwise(F.col("mad")))
    iqr, mad = F.col("iqr"), F.col("mad")
    return (
        out.withColumn("iqr", q3 - q1)
        .withColumn("c_n", F.when(few, R.d(1.0)).otherwise(R.mad_correction(n)))
        .withColumn("refusal_code", R.refusal(n, iqr, mad))
        .withColumn("estimator", R.estimator(n, iqr, mad))
        .withColumn("robust_sigma", R.robust_sigma(n, iqr, mad))
        .withColumn("reduced_power", n < K.SMALL_COHORT)
        .withColumn("zero_iqr", F.col("refusal_code").isNotNull())
        .withColumn("tukey_mild_low", q1 - R.d(K.TUKEY_MILD) * iqr)
        .withColumn("tukey_mild_high", q3 + R.d(K.TUKEY_MILD) * iqr)
        .withColumn("tukey_extreme_low", q1 - R.d(K.TUKEY_EXTREME) * iqr)
        .withColumn("tukey_extreme_high", q3 + R.d(K.TUKEY_EXTREME) * iqr)
    )


# The outcome tables are written as SQL text: one expression per group table instead of thousands of Column calls.


def _quantile_sql(a: str, p: float) -> str:
    """Type-7 quantile of one sorted array (NULL when empty)."""
    at = f"(size({a}) - 1) * {p}D"
    low, high = f"get({a}, CAST(floor({at}) AS INT))", f"get({a}, CAST(ceil({at}) AS INT))"
    return f"CASE WHEN size({a}) > 0 THEN {low} + ({high} - {low}) * ({at} - floor({at})) END"


def _small_cases_sql(values: str) -> str:
    """Statistics of a small sorted group without each of its members in turn, then of the whole group."""
    places = f"CASE WHEN size({values}) > 0 THEN sequence(0, size({values}) - 1) ELSE array() END"
    rests = f"transform({places}, r -> concat(slice({values}, 1, r), slice({values}, r + 2, size({values}))))"
    quarts = ", ".join(f"'{q}', {_quantile_sql('a', p)}" for q, p in QUARTILES.items())
    step1 = f"transform(concat({rests}, array({values})), a -> named_struct('a', a, {quarts}))"
    step2 = (
        f"transform({step1}, s -> named_struct('q1', s.q1, 'median', s.median, 'q3', s.q3,"
        " 'gaps', array_sort(transform(s.a, v -> abs(v - s.median)))))"
    )
    mad = f"CASE WHEN size(s.gaps) < {K.SMALL_COHORT} THEN {_quantile_sql('s.gaps', 0.5)} END"
    return (
        f"transform({step2}, s -> named_struct('n', CAST(size(s.gaps) AS BIGINT), 'q1', s.q1, 'median', s.median,"
        f" 'q3', s.q3, 'iqr', s.q3 - s.q1, 'mad', {mad}))"
    )


def _large_cases_sql() -> str:
    """The seven outcomes of removing one member of a large group, then the whole group.

    Case c means that the removed reading lies above exactly c of the six watched order statistics.
    """

    def block(size: str, quarts: list[str]) -> str:
        q1, med, q3 = quarts
        return (
            f"named_struct('n', CAST({size} AS BIGINT), 'q1', {q1}, 'median', {med}, 'q3', {q3},"
            f" 'iqr', ({q3}) - ({q1}), 'mad', CAST(NULL AS DOUBLE))"
        )

    def between(low: str, high: str, size: str, p: float) -> str:
        at = f"({size} - 1) * {p}D"
        return f"{low} + ({high} - {low}) * ({at} - floor({at}))"

    blocks = []
    for case in range(7):
        quarts = []
        for at, (q, p) in enumerate(QUARTILES.items()):
            low = f"_{q}0" if case > 2 * at else f"_{q}1"
            high = f"_{q}1" if case > 2 * at + 1 else f"_{q}2"
            quarts.append(between(low, high, "(_n - 1)", p))
        blocks.append(block("(_n - 1)", quarts))
    whole = []
    for q, p in QUARTILES.items():
        shifted = f"floor((_n - 1) * {p}D) > floor((_n - 2) * {p}D)"
        low, high = f"if({shifted}, _{q}1, _{q}0)", f"if({shifted}, _{q}2, _{q}1)"
        whole.append(between(low, high, "_n", p))
    blocks.append(block("_n", whole))
    return f"array({', '.join(blocks)})"


def _ladder_sql(cases: str) -> str:
    """Add sigma, estimator, power flag and refusal. For n >= 20 a zero IQR forces a zero MAD."""
    none = f"(s.n < {K.MIN_COHORT} OR (s.iqr = 0 AND coalesce(s.mad, 0D) = 0))"
    by_mad = f"(s.n < {K.SMALL_COHORT} AND s.mad > 0)"
    table = "array(" + ", ".join(f"{c}D" for c in K.MAD_CORRECTION) + ")"
    return (
        f"transform({cases}, s -> named_struct('n', s.n, 'q1', s.q1, 'median', s.median, 'q3', s.q3, 'iqr', s.iqr,"
        f" 'mad', s.mad, 'robust_sigma', CASE WHEN {none} THEN 0D WHEN {by_mad}"
        f" THEN {K.MAD_SCALE}D * get({table}, CAST(s.n AS INT) - 1) * s.mad ELSE s.iqr / {K.IQR_DIVISOR}D END,"
        f" 'estimator', CASE WHEN {none} THEN 'none' WHEN {by_mad} THEN 'mad' ELSE 'iqr' END,"
        f" 'reduced_power', s.n < {K.SMALL_COHORT},"
        f" 'refusal_code', CASE WHEN s.n < {K.MIN_COHORT} THEN 'INSUFFICIENT_COHORT' WHEN {none} THEN 'NO_VARIATION' END))"
    )


LOO_COLUMNS = (
    "n", "q1", "median", "q3", "iqr", "mad", "robust_sigma", "estimator", "reduced_power", "refusal_code"
)


def cohort_table(
    members: DataFrame,
    keys: Sequence[str],
    value: str,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Per group: every outcome of leaving one member out, so that rows only look theirs up.

    A group of at most 20 keeps its sorted values and one outcome per member; a larger one has seven outcomes.
    """
    picks = {}
    for name, p in QUARTILES.items():
        for step in range(3):
            picks[f"_{name}{step}"] = lambda n, p=p, step=step: F.least(
                n - 1, F.greatest(F.lit(0), F.floor((n - 2) * F.lit(p))) + step
            )
    table = order_statistics(
        members, keys, value, picks, small_upto=K.SMALL_COHORT, limit=limit, sizes=sizes, around=list(QUARTILES.values())
    ).withColumnsRenamed({"n": "_n", "small": "_small"})
    tiny = f"_n <= {K.SMALL_COHORT}"
    cases = _ladder_sql(f"CASE WHEN {tiny} THEN {_small_cases_sql('_small')} ELSE {_large_cases_sql()} END")
    edges = ", ".join(f"_{q}{i}" for q in QUARTILES for i in range(2))
    return table.selectExpr(
        *keys, "_n", f"CASE WHEN {tiny} THEN _small END AS _small", f"array({edges}) AS _edges", f"{cases} AS _cases"
    )


def leave_one_out(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    status: str | None = None,
    prefix: str = "",
    limit: int | None = None,
    sizes: GroupSizes | None = None,
    source: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every row with the statistics of its cohort: the group's members other than the row itself.

    Adds n, q1, median, q3, iqr, mad (NULL for n >= 20, where sigma does not need it), robust_sigma, estimator,
    reduced_power, refusal_code, each with ``prefix``. Rows outside the cohort (not OK, not finite) are compared
    with the whole group. ``source`` holds the same readings without the columns ``df`` gained since, so that the
    cohort table does not recompute them. ``by`` names the keys that the rows are dealt by.
    """
    members = cohort_members(df if source is None else source, keys, value, status)
    sizes = sizes or group_sizes(members, keys)
    table = cohort_table(members, keys, value, limit, sizes)
    joined = lookup_join(df, table, keys, sizes, "left", limit, by=by)
    x = f"`{value}`"
    member = f"NOT isnan({x}) AND abs({x}) < double('Infinity')" + (f" AND `{status}` = 'OK'" if status else "")
    case = " + ".join(f"CASE WHEN {x} > _edges[{i}] THEN 1 ELSE 0 END" for i in range(6))
    own = f"CASE WHEN _small IS NOT NULL THEN CAST(array_position(_small, {x}) AS INT) - 1 ELSE {case} END"
    found = f"CASE WHEN {member} THEN get(_cases, {own}) ELSE element_at(_cases, -1) END"
    absent = (
        "named_struct('n', 0L, 'q1', CAST(NULL AS DOUBLE), 'median', CAST(NULL AS DOUBLE), 'q3', CAST(NULL AS DOUBLE),"
        " 'iqr', CAST(NULL AS DOUBLE), 'mad', CAST(NULL AS DOUBLE), 'robust_sigma', 0D, 'estimator', 'none',"
        " 'reduced_power', true, 'refusal_code', 'INSUFFICIENT_COHORT')"
    )
    # A generator turns the struct into real columns, so later filters do not repeat the lookup per use.
    names = ", ".join(f"`{prefix}{c}`" for c in LOO_COLUMNS)
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns], f"inline(array(coalesce({found}, {absent}))) AS ({names})"
    )


def dpat(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    status: str | None = None,
    k: float = K.DPAT_K,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Leave-one-out DPAT limits, robust z and verdict for every row."""
    stats = leave_one_out(df, keys, value, status, limit=limit, sizes=sizes, by=by)
    x, med, sigma, code = F.col(value), F.col("median"), F.col("robust_sigma"), F.col("refusal_code")
    usable = code.isNull()
    return (
        stats.withColumn("limit_low", F.when(usable, med - R.d(k) * sigma))
        .withColumn("limit_high", F.when(usable, med + R.d(k) * sigma))
        .withColumn("z", F.when(F.coalesce(code, F.lit("")) != "INSUFFICIENT_COHORT", R.dpat_z(x, med, sigma)))
        .withColumn("verdict", R.dpat_verdict(x, code, med, sigma, R.d(k)))
        .withColumn("warning", R.dpat_warning(F.col("n"), F.col("estimator"), code))
    )


def whole_cohort_z(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, k: float = K.DPAT_K,
    sizes: GroupSizes | None = None, limit: int | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Each row's z against its whole group, and whether it lies outside the group's window."""
    table = stats.select(*keys, "median", "robust_sigma")
    out = lookup_join(df, table, keys, sizes, "left", limit, by=by)
    x, med, sigma = F.col(value), F.col("median"), F.col("robust_sigma")
    outside = (x > med + R.d(k) * sigma) | (x < med - R.d(k) * sigma)
    return out.withColumn("z", F.when(sigma > 0, (x - med) / sigma)).withColumn(
        "flagged", F.coalesce((sigma > 0) & outside, F.lit(False))
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Equal-width counts over each group's observed range, empty bins included.

    A group with one distinct value gets a single bin of width 1 around it.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    sizes = group_sizes(df, keys)
    rows = lookup_join(df.select(*keys, value), span, keys, sizes, "inner")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))
    )
    counts = rows.withColumn("bin", at.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("bin_rows"))
    last = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(bins - 1)
    edges = span.withColumn("bin", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    flat = F.col("_hi") == F.col("_lo")
    return (
        edges.join(counts, [*keys, "bin"], "left")
        .select(
            *keys,
            "bin",
            F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo") + F.col("bin") * width).alias("bin_low"),
            F.when(flat, F.col("_lo") + 0.5).otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_high"),
            F.coalesce(F.col("bin_rows"), F.lit(0)).alias("bin_rows"),
        )
    )
