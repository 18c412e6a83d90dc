"""Medcouple and adjusted boxplot per group.

Groups that fit in one task are handled as one sorted array in an Arrow batch. For hot groups the kernel median is
found by counting: a pair (u above, d below the median, both as distances) has kernel at most t exactly when
d >= u (1 - t) / (1 + t). Each round counts the pairs for several t at once with the cumulative counts of
``ordered.locate`` and narrows the interval per group; no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import robust as R
from lotwise.functions.medcouple import medcouple_of_sorted, medcouples_of_runs
from lotwise.operators.ordered import (
    GroupSizes,
    _hot_limit,
    bounded_broadcast,
    group_sizes,
    hot_keys,
    locate,
    lookup_join,
    quantiles,
)
from lotwise.session import pin

# Rows of one group that may travel as one array.
ARRAY_ROWS = 200_000
PROBES = 15
ROUNDS = 14


def medcouple(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per group: ``n`` and ``medcouple`` (0 below three rows or for a constant group).

    In hot groups every round narrows the value sixteenfold; fourteen rounds reach double precision.
    """
    keys = list(keys)
    rows = df.select(*keys, value)
    limit = min(ARRAY_ROWS, _hot_limit(df, limit))
    sizes = sizes or group_sizes(rows, keys)
    if not sizes.is_hot(limit):
        return _by_array(rows, keys, value)
    n_hot = max(1, sizes.rows // limit)
    hot = bounded_broadcast(pin(hot_keys(rows, keys, limit).select(*keys)), n_hot)
    cold = _by_array(rows.join(hot, keys, "left_anti"), keys, value)
    return cold.unionByName(_by_counting(rows.join(hot, keys, "left_semi"), keys, value, limit, n_hot, rounds))


def _by_array(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    arrays = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return arrays.select(*keys, F.size("_v").cast("long").alias("n"), medcouple_of_sorted("_v").alias("medcouple"))


def _by_counting(rows: DataFrame, keys: list[str], value: str, limit: int, n_hot: int, rounds: int) -> DataFrame:
    centres = pin(quantiles(rows, keys, value, {"_c": 0.5}, limit=limit))
    z = F.col(value) - F.col("_c")
    spread = rows.join(bounded_broadcast(centres.select(*keys, "_c"), n_hot), keys).withColumn("_z", z)
    # Equal distances are combined before any shuffle.
    up = spread.filter("_z > 0").groupBy(*keys, F.col("_z").alias("_u")).agg(F.count(F.lit(1)).alias("_uw"))
    down = spread.filter("_z < 0").select(*keys, (-F.col("_z")).alias("_d"))
    shape = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_z") > 0).alias("_nu"),
        F.count_if(F.col("_z") < 0).alias("_nd"),
        F.count_if(F.col("_z") == 0).alias("_ties"),
    )
    ties, nu, nd = F.col("_ties"), F.col("_nu"), F.col("_nd")
    pairs = (nu + ties) * (nd + ties)
    state = shape.withColumn(
        "_want", F.explode(F.array(F.floor((pairs - 1) / 2), F.floor(pairs / 2)))
    ).withColumn("_which", F.monotonically_increasing_id())
    lows = nd * ties + F.floor(ties * (ties - 1) / 2)
    state = state.withColumn("_inner", F.col("_want") - lows)
    state = pin(
        state.select(*keys, "n", "_nu", "_nd", "_ties", "_which", "_inner", R.d(-1.0).alias("_lo"), R.d(1.0).alias("_hi"))
    )
    for _ in range(rounds):
        state = pin(_narrow(state, up, down, keys, limit, n_hot))
    inner = F.col("_inner")
    mid = (F.col("_lo") + F.col("_hi")) / 2
    at = (
        F.when(inner < 0, R.d(-1.0))
        .when(inner >= nu * nd + ties, R.d(1.0))
        .otherwise(F.when(F.abs(mid) < 1e-15, R.d(0.0)).otherwise(mid))
    )
    flat = (nu == 0) & (nd == 0)
    return state.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg(F.when(flat, R.d(0.0)).otherwise(at)).alias("medcouple")
    )


def _narrow(
    state: DataFrame, up: DataFrame, down: DataFrame, keys: list[str], limit: int, n_hot: int
) -> DataFrame:
    """Replace each [lo, hi] by the part between two neighbouring probes that holds the wanted pair."""
    steps = F.array(*[F.lit((i + 1) / (PROBES + 1)) for i in range(PROBES)])
    probes = state.select(
        *keys, "_which", "_inner", "_lo", "_hi", F.posexplode(steps).alias("_i", "_f")
    ).withColumn("_t", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))
    points = up.join(bounded_broadcast(probes.select(*keys, "_which", "_i", "_t"), 2 * PROBES * n_hot), keys).withColumn(
        "_d", F.col("_u") * (1 - F.col("_t")) / (1 + F.col("_t"))
    )
    located = locate(down, points, [*keys], "_d", limit=limit)
    counted = (
        points.join(located, [*keys, "_d"])
        .groupBy("_which", "_i")
        .agg(F.sum((F.col("reference_rows") - F.col("below")) * F.col("_uw")).alias("_at_most"))
    )
    # The zero pairs of tied medians enter once t reaches zero.
    marks = probes.join(bounded_broadcast(counted, 2 * PROBES * n_hot), ["_which", "_i"], "left").join(
        bounded_broadcast(state.select("_which", "_ties"), 2 * n_hot), "_which"
    )
    reached = F.coalesce(F.col("_at_most"), F.lit(0)) + F.when(F.col("_t") >= 0, F.col("_ties")).otherwise(F.lit(0))
    bounds = marks.groupBy("_which").agg(
        F.min(F.when(reached > F.col("_inner"), F.col("_t"))).alias("_new_hi"),
        F.max(F.when(reached <= F.col("_inner"), F.col("_t"))).alias("_new_lo"),
    )
    return (
        state.join(bounded_broadcast(bounds, 2 * n_hot), "_which")
        .withColumn("_lo", F.coalesce("_new_lo", "_lo"))
        .withColumn("_hi", F.coalesce("_new_hi", "_hi"))
        .drop("_new_lo", "_new_hi")
        .select(*state.columns)
    )


def medcouple_leave_one_out(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Every row with the medcouple of the other rows of its group.

    Equal readings are combined first, and a group's distinct readings are scored together in O(n log n). A row without a
    finite reading is compared with the whole group. Groups of more than ``ARRAY_ROWS`` distinct readings don't travel as
    one array: their rows get the whole-group value, which ``medcouple_mode`` says ('cohort' instead of 'leave_one_out').
    """
    keys = list(keys)
    sizes = sizes or group_sizes(df, keys)
    limit = min(ARRAY_ROWS, _hot_limit(df, limit))
    usable = df.filter(R.finite(F.col(value)))
    runs = usable.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"))
    distinct = group_sizes(runs, keys)
    hot = None
    if distinct.is_hot(limit):
        hot = bounded_broadcast(pin(hot_keys(runs, keys, limit).select(*keys)), max(1, distinct.rows // limit))
        runs = runs.join(hot, keys, "left_anti")
    arrays = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col("_rows").alias("n")))).alias("_r"))
    each = F.arrays_zip(F.col("_r.v").alias("v"), medcouples_of_runs(F.col("_r.v"), F.col("_r.n")).alias("m"))
    scored = arrays.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.v").alias(value), F.col("_e.m").alias("medcouple"))
    out = usable if hot is None else usable.join(hot, keys, "left_anti")
    # Rows and scores are both as many as the readings; a value that a third of the rows share is split by AQE.
    out = out.join(scored, [*keys, value]).withColumn("medcouple_mode", F.lit("leave_one_out"))
    # Rows without a reading, and those of groups too large for an array.
    rest = df.filter(~R.finite(F.col(value)))
    if hot is not None:
        rest = rest.unionByName(usable.join(hot, keys, "left_semi"))
    some = usable.join(rest.select(*keys).distinct(), keys, "left_semi")
    whole = medcouple(some, keys, value, sizes=sizes).select(*keys, "medcouple")
    rest = lookup_join(rest, whole, keys)
    rest = rest.withColumn("medcouple", F.coalesce("medcouple", R.d(0.0))).withColumn("medcouple_mode", F.lit("cohort"))
    return out.select(*df.columns, "medcouple", "medcouple_mode").unionByName(rest.select(*df.columns, "medcouple", "medcouple_mode"))


def adjusted_boxplot(stats: DataFrame) -> DataFrame:
    """Add the skewness-adjusted fences to a table with q1, q3 and medcouple."""
    iqr = F.col("q3") - F.col("q1")
    return stats.withColumn("boxplot_low", R.boxplot_lower(F.col("q1"), iqr, F.col("medcouple"))).withColumn(
        "boxplot_high", R.boxplot_upper(F.col("q3"), iqr, F.col("medcouple"))
    )
