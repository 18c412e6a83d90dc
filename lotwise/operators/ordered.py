"""Exact order statistics, ranks and cumulative counts per group, safe for hot groups.

A group that fits in one task is sorted by a window. A larger (hot) group is cut into value buckets: approximate
quantiles (a mergeable sketch) give the cut points, exact bucket counts give the offsets, and only then are rows
sorted, bucket by bucket. The cut points steer the work only; every result is exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import broadcast_rows, hot_rows, pin, stage

MAX_BUCKETS = 10_000
SPLITS_PER_HOT = 4
# Rows a dealt group must have on average; lookup tables of such groups fit in memory, task by task
LEAST_DEALT = 50
# Distinct values that one task sorts when they are ranked over all
RUN_ROWS = 1_000_000
# Rows of a group that are gathered and sorted as one array; larger ones are sorted by a window, which spills
GATHERED_ROWS = 10_000
# Accuracy of the sketch that brackets wanted quantiles, and how far from them the brackets end; beyond the sketch's error
BRACKET_ACCURACY = 1_000
BRACKET_REACH = 0.0025


@dataclass(frozen=True)
class GroupSizes:
    """Number of groups, rows of the largest one, rows in all."""

    groups: int
    largest: int
    rows: int

    def is_hot(self, limit: int) -> bool:
        return self.largest > limit


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """One pass over the key columns; three numbers reach the driver."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counted.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    return GroupSizes(int(row[0]), int(row[1] or 0), int(row[2] or 0))


def _hot_limit(df: DataFrame, limit: int | None) -> int:
    return hot_rows(df.sparkSession) if limit is None else limit


def deal(df: DataFrame, by: str, limit: int | None = None) -> tuple[DataFrame, GroupSizes] | None:
    """Rows hashed by ``by`` alone, so that whatever groups within it needs no further shuffle; None if that is no good.

    Meant for rows that are multiplied later. It takes many groups of some size, none hot or larger than a core's share.
    """
    sizes = group_sizes(df, [by])
    cores = df.sparkSession.sparkContext.defaultParallelism
    fits = not sizes.is_hot(_hot_limit(df, limit)) and sizes.largest * cores <= sizes.rows
    return (df.repartition(by), sizes) if fits and sizes.groups * LEAST_DEALT <= sizes.rows else None


def bounded_broadcast(table: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the known row count allows it."""
    return F.broadcast(table) if rows <= broadcast_rows(table.sparkSession) else table


def checked_broadcast(table: DataFrame) -> DataFrame:
    """Hint a broadcast after counting the table's rows, as far as the bound."""
    most = broadcast_rows(table.sparkSession)
    return bounded_broadcast(table, table.limit(most + 1).count())


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; at most rows / limit of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n")).filter(F.col("_hot_n") > limit)


def bucketed(
    df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None, sizes: GroupSizes | None = None, around: Sequence[float] = ()
) -> tuple[DataFrame, bool]:
    """Add ``_bucket``: 0 in ordinary groups, a value range number (ascending with ``order``) in hot ones.

    Ranges hold about as many rows each, or, where only the quantiles ``around`` some probabilities are wanted, each of these
    lies in a narrow one; a row is then compared with few cuts.
    """
    limit = _hot_limit(df, limit)
    sizes = sizes or group_sizes(df, keys)
    if not sizes.is_hot(limit):
        return df.withColumn("_bucket", F.lit(0)), False
    pieces = min(MAX_BUCKETS, SPLITS_PER_HOT * math.ceil(sizes.largest / limit))
    hot = hot_keys(df, keys, limit)
    n_hot = max(1, sizes.rows // limit)
    if around:
        ends = sorted({BRACKET_REACH, *(min(1.0, max(0.0, p + side * BRACKET_REACH)) for p in around for side in (-1, 1))})
        cuts = df.join(bounded_broadcast(hot, n_hot), list(keys), "inner").groupBy(*keys).agg(
            F.percentile_approx(order, F.array(*[F.lit(p) for p in ends]), F.lit(BRACKET_ACCURACY)).alias("_cuts")
        )
        cuts = pin(cuts.select(*keys, *[F.get("_cuts", F.lit(i)).alias(f"_cut{i}") for i in range(len(ends))]))
        names = [f"_cut{i}" for i in range(len(ends))]
        bucket = sum((F.when(F.col(name) < F.col(order), 1).otherwise(0) for name in names), F.lit(0))
        return df.join(bounded_broadcast(cuts, n_hot), list(keys), "left").withColumn("_bucket", bucket).drop(*names), True
    probabilities = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    wanted = F.ceil(F.col("_hot_n") / F.lit(limit)) * SPLITS_PER_HOT
    step = F.greatest(F.lit(1), F.floor(F.lit(pieces) / wanted)).cast("int")
    cuts = (
        df.join(bounded_broadcast(hot, n_hot), list(keys), "inner")
        .groupBy(*keys)
        .agg(
            F.percentile_approx(order, probabilities, F.lit(4 * pieces)).alias("_cuts"),
            F.max("_hot_n").alias("_hot_n"),
        )
        .withColumn("_step", step)
        .select(*keys, F.array_distinct(F.expr("filter(_cuts, (c, i) -> i % _step = 0)")).alias("_cuts"))
    )
    cuts = pin(cuts)
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    out = df.join(bounded_broadcast(cuts, n_hot), list(keys), "left")
    return out.withColumn("_bucket", F.when(F.col("_cuts").isNull(), 0).otherwise(bucket)).drop("_cuts"), True


def bucket_offsets(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows of the group below each bucket (``_below``) and in all (``group_rows``)."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, "_bucket").agg(total.alias("_in_bucket"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_below", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).withColumn(
        "group_rows", F.sum("_in_bucket").over(w)
    )


def sorted_runs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """One row per distinct value of a group: ``run_rows`` equal rows, ``run_start`` rows strictly below,
    ``group_rows`` in the group. Equal values are combined before the shuffle."""
    limit = _hot_limit(df, limit)
    sizes = sizes or group_sizes(df, keys)
    amount = F.lit(1) if weight is None else F.col(weight)
    if not sizes.is_hot(limit):
        runs = df.groupBy(*keys, value).agg(F.sum(amount).alias("run_rows"))
        w = Window.partitionBy(*keys)
        before = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return runs.withColumn("run_start", F.coalesce(F.sum("run_rows").over(before), F.lit(0))).withColumn(
            "group_rows", F.sum("run_rows").over(w)
        )
    cut, _ = bucketed(df, keys, value, limit, sizes)
    runs = cut.groupBy(*keys, "_bucket", value).agg(F.sum(amount).alias("run_rows"))
    offsets = bucket_offsets(cut, keys, amount)
    before = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("_local", F.coalesce(F.sum("run_rows").over(before), F.lit(0)))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("run_start", F.col("_below") + F.col("_local"))
        .select(*keys, value, "run_rows", "run_start", "group_rows")
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: Mapping[str, Callable[[Column], Column]],
    small_upto: int = 0,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
    around: Sequence[float] = (),
) -> DataFrame:
    """Per group: ``n`` and the values at the 0-based sorted positions ``picks[name](n)`` (NULL when out of range).

    With ``small_upto`` the sorted values of groups of at most that many rows come along as ``small``. Positions known to lie
    ``around`` some probabilities take fewer buckets.
    """
    limit = _hot_limit(df, limit)
    sizes = sizes or group_sizes(df, keys)
    rows = df.select(*keys, value)
    n = F.col("group_rows")
    if sizes.largest <= min(limit, GATHERED_ROWS):
        return _gathered_statistics(rows, keys, value, picks, small_upto)
    if not sizes.is_hot(limit):
        w = Window.partitionBy(*keys)
        ranked = rows.withColumn("run_start", F.row_number().over(w.orderBy(value)) - 1).withColumn(
            "group_rows", F.count(F.lit(1)).over(w)
        )
        kept = ranked.withColumn("run_rows", F.lit(1))
    else:
        cut, _ = bucketed(rows, keys, value, limit, sizes, around)
        offsets = bucket_offsets(cut, keys)
        if around:  # few rows, which are joined and counted
            offsets = pin(offsets)
        position_in = [
            (fn(n) >= F.col("_below")) & (fn(n) < F.col("_below") + F.col("_in_bucket")) for fn in picks.values()
        ]
        wanted = position_in[0]
        for condition in position_in[1:]:
            wanted = wanted | condition
        if small_upto:
            wanted = wanted | (n <= small_upto)
        # Only buckets that hold a wanted position are sorted at all. One bucket row per group keeps n alive.
        needed = offsets.filter(F.coalesce(wanted, F.lit(False)) | (F.col("_below") == 0))
        needed = bounded_broadcast(needed, sizes.groups * (len(picks) + 1))
        runs = cut.join(needed, [*keys, "_bucket"]).groupBy(
            *keys, "_bucket", value, "_below", "group_rows"
        ).agg(F.count(F.lit(1)).alias("run_rows"))
        before = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        kept = runs.withColumn(
            "run_start", F.col("_below") + F.coalesce(F.sum("run_rows").over(before), F.lit(0))
        )
    hit = {
        name: F.max(
            F.when((fn(n) >= F.col("run_start")) & (fn(n) < F.col("run_start") + F.col("run_rows")), F.col(value))
        )
        for name, fn in picks.items()
    }
    extra = []
    if small_upto:
        repeated = F.when(n <= small_upto, F.array_repeat(F.col(value), F.col("run_rows").cast("int")))
        extra.append(F.sort_array(F.flatten(F.collect_list(repeated))).alias("small"))
    return kept.groupBy(*keys).agg(F.max("group_rows").alias("n"), *[c.alias(k) for k, c in hit.items()], *extra)


def _gathered_statistics(
    rows: DataFrame, keys: Sequence[str], value: str, picks: Mapping[str, Callable[[Column], Column]], small_upto: int
) -> DataFrame:
    """``order_statistics`` of groups small enough to be arrays; missing values come first, as in a window."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(value)).alias("_sorted"))
    groups = groups.withColumn("_missing", (F.col("n") - F.size("_sorted")).cast("int"))
    n = F.col("n")
    found = [F.get("_sorted", fn(n).cast("int") - F.col("_missing")).alias(name) for name, fn in picks.items()]
    extra = []
    if small_upto:
        whole = F.concat(F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.col("_missing")), F.col("_sorted"))
        extra.append(F.when(n <= small_upto, whole).otherwise(F.slice("_sorted", 1, 0)).alias("small"))
    return groups.select(*keys, "n", *found, *extra)


def quantile_picks(probabilities: Mapping[str, float]) -> dict[str, Callable[[Column], Column]]:
    """Lower and upper neighbours of Type-7 quantiles as order-statistic picks."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probabilities.items():
        picks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        picks[f"{name}_hi"] = lambda n, p=p: F.least(n - 1, F.floor((n - 1) * F.lit(p)) + 1)
    return picks


def type7(n: Column, p: float, low: Column, high: Column) -> Column:
    position = (n - 1) * F.lit(p)
    return low + (high - low) * (position - F.floor(position))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Exact Type-7 quantiles per group, with ``n``."""
    stats = order_statistics(df, keys, value, quantile_picks(probabilities), limit=limit, sizes=sizes, around=list(probabilities.values()))
    return stats.select(
        *keys,
        "n",
        *[
            type7(F.col("n"), p, F.col(f"{name}_lo"), F.col(f"{name}_hi")).alias(name)
            for name, p in probabilities.items()
        ],
    )


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rank: str = "avg_rank",
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Rows with their 1-based average rank inside the group (ties share the mean rank)."""
    limit = _hot_limit(df, limit)
    sizes = sizes or group_sizes(df, keys)
    if not sizes.is_hot(limit):
        w = Window.partitionBy(*keys).orderBy(value)
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(rank, F.rank().over(w) + (ties - 1) / 2)
    runs = sorted_runs(df, keys, value, limit=limit, sizes=sizes)
    ranks = runs.select(*keys, value, (F.col("run_start") + (F.col("run_rows") + 1) / 2).alias(rank))
    return df.join(ranks, [*keys, value])


def with_rank(
    rows: DataFrame, keys: Sequence[str], value: str, rank: str, limit: int | None = None, weight: str | None = None
) -> DataFrame:
    """Rows with their average rank, looked up by value; rows without a value are left out.

    A row counts as ``weight`` equal ones. Distinct values are kept as a table first, and only they are sorted. Few of them are broadcast back to the rows.
    """
    keys = list(keys)
    limit = min(_hot_limit(rows, limit), RUN_ROWS)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    runs = stage(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("run_rows")))
    total = runs.agg(F.count(F.lit(1)), F.max("run_rows"), F.sum("run_rows")).first()
    table = sorted_runs(runs, keys, value, weight="run_rows", limit=limit)
    table = stage(table.select(*keys, value, (F.col("run_start") + (F.col("run_rows") + 1) / 2).alias(rank)))
    return lookup_join(rows, table, [*keys, value], GroupSizes(int(total[0]), int(total[1] or 0), int(total[2] or 0)), "inner")


def locate(
    reference: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    value: str,
    limit: int | None = None,
) -> DataFrame:
    """For each distinct probe value: reference rows ``below`` it, ``upto`` it, and ``reference_rows`` in the group."""
    both = reference.select(*keys, value, F.lit(1).alias("_w")).unionByName(
        probes.select(*keys, value, F.lit(0).alias("_w")).distinct()
    )
    runs = sorted_runs(both, keys, value, weight="_w", limit=limit)
    located = runs.select(
        *keys,
        value,
        F.col("run_start").alias("below"),
        (F.col("run_start") + F.col("run_rows")).alias("upto"),
        F.col("group_rows").alias("reference_rows"),
    )
    return probes.select(*keys, value).distinct().join(located, [*keys, value])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    sizes: GroupSizes | None = None,
    how: str = "left",
    limit: int | None = None,
    salts: int = 64,
    by: Sequence[str] = (),
    where: str | None = None,
) -> DataFrame:
    """Join rows to a one-row-per-key table.

    Few keys: broadcast. Many keys, none hot: plain shuffle join. Many keys, some hot: rows of hot keys are spread
    over ``salts`` copies of their table row; other keys are not copied. Rows dealt ``by`` some of the keys stay where
    they are, whatever the number of keys; with a condition ``where``, only rows that meet it look something up there.
    """
    if by:
        return _dealt_join(rows, table, keys, list(by), how, where)
    limit = _hot_limit(rows, limit)
    sizes = sizes or group_sizes(rows, keys)
    keys = list(keys)
    if sizes.groups <= broadcast_rows(rows.sparkSession):
        return rows.join(F.broadcast(table), keys, how)
    if not sizes.is_hot(limit):
        return rows.join(table, keys, how)
    hot = pin(hot_keys(rows, keys, limit).select(*keys, F.lit(True).alias("_is_hot")))
    n_hot = max(1, sizes.rows // limit)
    salted_rows = rows.join(bounded_broadcast(hot, n_hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_is_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    copies = F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_table = (
        table.join(bounded_broadcast(hot, n_hot), keys, "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_is_hot")
    )
    return salted_rows.drop("_is_hot").join(salted_table, [*keys, "_salt"], how).drop("_salt")


def _dealt_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: list[str], how: str, where: str | None = None) -> DataFrame:
    """Join by the dealt keys alone: all of the table that belongs to them is one row, in which the other keys are looked up."""
    rest = [k for k in keys if k not in by]
    columns = [c for c in table.columns if c not in keys]
    entry = F.struct(F.struct(*rest).alias("key"), F.struct(*columns).alias("found"))
    nested = table.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_nested"))
    joined = rows.join(nested.hint("shuffle_hash"), by, how)
    found = f"_nested[named_struct({', '.join(f"'{k}', `{k}`" for k in rest)})]"
    if where is not None:
        found = f"CASE WHEN {where} THEN {found} END"
    if how == "inner":
        joined = joined.filter(f"{found} IS NOT NULL")
    return joined.selectExpr(*[f"`{c}`" for c in rows.columns], f"inline(array({found})) AS ({', '.join(f'`{c}`' for c in columns)})")
