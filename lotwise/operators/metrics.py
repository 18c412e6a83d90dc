"""Places of readings in their cohort, nested readings, zonal limits, and how well a screen finds defects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.constants import MIN_ZONE_COHORT
from lotwise.operators import cohort as C
from lotwise.operators.ordered import GroupSizes, sorted_runs


def cohort_positions(rows: DataFrame, keys: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """One row per distinct value of a cohort: ``position`` (from 1, of equal values the first), ``members`` with that
    value, ``share_below`` (rows below over rows less one; null in a cohort of one)."""
    runs = sorted_runs(rows, keys, value, limit=limit)
    share = F.when(F.col("group_rows") > 1, F.col("run_start") / (F.col("group_rows") - 1))
    return runs.select(
        *keys, value, (F.col("run_start") + 1).cast("long").alias("position"), F.col("run_rows").cast("long").alias("members"), share.alias("share_below")
    )


def readings_map(rows: DataFrame, part_keys: Sequence[str]) -> DataFrame:
    """One row per part: ``readings``, a map of parameter to a map of hour to (value, status)."""
    reading = F.struct("elapsed_hours", F.struct("value", "status").alias("reading"))
    by_parameter = rows.groupBy(*part_keys, "parameter").agg(F.array_sort(F.collect_list(reading)).alias("_hours"))
    hours = F.map_from_entries(F.col("_hours"))
    return by_parameter.groupBy(*part_keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", F.col("_hours"))))).alias("_all")
    ).select(*part_keys, F.transform_values("_all", lambda _, v: F.map_from_entries(v)).alias("readings"))


def zonal_limits(
    rows: DataFrame, keys: Sequence[str], zone: str, value: str, k: float, least: int = MIN_ZONE_COHORT, sizes: GroupSizes | None = None
) -> DataFrame:
    """Limits ``median ± k sigma`` of each (cohort, zone) with at least ``least`` readings; smaller zones have none."""
    keys = [*keys, zone]
    stats = C.lot_statistics(rows, keys, value, sizes=sizes)
    usable = (F.col("n") >= least) & F.col("refusal_code").isNull()
    low, high = F.col("median") - k * F.col("robust_sigma"), F.col("median") + k * F.col("robust_sigma")
    return stats.select(*keys, "n", F.when(usable, low).alias("zone_low"), F.when(usable, high).alias("zone_high"))


def screening_metrics(parts: DataFrame, flagged: Column, defect: Column, group: str) -> DataFrame:
    """Per group and over all (group null): parts, flags, defects, recall, false positive rate, flag rate, precision, F2.

    A rate without a denominator is null.
    """
    hit = parts.select(F.col(group).alias("group"), flagged.cast("int").alias("f"), defect.cast("int").alias("d"))
    counts = hit.rollup("group").agg(
        F.grouping("group").alias("_all"), F.count(F.lit(1)).alias("n"), F.sum("f").alias("n_flagged"), F.sum("d").alias("n_defect"), F.sum(F.col("f") * F.col("d")).alias("tp")
    )
    recall, precision = F.try_divide("tp", "n_defect"), F.try_divide("tp", "n_flagged")
    return counts.select(
        F.when(F.col("_all") == 0, F.col("group")).alias("group"), "n", "n_flagged", "n_defect", "tp", recall.alias("recall"),
        F.try_divide(F.col("n_flagged") - F.col("tp"), F.col("n") - F.col("n_defect")).alias("false_positive_rate"),
        F.try_divide("n_flagged", "n").alias("flag_rate"), precision.alias("precision"),
        F.try_divide(5 * precision * recall, 4 * precision + recall).alias("f2"),
    )
