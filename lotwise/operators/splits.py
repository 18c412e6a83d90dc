"""Lot-disjoint train / calibration / test splits and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.ordered import checked_broadcast, sorted_runs

SEED = 20260930
MIN_CALIB_PARTS = 50
# Special lots that always go to one side
TO_TEST = ("zero_iqr", "single_part", "tiny_n", "tester_drift")
TO_TRAIN = ("unit_inconsistent",)


def assign_splits(
    lots: DataFrame, seed: int = SEED, shares: tuple[float, float] = (0.6, 0.2), limit: int | None = None
) -> DataFrame:
    """lots(lot_id, component_type, n_parts[, special_type]) with a split, the same on every run.

    ``shares`` of all lots are train and calib, the rest test, each count rounded once for the whole table and met exactly
    unless special lots alone exceed it. Special lots go first: guards to test, one lot_shift lot to train and the others to
    test. Normal lots are laid out type by type and each type's block takes its even part of what every split still wants,
    so a type is off its share by less than one lot. Within a type lots go by (fewer than 50 parts, keyed hash): calibration
    takes the first of them, test the next, train the rest.
    """
    special = F.col("special_type") if "special_type" in lots.columns else F.lit(None).cast("string")
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("lot_id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10)
    late = F.when(F.col("n_parts") < MIN_CALIB_PARTS, F.lit(float(2**48))).otherwise(F.lit(0.0))
    keyed = lots.withColumn("_special", special).withColumn("_hash", digest.cast("double")).withColumn("_place", F.col("_hash") + late)
    shifted = keyed.filter("_special = 'lot_shift'").agg(F.min(F.struct("_hash", "lot_id")).alias("_s")).select(F.col("_s.lot_id").alias("_trained"))
    keyed = keyed.join(F.broadcast(shifted), how="left")
    fixed = (
        F.when(F.col("_special").isin(*TO_TEST), "test")
        .when(F.col("_special") == "lot_shift", F.when(F.col("lot_id") == F.col("_trained"), "train").otherwise("test"))
        .when(F.col("_special").isin(*TO_TRAIN), "train")
    )
    keyed = keyed.withColumn("_fixed", fixed)
    # One row per type: where its block of normal lots begins, and what each split wants over all.
    normal = F.col("_fixed").isNull()
    types = keyed.groupBy("component_type").agg(
        F.count_if(normal).alias("_m"), F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("_fixed") == s).alias(f"_{s}") for s in ("train", "calib", "test")]
    )
    whole = types.agg(*[F.sum(c).alias(c) for c in ("_m", "_all", "_train", "_calib", "_test")])
    n, train, calib = F.col("_all"), F.round(F.col("_all") * shares[0]), F.round(F.col("_all") * shares[1])
    wants = whole.select(
        F.col("_m").alias("_rest"), F.least(F.col("_m"), F.greatest(F.lit(0), calib - F.col("_calib"))).cast("long").alias("_want_calib"),
        F.greatest(F.lit(0), n - train - calib - F.col("_test")).cast("long").alias("_want_test"),
        F.greatest(F.lit(0), train - F.col("_train")).cast("long").alias("_want_train"),
    )
    left = F.col("_rest") - F.col("_want_calib")
    # Where special lots exceed a split, what is left is shared in the ratio that the others still want.
    want_test = F.when(F.col("_want_test") + F.col("_want_train") > 0, F.floor(left * F.col("_want_test") / (F.col("_want_test") + F.col("_want_train")) + 0.5)).otherwise(F.lit(0))
    wants = wants.select("_rest", "_want_calib", want_test.cast("long").alias("_want_test"))
    block = Window.orderBy("component_type").rowsBetween(Window.unboundedPreceding, -1)
    # A type is a row here, so this window is as small as the domain of types.
    at = types.select("component_type", "_m", F.coalesce(F.sum("_m").over(block), F.lit(0)).alias("_from")).join(F.broadcast(wants))

    def part(start: Column, end: Column, want: Column, of: Column) -> Column:
        """How many of the places from ``start`` to before ``end`` an even spread of ``want`` over ``of`` places takes."""
        whole = F.nullif(of, F.lit(0))
        return F.coalesce(F.floor(end * want / whole) - F.floor(start * want / whole), F.lit(0))

    begin, end = F.col("_from"), F.col("_from") + F.col("_m")
    nothing = F.lit(0)
    calibs_before = part(nothing, begin, F.col("_want_calib"), F.col("_rest"))
    calibs_upto = part(nothing, end, F.col("_want_calib"), F.col("_rest"))
    tests = part(begin - calibs_before, end - calibs_upto, F.col("_want_test"), F.col("_rest") - F.col("_want_calib"))
    quota = at.select("component_type", (calibs_upto - calibs_before).alias("_c"), tests.alias("_t"))
    order = sorted_runs(keyed.filter(normal), ["component_type"], "_place", limit=limit).select(
        "component_type", "_place", F.col("run_start").alias("_rank")
    )
    out = keyed.join(order, ["component_type", "_place"], "left").join(checked_broadcast(quota), "component_type")
    dealt = F.when(F.col("_rank") < F.col("_c"), "calib").when(F.col("_rank") < F.col("_c") + F.col("_t"), "test").otherwise("train")
    return out.select(*lots.columns, F.coalesce("_fixed", dealt).alias("split"))


def type_counts(assigned: DataFrame) -> DataFrame:
    """Lots, parts, special lots and lots too small for calibration of each (type, split)."""
    special = F.col("special_type") if "special_type" in assigned.columns else F.lit(None).cast("string")
    return assigned.groupBy("component_type", "split").agg(
        F.count(F.lit(1)).alias("n_lots"), F.sum("n_parts").alias("n_parts"), F.count(special).alias("n_special"),
        F.count_if(F.col("n_parts") < MIN_CALIB_PARTS).alias("n_small"),
    )


def overlaps(rows: DataFrame) -> DataFrame:
    """Lots shared by two splits, per pair; a sound split has none."""
    pairs = [("train", "calib"), ("train", "test"), ("calib", "test")]
    out = None
    for a, b in pairs:
        lots = rows.filter(F.col("split") == a).select("lot_id").intersect(rows.filter(F.col("split") == b).select("lot_id"))
        part = lots.agg(F.count(F.lit(1)).alias("shared_lots")).select(F.lit(f"{a}/{b}").alias("pair"), "shared_lots")
        out = part if out is None else out.unionByName(part)
    return out


def split_counts(rows: DataFrame) -> DataFrame:
    """Lots, parts and rows of each split; distinct keys are combined before they are counted."""
    lots = rows.select("split", "lot_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_lots"))
    parts = rows.select("split", "lot_id", "component_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_parts"))
    total = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return lots.join(parts, "split").join(total, "split")
