"""Joint distance in lots too large for one task: concentration steps and leave-one-out windows over the whole cluster.

Between steps a lot is its moments only. Exactly h rows are kept: rows below the h-th distance, and of those that tie with
it as many as are needed, in lexical order; the steps end when the kept rows, told by a digest, stay the same in every lot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions.loo import Widen, lot_from, score_some
from lotwise.functions.mcd import STEPS, chi2_isf, inverse
from lotwise.functions.robust import d
from lotwise.operators.ordered import bounded_broadcast, order_statistics, quantile_picks, quantiles, type7
from lotwise.session import pin, stage

# Points on either side of a cut that a leave-one-out window holds at first.
WINDOW = 400


@dataclass(frozen=True)
class Concentrated:
    """Scaled rows with their distance, and one row per lot: _size, scales, _mean and _cov of the kept rows, _half."""

    rows: DataFrame
    lots: DataFrame
    flat: DataFrame  # lots with a column that doesn't vary: keys, _size


def support(n: Column) -> Column:
    return F.ceil(n * d(K.MCD_SUPPORT))


def _cells(columns: Sequence[str]) -> list[Column]:
    return [*[F.col(c) for c in columns], *[F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i:]]]


def _full(columns: Sequence[str], sums: Sequence[Column]) -> Column:
    """Count, sums and all products as one array from the sums of ``_cells``."""
    p = len(columns)
    product = {}
    k = 1 + p
    for i in range(p):
        for j in range(i, p):
            product[i, j] = product[j, i] = sums[k]
            k += 1
    return F.array(*sums[: 1 + p], *[product[i, j] for i in range(p) for j in range(p)])


def _mean_cov(m: Column, p: int) -> tuple[Column, Column]:
    n = F.get(m, F.lit(0))
    mean = [F.get(m, F.lit(1 + i)) / n for i in range(p)]
    cov = [F.get(m, F.lit(1 + p + i * p + j)) / n - mean[i] * mean[j] for i in range(p) for j in range(p)]
    return F.array(*mean), F.array(*cov)


def _distance(columns: Sequence[str]) -> Column:
    p = len(columns)
    delta = [F.col(c) - F.get("_mean", F.lit(i)) for i, c in enumerate(columns)]
    total = d(0.0)
    for i in range(p):
        weight = d(0.0)
        for j in range(p):
            weight = weight + F.get("_prec", F.lit(i * p + j)) * delta[j]
        total = total + delta[i] * weight
    return F.greatest(d(0.0), total)


def _kept(dist: DataFrame, keys: list[str], columns: list[str], limit: int, n_hot: int) -> DataFrame:
    """Moments and digest of the h nearest rows of each lot."""
    cut = order_statistics(dist, keys, "_dist", {"_cut": lambda n: support(n) - 1}, limit=limit)
    cut = bounded_broadcast(pin(cut.select(*keys, "_cut", support(F.col("n")).alias("_h"))), n_hot)
    rows = dist.join(cut, keys)
    cells, mark = _cells(columns), F.xxhash64(*columns).cast("decimal(38,0)")
    names = [f"_a{i}" for i in range(1 + len(cells))]
    below = rows.filter("_dist < _cut").groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias(names[0]), *[F.sum(c).alias(n) for c, n in zip(cells, names[1:])], F.sum(mark).alias("_mark")
    )
    # Rows that tie with the h-th: equal ones are one row here, so what a window walks are distinct vectors at one distance.
    ties = rows.filter("_dist = _cut").groupBy(*keys, "_h", *columns).agg(F.count(F.lit(1)).alias("_k"))
    counts = bounded_broadcast(pin(below.select(*keys, F.col(names[0]).alias("_below"))), n_hot)
    ties = ties.join(counts, keys, "left")
    before = Window.partitionBy(*keys).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.col("_h") - F.coalesce("_below", d(0.0)) - F.coalesce(F.sum("_k").over(before), F.lit(0))
    ties = ties.withColumn("_w", F.greatest(d(0.0), F.least(F.col("_k").cast("double"), open_)))
    tied = ties.groupBy(*keys).agg(
        F.sum("_w").alias(names[0]), *[F.sum(F.col("_w") * c).alias(n) for c, n in zip(cells, names[1:])],
        F.sum(mark * F.col("_w").cast("decimal(20,0)")).cast("decimal(38,0)").alias("_mark"),
    )
    both = below.withColumn("_mark", F.col("_mark").cast("decimal(38,0)")).unionByName(tied).groupBy(*keys)
    out = both.agg(*[F.sum(n).alias(n) for n in names], F.sum("_mark").alias("_mark"))
    mean, cov = _mean_cov(_full(columns, [F.col(n) for n in names]), len(columns))
    return pin(out.select(*keys, mean.alias("_mean"), cov.alias("_cov"), F.col("_mark").cast("string").alias("_mark")))


def concentrate(rows: DataFrame, keys: list[str], columns: list[str], limit: int, n_hot: int) -> Concentrated:
    spread = [F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    shape = pin(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *spread))
    constant = F.lit(False)
    for c in columns:
        constant = constant | (F.col(f"_s_{c}") == 0)
    flat, shape = shape.filter(constant).select(*keys, "_size"), shape.filter(~constant)
    for c in columns:
        med = quantiles(rows.select(*keys, c), keys, c, {"_m": 0.5}, limit=limit).select(*keys, F.col("_m").alias(f"_m_{c}"))
        shape = shape.join(bounded_broadcast(pin(med), n_hot), keys)
    shape = pin(shape)
    scaled = rows.join(bounded_broadcast(shape, n_hot), keys)
    scaled = stage(scaled.select(*keys, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in columns]))
    near, start = scaled, d(0.0)
    for c in columns:
        mad = quantiles(scaled.select(*keys, F.abs(c).alias("_dev")), keys, "_dev", {"_d": 0.5}, limit=limit)
        near = near.join(bounded_broadcast(pin(mad.select(*keys, F.col("_d").alias(f"_d_{c}"))), n_hot), keys)
        start = start + F.pow(F.col(c) / F.when(F.col(f"_d_{c}") == 0, d(1.0)).otherwise(F.col(f"_d_{c}")), 2)
    dist = stage(near.select(*keys, *columns, start.alias("_dist")))
    seen = None
    for _ in range(STEPS):
        state = _kept(dist, keys, columns, limit, n_hot)
        if seen is not None:
            moved = state.select(*keys, "_mark").join(seen.select(*keys, F.col("_mark").alias("_was")), keys).filter("_mark <> _was")
            if moved.isEmpty():
                break
        seen = state
        metric = pin(state.select(*keys, "_mean", inverse("_cov").alias("_prec")))
        dist = stage(scaled.join(bounded_broadcast(metric, n_hot), keys).select(*keys, *columns, _distance(columns).alias("_dist")))
    half = order_statistics(dist.filter("_dist IS NOT NULL"), keys, "_dist", quantile_picks({"m": 0.5}), limit=limit)
    half = half.select(*keys, type7(F.col("n"), 0.5, F.col("m_lo"), F.col("m_hi")).alias("_half"))
    lots = shape.join(bounded_broadcast(seen.drop("_mark"), n_hot), keys).join(bounded_broadcast(pin(half), n_hot), keys, "left")
    return Concentrated(dist, pin(lots), flat)


def _ellipsoid(p: int) -> Column:
    """The distance at which the ellipsoid cuts."""
    return F.col("_half") / d(chi2_isf(0.5, p)) * d(chi2_isf(0.025, p))


def fit_hot(rows: DataFrame, keys: list[str], columns: list[str], limit: int, n_hot: int) -> DataFrame:
    """n, _mean, _prec and refusal_code of each lot, as the form for small lots gives them."""
    p = len(columns)
    found = concentrate(rows, keys, columns, limit, n_hot)
    lots = bounded_broadcast(found.lots, n_hot)
    inside = found.rows.join(lots.select(*keys, "_half"), keys)
    inside = inside.filter(F.col("_dist") / (F.col("_half") / d(chi2_isf(0.5, p))) < d(chi2_isf(0.025, p)))
    sums = [F.count(F.lit(1)).cast("double"), *[F.sum(c) for c in _cells(columns)]]
    names = [f"_a{i}" for i in range(len(sums))]
    final = inside.groupBy(*keys).agg(*[s.alias(n) for s, n in zip(sums, names)])
    mean, cov = _mean_cov(_full(columns, [F.col(n) for n in names]), p)
    final = final.select(*keys, mean.alias("_z"), cov.alias("_c")).select(*keys, "_z", inverse("_c").alias("_p"))
    back = found.lots.join(bounded_broadcast(pin(final), n_hot), keys, "left")
    centre = F.array(*[F.col(f"_m_{c}") + F.get("_z", F.lit(i)) * F.col(f"_s_{c}") for i, c in enumerate(columns)])
    prec = [F.get("_p", F.lit(i * p + j)) / (F.col(f"_s_{a}") * F.col(f"_s_{b}")) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    code = F.when(F.col("_p").isNull(), "SINGULAR_COVARIANCE")
    out = back.select(
        *keys, F.col("_size").cast("long").alias("n"), F.when(code.isNull(), centre).alias("_mean"), F.when(code.isNull(), F.array(*prec)).alias("_prec"),
        code.alias("refusal_code"),
    )
    none = F.lit(None).cast("array<double>")
    flat = found.flat.select(*keys, F.col("_size").cast("long").alias("n"), none.alias("_mean"), none.alias("_prec"), F.lit("SINGULAR_COVARIANCE").alias("refusal_code"))
    return out.unionByName(flat)


def _windows(found: Concentrated, keys: list[str], columns: list[str], limit: int, n_hot: int, width: int) -> DataFrame:
    """Of each lot, its figures and three windows."""
    p = len(columns)
    rows = found.rows.join(bounded_broadcast(found.lots.select(*keys, _ellipsoid(p).alias("_edge")), n_hot), keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_dist") < F.col("_edge")).alias("_inside"))
    counts = bounded_broadcast(pin(counts), n_hot)
    near = found.rows.join(counts, keys)
    with_count = [*keys, "_n", "_inside"]
    centre = {"s": support(F.col("_n")), "m": F.floor(F.col("_n") / 2), "e": F.col("_inside")}
    picks = {}
    for name, rank in centre.items():
        picks[f"_lo_{name}"] = lambda n, r=rank: F.least(n - 1, F.greatest(F.lit(0), r - width))
        picks[f"_hi_{name}"] = lambda n, r=rank: F.least(n - 1, r + width)
    cuts = bounded_broadcast(pin(order_statistics(near, with_count, "_dist", picks, limit=limit).drop("n")), n_hot)
    near = found.rows.join(cuts, keys)
    aggs, cells = [], _cells(columns)
    for w in centre:
        ahead, after = F.col("_dist") < F.col(f"_lo_{w}"), F.col("_dist") > F.col(f"_hi_{w}")
        sums = [F.count_if(ahead).cast("double"), *[F.coalesce(F.sum(F.when(ahead, c)), d(0.0)) for c in cells]]
        aggs += [
            # Twice the window and what ties with its ends.
            F.collect_list(F.when(~ahead & ~after, F.array(*columns))).alias(f"_points_{w}"), _full(columns, sums).alias(f"_before_{w}"),
            F.max(F.when(ahead, F.col("_dist"))).alias(f"_low_{w}"), F.min(F.when(after, F.col("_dist"))).alias(f"_high_{w}"),
        ]
    return pin(near.groupBy(*keys, "_n").agg(*aggs)).join(bounded_broadcast(found.lots, n_hot), keys)


def leave_one_out(rows: DataFrame, keys: list[str], columns: list[str], limit: int, n_hot: int) -> DataFrame:
    """Rows of hot lots with n, d2, contributions and refusal_code of the fit of all others of their lot."""
    found = concentrate(rows, keys, columns, limit, n_hot)
    width = WINDOW
    while True:
        out = stage(_score(rows, found, _windows(found, keys, columns, limit, n_hot, width), keys, columns, limit))
        if out.filter("refusal_code = 'WIDEN'").isEmpty():
            return out
        width *= 4


def _score(rows: DataFrame, found: Concentrated, lots: DataFrame, keys: list[str], columns: list[str], limit: int) -> DataFrame:
    kinds = dict(rows.dtypes)
    figures = F.struct(
        "_n", "_mean", "_cov", F.array(*[f"_m_{c}" for c in columns]).alias("m"), F.array(*[f"_s_{c}" for c in columns]).alias("s"),
        *[F.struct(f"_points_{w}", f"_before_{w}", f"_low_{w}", f"_high_{w}").alias(f"at_{w}") for w in "sme"],
    )
    salts = F.ceil(F.col("_n") / limit).cast("int")
    state = lots.select(*keys, salts.alias("_salts"), F.to_json(F.struct(figures.alias("f"))).alias("_lot"))
    flat = found.flat.select(*keys, F.ceil(F.col("_size") / limit).cast("int").alias("_salts"), F.lit("").alias("_lot"))
    state = pin(state.unionByName(flat))
    heads = state.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_lot")
    sized = rows.join(F.broadcast(state.select(*keys, "_salts")) if state.count() <= 10_000 else state.select(*keys, "_salts"), keys)
    dealt = sized.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int")).drop("_salts").withColumn("_lot", F.lit(None).cast("string"))
    both = dealt.unionByName(heads, allowMissingColumns=True).repartition(*keys, "_salt")
    both = both.sortWithinPartitions(*keys, "_salt", F.col("_lot").asc_nulls_last())
    names = rows.columns
    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + "".join(f", `c_{c}` double" for c in columns) + ", n bigint, d2 double, refusal_code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            starts = np.flatnonzero(batch["_lot"].notna().to_numpy())
            for a, b in zip([0, *starts], [*starts, len(batch)]):
                part = batch.iloc[a:b]
                if not len(part):
                    continue
                if part["_lot"].iloc[0] is not None:
                    state, part = _lot(part["_lot"].iloc[0]), part.iloc[1:]
                if len(part):
                    yield _scored(part[names], state, columns)

    return both.mapInPandas(run, out_schema)


def _lot(text: str):
    """(size, the lot, places, medians, scales), or None for a lot with a constant column."""
    if not text:
        return None
    f = json.loads(text)["f"]
    windows = [
        (np.array(f[f"at_{w}"][f"_points_{w}"], float), np.array(f[f"at_{w}"][f"_before_{w}"], float), f[f"at_{w}"].get(f"_low_{w}"), f[f"at_{w}"].get(f"_high_{w}"))
        for w in "sme"
    ]
    p = len(f["m"])
    try:
        lot, places = lot_from(int(f["_n"]), np.array(f["_mean"], float), np.array(f["_cov"], float).reshape(p, p), windows)
    except np.linalg.LinAlgError:
        return None
    return int(f["_n"]), lot, places, np.array(f["m"], float), np.array(f["s"], float)


def _scored(part: pd.DataFrame, state, columns: list[str]) -> pd.DataFrame:
    out = part.copy()
    code: str | None = "SINGULAR_COVARIANCE"
    parts = np.full((len(part), len(columns)), np.nan)
    if state is not None:
        n, lot, places, middle, scale = state
        try:
            parts, _, cov = score_some(lot, places, (part[columns].to_numpy(np.float64) - middle) / scale)
            code = None if (np.linalg.cond(cov) <= K.MCD_CONDITION).all() else code
        except Widen:
            code = "WIDEN"
        except np.linalg.LinAlgError:
            pass
    for j, c in enumerate(columns):
        out[f"c_{c}"] = parts[:, j]
    out["n"] = None if state is None else state[0] - 1
    out["d2"] = np.maximum(0.0, parts.sum(axis=1))
    out["refusal_code"] = code
    return out
