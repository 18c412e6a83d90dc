"""Joint distance of a part from its lot, with exact additive contributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import mcd
from lotwise.functions.loo import against_others
from lotwise.functions.robust import d, finite
from lotwise.operators import joint_hot
from lotwise.operators.ordered import (
    GroupSizes,
    _hot_limit,
    bounded_broadcast,
    group_sizes,
    hot_keys,
    lookup_join,
)
from lotwise.session import pin

# Rows of one lot that one task may fit in memory.
FIT_ROWS = 200_000


def complete_vectors(rows: DataFrame, part_keys: Sequence[str], parameters: Sequence[str]) -> DataFrame:
    """One row per part with a column per parameter; parts that lack a parameter are left out."""
    wide = rows.groupBy(*part_keys).pivot("parameter", list(parameters)).agg(F.min("value"))
    return wide.dropna("any", subset=list(parameters))


def _finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(F.col(c))
    return df.filter(keep)


def _moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], sample: bool) -> DataFrame:
    """Mean vector and row-major covariance of each group, by aggregates that combine before the shuffle."""
    covar = F.covar_samp if sample else F.covar_pop
    cells = {}
    for i, a in enumerate(columns):
        for b in columns[i:]:
            cells[a, b] = covar(a, b)
    flat = [cells.get((a, b), cells.get((b, a))) for a in columns for b in columns]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in columns]).alias("_mean"), F.array(*flat).alias("_cov")
    )


def _algebra(columns: Sequence[str]) -> tuple[Column, list[Column]]:
    """(D squared, contributions) from _mean and _prec; contribution q is delta_q * (P delta)_q."""
    p = len(columns)
    delta = [F.col(c) - F.get("_mean", F.lit(i)) for i, c in enumerate(columns)]
    parts = []
    for i in range(p):
        weight = d(0.0)
        for j in range(p):
            weight = weight + F.get("_prec", F.lit(i * p + j)) * delta[j]
        parts.append(delta[i] * weight)
    total = parts[0]
    for c in parts[1:]:
        total = total + c
    return total, parts


def _score(rows: DataFrame, fits: DataFrame, keys: Sequence[str], columns: Sequence[str], sizes: GroupSizes) -> DataFrame:
    out = lookup_join(rows, fits, keys, sizes)
    d2, parts = _algebra(columns)
    out = out.withColumn("d2", F.greatest(d(0.0), d2)).withColumns({f"c_{c}": part for c, part in zip(columns, parts)})
    return out.withColumn("p_value", mcd.chi2_tail("d2", len(columns))).drop("_mean", "_prec")


def classical(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mahalanobis distance with the plain mean and sample covariance of the lot."""
    rows = _finite_rows(df, columns)
    sizes = group_sizes(rows, keys)
    fits = _moments(rows, keys, columns, sample=True)
    fits = fits.select(*keys, F.col("_n").alias("n"), "_mean", mcd.inverse("_cov").alias("_prec"))
    few = F.col("n") <= len(columns)
    out = _score(rows, fits, keys, columns, sizes)
    return out.withColumn(
        "refusal_code", F.when(few, "INSUFFICIENT_COHORT").when(F.col("d2").isNull(), "SINGULAR_COVARIANCE")
    )


def robust(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    mode: str = "shared",
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Robust distance d2, p_value and contributions c_<column> of every complete row.

    ``shared`` fits each lot once and scores all its parts; ``exact`` compares each part with the fit of all others of
    its lot, concentrated on from the lot's own fit. Lots of more than ``limit`` rows are concentrated over the cluster,
    by the same steps to the same end. Refusals (``refusal_code``) leave d2 empty.
    """
    keys, columns = list(keys), list(columns)
    rows = _finite_rows(df, columns)
    limit = min(FIT_ROWS, _hot_limit(df, limit))
    sizes = sizes or group_sizes(rows, keys)
    n_hot = max(1, sizes.rows // limit)
    hot = bounded_broadcast(pin(hot_keys(rows, keys, limit).select(*keys)), n_hot) if sizes.is_hot(limit) else None
    small = rows if hot is None else rows.join(hot, keys, "left_anti")
    big = None if hot is None else rows.join(hot, keys, "left_semi")
    if mode == "exact":
        out = _leave_one_out(small, keys, columns)
        if big is not None:
            out = out.unionByName(joint_hot.leave_one_out(big, keys, columns, limit, n_hot))
        return out.withColumn("p_value", mcd.chi2_tail("d2", len(columns))).withColumn("fit_mode", F.lit("exact"))
    fits = _fit_small(small, keys, columns)
    if big is not None:
        fits = fits.unionByName(joint_hot.fit_hot(big, keys, columns, limit, n_hot))
    return _score(rows, fits, keys, columns, sizes).withColumn("fit_mode", F.lit("shared"))


def _fit_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (
        ", n bigint, _mean array<double>, _prec array<double>, refusal_code string"
    )


def _fit_small(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    fit_rows = mcd.fit

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        code, centre, cov = fit_rows(pdf[columns].to_numpy(dtype=np.float64))
        prec = None if code else np.linalg.inv(cov)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out["n"] = [len(pdf)]
        out["_mean"] = [None if code else centre.tolist()]
        out["_prec"] = [None if code else ((prec + prec.T) / 2).ravel().tolist()]
        out["refusal_code"] = [code]
        return pd.DataFrame(out)

    return _by_lot(rows.select(*keys, *columns), keys).groupBy(*keys).applyInPandas(fit, _fit_schema(rows, keys))


def _by_lot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows hashed by lot to a fixed number of tasks: a lot's bytes are few but its fit is long, so tasks must not be merged by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _leave_one_out(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of lots that fit in a task, each against the fit of the others."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + "".join(f", `c_{c}` double" for c in columns)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        parts, codes = against_others(pdf[columns].to_numpy(dtype=np.float64))
        for j, c in enumerate(columns):
            out[f"c_{c}"] = parts[:, j]
        out["n"] = len(pdf) - 1
        out["d2"] = np.maximum(0.0, parts.sum(axis=1))
        out["refusal_code"] = codes
        return out

    return _by_lot(rows, keys).groupBy(*keys).applyInPandas(score, kinds + ", n bigint, d2 double, refusal_code string")


def top_contributions(scored: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Largest contributions by absolute size, and whether all of them add up to d2."""
    items = F.array(
        *[F.struct(F.abs(f"c_{c}").alias("size"), F.lit(c).alias("parameter"), F.col(f"c_{c}").alias("contribution")) for c in columns]
    )
    total = F.col(f"c_{columns[0]}")
    for c in columns[1:]:
        total = total + F.col(f"c_{c}")
    top = F.slice(F.sort_array(items, asc=False), 1, k)
    return scored.withColumn("top", top).withColumn(
        "adds_up", F.abs(total - F.col("d2")) <= K.SUM_TOLERANCE * F.greatest(d(1.0), F.col("d2"))
    )
