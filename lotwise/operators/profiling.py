"""Dataset profile: marginals, variance components, correlations, leakage, imperfections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions.robust import d
from lotwise.operators.ordered import average_ranks, quantiles, with_rank
from lotwise.session import stage


def marginals(rows: DataFrame, keys: Sequence[str], value: str, limit: int | None = None) -> DataFrame:
    """Moments, quartiles and adjusted skewness of each parameter."""
    n = F.count(value)
    adjust = F.sqrt(n.cast("double") * (n - 1)) / F.nullif(n - 2, F.lit(0))
    moments = rows.groupBy(*keys).agg(
        n.alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.when((n > 2) & (F.stddev_pop(value) > 0), F.skewness(value) * adjust).otherwise(d(0.0)).alias("skewness"),
    )
    q = quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit=limit).drop("n")
    out = moments.join(q, list(keys))
    iqr = F.col("q3") - F.col("q1")
    return out.withColumn("iqr", iqr).withColumn("robust_sigma", iqr / d(K.IQR_DIVISOR))


def variance_components(rows: DataFrame, keys: Sequence[str], lot: str, value: str) -> DataFrame:
    """Variance of lot means against the mean variance inside lots."""
    lots = rows.groupBy(*keys, lot).agg(F.avg(value).alias("_mean"), F.var_samp(value).alias("_var"))
    out = lots.groupBy(*keys).agg(
        F.var_pop("_mean").alias("between_variance"), F.avg("_var").alias("within_variance"), F.count(F.lit(1)).alias("n_lots")
    )
    return out.withColumn("sigma_ratio", F.sqrt("between_variance") / F.nullif(F.sqrt("within_variance"), d(0.0)))


def correlations(
    wide: DataFrame, part: str, columns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Pearson and Spearman of every pair of columns over complete rows, long format."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = stage(wide.select(*columns))
    ranks = wide.withColumn("_all", F.lit(0))
    for c in columns:
        ranks = with_rank(ranks, ["_all"], c, f"_rank_{c}", limit)
    ranks = ranks.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])

    def matrix(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
        items = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
        return one.selectExpr(f"stack({len(pairs)}, {items}) AS (first, second, {name})")

    return matrix(wide, "pearson").join(matrix(ranks, "spearman"), ["first", "second"])


def leakage(rows: DataFrame, part: Sequence[str], columns: Sequence[str], target: str, limit: int | None = None) -> DataFrame:
    """Spearman of each screening column with a late value; large values mean the column knows the future."""
    columns = list(columns)
    spec = ", ".join(f"'{c}', `{c}`" for c in [*columns, target])
    long = rows.selectExpr(*part, f"stack({len(columns) + 1}, {spec}) AS (_column, _value)")
    ranked = average_ranks(long, ["_column"], "_value", limit=limit)
    wide = ranked.groupBy(*part).pivot("_column", [*columns, target]).agg(F.max("avg_rank"))
    one = wide.agg(*[F.corr(c, target).alias(c) for c in columns])
    items = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {items}) AS (column, spearman)")


def spearman(
    rows: DataFrame, part: Sequence[str], keys: Sequence[str], a: str, b: str, limit: int | None = None
) -> DataFrame:
    """Rank correlation of two columns inside each group (at least three rows)."""
    pairs = rows.select(F.struct(*keys).alias("_group"), a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = with_rank(with_rank(pairs, ["_group"], b, "_rb", limit), ["_group"], a, "_ra", limit)
    out = ranked.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))
    return out.select("_group.*", "n", F.when(F.col("n") >= K.MIN_COHORT, F.col("rho")).alias("rho"))


def imperfections(rows: DataFrame, status: str, unit_wrong: str) -> DataFrame:
    """Rate of every status, and how many lots carry a wrong unit."""
    wrong = (
        rows.filter(F.col(unit_wrong)).select("lot_id").distinct().agg(F.count(F.lit(1)).alias("lots_wrong_unit"))
    )
    rates = rows.groupBy(F.coalesce(F.col(status), F.lit("(none)")).alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    one = rates.withColumn("_j", F.lit(1)).join(F.broadcast(total.withColumn("_j", F.lit(1))), "_j")
    one = one.join(F.broadcast(wrong.withColumn("_j", F.lit(1))), "_j")
    return one.select("status", "n_rows", (F.col("n_rows") / F.nullif(F.col("_all"), F.lit(0))).alias("rate"), "lots_wrong_unit")


def leaky_columns(columns: Sequence[str], tokens: Sequence[str] = ("96", "168", "target", "failure")) -> list[str]:
    """Column names a decision-time view must not carry."""
    return sorted(c for c in columns if any(t in c.lower() for t in tokens))
