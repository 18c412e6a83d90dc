"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.robust import round6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Keep the named columns (all when none are named) and round doubles to six decimals."""
    names = list(columns) or df.columns
    kinds = dict(df.dtypes)
    return df.select(*[round6(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in names])
