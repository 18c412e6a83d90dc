"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import pin, stage

__all__ = ["broadcast_if_small", "let", "pin", "read", "stage", "whole_text", "words_of"]

# Rows of a key table (a few dozen bytes each) that may be broadcast; above it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The table with a broadcast hint if it has no more rows than the limit, else unchanged (shuffled join)."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table.hint("merge")
