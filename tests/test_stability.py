"""The stability of a work list under drawn weights: the same figures whatever the cuts, and rows computed once."""

import numpy as np
from pyspark.sql import functions as F

from lotwise.operators import scoring

WEIGHTS = {"a": 0.3, "b": 0.5, "c": 0.2}


def _expected(table, draws):
    names, base = list(WEIGHTS), sum(w * table[n] for n, w in WEIGHTS.items()).rank()
    out = {}
    for draw in range(1, draws + 1):
        index = 0.0
        for name in names:
            index = index + WEIGHTS[name] * (1.0 + 0.5 * (2.0 * scoring.weight_draw(20260930, draw, name) - 1.0)) * table[name]
        out[draw] = (len(table), round(float(np.corrcoef(base, index.rank())[0, 1]), 9))
    return out


def test_draws_are_cut_and_merged_exactly(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(6000).select(
        ((F.col("id") * 7919 % 1013) / 1013).alias("a"), F.greatest(F.lit(0.0), (F.col("id") * 104729 % 997) / 997 - 0.5).alias("b"),
        (F.col("id") % 3 / 2.0).alias("c"),
    )
    table = rows.toPandas()
    out = scoring.rank_stability(rows.withColumn("a", counted("a")), WEIGHTS, draws=7, limit=500)
    got = {r["draw"]: (r["n"], round(r["rho"], 9)) for r in out.collect()}
    assert got == _expected(table, 7)
    assert seen.value == 6000
    whole = scoring.rank_stability(rows, WEIGHTS, draws=7)
    assert {r["draw"]: (r["n"], round(r["rho"], 9)) for r in whole.collect()} == got


def test_many_equal_rows_and_no_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 5 / 5.0).alias("a"), F.lit(0.0).alias("b"), (F.col("id") % 2 / 2.0).alias("c"))
    got = {r["draw"]: (r["n"], round(r["rho"], 9)) for r in scoring.rank_stability(rows, WEIGHTS, draws=3, limit=4).collect()}
    assert got == _expected(rows.toPandas(), 3)
    assert scoring.rank_stability(rows.filter("a > 1"), WEIGHTS, draws=3).isEmpty()
    same = scoring.rank_stability(rows.select(F.lit(0.5).alias("a"), "b", F.lit(0.0).alias("c")), WEIGHTS, draws=2)
    assert {(r["n"], r["rho"]) for r in same.collect()} == {(4000, None)}
