"""Traced values counted side by side: the same counts as from values written out one by one."""

from pyspark.sql import functions as F

from lotwise.functions import formulas as T

SHAPE = ["formula_id", "value", "unit", "inputs", "parameters"]


def _rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 5.0, 2.0, 3.0, "uA"), (2, 5.0, 2.0, 3.1, "uA"), (3, 5.0, 2.0, 3.0, "furlong"), (4, None, 2.0, 3.0, "uA"), (5, 5.0, 2.0, nan, "uA"),
            (6, inf, 2.0, 3.0, "uA"), (7, 5.0, 2.0, None, None), (8, 5.0, 2.0, 3.0, None)]
    return spark.createDataFrame(rows * 3, "id long, q3 double, q1 double, iqr double, unit string")


def _items():
    c, q = F.col, {"q3": F.col("q3"), "q1": F.col("q1")}
    return [
        T.Item("robust.iqr_v1", c("iqr"), q, {}, c("unit")), T.Item("robust.median_v1", c("q1"), {"n": c("id")}, {}, F.lit("uA")),
        T.Item("robust.iqr_v1", c("iqr"), q, {}, c("unit"), c("id") > 2), T.Item("none.such_v1", c("iqr"), q, {}, c("unit")),
        T.Item("robust.sigma_iqr_v1", c("iqr"), {"iqr": c("iqr")}, {"divisor": F.lit(1.0)}, F.lit("uA")),
        T.Item("robust.sigma_iqr_v1", c("iqr"), {"iqr": c("iqr")}, {}, F.lit("uA")),
        T.Item("dpat.limit_low_v1", c("q1"), q, {}, F.lit("uA")),
        T.Item("risk.anomaly_v1", F.lit(0.5), {"abs_z": c("q3") - 0.5}, {"z_low": F.lit(3.0), "z_high": F.lit(6.0)}, F.lit("index")),
    ]


def _long(spark):
    return _rows(spark).select(F.explode(F.array_compact(F.array(*[i.traced() for i in _items()]))).alias("t")).select("t.*")


def _same(one, other):
    other = other.select(*one.columns)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)


def test_rate_of_items_is_that_of_written_values(spark):
    out = T.item_rederivation_rate(_rows(spark), _items())
    _same(out, T.rederivation_rate(_long(spark), spark))
    assert "map(" not in out._jdf.queryExecution().optimizedPlan().toString()
    rate = {r["formula_id"]: (r["n_values"], r["n_rederived"]) for r in out.collect()}
    assert rate["robust.iqr_v1"] == (18, 15) and rate["robust.sigma_iqr_v1"] == (36, 18) and rate["dpat.limit_low_v1"] == (18, 0)


def test_errors_of_items_are_those_of_written_values(spark):
    long = _long(spark).join(T.registry(spark).drop("parameters"), "formula_id", "left")
    want = long.withColumn("error", F.coalesce(T.trace_error(), F.lit("NONE"))).groupBy("formula_id", "error").agg(F.count(F.lit(1)).alias("n_values"))
    out = T.item_errors(_rows(spark), _items())
    _same(out, want)
    assert {r["error"] for r in out.collect()} == {"NONE", "UNKNOWN_UNIT", "UNKNOWN_FORMULA", "OPERANDS_DIFFER"}


def test_trace_queries_write_no_value_out(spark):
    from lotwise.plans.registry import QUERIES
    from tests.conftest import SF_DIR

    for name in ("trace_errors", "rederivation_rate", "formula_appendix"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "map(k" not in plan and "map(median" not in plan and "map(q3" not in plan, name
