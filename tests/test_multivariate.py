import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import loo, mcd
from lotwise.operators import multivariate as M


def sample(spark, n=120, seed=1, lots=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for lot in lots:
        z = rng.normal(size=(n, 3)) @ np.array([[2.0, 0.5, 0.1], [0, 1.0, 0.3], [0, 0, 0.2]]) + [5, -3, 1]
        z[0] = [40, 30, 9]
        rows += [(f"{lot}{i}", lot, *map(float, v)) for i, v in enumerate(z)]
    return rows, spark.createDataFrame(rows, "id string, lot string, x double, y double, w double")


def test_chi2():
    assert mcd.chi2_sf(2.0, 2) == pytest.approx(np.exp(-1))
    assert mcd.chi2_isf(0.025, 1) == pytest.approx(5.023886, abs=1e-5)
    assert mcd.chi2_isf(0.5, 3) == pytest.approx(2.365974, abs=1e-5)
    assert mcd.chi2_sf(11.0705, 5) == pytest.approx(0.05, abs=1e-5)


def test_outlier_first_and_additive(spark):
    _, df = sample(spark)
    out = M.top_contributions(M.robust(df, ["lot"], ["x", "y", "w"]), ["x", "y", "w"]).collect()
    for lot in "ab":
        best = max((r for r in out if r["lot"] == lot), key=lambda r: r["d2"])
        assert best["id"] == f"{lot}0" and best["p_value"] < 1e-9
    assert all(r["adds_up"] for r in out)


def test_scale_and_order_do_not_matter(spark):
    _, df = sample(spark)
    base = {r["id"]: r["d2"] for r in M.robust(df, ["lot"], ["x", "y", "w"]).collect()}
    moved = df.selectExpr("id", "lot", "x * 1e-9 + 3 AS x", "y * 7 AS y", "w").repartition(7)
    for r in M.robust(moved, ["lot"], ["x", "y", "w"]).collect():
        assert r["d2"] == pytest.approx(base[r["id"]], rel=1e-5)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


@pytest.mark.parametrize("mode", ["shared", "exact"])
def test_hot_lot_equals_local_fit(spark, mode):
    _, df = sample(spark, n=150)
    base = by_id(M.robust(df, ["lot"], ["x", "y", "w"], mode))
    hot = by_id(M.robust(df.repartition(5), ["lot"], ["x", "y", "w"], mode, limit=100))
    assert hot.keys() == base.keys() and len(hot) == 300
    for k, r in base.items():
        assert hot[k]["n"] == r["n"] and hot[k]["refusal_code"] is None and hot[k]["fit_mode"] == mode
        for c in ("d2", "p_value", "c_x", "c_y", "c_w"):
            assert hot[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-12)


def test_hot_lot_with_ties(spark):
    """Rounded values: many equal rows, and many at the distance that cuts."""
    rows, _ = sample(spark, n=160, lots=("a",))
    rows = [(i, lot, float(round(x)), float(round(y)), float(round(w * 3))) for i, lot, x, y, w in rows]
    df = spark.createDataFrame(rows + [(f"c{i}", "flat", float(i), 2.0, 3.0) for i in range(130)], "id string, lot string, x double, y double, w double")
    base, hot = (by_id(M.robust(df, ["lot"], ["x", "y", "w"], "exact", limit=limit)) for limit in (None, 100))
    for k, r in base.items():
        assert hot[k]["refusal_code"] == r["refusal_code"] == ("SINGULAR_COVARIANCE" if k.startswith("c") else None)
        if r["d2"] is not None and r["d2"] == r["d2"]:
            assert hot[k]["d2"] == pytest.approx(r["d2"], rel=1e-9, abs=1e-12)


def test_narrow_windows_widen(spark, monkeypatch):
    _, df = sample(spark, n=150, lots=("a",))
    base = by_id(M.robust(df, ["lot"], ["x", "y", "w"], "exact"))
    monkeypatch.setattr(loo, "WINDOW", 2)
    got = by_id(M.robust(df, ["lot"], ["x", "y", "w"], "exact"))
    assert all(got[k]["d2"] == pytest.approx(r["d2"], rel=1e-9) for k, r in base.items())


@pytest.mark.parametrize("n,p,kind", [(22, 2, 0), (31, 3, 1), (60, 3, 2), (121, 4, 0), (302, 3, 1), (302, 3, 2)])
def test_downdating_equals_refits(n, p, kind):
    rng = np.random.default_rng(n + kind)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 3
    if kind == 1:
        x[: n // 8] += rng.normal(size=p) * 9
    if kind == 2:
        x = np.round(x * 2) / 2
    x = x[np.lexsort(x.T[::-1])] / x.std(axis=0)
    parts, means, spreads = loo.score(x)
    keep, _, _ = loo.concentrate(x)
    for i in range(n):
        left = np.delete(np.arange(n), i)
        mean, spread = loo.refit(x[left], np.flatnonzero(np.isin(left, keep)))
        np.testing.assert_allclose(means[i], mean, rtol=1e-9, atol=1e-11)
        np.testing.assert_allclose(spreads[i], spread, rtol=1e-9, atol=1e-11)
        delta = x[i] - mean
        np.testing.assert_allclose(parts[i], delta * np.linalg.solve(spread, delta), rtol=1e-8, atol=1e-10)


def test_leave_one_out_refusals(spark):
    rows = [("a", float(i), 1.0) for i in range(30)] + [("a", 3.0, 2.0)] + [("b", 1.0, 2.0)] + [("c", float(i), float(i * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "lot string, x double, y double")
    got = {(r["lot"], r["y"]): r["refusal_code"] for r in M.robust(df, ["lot"], ["x", "y"], "exact").collect()}
    assert got["a", 2.0] == "SINGULAR_COVARIANCE" and got["b", 2.0] == "INSUFFICIENT_COHORT" and got["c", 4.0] == "INSUFFICIENT_SAMPLE_RATIO"
    with_gap = M.robust(df.withColumn("x", F.when(F.col("x") == 1, None).otherwise(F.col("x"))), ["lot"], ["x", "y"], "exact")
    assert with_gap.count() == df.filter("x <> 1").count()


def test_classical_then_robust_in_one_session(spark):
    """A used inverse must not keep later fits from travelling to the workers."""
    _, df = sample(spark, n=60, lots=("a",))
    assert M.classical(df, ["lot"], ["x", "y", "w"]).filter("d2 IS NULL").count() == 0
    assert M.robust(df, ["lot"], ["x", "y", "w"]).filter("d2 IS NULL").count() == 0
    assert M.robust(df, ["lot"], ["x", "y", "w"], "exact").filter("d2 IS NULL").count() == 0


@pytest.mark.parametrize("df", [1, 2, 3, 4, 6, 7])
def test_chi2_column(spark, df):
    rows = spark.createDataFrame([(x,) for x in (0.0, -1.0, 0.3, 5.0, 80.0, None, float("nan"))], "x double")
    for r in rows.withColumn("p", mcd.chi2_tail("x", df)).collect():
        if r["x"] is None or r["x"] != r["x"]:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(mcd.chi2_sf(r["x"], df), rel=1e-12)


def test_refusals(spark):
    rows = [("a", float(i), 1.0) for i in range(30)] + [("b", 1.0, 2.0)] + [("c", float(i), float(i * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "lot string, x double, y double")
    got = {r["lot"]: r["refusal_code"] for r in M.robust(df, ["lot"], ["x", "y"]).collect()}
    assert got == {"a": "SINGULAR_COVARIANCE", "b": "INSUFFICIENT_COHORT", "c": "INSUFFICIENT_SAMPLE_RATIO"}


def test_others_on_a_line():
    """Most of the lot lies on one line, so the kept set of the others is singular; those rows are refused, none fails."""
    line = np.array([[float((i * 7 + j * 3) % 11) + i / 10 + j for j in range(2)] for i in range(40) if i != 3])
    parts, codes = loo.against_others(line)
    assert set(codes) <= {None, "SINGULAR_COVARIANCE"}
    assert "SINGULAR_COVARIANCE" in codes
    assert all(np.isfinite(p).all() == (c is None) for p, c in zip(parts, codes))


def test_lots_are_not_merged_into_one_task(spark):
    rows = spark.range(400).select((F.col("id") % 8).alias("lot"), *[F.rand(i).alias(c) for i, c in enumerate("ab")])
    plan = M._leave_one_out(rows, ["lot"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan, plan
