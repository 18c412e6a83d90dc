import numpy as np
import pytest

from lotwise.functions.medcouple import medcouple as mc_array
from lotwise.functions.medcouple import medcouples_without_each
from lotwise.operators import skewness


def brute(v):
    v = np.sort(np.asarray(v, float))
    if len(v) < 3 or v[0] == v[-1]:
        return 0.0
    m = np.median(v)
    lo, hi = v[v <= m], v[v >= m]
    k = int((v == m).sum())
    off = len(lo) - k
    out = []
    for i, a in enumerate(lo):
        for j, b in enumerate(hi):
            if a < b:
                out.append(((b - m) - (m - a)) / (b - a))
            else:
                s = (i - off + 1) + (j + 1) - 1
                out.append(-1.0 if s < k else 0.0 if s == k else 1.0)
    return float(np.median(out))


@pytest.mark.parametrize("seed", range(12))
def test_array_form(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 400))
    v = rng.exponential(2, n) if seed % 2 else rng.integers(0, 7, n).astype(float)
    assert mc_array(np.sort(v)) == pytest.approx(brute(v), abs=1e-12)


def test_known():
    assert mc_array(np.array([-10, -5, -2, 0, 2, 5, 10.0])) == 0.0


def test_counting_form_equals_array_form(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.exponential(1, 300)]
    rows += [("b", float(x)) for x in rng.integers(0, 6, 201)]
    rows += [("c", float(x)) for x in (1, 2, 5, 9)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["medcouple"] for r in skewness.medcouple(df, ["k"], "v", limit=200, rounds=3).collect()}
    for k in "abc":
        assert got[k] == pytest.approx(brute([v for kk, v in rows if kk == k]), abs=3e-4)


def test_leave_one_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a", float(x)) for i, x in enumerate(rng.exponential(1, 15))] + [
        (100 + i, "b", float(x)) for i, x in enumerate(rng.integers(0, 4, 10))
    ]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for r in skewness.medcouple_leave_one_out(df, ["k"], "v").collect():
        rest = [v for i, k, v in rows if k == r["k"] and i != r["id"]]
        assert r["medcouple"] == pytest.approx(brute(rest), abs=1e-12)
        assert r["medcouple_mode"] == "leave_one_out"


@pytest.mark.parametrize("seed", range(20))
def test_without_each(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    kinds = (rng.exponential(2, n), rng.integers(0, 7, n).astype(float), rng.integers(-30, 30, n).astype(float), rng.integers(0, 2, n).astype(float))
    values, rows = np.unique(kinds[seed % 4], return_counts=True)
    every = np.repeat(values, rows)
    for x, got in zip(values, medcouples_without_each(values, rows)):
        rest = np.delete(every, np.searchsorted(every, x))
        assert got == pytest.approx(brute(rest), abs=1e-12)


def test_leave_one_out_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(1, 4000), np.full(2000, 0.5)])
    rows = [(i, float(x)) for i, x in enumerate(values)] + [(9000, None)]
    out = skewness.medcouple_leave_one_out(spark.createDataFrame(rows, "id long, v double").selectExpr("id", "'a' AS k", "v"), ["k"], "v")
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i in (0, 17, 3999, 4000, int(np.argmax(values)), int(np.argmin(values))):
        assert got[i]["medcouple"] == pytest.approx(mc_array(np.sort(np.delete(values, i))), abs=1e-12)
        assert got[i]["medcouple_mode"] == "leave_one_out"
    assert got[9000]["medcouple_mode"] == "cohort"
    assert got[9000]["medcouple"] == pytest.approx(mc_array(np.sort(values)), abs=1e-12)
