"""Order statistics, ranks and leave-one-out statistics against numpy, in ordinary and hot form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import cohort, ordered


def skewed(spark, seed=7, n=1500):
    """One key holds most rows, with heavy ties; the others are tiny."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.8 else f"k{rng.integers(0, 40)}"
        value = float(rng.integers(0, 9)) if rng.random() < 0.4 else float(np.round(rng.normal(5, 3), 3))
        status = "OK" if rng.random() < 0.95 else "OVERRANGE"
        rows.append((i, key, value, status))
    return rows, spark.createDataFrame(rows, "id long, k string, v double, status string").repartition(5)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_quantiles(spark, limit):
    rows, df = skewed(spark)
    got = {
        r["k"]: (r["q1"], r["median"], r["q3"], r["n"])
        for r in ordered.quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit=limit).collect()
    }
    for k in {r[1] for r in rows}:
        v = np.array([r[2] for r in rows if r[1] == k])
        np.testing.assert_allclose(got[k][:3], np.percentile(v, [25, 50, 75]), rtol=1e-12)
        assert got[k][3] == len(v)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_average_ranks_and_locate(spark, limit):
    rows, df = skewed(spark)
    got = {r["id"]: r["avg_rank"] for r in ordered.average_ranks(df, ["k"], "v", limit=limit).collect()}
    assert len(got) == len(rows)
    hot = [r for r in rows if r[1] == "hot"]
    v = np.array([r[2] for r in hot])
    for r in hot[::17]:
        assert got[r[0]] == pytest.approx((v < r[2]).sum() + ((v == r[2]).sum() + 1) / 2)
    probes = df.select("k", (F.col("v") + 0.5).alias("v"))
    for r in ordered.locate(df, probes, ["k"], "v", limit=limit).collect():
        ref = np.array([x[2] for x in rows if x[1] == r["k"]])
        assert r["below"] == (ref < r["v"]).sum()
        assert r["upto"] == (ref <= r["v"]).sum()
        assert r["reference_rows"] == len(ref)


def brute_loo(rows, i):
    _, k, x, _ = rows[i]
    rest = np.array([r[2] for j, r in enumerate(rows) if r[1] == k and r[3] == "OK" and j != i])
    m = len(rest)
    if m < 3:
        return m, None, 0.0
    q1, med, q3 = np.percentile(rest, [25, 50, 75])
    mad = np.median(np.abs(rest - med))
    if q3 == q1 and mad == 0:
        return m, med, 0.0
    c = [1, 1.0, 1.1955, 1.4872, 1.3606, 1.2168, 1.1896, 1.1379, 1.1274, 1.1012, 1.0957, 1.0799, 1.0766, 1.0661,
         1.0638, 1.0563, 1.0547, 1.0491, 1.0479, 1.0435]
    if m < 20 and mad > 0:
        return m, med, 1.4826 * c[m] * mad
    return m, med, (q3 - q1) / 1.35


@pytest.mark.parametrize("limit", [10**6, 60])
def test_leave_one_out(spark, limit):
    rows, df = skewed(spark)
    got = {r["id"]: r for r in cohort.leave_one_out(df, ["k"], "v", "status", limit=limit).collect()}
    assert len(got) == len(rows)
    for i, row in enumerate(rows):
        if row[1] == "hot" and i % 11:
            continue
        m, med, sigma = brute_loo(rows, i)
        r = got[row[0]]
        assert r["n"] == m
        if med is None:
            assert r["refusal_code"] == "INSUFFICIENT_COHORT"
        else:
            assert r["median"] == pytest.approx(med)
            assert r["robust_sigma"] == pytest.approx(sigma)


def test_lookup_join_forms_agree(spark):
    rows, df = skewed(spark)
    table = df.groupBy("k").agg(F.sum("v").alias("s"))
    want = sorted((r["id"], r["s"]) for r in df.join(table, "k").collect())
    spark.conf.set("spark.lotwise.broadcastRows", "1")
    try:
        for limit in (10**6, 60):
            out = ordered.lookup_join(df, table, ["k"], limit=limit)
            got = sorted((r["id"], r["s"]) for r in out.collect())
            assert [g[0] for g in got] == [w[0] for w in want]
            np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want])
    finally:
        spark.conf.unset("spark.lotwise.broadcastRows")


@pytest.mark.parametrize("limit", [10**6, 60])
def test_lot_statistics(spark, limit):
    rows, df = skewed(spark)
    for r in cohort.lot_statistics(df, ["k"], "v", "status", limit=limit).collect():
        v = np.array([x[2] for x in rows if x[1] == r["k"] and x[3] == "OK"])
        assert r["n"] == len(v)
        if len(v) >= 3:
            assert r["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))))


def test_known_answers(spark):
    v = spark.createDataFrame([("a", float(x)) for x in (2, 4, 7, 11, 16, 22, 29, 37, 46)], "k string, v double")
    r = cohort.lot_statistics(v, ["k"], "v").first()
    assert (r["q1"], r["median"], r["q3"]) == (7.0, 16.0, 29.0)
    values = [9.05] * 7 + [10.4] * 6 + [11.75] * 12
    for x, z, verdict in ((27.8, 8.7, "FAIL"), (22.4, 6.0, "PASS")):
        df = spark.createDataFrame([("a", u, "OK") for u in values] + [("a", x, "SUSPECT")], "k string, v double, s string")
        r = cohort.dpat(df, ["k"], "v", "s").filter("s = 'SUSPECT'").first()
        assert r["n"] == 25
        assert r["median"] == pytest.approx(10.4)
        assert r["robust_sigma"] == pytest.approx(2.0)
        assert r["limit_high"] == pytest.approx(22.4)
        assert r["z"] == pytest.approx(z)


def test_small_groups_are_gathered_with_the_same_result(spark):
    rows = spark.range(600).select(
        (F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"), F.col("id"),
    ).filter("k < 6 OR id < 40")
    picks = {**ordered.quantile_picks({"q1": 0.25, "median": 0.5}), "beyond": lambda n: n + 3, "before": lambda n: n - n - 1, "first": lambda n: n - n}
    one = ordered.order_statistics(rows, ["k"], "v", picks, small_upto=20)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan, plan
    large = ordered.GroupSizes(7, ordered.GATHERED_ROWS + 1, 600)
    other = ordered.order_statistics(rows, ["k"], "v", picks, small_upto=20, sizes=large)
    assert "Window" in other._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
