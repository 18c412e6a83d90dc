"""CUSUM and quality in ordinary and chunked form; known answers of the decision functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import drift as D
from lotwise.functions.robust import d
from lotwise.operators import calibrate as C
from lotwise.operators import series as S
from lotwise.plans import evidence as E


def fold(values, ref, scale, k=0.5, h=4.0):
    up = down = 0.0
    first = None
    for i, x in enumerate(values):
        if x is None:
            continue
        z = (x - ref) / scale
        up, down = max(0.0, up + z - k), max(0.0, down - z - k)
        if first is None and up > h:
            first = i
    return up, down, first


@pytest.mark.parametrize("limit", [10**6, 40])
def test_cusum(spark, limit):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key, n in (("long", 160), ("short", 9), ("tiny", 2)):
        values = [None if rng.random() < 0.1 else float(x) for x in rng.normal(10.4, 2, n)]
        rows += [(key, float(i), i, v, 10.0, 2.0) for i, v in enumerate(values)]
        want[key] = fold(values, 10.0, 2.0)
    df = spark.createDataFrame(rows, "k string, t double, seq int, v double, ref double, sc double").repartition(3)
    got = {r["k"]: r for r in S.cusum(df, ["k"], ["t", "seq"], "v", "ref", "sc", limit=limit).collect()}
    for key in ("long", "short"):
        assert got[key]["s_high"] == pytest.approx(want[key][0], abs=1e-9)
        assert got[key]["s_low"] == pytest.approx(want[key][1], abs=1e-9)
        assert got[key]["first_crossing_high"] == want[key][2]
    assert got["tiny"]["refusal_code"] == "INSUFFICIENT_DATA"


def test_cusum_known_with_gap_and_fold(spark):
    values = [10.0] * 3 + [None] + [12.0] * 9
    rows = [("a", float(i), v, 10.0, 2.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t double, v double, ref double, sc double")
    r = S.cusum(df, ["k"], ["t"], "v", "ref", "sc").first()
    assert (r["s_high"], r["s_low"], r["first_crossing_high"], r["n_gaps"]) == (4.5, 0.0, 12, 1)
    one = spark.createDataFrame([(values,)], "v array<double>").select(S.cusum_fold(F.col("v"), d(10.0), d(2.0)).alias("s")).first()
    assert one["s"]["s_high"] == 4.5


@pytest.mark.parametrize("limit", [10**6, 12])
def test_quality(spark, limit):
    rows = [("flat", i, float(i), 5.0) for i in range(4)]
    rows += [("gap", i, float(t), float(i)) for i, t in enumerate([0.0, 1, 2, 3, 9, 9])]
    spike = [1.0, 1.1, None, 60.0, 1.0, 1.2, float("nan"), 900.0] + [1.0 + i / 10 for i in range(20)]
    rows += [("spike", i, float(i), v) for i, v in enumerate(spike)]
    df = spark.createDataFrame(rows, "k string, seq int, t double, v double").withColumn("sc", F.lit(1.0))
    out = S.series_quality(df, ["k"], ["seq"], "v", time="t", scale="sc", high=F.lit(100.0), limit=limit)
    got = {r["k"]: r for r in out.collect()}
    assert got["flat"]["score"] == pytest.approx(0.75)
    assert (got["gap"]["n_gap"], got["gap"]["n_disorder"]) == (1, 1)
    s = got["spike"]
    assert (s["n_missing"], s["n_nonfinite"], s["n_impossible"], s["n_discontinuity"], s["first_spike"]) == (1, 1, 1, 1, 3)
    assert s["score"] == pytest.approx(1 - 0.05 - 0.1 - 0.1 - 0.1)
    assert [f["code"] for f in s["findings"]] == ["MISSING_OBSERVATION", "NON_FINITE_VALUE", "IMPOSSIBLE_VALUE", "DISCONTINUITY"]


def test_bands(spark):
    cases = [(10, 15, 12, 11, "SAFE"), (10, 30, 34, 12, "WATCH"), (40, 45, 45.6, 41, "WATCH"), (10, 45, 42, 12, "EARLY_WARNING"), (10, 50, 30, 12, "REJECT")]
    df = spark.createDataFrame([tuple(map(float, c[:4])) for c in cases], "v0 double, u double, v double, v24 double")
    got = df.select(D.safety(F.col("v0"), F.col("u"), F.col("v"), F.col("v24"), d(50.0)).alias("s")).collect()
    assert [r["s"]["band"] for r in got] == [c[4] for c in cases]
    r = df.limit(1).select(D.safety(d(50.0), d(1.0), d(1.0), d(1.0), d(50.0)).alias("s")).first()
    assert r["s"]["refusal_code"] == "INVALID_INPUT"


def test_forecast_and_shape(spark):
    one = spark.range(1)
    r = one.select(D.forecast(d(12.1), d(18.7), d(3.06)).alias("f"), D.phi_at(d(24.0), "saturating", param=d(30.0)).alias("p")).first()
    assert r["f"]["shape_point"] == pytest.approx(32.296) and r["f"]["baseline_linear"] == pytest.approx(58.3) and r["p"] == 1.0
    rows = [(f"L{i}", "T", "p", 10.0, v24, v168) for i, (v24, v168) in enumerate([(12, 14), (14, 20), (16, 28), (11, 99)])]
    df = spark.createDataFrame([(a, b, c, x, float(y), float(z)) for a, b, c, x, y, z in rows], "lot_id string, component_type string, parameter string, v0 double, v24 double, v168 double")
    phi = C.shape_phi(df, df.filter("lot_id <> 'L3'").select("lot_id")).first()
    assert (phi["phi_168"], phi["n_used"], phi["n_excluded"]) == (2.5, 3, 1)


def test_conformal(spark):
    res = [-2.1, -0.5, 0.3, 1.2, 2.0, 3.1, 4.4, 5.9, 7.5]
    df = spark.createDataFrame([("T", "p", x) for x in res], "component_type string, parameter string, residual double")
    point = spark.createDataFrame([("T", "p", 32.3), ("T", "q", None)], "component_type string, parameter string, point double")
    for limit in (10**6, 4):
        r = C.conformal_bound(point, C.conformal_table(df, 0.10, limit), "point", 1).filter("parameter = 'p'").first()
        assert (r["k"], r["q_hat"], r["mondrian_level"]) == (9, 7.5, 0) and r["upper"] == pytest.approx(39.8)
    none = C.conformal_bound(point, C.conformal_table(df, 0.05), "point", 1)
    got = {x["parameter"]: x for x in none.collect()}
    assert got["p"]["bound_code"] == "INSUFFICIENT_CALIBRATION" and got["p"]["mondrian_level"] == 3
    assert got["p"]["attainable_alpha"] == pytest.approx(0.1) and got["q"]["bound_code"] == "INVALID_INPUT"


def test_rollup(spark):
    rows = [("A", "REJECT", False), ("A", "EARLY_WARNING", False)] + [("A", "SAFE", False)] * 18
    rows += [("B", "SAFE", False), ("B", "SAFE", True), ("B", None, False)]
    df = spark.createDataFrame(rows, "lot_id string, band string, absolute_fail boolean")
    got = {r["lot_id"]: r for r in E.lot_rollup(df).collect()}
    assert (got["A"]["pda_pct"], got["A"]["pda_pct_with_early_warning"], got["A"]["lot_verdict"]) == (5.0, 10.0, "REVIEW")
    assert (got["B"]["n_tested"], got["B"]["n_reject"], got["B"]["n_excluded"], got["B"]["lot_verdict"]) == (2, 1, 1, "FAIL_LOT")


def test_recommendations(spark):
    cases = [
        (None, False, 1.0, "PART", 0.5, False, False, "INSUFFICIENT_EVIDENCE"),
        ("SAFE", True, 1.0, "PART", 0.5, False, False, "REJECT"),
        ("SAFE", False, 1.0, "SOCKET", 0.5, False, False, "RETEST_DIFFERENT_SOCKET"),
        ("SAFE", False, 1.0, "ZONE", 0.5, False, True, "ZONAL_REVIEW"),
        ("REJECT", False, 1.0, "PART", 0.5, False, False, "REJECT"),
        ("EARLY_WARNING", False, 1.0, "PART", 0.5, False, False, "EXTEND_BURN_IN"),
        ("WATCH", False, 1.0, "PART", 0.5, False, False, "MONITOR"),
        ("SAFE", False, 5.0, "PART", 0.5, False, False, "INVESTIGATE"),
        ("SAFE", False, 1.0, "PART", 0.5, True, False, "INVESTIGATE"),
        ("SAFE", False, 1.0, "PART", 0.5, False, False, "ACCEPT"),
    ]
    df = spark.createDataFrame(cases, "b string, f boolean, z double, a string, m double, w boolean, c boolean, want string")
    out = df.select(D.recommend(*[F.col(x) for x in "bfzamwc"]).alias("r"), "want").collect()
    assert [x["r"]["action"] for x in out] == [x["want"] for x in out]
