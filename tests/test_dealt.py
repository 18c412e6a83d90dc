"""Rows dealt by lot before they are multiplied: the same results, and no shuffle of the multiplied rows."""

from pyspark.sql import functions as F

from lotwise.operators import cohort, ordered, profiling
from lotwise.plans import evidence, views
from tests.conftest import SF_DIR


def test_dealt_lookups_do_not_shuffle_readings(spark):
    spark.conf.set("spark.lotwise.broadcastRows", "1")
    try:
        rows, how = views.dealt_cohorts(spark, SF_DIR)
        assert how["by"] == ["lot_id"]
        out = cohort.dpat(rows, views.COHORT_KEYS, "value", "status", 1.2, **how)
        plan = out._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffles and all("l_suppkey" in line for line in shuffles), plan
        plain = cohort.dpat(views.cohort_view(spark, SF_DIR), views.COHORT_KEYS, "value", "status", 1.2).select(*out.columns)
        assert out.exceptAll(plain).isEmpty() and out.count() == plain.count()
    finally:
        spark.conf.unset("spark.lotwise.broadcastRows")


def test_hot_or_few_lots_are_not_dealt(spark):
    rows = spark.range(10_000).select((F.col("id") % 100).alias("lot"), "id")
    assert ordered.deal(rows, "lot") is not None
    assert ordered.deal(rows, "lot", limit=50) is None
    assert ordered.deal(rows.withColumn("lot", F.col("id") % 2), "lot") is None
    assert ordered.deal(rows.withColumn("lot", F.col("id")), "lot") is None


def test_dealt_join_keeps_rows_without_a_match(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, None, 6), (2, "a", 7), (None, "a", 8)], "lot long, k string, x long")
    table = spark.createDataFrame([(1, "a", 1.5), (1, "b", 2.5)], "lot long, k string, m double")
    left = ordered.lookup_join(rows, table, ["lot", "k"], by=["lot"])
    assert {(r["x"], r["m"]) for r in left.collect()} == {(5, 1.5), (6, None), (7, None), (8, None)}
    assert [r["x"] for r in ordered.lookup_join(rows, table, ["lot", "k"], how="inner", by=["lot"]).collect()] == [5]


def test_ranks_are_looked_up_in_tables_of_values(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 37 % 1009).cast("double").alias("y"),
        F.col("id").cast("string").alias("part"),
    )
    got = {r["k"]: (r["n"], round(r["rho"], 9)) for r in profiling.spearman(rows, ["part"], ["k"], "x", "y", limit=100).collect()}
    table = rows.toPandas()
    for k, group in table.groupby("k", dropna=False):
        k = k if isinstance(k, str) else None
        assert got[k] == (len(group), round(group["x"].rank().corr(group["y"].rank()), 9))
    out = profiling.correlations(rows, "part", ["x", "y"], limit=100)
    assert abs(out.first()["spearman"] - table["x"].rank().corr(table["y"].rank())) < 1e-9
    plan = profiling.spearman(rows, ["part"], ["k"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "part" not in plan.replace("partition", "").replace("Partition", "").replace("part-", "")


def test_average_ranks_shuffle_once(spark):
    rows = spark.range(900).select((F.col("id") % 3).alias("k"), (F.col("id") % 10).cast("double").alias("v"))
    out = ordered.average_ranks(rows, ["k"], "v")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["avg_rank"] for r in out.filter("k = 0").collect()} == {15.5 + 30 * i for i in range(10)}


def test_small_lots_are_counted_where_they_are(spark):
    rows = spark.createDataFrame([(i, lot) for i, lot in enumerate([1, 1, 1, 2, 2, 3, None])], "component_id long, lot_id long").repartition("lot_id")
    good, small = evidence.refuse_small_lots(rows, by=["lot_id"])
    assert good._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain, refused = evidence.refuse_small_lots(rows)
    assert sorted(good.collect(), key=str) == sorted(plain.select(*good.columns).collect(), key=str) and {r["component_id"] for r in good.collect()} == {0, 1, 2, 6}
    assert sorted(small.collect(), key=str) == sorted(refused.collect(), key=str)


def test_dealt_lookup_is_made_once_and_only_where_wanted(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "lot long, k string, x long")
    table = spark.createDataFrame([(1, "a", 1.5), (1, "b", 2.5)], "lot long, k string, m double")
    out = ordered.lookup_join(rows, table, ["lot", "k"], by=["lot"], where="x > 5")
    assert {(r["x"], r["m"]) for r in out.collect()} == {(5, None), (6, 2.5), (7, None)}
    plain = ordered.lookup_join(rows, table, ["lot", "k"], by=["lot"])._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count("named_struct(k, k") == 1, plain


def test_quartiles_of_hot_groups_take_few_cuts(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 2).alias("k"), F.when(F.col("id") % 5 == 0, 3.0).otherwise((F.col("id") * 7919 % 59_999).cast("double")).alias("v")
    )
    cut, hot = ordered.bucketed(rows, ["k"], "v", limit=1_000, around=(0.25, 0.5, 0.75))
    counts = {(r["k"], r["_bucket"]): r["count"] for r in cut.groupBy("k", "_bucket").count().collect()}
    assert hot and {b for _, b in counts} <= set(range(8))
    assert all(counts.get((k, b), 0) < 600 for k in (0, 1) for b in (2, 4, 6)), counts
    exact = rows.toPandas().groupby("k")["v"].quantile([0.25, 0.5, 0.75])
    for limit in (None, 1_000):
        for r in ordered.quantiles(rows, ["k"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, limit=limit).collect():
            assert r["n"] == 30_000 and [r["q1"], r["median"], r["q3"]] == [exact[r["k"], p] for p in (0.25, 0.5, 0.75)]
