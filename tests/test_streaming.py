"""Streams in several batches, rows out of order and late, against the operators over the whole table."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotwise.operators import ingest as I
from lotwise.operators import series as S
from lotwise.streaming import jobs as J
from tests.test_ingest_and_sinks import PROFILE, upload


def rows_of(spark):
    """The upload twice more with other parts; every row has a stamp, an hour later than the one before."""
    base = upload(spark)
    more = [base.withColumn("source_row", F.col("source_row") + 100 * i).withColumn("component_id", F.concat("component_id", F.lit(f"-{i}"))) for i in (1, 2)]
    again = base.withColumn("source_row", F.col("source_row") + 300)  # keys claimed before
    df = base
    for part in (*more, again):
        df = df.unionByName(part)
    return df.withColumn("read_timestamp", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("source_row") * 3600), "yyyy-MM-dd'T'HH:mm:ss"))


def codes(df):
    return Counter((r.finding_code, r.censored) for r in df.collect())


def stream(spark, rows, slice_of, n, delay):
    base = J.new_base(spark)
    for s in J.arrivals(rows, slice_of, n):
        J.ingest_stream(s, PROFILE, F.to_timestamp("read_timestamp"), delay, base)
    return base, spark.read.parquet(f"{base}/out")


def test_ingest_in_order_equals_the_batch(spark):
    rows = rows_of(spark)
    _, out = stream(spark, rows, F.floor(F.col("source_row") / 100).cast("int"), 4, 5.0)
    assert codes(out) == codes(I.validate(rows, PROFILE))
    assert {(r.source_row, r.finding_code) for r in out.collect()} == {(r.source_row, r.finding_code) for r in I.validate(rows, PROFILE).collect()}
    assert out.filter("(side = 'accepted') <> (finding_code IS NULL)").isEmpty()


def test_late_rows_are_quarantined_and_claim_nothing(spark):
    rows = rows_of(spark)
    slice_of = F.when(F.col("source_row").isin(1, 101), 3).otherwise(F.floor(F.col("source_row") / 100).cast("int"))
    _, out = stream(spark, rows, slice_of, 4, 5.0)
    got = {r.source_row: r.finding_code for r in out.collect()}
    assert len(got) == rows.count()
    assert got[1] == got[101] == "LATE_ARRIVAL"
    # Row 301 has the key of row 1 and may claim it now.
    assert got[301] is None and got[302] == "DUPLICATE_KEY"
    # With a delay that covers them, the late rows are duplicates or claim as they come.
    _, patient = stream(spark, rows, slice_of, 4, 1000.0)
    assert patient.filter("finding_code = 'LATE_ARRIVAL'").isEmpty()
    assert patient.filter("source_row = 1 AND finding_code IS NULL").count() == 1


def test_replayed_batch_changes_nothing(spark):
    rows = rows_of(spark)
    base, out = stream(spark, rows, F.floor(F.col("source_row") / 100).cast("int"), 4, 5.0)
    before = codes(out)
    state = J.BatchState(spark, base, 5.0)
    last = spark.read.parquet(f"{base}/rows/batch_id=3")
    claims = state.earlier("claims", 3, "component_id string, parameter string, elapsed_hours long, source_row long")
    again = I.first_claims(last).join(claims.select(*I.KEY), I.KEY, "left_anti")
    assert sorted(map(tuple, again.select(*I.KEY, "source_row").collect())) == sorted(map(tuple, spark.read.parquet(f"{base}/claims/batch_id=3").select(*I.KEY, "source_row").collect()))
    assert codes(spark.read.parquet(f"{base}/out")) == before


@pytest.mark.parametrize("delay", [1000.0, 30.0])
def test_cusum_of_shuffled_batches(spark, delay):
    rng = random.Random(3)
    rows = []
    for key in "abcd":
        for i in range(60):
            value = None if rng.random() < 0.1 else rng.gauss(0 if i < 30 else 1.5, 1)
            rows.append((key, i * 3600 + rng.randrange(3600), i, value, rng.randrange(3)))
    rows += [("short", 5, 1, 0.0, 0), ("bad", 5, 1, float("nan"), 0), ("bad", 9, 2, 1.0, 2)]
    df = spark.createDataFrame(rows, "k string, at long, seq long, value double, slice int")
    df = df.withColumn("ts", F.timestamp_seconds("at")).withColumns({"reference": F.lit(0.0), "scale": F.lit(1.0)})
    base = J.new_base(spark)
    for s in J.arrivals(df, F.col("slice"), 3):
        J.cusum_stream(s, ["k"], F.col("ts"), "seq", delay, base)
    got = {r.k: r.asDict() for r in J.cusum_close(s, base, ["k"], "seq").collect()}
    # Late by hand: before the latest time of the earlier slices less the delay.
    latest = [max((r[1] for r in rows if r[4] < n), default=None) for n in range(3)]
    late = [r for r in rows if latest[r[4]] is not None and r[1] / 3600 < latest[r[4]] / 3600 - delay]
    assert bool(late) == (delay < 100)
    kept = spark.createDataFrame([r for r in rows if r not in late], "k string, at long, seq long, value double, slice int")
    kept = kept.withColumns({"reference": F.lit(0.0), "scale": F.lit(1.0)}).withColumn("t", F.col("at") / 3600)
    want = {r.k: r.asDict() for r in S.cusum(kept, ["k"], ["t", "seq"], "value", "reference", "scale").collect()}
    assert got.keys() == {r[0] for r in rows} and sum(r["n_late"] for r in got.values()) == len(late)
    for k, row in want.items():
        for name, value in row.items():
            assert got[k][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (k, name)


def test_hot_series_in_chunks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a", float(i), i, rng.gauss(0.2, 1)) for i in range(400)], "k string, event_hours double, seq long, value double")
    df = df.withColumns({"reference": F.lit(0.0), "scale": F.lit(1.0)})
    none = spark.createDataFrame([], "k string, " + J.CUSUM_STATE)
    whole = J.cusum_add(none, df, df.limit(0), ["k"], ["event_hours", "seq"]).first()
    spark.conf.set("spark.lotwise.hotRows", "50")
    try:
        half = J.cusum_add(none, df.filter("seq < 170"), df.limit(0), ["k"], ["event_hours", "seq"])
        both = J.cusum_add(half, df.filter("seq >= 170"), df.limit(0), ["k"], ["event_hours", "seq"]).first()
    finally:
        spark.conf.unset("spark.lotwise.hotRows")
    for name in whole.asDict():
        assert both[name] == (pytest.approx(whole[name], abs=1e-9) if isinstance(whole[name], float) else whole[name])
