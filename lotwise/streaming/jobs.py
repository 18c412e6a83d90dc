"""Structured Streaming forms of the sequential operators.

Every job writes through ``foreachBatch`` into one folder per batch id, overwriting it, so a replayed batch leaves
the same files. Results are read back from the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import robust as R
from lotwise.operators import ingest as I
from lotwise.operators import series as S
from lotwise.session import ensure_checkpoint_dir, stage


def read_files(spark: SparkSession, folder: str, pattern: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def new_base(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder for a stream's state and results."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run(
    stream: DataFrame, mode: str, write: Callable[[DataFrame, int, str], None] | None = None, base: str | None = None
) -> str:
    """Process everything available and return the output folder; with ``base`` a stream goes on where it stopped."""
    base = base or new_base(stream.sparkSession)

    def store(batch: DataFrame, batch_id: int) -> None:
        if write is not None:
            write(batch, batch_id, base)
        else:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .foreachBatch(store)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return base


def arrivals(rows: DataFrame, slice_of: Column, n: int) -> Iterator[DataFrame]:
    """``rows`` as a stream of files that arrive in ``n`` slices; each next() adds one slice to the folder it reads."""
    folder = f"{new_base(rows.sparkSession)}/arrivals"
    cut = stage(rows.withColumn("_slice", slice_of))
    for i in range(n):
        cut.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(folder)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The row of the newest batch for each key."""
    rows = spark.read.parquet(f"{folder}/out")
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r")).select(*keys, "_r.*")


class BatchState:
    """Tables that a stream carries from one micro-batch to the next, and its event-time watermark.

    Every batch writes its own folders, named by its id, and reads those of earlier ids only. A batch that is replayed
    after a failure therefore overwrites what it wrote and sees the same state. The watermark is the latest event time of
    all earlier batches less the delay; rows before it come late.
    """

    def __init__(self, spark: SparkSession, base: str, delay_hours: float) -> None:
        self.spark, self.base, self.delay = spark, base, delay_hours

    def save(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, name: str, batch_id: int, schema: str) -> DataFrame:
        """The table a batch saved; empty for ids below zero."""
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/batch_id={batch_id}")

    def earlier(self, name: str, batch_id: int, schema: str) -> DataFrame:
        """All rows that earlier batches saved."""
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.base}/{name}/batch_id={i}" for i in range(batch_id)]
        return self.spark.read.schema(schema).parquet(*folders)

    def watermark(self, batch_id: int) -> float | None:
        """Hours since the epoch; None before any batch."""
        row = self.load("marks", batch_id - 1, "mark double").first()
        return None if row is None else row.mark

    def advance(self, batch_id: int, hours: DataFrame) -> float | None:
        """Save and return the watermark that holds after a batch with these event times."""
        latest, old = hours.agg(F.max("event_hours")).first()[0], self.watermark(batch_id)
        new = old if latest is None else max(latest - self.delay, old if old is not None else float("-inf"))
        self.save("marks", batch_id, self.spark.createDataFrame([(new,)], "mark double"))
        return new


LATE = "LATE_ARRIVAL"


def hours_of(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / F.lit(3.6e9)


def before(mark: float | None) -> Column:
    """Whether a row's event time lies before the watermark; one without a time never comes late."""
    return F.lit(False) if mark is None else F.coalesce(F.col("event_hours") < F.lit(mark), F.lit(False))


def ingest_stream(stream: DataFrame, profile: I.Profile, event_time: Column, delay_hours: float, base: str | None = None) -> str:
    """Validate a stream by all the rules of the batch; returns the folder of its results.

    Keys are claimed once and for all: by the earliest batch that holds a row for them without a structural finding, in it
    by the smallest source_row. A row that comes before the watermark is set aside as LATE_ARRIVAL and claims nothing. Each
    batch writes ``out`` (every row with its finding, partitioned by side: accepted or quarantine) and its new ``claims``.
    """
    claim_schema = "component_id string, parameter string, elapsed_hours long, source_row long"

    def write(batch: DataFrame, batch_id: int, base: str) -> None:
        state = BatchState(batch.sparkSession, base, delay_hours)
        rows = I.structural_checks(batch, profile, batch.sparkSession, {"event_hours": hours_of(event_time)})
        late = before(state.watermark(batch_id)) & F.col("finding_code").isNull()
        rows = (
            rows.withColumn("finding_detail", F.when(late, "event time before the watermark").otherwise(F.col("finding_detail")))
            .withColumn("finding_column", F.when(late, "read_timestamp").otherwise(F.col("finding_column")))
            .withColumn("finding_code", F.when(late, LATE).otherwise(F.col("finding_code")))
        )
        # Written once; claims, verdicts and the watermark all read it.
        rows = state.save("rows", batch_id, rows)
        known = state.earlier("claims", batch_id, claim_schema)
        claims = state.save("claims", batch_id, I.first_claims(rows).join(known.select(*I.KEY), I.KEY, "left_anti").select(*I.KEY, "source_row"))
        judged = I.judge(rows, claims, profile)
        side = F.when(F.col("finding_code").isNull(), "accepted").otherwise("quarantine")
        judged.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(f"{base}/out/batch_id={batch_id}")
        state.advance(batch_id, rows)

    return run(stream, "append", write, base)


CUSUM_STATE = "s_high double, s_low double, position long, first_high long, first_low long, n_obs long, n_gaps long, bad boolean, n_late long"


def cusum_stream(
    stream: DataFrame, keys: list[str], event_time: Column, seq: str, delay_hours: float, base: str | None = None, k: float = K.CUSUM_K,
    h: float = K.CUSUM_H,
) -> str:
    """CUSUM of every series in order of event time; returns the folder that ``cusum_close`` reads.

    ``stream`` holds the keys, ``seq`` (order among equal times), value, reference and scale. Rows wait until the watermark
    passes them, so rows that arrive out of order are added in order; those before the watermark are left out and counted.
    A batch adds its rows by running sums from the state of eight numbers per series: S = C - min(0, min C) with the
    carried sum in the first step.
    """
    waiting, sums_of = _cusum_schemas(dict(stream.dtypes), keys, seq)

    def write(batch: DataFrame, batch_id: int, base: str) -> None:
        state = BatchState(batch.sparkSession, base, delay_hours)
        rows = batch.withColumn("event_hours", hours_of(event_time)).select(*keys, "event_hours", seq, "value", "reference", "scale")
        rows = state.save("rows", batch_id, rows)
        old, new = state.watermark(batch_id), state.advance(batch_id, rows)
        here = rows.filter(~before(old)).unionByName(state.load("waiting", batch_id - 1, waiting))
        state.save("waiting", batch_id, here.filter(~before(new)))
        sums = state.load("sums", batch_id - 1, sums_of)
        state.save("sums", batch_id, cusum_add(sums, here.filter(before(new)), rows.filter(before(old)), keys, ["event_hours", seq], k, h))

    return run(stream, "append", write, base)


def _cusum_schemas(kinds: dict[str, str], keys: list[str], seq: str) -> tuple[str, str]:
    named = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return f"{named}, event_hours double, `{seq}` {kinds[seq]}, value double, reference double, scale double", f"{named}, {CUSUM_STATE}"


def cusum_close(stream: DataFrame, base: str, keys: list[str], seq: str, k: float = K.CUSUM_K, h: float = K.CUSUM_H) -> DataFrame:
    """The sums at the end of the stream, what still waits added, in the shape of the batch operator and with ``n_late``."""
    spark = stream.sparkSession
    waiting, sums_of = _cusum_schemas(dict(stream.dtypes), keys, seq)
    last = spark.read.parquet(f"{base}/marks").agg(F.max("batch_id")).first()[0]
    state = BatchState(spark, base, 0.0)
    rest, sums = state.load("waiting", last, waiting), state.load("sums", last, sums_of)
    return cusum_result(cusum_add(sums, rest, rest.limit(0), keys, ["event_hours", seq], k, h), keys)


def cusum_add(
    sums: DataFrame, rows: DataFrame, late: DataFrame, keys: list[str], order: list[str], k: float = K.CUSUM_K, h: float = K.CUSUM_H
) -> DataFrame:
    """The state ``sums`` after ``rows`` have been added in order; ``late`` rows are counted only."""
    old = [F.coalesce(c, F.lit(z)).alias(c) for c, z in (("s_high", 0.0), ("s_low", 0.0), ("position", 0))]
    carried = rows.join(sums.select(*keys, "s_high", "s_low", "position"), keys, "left")
    x, ref, sigma = F.col("value"), F.col("reference"), F.col("scale")
    bad = ~(R.finite(ref) & R.finite(sigma) & (sigma > 0)) | (x.isNotNull() & ~R.finite(x))
    z = F.when(~bad & x.isNotNull(), (x - ref) / sigma)
    carried = carried.select(*keys, *order, *old, x.isNull().alias("_gap"), F.coalesce(bad, F.lit(True)).alias("_bad"), z.alias("_z"))
    walk = S.Chunks(carried, keys, order)
    walk.position("_pos")
    first = F.col("_pos") == 0
    for name, start, step in (("_up", "s_high", F.col("_z") - k), ("_down", "s_low", -F.col("_z") - k)):
        walk.df = walk.df.withColumn(name, F.coalesce(step, R.d(0.0)) + F.when(first, F.col(start)).otherwise(R.d(0.0)))
    walk.reflected_sum("_up", "_high")
    walk.reflected_sum("_down", "_low")
    place, seen = F.col("position") + F.col("_pos"), F.col("_z").isNotNull()
    added = walk.df.groupBy(*keys).agg(
        F.max_by("_high", "_pos").alias("_s_high"), F.max_by("_low", "_pos").alias("_s_low"), F.count(F.lit(1)).alias("_n"),
        F.min(F.when(seen & (F.col("_high") > h), place)).alias("_first_high"),
        F.min(F.when(seen & (F.col("_low") > h), place)).alias("_first_low"),
        F.count_if(~F.col("_gap")).alias("_seen"), F.count_if("_gap").alias("_gaps"), F.max("_bad").alias("_any_bad"),
    )
    counted = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("_late"))
    out = sums.join(added, keys, "full").join(counted, keys, "full")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        *keys, F.coalesce("_s_high", "s_high", F.lit(0.0)).alias("s_high"), F.coalesce("_s_low", "s_low", F.lit(0.0)).alias("s_low"),
        (number("position") + number("_n")).alias("position"), F.coalesce("first_high", "_first_high").alias("first_high"),
        F.coalesce("first_low", "_first_low").alias("first_low"), (number("n_obs") + number("_seen")).alias("n_obs"),
        (number("n_gaps") + number("_gaps")).alias("n_gaps"),
        (F.coalesce("bad", F.lit(False)) | F.coalesce("_any_bad", F.lit(False))).alias("bad"), (number("n_late") + number("_late")).alias("n_late"),
    )


def cusum_result(state: DataFrame, keys: list[str]) -> DataFrame:
    """State rows in the shape of the batch operator."""
    code = F.when(F.col("bad"), "INVALID_INPUT").when(F.col("n_obs") < K.CUSUM_MIN, "INSUFFICIENT_DATA")
    ok = code.isNull()
    up, down = F.col("first_high"), F.col("first_low")
    return state.select(
        *keys, F.when(ok, F.col("s_high")).alias("s_high"), F.when(ok, F.col("s_low")).alias("s_low"),
        (ok & up.isNotNull()).alias("signal_high"), (ok & down.isNotNull()).alias("signal_low"),
        F.when(ok, up).alias("first_crossing_high"), F.when(ok, down).alias("first_crossing_low"),
        F.col("n_obs").alias("n_observations"), "n_gaps", code.alias("refusal_code"), "n_late",
    )


def quality_stream(
    rows: DataFrame, key: str, event_time: str, width: str, delay: str, low: float, high: float
) -> DataFrame:
    """Missing, non-finite and out-of-range counts per key and tumbling window."""
    x = F.col("value")
    good = R.finite(x) & (x >= low) & (x <= high)
    return (
        rows.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width).alias("w"), key)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(x.isNull()).alias("n_missing"),
            F.count_if(x.isNotNull() & ~R.finite(x)).alias("n_nonfinite"),
            F.count_if(R.finite(x) & ~good).alias("n_impossible"),
        )
        .select(F.col("w.start").alias("window_start"), key, "n_total", "n_missing", "n_nonfinite", "n_impossible")
    )
