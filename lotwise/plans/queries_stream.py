"""Registered queries that run the streaming jobs over the whole tables and return what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import cohort as C
from lotwise.plans.queries_ingest import PROFILE
from lotwise.plans.queries_series import HIGH, LOW
from lotwise.plans.reports import rounded
from lotwise.plans.views import SERIES_KEYS, series_view, upload_view
from lotwise.streaming import jobs as J


# Rows with such an id arrive a slice later than their date says; hours that rows may lag behind
LAGGARDS, LAG_HOURS = (97, 5), 48.0
EVENT_LAGGARDS, EVENT_LAG_HOURS = (50, 7), 6.0


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per finding and side after a stream of four slices by date, some rows of each arriving with the next."""
    rows = upload_view(spark, sf_dir)
    year = F.year(F.to_timestamp("read_timestamp"))
    behind = (F.col("source_row") % LAGGARDS[0] == LAGGARDS[1]).cast("int")
    slice_of = F.least(F.lit(3), F.floor((year - 1995) / 2).cast("int")) + behind
    base = J.new_base(spark)
    for stream in J.arrivals(rows, slice_of, 5):
        J.ingest_stream(stream, PROFILE, F.to_timestamp("read_timestamp"), LAG_HOURS, base)
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy(F.coalesce("finding_code", F.lit("ACCEPTED")).alias("outcome"), "side").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("censored").alias("n_censored"), F.sum("source_row").alias("row_sum")
    )


def stream_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUSUM of all events from a stream of four slices, in which some events arrive a slice late."""
    stats = C.lot_statistics(series_view(spark, sf_dir), ["parameter"], "value").select(
        "parameter", F.col("median").alias("reference"), F.col("robust_sigma").alias("scale")
    )
    rows = series_view(spark, sf_dir).select(*SERIES_KEYS, F.col("read_timestamp").cast("timestamp").alias("ts"), "seq", "value")
    rows = rows.join(F.broadcast(stats), "parameter")
    behind = (F.col("seq") % EVENT_LAGGARDS[0] == EVENT_LAGGARDS[1]).cast("int")
    slice_of = F.floor((F.dayofmonth("ts") - 1) / 8).cast("int") + behind
    base, stream = J.new_base(spark), None
    for stream in J.arrivals(rows, slice_of, 5):
        J.cusum_stream(stream, SERIES_KEYS, F.col("ts"), "seq", EVENT_LAG_HOURS, base)
    return rounded(J.cusum_close(stream, base, SERIES_KEYS, "seq"))


def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = J.read_files(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.quality_stream(events, "event_type", "ts", "1 day", "2 days", LOW, HIGH)
    folder = J.run(out, "update")
    rows = J.latest(spark, folder, ["window_start", "event_type"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


QUERIES = {"stream_ingest": stream_ingest, "stream_cusum": stream_cusum, "stream_quality": stream_quality}
