"""Measurement-shaped views over the star-schema and event tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.ordered import GroupSizes, deal
from lotwise.sources.readers import read_parquet, spread

COHORT_KEYS = ["lot_id", "component_type", "parameter", "elapsed_hours"]
SERIES_KEYS = ["component_id", "parameter"]
GROUP_KEYS = ["component_type", "parameter"]

# Absolute limits used on the line-item view
COHORT_LIMITS = {
    "quantity": (None, 49.0, "ea"),
    "price": (1000.0, 95000.0, "usd"),
    "discount": (None, 0.095, "ratio"),
    "rebate": (None, 75.0, "usd"),
}
MEASURES = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "rebate": "l_extendedprice * l_discount * l_tax / 7D",
}
COHORT_PARAMETERS = ("quantity", "price", "discount", "rebate")

# Absolute upper limit used on the trajectory view
TRAJECTORY_HIGH = 150.0
# Fixed value: what the number of a triple is worth in the part's id
TRIPLE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0])


def cohort_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as 24 h readings: the supplier is the lot, three measures and their rebate are the parameters."""
    return _cohort_rows(table(spark, sf_dir, "lineitem"))


def dealt_cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Any]]:
    """The cohort view with whole lots dealt to tasks before a line item becomes four readings, and what operators take of that.

    Lots too few or too large for it are left where they are.
    """
    dealt = deal(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey")
    if dealt is None:
        return cohort_view(spark, sf_dir), {}
    item, lots = dealt
    n = len(COHORT_PARAMETERS)
    return _cohort_rows(item), {"by": ["lot_id"], "sizes": GroupSizes(n * lots.groups, lots.largest, n * lots.rows)}


def _cohort_rows(item: DataFrame) -> DataFrame:
    over = (F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08)
    return item.select(
        _item_id(),
        F.col("l_suppkey").alias("lot_id"),
        F.lit("ITEM").alias("component_type"),
        F.expr(f"stack({len(MEASURES)}, {', '.join(f"'{p}', {m}" for p, m in MEASURES.items())}) AS (parameter, value)"),
        F.lit(24).alias("elapsed_hours"),
        F.when(over, "OVERRANGE").otherwise("OK").alias("status"),
        (F.col("l_partkey") % 50).alias("socket_id"),
        F.col("l_linestatus").alias("thermal_zone"),
        F.col("l_returnflag").alias("tester_id"),
        F.col("l_shipdate").alias("read_timestamp"),
    )


def _item_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("component_id")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort view with one row per part: its smallest value of each parameter; parts that lack one are left out."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(_item_id(), *[F.expr(m).alias(p) for p, m in MEASURES.items()])
    return item.groupBy("component_id").agg(*[F.min(p).alias(p) for p in MEASURES]).dropna("any", subset=list(MEASURES))


def small_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiny lots: brand and size name the lot, the retail price is the reading."""
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("lot_id"),
        F.col("p_partkey").alias("component_id"),
        F.col("p_retailprice").alias("value"),
    )


def series_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one ordered series per user and event type; ``t`` is hours since the epoch."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("component_id"),
        F.col("event_type").alias("parameter"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("t"),
        F.col("event_id").alias("seq"),
        "value",
        F.col("ts").alias("read_timestamp"),
    )


def trajectory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trajectories, long format: each three successive events of a series are a part's 0, 24 and 168 h readings.

    The part is the user and the number of the triple; a series whose events are no multiple of three ends in a part with
    missing read-points. Some parts of the test split come from a tester that no other split has.
    """
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    user = F.col("user_id")
    place = F.row_number().over(w) - 1
    return (
        events.withColumn("_place", place)
        .select(
            (user + F.expr("_place div 3") * TRIPLE).alias("component_id"),
            (user % 10).alias("lot_id"),
            (user % 3).cast("string").alias("component_type"),
            F.col("event_type").alias("parameter"),
            F.element_at(F.array(F.lit(0), F.lit(24), F.lit(168)), F.col("_place") % 3 + 1).alias("elapsed_hours"),
            "value",
            F.lit("OK").alias("status"),
            (F.lit(120.0) + (user % 5)).alias("temperature_c"),
            F.when((user % 10 >= 8) & (user % 3 == 0), "new").otherwise((user % 4).cast("string")).alias("tester_id"),
            (user % 7).cast("string").alias("socket_id"),
            (user % 2).cast("string").alias("thermal_zone"),
            F.col("ts").alias("read_timestamp"),
            F.col("event_id").alias("source_row"),
            F.when(user % 10 < 6, "train").when(user % 10 < 8, "calib").otherwise("test").alias("split"),
        )
    )


# Parameters, units and limits of the upload view
UPLOAD_LIMITS = {f"p{i}": (1000.0, 90000.0, "u1") for i in range(1, 7)}


def upload_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an upload with defects that occur naturally in their values; rows keep their file position."""
    return shape_upload(spread(read_parquet(spark, f"{sf_dir}/lineitem.parquet"), "source_row"))


def shape_upload(item: DataFrame) -> DataFrame:
    """The upload columns of line items that carry a source_row."""
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return item.select(
        "source_row",
        F.col("l_orderkey").cast("string").alias("component_id"),
        F.concat(F.lit(" L"), (F.col("l_suppkey") % 40).cast("string")).alias("lot_id"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 40 % 5).cast("string")).alias("component_type"),
        F.when(line == 7, "mystery").otherwise(F.concat(F.lit("p"), line.cast("string"))).alias("parameter"),
        F.when(F.col("l_quantity") == 13, 96.0)
        .when(F.col("l_quantity") == 14, 0.5)
        .when(F.col("l_linestatus") == "O", 0.0)
        .otherwise(24.0)
        .alias("elapsed_hours"),
        F.when((F.col("l_discount") == 0.1) & (F.col("l_quantity") == 7), None)
        .otherwise(F.col("l_extendedprice"))
        .alias("measurement_value"),
        F.when(F.col("l_suppkey") % 37 == 0, "u2").otherwise("u1").alias("measurement_unit"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.05), "  ")
        .when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), "NOT_MEASURED")
        .when((flag == "R") & (F.col("l_tax") >= 0.08), "OVERRANGE")
        .otherwise("OK")
        .alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("read_timestamp"),
        F.when(F.col("l_partkey") % 500 == 3, "FIELD").otherwise("SYNTHETIC").alias("data_provenance"),
    )
