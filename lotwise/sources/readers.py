"""Readers for long-format measurement files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.constants import REQUIRED_COLUMNS
from lotwise.operators.ordered import bounded_broadcast

OPTIONAL_COLUMNS = (
    "temperature_c", "voltage_v", "read_timestamp", "absolute_limit_low", "absolute_limit_high", "board_id",
    "socket_id", "thermal_zone", "tester_id", "operator_id", "data_provenance", "ingest_id",
)
CORRUPT = "_corrupt_record"


def upload_schema(columns: Sequence[str]) -> T.StructType:
    """CSV cells are read as text and coerced by the validation rules."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def check_columns(df: DataFrame) -> list[str]:
    """Required columns the frame lacks, sorted; the schema is all it reads."""
    return sorted(set(REQUIRED_COLUMNS) - set(df.columns))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header. Column names come from the header line; malformed lines are kept in ``_corrupt_record``.

    A CSV file has no row index, so ``source_row`` must be a column of the file; see ``number_csv_rows``.
    """
    header = list(columns) if columns else spark.read.csv(path, header=True).columns
    return spark.read.csv(path, header=True, schema=upload_schema(header), mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def number_csv_rows(df: DataFrame) -> DataFrame:
    """1-based row numbers in file order: the rows of each partition are counted, then their sums are added.

    ``df`` must be a plain scan, so that both passes see the same partitions.
    """
    inner = F.monotonically_increasing_id()
    rows = df.withColumns({"_part": F.shiftright(inner, 33), "_place": inner.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    out = rows.join(bounded_broadcast(offsets, df.rdd.getNumPartitions()), "_part")
    return out.withColumn("source_row", F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_offset")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with ``source_row``: 1-based, counted through the files in name order.

    Every file carries its own row index; only the row counts of the files are added up, no row is sorted.
    """
    df = spark.read.parquet(path)
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(bounded_broadcast(offsets, len(df.inputFiles())), "_file")
        .withColumn("source_row", F.col("_offset") + F.col("_index") + 1)
        .drop("_file", "_index", "_offset")
    )


def spread(df: DataFrame, column: str) -> DataFrame:
    """Hash rows over the cores when the input has fewer splits than the cluster has cores; else leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, column) if df.rdd.getNumPartitions() < cores else df
