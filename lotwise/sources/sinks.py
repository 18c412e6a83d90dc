"""Append-only tables, keyed overwrites, versioned profiles, artifacts and manifests on Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.ingest import dataset_digest
from lotwise.session import stage

ARTIFACT_ORDER = ["component_id", "parameter", "elapsed_hours"]
DIGEST_PRIME = (1 << 61) - 1


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None while nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_measurements(rows: DataFrame, path: str, dataset_hash: str) -> int:
    """Store accepted rows under their dataset; returns the number of rows the job wrote."""
    seen = Observation()
    counted = rows.withColumn("dataset_hash", F.lit(dataset_hash)).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").partitionBy("dataset_hash").parquet(path)
    return int(seen.get["rows"])


def unseen_datasets(catalogue: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Incoming dataset rows whose content hash is not in the catalogue yet."""
    return incoming if catalogue is None else incoming.join(catalogue.select("dataset_hash"), "dataset_hash", "left_anti")


def ingest_records(catalogue: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Audit rows: COMMITTED for new content, DUPLICATE_CONTENT for a replay."""
    known = None if catalogue is None else catalogue.select("dataset_hash").distinct().withColumn("_known", F.lit(True))
    marked = incoming.withColumn("_known", F.lit(None).cast("boolean")) if known is None else incoming.join(known, "dataset_hash", "left")
    return marked.withColumn("outcome", F.when(F.col("_known"), "DUPLICATE_CONTENT").otherwise("COMMITTED")).drop("_known")


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key; the newest is chosen while combining before the shuffle."""
    if existing is None:
        return incoming
    values = [c for c in incoming.columns if c not in keys]
    both = existing.select(*incoming.columns).withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_v").alias("_r")).select(*keys, "_r.*")


def insert_missing(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key does not exist yet."""
    return incoming if existing is None else incoming.join(existing.select(*keys), list(keys), "left_anti")


def lots_table(rows: DataFrame) -> DataFrame:
    parts = rows.select("lot_id", "component_type", "component_id").distinct()
    return parts.groupBy("lot_id").agg(F.min("component_type").alias("component_type"), F.count(F.lit(1)).alias("n_parts"))


def components_table(rows: DataFrame) -> DataFrame:
    meta = F.struct("source_row", "lot_id", "component_type", "board_id", "socket_id", "thermal_zone", "tester_id")
    return rows.groupBy("component_id").agg(F.min(meta).alias("_m")).select("component_id", "_m.*").drop("source_row")


def component_page(components: DataFrame, after: str | None, size: int) -> DataFrame:
    """Keyset page of the component directory; one row more than ``size`` tells that another page follows."""
    rows = components if after is None else components.filter(F.col("component_id") > after)
    return rows.orderBy("component_id").limit(size + 1)


def dataset_catalogue(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("created_at"), "dataset_hash")


def dispositions(requests: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with a JSON snapshot of the part's payload, rejected). An OVERRIDE needs a reason."""
    blank = F.coalesce(F.trim("reason"), F.lit("")) == ""
    refused = (F.col("action") == "OVERRIDE") & blank
    snapshot = payload.select("component_id", F.to_json(F.struct(*payload.columns)).alias("payload_json"))
    accepted = requests.filter(~refused).join(snapshot, "component_id", "left")
    return accepted, requests.filter(refused).withColumn("error", F.lit("OVERRIDE_WITHOUT_REASON"))


def lot_dispositions(stored: DataFrame, components: DataFrame, lot_id: str) -> DataFrame:
    """Dispositions of one lot in the order they were made."""
    lot = components.filter(F.col("lot_id") == lot_id).select("component_id", "lot_id")
    return stored.join(lot, "component_id").orderBy("created_at", "component_id")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists; False if it did. The file system's exclusive create decides between writers."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = system.create(target, False)
    except Exception as error:
        if system.exists(target):
            return False
        raise error
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def commit_run(results: DataFrame, base: str, run_id: str, keys: Sequence[str], about: dict[str, str] | None = None) -> bool:
    """Store one analysis run: a JSON row per part and parameter, and a run row. False if the run id was taken.

    Results go to a folder of this attempt first; the run is the manifest that names it, created exclusively. A second
    writer of the same id, or a replay, loses and its folder is never read.
    """
    spark = results.sparkSession
    attempt = uuid.uuid4().hex
    seen = Observation()
    rows = results.select(*keys, F.to_json(F.struct(*results.columns)).alias("result_json")).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.option("compression", "zstd").parquet(f"{base}/results/{run_id}/{attempt}")
    manifest = {"run_id": run_id, "attempt": attempt, "n_results": int(seen.get["rows"]), **(about or {})}
    return put_if_absent(spark, f"{base}/runs/{run_id}.json", json.dumps(manifest))


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    """The run rows."""
    return spark.read.json(f"{base}/runs")


def read_run(spark: SparkSession, base: str, run_id: str, schema: str | None = None) -> DataFrame:
    """Result rows of a committed run; with the schema of a result, its fields beside the JSON."""
    run = read_runs(spark, base).filter(F.col("run_id") == run_id).first()
    if run is None:
        raise KeyError(f"no run {run_id}")
    rows = spark.read.parquet(f"{base}/results/{run_id}/{run.attempt}")
    return rows if schema is None else rows.withColumn("result", F.from_json("result_json", schema))


def next_profile_version(profiles: DataFrame | None, document: DataFrame) -> DataFrame:
    """The document with version = newest version of its profile + 1."""
    if profiles is None:
        return document.withColumn("version", F.lit(1))
    newest = profiles.groupBy("profile_id").agg(F.max("version").alias("_v"))
    return document.join(newest, "profile_id", "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v")


def latest_profiles(profiles: DataFrame) -> DataFrame:
    w = Window.partitionBy("profile_id").orderBy(F.desc("version"))
    return profiles.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def referenced_profiles(profiles: DataFrame, used: DataFrame) -> DataFrame:
    """Profile versions that a disposition or run names; these must not be rewritten."""
    return profiles.join(used.select("profile_id", "version").distinct(), ["profile_id", "version"], "left_semi")


def profile_version(profiles: DataFrame, profile_id: str, version: int) -> DataFrame:
    """Exactly that version; empty if there is none."""
    return profiles.filter((F.col("profile_id") == profile_id) & (F.col("version") == version))


def rewrite_profiles(profiles: DataFrame, documents: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles after the rewrite, refused documents). A version that a run or disposition names stays as it is."""
    keys = ["profile_id", "version"]
    known = documents.join(profiles.select(*keys), keys, "left_semi")
    bound = referenced_profiles(known, used)
    error = F.when(F.col("_bound"), "PROFILE_REFERENCED").otherwise("UNKNOWN_VERSION")
    refused = documents.join(known.join(bound.select(*keys), keys, "left_anti").select(*keys), keys, "left_anti")
    refused = refused.join(bound.select(*keys).withColumn("_bound", F.lit(True)), keys, "left").withColumn("error", error).drop("_bound")
    allowed = known.join(bound.select(*keys), keys, "left_anti")
    return upsert(profiles, allowed.select(*profiles.columns), keys), refused


def in_order(rows: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted over all: by ranges of the keys, then within each range; a range is one file, in the order of names."""
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def write_ordered(rows: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None) -> None:
    in_order(rows, keys, partitions).write.mode("overwrite").parquet(path)


def ordered_digest(rows: DataFrame, keys: Sequence[str], digest: Column, partitions: int | None = None) -> DataFrame:
    """One row: count and a digest that depends on the order of the rows, the same for any number of partitions.

    A row counts with its position, which is its place in its range and the rows of the ranges before; equal keys go by
    digest. Sums of position times digest lane, kept below a prime, combine in any order.
    """
    lane_keys = [*[F.col(k) for k in keys], F.col("_h")]
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*keys, digest.alias("_h")).repartitionByRange(parts, *lane_keys).sortWithinPartitions(*lane_keys)
    placed = stage(placed.select("_h", F.monotonically_increasing_id().alias("_at")))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    at = placed.withColumn("_part", part).join(offsets, "_part")
    position = (F.col("_offset") + place + 1).cast("decimal(20,0)")
    prime = F.lit(str(DIGEST_PRIME)).cast("decimal(20,0)")
    lanes = [
        F.sum(F.pmod(F.conv(F.substring("_h", 1 + 12 * i, 12), 16, 10).cast("decimal(18,0)") * position, prime).cast("decimal(20,0)")).alias(f"_l{i}")
        for i in range(4)
    ]
    one = at.agg(F.count(F.lit(1)).alias("row_count"), *lanes)
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(4)])
    return one.select("row_count", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("order_digest"))


def write_artifacts(rows: DataFrame, truth: DataFrame, base: str, split_column: str = "split") -> None:
    """Full, truth, screening and split tables, each in the order of part, parameter and hour."""
    write_ordered(rows.drop(split_column), f"{base}/full", ARTIFACT_ORDER)
    write_ordered(truth, f"{base}/truth", [c for c in ARTIFACT_ORDER if c in truth.columns])
    write_ordered(rows.filter(F.col("elapsed_hours").isin(0, 24)).drop(split_column), f"{base}/screening", ARTIFACT_ORDER)
    for split in ("train", "calib", "test"):
        write_ordered(rows.filter(F.col(split_column) == split).drop(split_column), f"{base}/{split}", ARTIFACT_ORDER)


def manifest(tables: dict[str, DataFrame], digest: Column | None = None) -> DataFrame:
    """Row count and content digest of each table."""
    out = None
    for name, table in tables.items():
        h = digest if digest is not None else F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
        part = dataset_digest(table, (), h).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One status per table: SAME, CHANGED, ROWS_DIFFER, MISSING or UNEXPECTED."""
    a = expected.select("table_name", F.col("row_count").alias("_n"), F.col("dataset_hash").alias("_h"))
    both = a.join(actual, "table_name", "full")
    status = (
        F.when(F.col("dataset_hash").isNull(), "MISSING")
        .when(F.col("_h").isNull(), "UNEXPECTED")
        .when(F.col("_n") != F.col("row_count"), "ROWS_DIFFER")
        .when(F.col("_h") != F.col("dataset_hash"), "CHANGED")
        .otherwise("SAME")
    )
    return both.select("table_name", status.alias("status"))
