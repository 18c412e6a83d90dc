"""Registered queries over stored tables: upserts, replays, runs, profiles, dispositions, ordered artifacts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import formulas as T
from lotwise.operators import ingest as I
from lotwise.operators import labels as L
from lotwise.plans import evidence as E
from lotwise.plans.queries_data import LIMITS
from lotwise.plans.queries_drift import _escapes
from lotwise.plans.queries_ingest import PROFILE, _validated
from lotwise.plans.reports import rounded
from lotwise.plans.views import COHORT_LIMITS, COHORT_PARAMETERS, cohort_view, dealt_cohorts, table, trajectory_rows
from lotwise.session import stage
from lotwise.sources import sinks
from lotwise.streaming.jobs import new_base


def _text_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def stored_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the first half of the upload, overwritten by that of the whole upload where a part is in both."""
    rows = _validated(spark, sf_dir)
    keys = ["component_id", "lot_id", "component_type", "parameter"]
    quality = lambda df: I.grid_quality(df, PROFILE).select(*keys, "n_missing", "n_valid", "score")
    old = quality(rows.filter("source_row % 2 = 0"))
    return rounded(sinks.upsert(old, quality(rows.filter("source_row % 3 > 0")), keys))


def stored_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of the accepted rows; those of odd rows stay as they are, others are inserted."""
    ok = I.accepted(_validated(spark, sf_dir))
    old = sinks.lots_table(ok.filter("source_row % 2 = 1 AND lot_id < 'L3'"))
    return old.unionByName(sinks.insert_missing(old, sinks.lots_table(ok), ["lot_id"]))


def stored_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.components_table(I.accepted(_validated(spark, sf_dir))).select("component_id", "lot_id", "component_type")


def component_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the component directory and the row that tells of a third."""
    # Both pages read the directory, so it is written once.
    parts = stage(sinks.components_table(I.accepted(_validated(spark, sf_dir))).select("component_id", "lot_id"))
    first = sinks.component_page(parts, None, 50).agg(F.max("component_id")).first()[0]
    return sinks.component_page(parts, first, 50)


def ingest_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot's rows as a dataset; those of even lots are known already under the same content digest."""
    rows = I.accepted(_validated(spark, sf_dir))
    sets = I.dataset_digest(rows, ["lot_id"], _text_digest("source_row"))
    known = sets.filter(F.substring("lot_id", 2, 9).cast("int") % 2 == 0)
    return sinks.ingest_records(known.select("dataset_hash"), sets).select("lot_id", "row_count", "outcome")


def stored_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted while they are written, and rows and sums read back."""
    base = new_base(spark)
    rows = I.accepted(_validated(spark, sf_dir))
    n = sum(sinks.write_measurements(rows.filter(F.col("parameter") == p), f"{base}/m", p) for p in ("p1", "p2", "p3"))
    stored = sinks.read_table(spark, f"{base}/m")
    return rounded(stored.agg(F.count(F.lit(1)).alias("n_stored"), F.lit(n).alias("n_written"), F.sum(F.floor("value")).alias("value_sum")))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of worst parameters, committed once although written twice, read back from its JSON."""
    base = new_base(spark)
    rows, dealt = dealt_cohorts(spark, sf_dir)
    worst = E.worst_parameter(_escapes(spark, rows, dealt), COHORT_PARAMETERS)
    good, _ = E.refuse_small_lots(worst, by=dealt.get("by", ()))
    kept = good.select("component_id", "lot_id", "parameter", "severity", "dpat_verdict", "absolute_fail")
    won = [sinks.commit_run(part, base, "run-1", ["component_id", "lot_id"], {"kind": "anomaly"}) for part in (kept, kept.filter("lot_id < 10"))]
    rows = sinks.read_run(spark, base, "run-1", "parameter string, severity string, dpat_verdict string, absolute_fail boolean")
    return rows.select("component_id", "lot_id", "result.*").withColumn("n_runs", F.lit(sinks.read_runs(spark, base).count())).withColumn(
        "first_won", F.lit(won == [True, False])
    )


def queue_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and size lots of parts with fewer than three parts, which no queue ranks."""
    part = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("lot_id"), "p_partkey")
    return E.refuse_small_lots(part)[1]


def profile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as profiles with a version per year of shipping; what may be rewritten and what is bound by orders."""
    item = table(spark, sf_dir, "lineitem")
    profiles = item.groupBy(F.col("l_suppkey").cast("string").alias("profile_id"), F.year("l_shipdate").alias("version")).agg(
        F.count(F.lit(1)).cast("string").alias("body")
    )
    used = item.filter("l_quantity = 1 AND l_discount > 0.05").select(F.col("l_suppkey").cast("string").alias("profile_id"), F.year("l_shipdate").alias("version"))
    wanted = profiles.filter("CAST(profile_id AS INT) % 4 = 0").withColumn("body", F.lit("new")).withColumn(
        "version", F.when(F.col("profile_id").cast("int") % 8 == 0, F.col("version") + 1).otherwise(F.col("version"))
    )
    after, refused = sinks.rewrite_profiles(profiles, wanted, used)
    newest = sinks.latest_profiles(after).select("profile_id", F.col("version").alias("latest"))
    counts = after.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("body") == "new").alias("n_rewritten"))
    errors = refused.groupBy("profile_id").agg(
        F.count_if(F.col("error") == "PROFILE_REFERENCED").alias("n_referenced"), F.count_if(F.col("error") == "UNKNOWN_VERSION").alias("n_unknown")
    )
    out = counts.join(newest, "profile_id").join(errors, "profile_id", "left")
    return out.select("profile_id", "n_versions", "n_rewritten", "latest", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_referenced", "n_unknown")])


def disposition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the items of one order priority, of which overrides without a reason are refused."""
    orders = table(spark, sf_dir, "orders")
    asks = orders.select(
        F.col("o_orderkey").alias("component_id"), F.when(F.col("o_totalprice") > 150000, "OVERRIDE").otherwise("ACCEPT").alias("action"),
        F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("reason"),
    )
    payload = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("component_id")).agg(F.count(F.lit(1)).alias("n"))
    good, bad = sinks.dispositions(asks, payload)
    return good.select("component_id", "action", "payload_json", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("component_id", "action", F.lit(None).cast("string").alias("payload_json"), "error")
    )


def lot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on the parts of one customer."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.select(F.col("o_orderkey").alias("component_id"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))
    parts = orders.select(F.col("o_orderkey").alias("component_id"), (F.col("o_custkey") % 20).cast("string").alias("lot_id"))
    return sinks.lot_dispositions(stored, parts, "7").select("component_id", "lot_id", "o_orderstatus")


def ordered_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent digest of the trajectories at two partition counts, and of what was written and read."""
    rows = trajectory_rows(spark, sf_dir).select("component_id", "parameter", "elapsed_hours", "source_row")
    digest = _text_digest("component_id", "parameter", "elapsed_hours", "source_row")
    out = None
    for parts in (3, 11):
        one = sinks.ordered_digest(rows, sinks.ARTIFACT_ORDER, digest, parts).withColumn("partitions", F.lit(parts))
        out = one if out is None else out.unionByName(one)
    return out


def split_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every artifact written from the trajectories."""
    base = new_base(spark)
    rows = trajectory_rows(spark, sf_dir)
    truth = rows.filter("elapsed_hours = 168").select("component_id", "lot_id", "parameter", F.col("value").alias("value_168h"))
    sinks.write_artifacts(rows, truth, base)
    out = None
    for name in ("full", "truth", "screening", "train", "calib", "test"):
        part = spark.read.parquet(f"{base}/{name}").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("component_id").alias("n_parts"))
        part = part.withColumn("artifact", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of four tables against one taken after changes."""
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "customer", "part")}
    digests = {"nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}
    named = {n: df.select(F.col(digests[n]).cast("string").alias("k")) for n, df in tables.items()}
    before = sinks.manifest(named, F.sha2("k", 256))
    named["supplier"] = named["supplier"].withColumn("k", F.concat("k", F.when(F.col("k") == "1", "x").otherwise("")))
    named["customer"] = named["customer"].filter("k <> '2'")
    named["region"] = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"))
    del named["part"]
    return sinks.compare_manifests(before, sinks.manifest(named, F.sha2("k", 256)))


def label_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labels, some of them altered, against recomputed ones."""
    fresh = L.labels(trajectory_rows(spark, sf_dir), LIMITS).select("component_id", "failure_label", "stratum")
    stored = fresh.filter("component_id % 50 <> 3").withColumn("failure_label", F.when(F.col("component_id") % 7 == 1, "FAILED").otherwise(F.col("failure_label")))
    return L.compare_labels(stored, fresh)


def shown_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearer limit of each reading, and value and unit for display."""
    rows = cohort_view(spark, sf_dir).select("component_id", "parameter", "value")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for p, (a, b, _) in COHORT_LIMITS.items():
        low = F.when(F.col("parameter") == p, F.lit(a).cast("double")).otherwise(low)
        high = F.when(F.col("parameter") == p, F.lit(b).cast("double")).otherwise(high)
    return rounded(rows.withColumn("nearer", T.nearer_limit(F.col("value"), low, high)))


QUERIES = {
    "stored_quality": stored_quality,
    "stored_lots": stored_lots,
    "stored_components": stored_components,
    "component_pages": component_pages,
    "ingest_replay": ingest_replay,
    "stored_measurements": stored_measurements,
    "run_results": run_results,
    "queue_refusals": queue_refusals,
    "profile_versions": profile_versions,
    "disposition_log": disposition_log,
    "lot_decisions": lot_decisions,
    "ordered_artifacts": ordered_artifacts,
    "split_artifacts": split_artifacts,
    "manifest_status": manifest_status,
    "label_differences": label_differences,
    "shown_limits": shown_limits,
}
