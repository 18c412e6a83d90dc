"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "robust_stats_lot", "dpat_loo", "escape_list", "worst_parameter", "ingest_verdicts", "cusum", "series_quality",
    "conformal_ladder", "labels", "mahalanobis_mcd", "evidence", "ingest_findings", "lot_summary",
)


def main() -> None:
    from lotwise.plans.registry import QUERIES
    from lotwise.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(","):
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()}
    if "evidence" in times:  # rows of evidence, one per part and parameter
        events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").count()
        rows["evidence"] = events.selectExpr("sum(ceil(count / 3))").first()[0]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": {
                    name: round(n / times[name])
                    for name, n in (
                        ("ingest_verdicts", rows["lineitem"]), ("dpat_loo", 4 * rows["lineitem"]), ("evidence", rows.get("evidence", 0))
                    )
                    if name in times
                },
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
