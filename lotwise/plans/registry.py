"""All registered queries."""

from lotwise.plans import (
    queries_cohort, queries_data, queries_drift, queries_explain, queries_ingest, queries_scoring, queries_series, queries_store, queries_stream, queries_trace,
)

QUERIES = {
    **queries_cohort.QUERIES,
    **queries_ingest.QUERIES,
    **queries_series.QUERIES,
    **queries_drift.QUERIES,
    **queries_data.QUERIES,
    **queries_trace.QUERIES,
    **queries_explain.QUERIES,
    **queries_scoring.QUERIES,
    **queries_store.QUERIES,
    **queries_stream.QUERIES,
}
