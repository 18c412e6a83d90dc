"""All SQL twins."""

from oracles import cohort, data, drift, explain, ingest, scoring, series, store, stream, trace

ORACLES = {**cohort.ORACLES, **ingest.ORACLES, **series.ORACLES, **drift.ORACLES, **data.ORACLES, **trace.ORACLES, **explain.ORACLES, **scoring.ORACLES, **store.ORACLES, **stream.ORACLES}
