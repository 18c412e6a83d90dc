"""A sample of the registered queries against their SQL twins; ``python -m oracles.compare`` runs all of them."""

import pytest

import __spark_entry__ as entry
from lotwise.plans.registry import QUERIES
from oracles.compare import connect, run
from oracles.registry import ORACLES
from tests.conftest import SF_DIR

SAMPLE = (
    "dpat_loo_small", "lot_histogram", "ingest_verdicts", "medcouple_lot", "shape_phi", "split_assignment", "split_types", "limit_violations", "joint_distance_loo",
    "curve_areas", "ordered_artifacts", "profile_versions", "stored_quality",
)


def test_registry():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, text = run(spark, connect(SF_DIR), SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text
