"""Ingest rules, digests, sinks and readers on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import ingest as I
from lotwise.sources import readers, sinks

PROFILE = I.Profile(limits={"iddq_standby": (None, 50.0, "uA"), "prop_delay": (None, 20.0, "ns")})


def upload(spark):
    rows = [
        # row, component, lot, type, parameter, hour, value, unit, status, stamp, provenance
        (1, "C1", "L1", "T", "iddq_standby", "0", "9.5", "uA", "OK", "2026-01-01T00:00:00", "SYNTHETIC"),
        (2, "C1", "L1", "T", "iddq_standby", "24", "9.8", "uA", "OK", "2025-12-31T00:00:00", None),
        (3, "C2", "L1", "T", "iddq_standby", "0", "9.9", "mA", "OK", None, None),
        (4, "C2", "L1", "T", "iddq_standby", "0", "9.9", "uA", "OK", None, None),
        (5, "C3", "L1", "T", "nonsense", "0", "1", "uA", "OK", None, None),
        (6, "C3", " ", "T", "iddq_standby", "0", "1", "uA", "OK", None, None),
        (7, "C3", "L1", "T", "iddq_standby", "0.5", "1", "uA", "OK", None, None),
        (8, "C3", "L1", "T", "iddq_standby", "96", "1", "uA", "OK", None, None),
        (9, "C3", "L1", "T", "iddq_standby", "0", "abc", "uA", "OK", None, None),
        (10, "C4", "L1", "T", "iddq_standby", "0", "2e9", "uA", "OK", None, None),
        (11, "C5", "L1", "T", "iddq_standby", "0", None, "uA", "NOT_MEASURED", None, None),
        (12, "C6", "L1", "T", "iddq_standby", "0", "3", "uA", "BELOW_LOD", None, None),
        (13, "C7", "L2", "T", "prop_delay", "0", "3", "ns", "OK", None, "FIELD"),
        (14, "C8", "L2", "T", "prop_delay", "0", "3", "ns", "SUSPECT", None, None),
    ]
    schema = (
        "source_row long, component_id string, lot_id string, component_type string, parameter string, elapsed_hours"
        " string, measurement_value string, measurement_unit string, status string, read_timestamp string,"
        " data_provenance string"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


def test_rules(spark):
    got = {r["source_row"]: (r["finding_code"], r["censored"]) for r in I.validate(upload(spark), PROFILE).collect()}
    assert got == {
        1: (None, False), 2: (None, False), 3: ("UNIT_MISMATCH", False),
        # the rejected first row has claimed the key
        4: ("DUPLICATE_KEY", False), 5: ("SCHEMA_VIOLATION", False), 6: ("SCHEMA_VIOLATION", False),
        7: ("SCHEMA_VIOLATION", False), 8: ("READPOINT_OUT_OF_GRID", False), 9: ("RANGE_VIOLATION", False),
        10: ("RANGE_VIOLATION", False), 11: ("NOT_MEASURED_ROW", False), 12: (None, True),
        13: ("SCHEMA_VIOLATION", False), 14: (None, False),
    }


def test_findings_and_classes(spark):
    checked = I.validate(upload(spark), PROFILE)
    found = {r["code"]: r for r in I.findings(I.occurrences(checked, PROFILE)).collect()}
    assert found["SCHEMA_VIOLATION"]["count"] == 4
    assert found["SCHEMA_VIOLATION"]["sample_rows"] == [5, 6, 7, 13]
    assert found["NON_MONOTONIC_TIME"]["count"] == 1
    assert found["SINGLE_PART_LOT"]["affected_lots"] == ["L2"]
    assert found["MISSING_READPOINT"]["count"] == 2
    assert {r["class"]: r["rejected"] for r in I.rejection_classes(checked).collect()} == {
        "SCHEMA": 5, "RANGE": 3, "UNIT": 1, "DUPLICATE": 1,
    }
    assert I.decide(I.rejection_classes(checked), I.findings(I.occurrences(checked, PROFILE)), 0) == "VALIDATION_FAILED"


def test_digest_ignores_order_not_content(spark):
    rows = I.accepted(I.validate(upload(spark), PROFILE))
    a = I.dataset_digest(rows).first()
    b = I.dataset_digest(rows.repartition(7).orderBy(F.desc("value"))).first()
    c = I.dataset_digest(rows.withColumn("value", F.col("value") + 1e-9)).first()
    twice = I.dataset_digest(rows.unionByName(rows)).first()
    assert a == b and a["dataset_hash"] != c["dataset_hash"] and a["dataset_hash"] != twice["dataset_hash"]


def test_csv_equals_parquet(spark, tmp_path):
    rows = upload(spark).orderBy("source_row")
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    rows.coalesce(1).drop("source_row").write.parquet(str(tmp_path / "p"))
    from_csv = readers.read_csv(spark, str(tmp_path / "c"))
    from_parquet = readers.read_parquet(spark, str(tmp_path / "p"))
    assert readers.check_columns(from_csv) == [] and readers.check_columns(from_csv.drop("status")) == ["status"]
    a, b = (I.dataset_digest(I.accepted(I.validate(x, PROFILE))).first() for x in (from_csv, from_parquet))
    assert a["dataset_hash"] == b["dataset_hash"]
    numbered = readers.number_csv_rows(from_csv.drop("source_row"))
    assert [r["source_row"] for r in numbered.orderBy("source_row").collect()] == list(range(1, 15))


def test_store_replay_and_upsert(spark, tmp_path):
    rows = I.accepted(I.validate(upload(spark), PROFILE))
    path = str(tmp_path / "m")
    assert sinks.read_table(spark, path) is None
    assert sinks.write_measurements(rows, path, "sha256:x") == rows.count()
    one = spark.createDataFrame([("sha256:x", 1)], "dataset_hash string, n int")
    assert sinks.unseen_datasets(one, one).count() == 0
    assert [r["outcome"] for r in sinks.ingest_records(one, one).collect()] == ["DUPLICATE_CONTENT"]
    assert [r["outcome"] for r in sinks.ingest_records(None, one).collect()] == ["COMMITTED"]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert [r["k"] for r in sinks.insert_missing(old, new, ["k"]).collect()] == ["c"]
    assert {r["lot_id"]: r["n_parts"] for r in sinks.lots_table(rows).collect()} == {"L1": 2, "L2": 1}
    assert sinks.components_table(rows).count() == 3
    assert [r["component_id"] for r in sinks.component_page(sinks.components_table(rows), "C1", 1).collect()] == ["C6", "C8"]


def test_profiles_and_dispositions(spark):
    doc = spark.createDataFrame([("p", "x")], "profile_id string, body string")
    v1 = sinks.next_profile_version(None, doc)
    v2 = sinks.next_profile_version(v1, doc)
    both = v1.unionByName(v2.select(*v1.columns))
    assert sinks.latest_profiles(both).first()["version"] == 2
    used = spark.createDataFrame([("p", 1)], "profile_id string, version int")
    assert [r["version"] for r in sinks.referenced_profiles(both, used).collect()] == [1]
    asks = spark.createDataFrame(
        [("C1", "ACCEPT", None), ("C2", "OVERRIDE", " "), ("C1", "OVERRIDE", "why")], "component_id string, action string, reason string"
    )
    payload = spark.createDataFrame([("C1", 1.5)], "component_id string, z double")
    good, bad = sinks.dispositions(asks, payload)
    assert good.count() == 2 and bad.first()["component_id"] == "C2"
    assert good.first()["payload_json"] == '{"component_id":"C1","z":1.5}'


def test_manifest(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    want = sinks.manifest({"a": a, "b": a, "gone": a})
    have = sinks.manifest({"a": a.repartition(3), "b": a.filter("i = 1"), "new": a})
    got = {r["table_name"]: r["status"] for r in sinks.compare_manifests(want, have).collect()}
    assert got == {"a": "SAME", "b": "ROWS_DIFFER", "gone": "MISSING", "new": "UNEXPECTED"}


def test_checks_are_not_repeated_by_filters_on_their_code(spark):
    from lotwise.plans.queries_ingest import PROFILE
    from lotwise.plans.views import upload_view
    from tests.conftest import SF_DIR

    claims = I.first_claims(I.structural_checks(upload_view(spark, SF_DIR), PROFILE, spark))
    plan = claims._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [line for line in plan if "Filter" in line]
    assert any("finding_code" in line for line in filters) and not any("trim(" in line for line in filters), filters


def test_component_pages_read_a_stored_directory(spark):
    from lotwise.plans.queries_store import component_pages
    from tests.conftest import SF_DIR

    page = component_pages(spark, SF_DIR)
    assert "Join" not in page._jdf.queryExecution().optimizedPlan().toString() and page.count() == 51
