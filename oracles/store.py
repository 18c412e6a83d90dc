"""Oracles for the queries over stored tables."""

from oracles.base import COHORT, LIMITS, TRAJ, fin, r6
from oracles.data import LABELS
from oracles.drift import ESCAPE
from oracles.ingest import QUALITY, UPLOAD


def _half(name: str, where: str) -> str:
    """Quality of some of the rows, as one CTE."""
    inner = QUALITY.replace("FROM ok GROUP BY ALL", f"FROM ok WHERE {where} GROUP BY ALL")
    return f"{name} AS (WITH {inner} SELECT component_id, lot_id, component_type, parameter, n_missing, n_valid, score FROM qs)"


def _digest(lanes: int, width: int, source: str) -> str:
    return ", ".join(f"CAST(sum((CAST('0x' || substr(h, {1 + width * i}, {width}) AS HUGEINT) * pos) % 2305843009213693951) AS VARCHAR) AS l{i}" for i in range(lanes)) + f" FROM {source}"


_ORDERED = f"""WITH {TRAJ}, h AS (SELECT *, sha256(component_id || '|' || parameter || '|' || elapsed_hours || '|' || source_row) AS h FROM traj),
  o AS (SELECT h, CAST(row_number() OVER (ORDER BY component_id, parameter, elapsed_hours, h) AS HUGEINT) AS pos FROM h),
  s AS (SELECT count(*) AS n, {_digest(4, 12, 'o')})
  SELECT n AS row_count, 'sha256:' || sha256(concat_ws('|', n, l0, l1, l2, l3)) AS order_digest, p AS partitions FROM s, (VALUES (3), (11)) t(p)"""

ORACLES = {
    "stored_quality": f"""WITH {UPLOAD}, {_half('a', 'source_row % 2 = 0')}, {_half('b', 'source_row % 3 > 0')}
      SELECT component_id, lot_id, component_type, parameter, n_missing, n_valid, {r6('score')} AS score FROM
        (SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (component_id, lot_id, component_type, parameter))""",
    "stored_lots": f"""WITH {UPLOAD}, a AS (SELECT lot_id, min(component_type) AS component_type, count(DISTINCT component_id) AS n_parts FROM ok WHERE source_row % 2 = 1 AND lot_id < 'L3' GROUP BY 1),
      b AS (SELECT lot_id, min(component_type) AS component_type, count(DISTINCT (component_type, component_id)) AS n_parts FROM ok GROUP BY 1)
      SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (lot_id)""",
    "stored_components": f"WITH {UPLOAD} SELECT component_id, min_by(lot_id, source_row) AS lot_id, min_by(component_type, source_row) AS component_type FROM ok GROUP BY 1",
    "component_pages": f"""WITH {UPLOAD}, c AS (SELECT component_id, min_by(lot_id, source_row) AS lot_id, row_number() OVER (ORDER BY component_id) AS r FROM ok GROUP BY 1)
      SELECT component_id, lot_id FROM c WHERE r BETWEEN 52 AND 102 ORDER BY component_id""",
    "ingest_replay": f"""WITH {UPLOAD} SELECT lot_id, count(*) AS row_count, CASE WHEN CAST(substr(lot_id, 2) AS INT) % 2 = 0 THEN 'DUPLICATE_CONTENT' ELSE 'COMMITTED' END AS outcome FROM ok GROUP BY lot_id""",
    "stored_measurements": f"""WITH {UPLOAD} SELECT count(*) AS n_stored, count(*) AS n_written, CAST(sum(floor(value)) AS BIGINT) AS value_sum FROM ok WHERE parameter IN ('p1', 'p2', 'p3')""",
    "run_results": f"""WITH {ESCAPE} SELECT component_id, lot_id, parameter, severity, verdict AS dpat_verdict, absolute_fail, 1 AS n_runs, true AS first_won FROM worst
      WHERE lot_id IN (SELECT lot_id FROM worst GROUP BY 1 HAVING count(*) >= 3)""",
    "queue_refusals": "SELECT p_brand || '/' || p_size AS lot_id, count(*) AS n_parts, 'INSUFFICIENT_COHORT' AS refusal_code FROM part GROUP BY 1 HAVING count(*) < 3",
    "profile_versions": """WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(year(l_shipdate) AS INT) AS v, l_quantity = 1 AND l_discount > 0.05 AS used FROM lineitem),
      p AS (SELECT id, v, bool_or(used) AS used FROM i GROUP BY ALL),
      w AS (SELECT id, CASE WHEN CAST(id AS INT) % 8 = 0 THEN v + 1 ELSE v END AS v FROM p WHERE CAST(id AS INT) % 4 = 0),
      m AS (SELECT p.id, p.v, p.used, w.id IS NOT NULL AND NOT p.used AS new FROM p LEFT JOIN w ON w.id = p.id AND w.v = p.v),
      e AS (SELECT w.id, count(*) FILTER (p.used) AS nr, count(*) FILTER (p.id IS NULL) AS nu FROM w LEFT JOIN p ON w.id = p.id AND w.v = p.v GROUP BY 1)
      SELECT m.id AS profile_id, count(*) AS n_versions, count(*) FILTER (new) AS n_rewritten, max(v) AS latest, coalesce(any_value(nr), 0) AS n_referenced, coalesce(any_value(nu), 0) AS n_unknown
      FROM m LEFT JOIN e ON e.id = m.id GROUP BY m.id""",
    "disposition_log": """WITH a AS (SELECT o_orderkey AS component_id, CASE WHEN o_totalprice > 150000 THEN 'OVERRIDE' ELSE 'ACCEPT' END AS action, o_orderkey % 3 = 0 AS blank FROM orders),
      n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT component_id, action, CASE WHEN NOT (action = 'OVERRIDE' AND blank) AND n IS NOT NULL THEN '{"component_id":' || component_id || ',"n":' || n || '}' END AS payload_json,
        CASE WHEN action = 'OVERRIDE' AND blank THEN 'OVERRIDE_WITHOUT_REASON' END AS error FROM a LEFT JOIN n ON l_orderkey = component_id""",
    "lot_decisions": "SELECT o_orderkey AS component_id, '7' AS lot_id, o_orderstatus FROM orders WHERE o_custkey % 20 = 7",
    "ordered_artifacts": _ORDERED,
    "split_artifacts": f"""WITH {TRAJ} SELECT artifact, count(*) AS n_rows, count(DISTINCT component_id) AS n_parts FROM (SELECT 'full' AS artifact, component_id FROM traj
      UNION ALL SELECT 'truth', component_id FROM traj WHERE elapsed_hours = 168 UNION ALL SELECT 'screening', component_id FROM traj WHERE elapsed_hours IN (0, 24)
      UNION ALL SELECT split, component_id FROM traj) GROUP BY 1""",
    "manifest_status": """SELECT * FROM (VALUES ('nation', 'SAME'), ('supplier', CASE WHEN (SELECT count(*) FROM supplier WHERE s_suppkey = 1) > 0 THEN 'CHANGED' ELSE 'SAME' END),
      ('customer', CASE WHEN (SELECT count(*) FROM customer WHERE c_custkey = 2) > 0 THEN 'ROWS_DIFFER' ELSE 'SAME' END), ('part', 'MISSING'), ('region', 'UNEXPECTED')) t(table_name, status)""",
    "label_differences": f"""WITH {LABELS}, s AS (SELECT component_id, CASE WHEN component_id % 7 = 1 THEN 'FAILED' ELSE failure_label END AS stored_label, stratum AS stored_stratum FROM lb WHERE component_id % 50 <> 3)
      SELECT coalesce(s.component_id, lb.component_id) AS component_id, stored_label, failure_label, stored_stratum, stratum FROM s FULL JOIN lb ON s.component_id = lb.component_id
      WHERE stored_label IS DISTINCT FROM failure_label OR stored_stratum IS DISTINCT FROM stratum""",
    "shown_limits": f"""WITH {COHORT}, {LIMITS} SELECT component_id, c.parameter, {fin('value', 'value')}, {r6('CASE WHEN low IS NULL THEN high WHEN abs(value - low) < abs(high - value) THEN low ELSE high END')} AS nearer
      FROM cohort c JOIN limits USING (parameter)""",
}
