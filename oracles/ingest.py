"""Oracles for the upload queries."""

from oracles.base import fin, r6

UPLOAD = """item AS (SELECT *, row_number() OVER () AS source_row FROM lineitem),
upload AS (SELECT source_row, CAST(l_orderkey AS VARCHAR) AS component_id, 'L' || (l_suppkey % 40) AS lot_id,
  'T' || (l_suppkey % 40 % 5) AS component_type,
  CASE WHEN l_linenumber = 7 THEN 'mystery' ELSE 'p' || l_linenumber END AS parameter,
  CASE WHEN l_quantity = 13 THEN 96.0 WHEN l_quantity = 14 THEN 0.5 WHEN l_linestatus = 'O' THEN 0.0 ELSE 24.0 END AS elapsed_hours,
  CASE WHEN l_discount = 0.1 AND l_quantity = 7 THEN NULL ELSE l_extendedprice END AS value,
  CASE WHEN l_suppkey % 37 = 0 THEN 'u2' ELSE 'u1' END AS unit,
  CASE WHEN l_quantity = 50 AND l_tax = 0.05 THEN NULL WHEN l_tax = 0 AND l_discount = 0 THEN 'NOT_MEASURED'
    WHEN l_returnflag = 'R' AND l_tax >= 0.08 THEN 'OVERRANGE' ELSE 'OK' END AS status,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS read_timestamp,
  CASE WHEN l_partkey % 500 = 3 THEN 'FIELD' ELSE 'SYNTHETIC' END AS data_provenance FROM item),
early AS (SELECT *, CASE WHEN status IS NULL THEN 'SCHEMA_VIOLATION' WHEN parameter = 'mystery' THEN 'SCHEMA_VIOLATION'
   WHEN elapsed_hours = 0.5 THEN 'SCHEMA_VIOLATION' WHEN elapsed_hours NOT IN (0, 24) THEN 'READPOINT_OUT_OF_GRID' END AS c1,
  CASE WHEN status IS NULL THEN 'status' WHEN parameter = 'mystery' THEN 'parameter'
   WHEN elapsed_hours NOT IN (0, 24) THEN 'elapsed_hours' END AS k1 FROM upload),
claimed AS (SELECT *, row_number() OVER (PARTITION BY component_id, parameter, elapsed_hours, c1 IS NULL ORDER BY source_row) AS nth FROM early),
v AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN c1 WHEN nth > 1 THEN 'DUPLICATE_KEY' WHEN unit <> 'u1' THEN 'UNIT_MISMATCH'
   WHEN status = 'NOT_MEASURED' THEN 'NOT_MEASURED_ROW' WHEN value IS NULL OR abs(value) > 1e9 THEN 'RANGE_VIOLATION'
   WHEN data_provenance <> 'SYNTHETIC' THEN 'SCHEMA_VIOLATION' END AS finding_code,
  CASE WHEN c1 IS NOT NULL THEN k1 WHEN nth > 1 THEN 'component_id' WHEN unit <> 'u1' THEN 'measurement_unit'
   WHEN status = 'NOT_MEASURED' OR value IS NULL OR abs(value) > 1e9 THEN 'measurement_value'
   WHEN data_provenance <> 'SYNTHETIC' THEN 'data_provenance' END AS finding_column,
  c1 IS NULL AND nth = 1 AND unit = 'u1' AND status = 'OVERRANGE' AND value IS NOT NULL AND abs(value) <= 1e9 AS censored FROM claimed),
ok AS (SELECT * FROM v WHERE finding_code IS NULL)"""

QUALITY = """q AS (SELECT component_id, lot_id, component_type, parameter, 2 - count(*) AS n_missing,
  count(*) FILTER (value < 1000 OR value > 90000) AS n_impossible, count(*) FILTER (censored) AS n_censored,
  count(*) FILTER (value BETWEEN 1000 AND 90000) AS n_valid,
  CASE WHEN count(*) FILTER (value BETWEEN 1000 AND 90000) >= 2 AND min(value) FILTER (value BETWEEN 1000 AND 90000)
    = max(value) FILTER (value BETWEEN 1000 AND 90000) THEN 1 ELSE 0 END AS n_flatline FROM ok GROUP BY ALL),
qs AS (SELECT *, CASE WHEN n_valid = 0 THEN 0 ELSE greatest(0, 1.0 - (n_missing * CAST(0.05 AS DOUBLE) + n_impossible * 0.1
  + n_censored * 0.02 + n_flatline * 0.25)) END AS score FROM q)"""

OCC = """times AS (SELECT component_id, parameter, min_by(source_row, elapsed_hours) AS source_row
   FROM (SELECT *, lag(read_timestamp) OVER (PARTITION BY component_id, parameter ORDER BY elapsed_hours) > read_timestamp AS back FROM ok)
   GROUP BY 1, 2 HAVING bool_or(coalesce(back, false))),
occ AS (SELECT finding_code AS code, source_row, finding_column AS "column", lot_id FROM v WHERE finding_code IS NOT NULL
  UNION ALL SELECT 'CENSORED_READING', source_row, 'status', lot_id FROM v WHERE censored
  UNION ALL SELECT 'NON_MONOTONIC_TIME', source_row, 'read_timestamp', NULL FROM times
  UNION ALL SELECT 'SINGLE_PART_LOT', 0, 'lot_id', lot_id FROM ok GROUP BY lot_id HAVING count(DISTINCT component_id) = 1
  UNION ALL SELECT 'MISSING_READPOINT', 0, 'elapsed_hours', lot_id FROM ok
    GROUP BY component_id, lot_id, component_type, parameter HAVING count(DISTINCT elapsed_hours) < 2)"""

ORACLES = {
    "ingest_verdicts": f"WITH {UPLOAD} SELECT source_row, finding_code, finding_column, coalesce(censored, false) AS censored FROM v",
    "ingest_accepted": f"""WITH {UPLOAD} SELECT source_row, component_id, lot_id, component_type, parameter,
      CAST(elapsed_hours AS BIGINT) AS elapsed_hours, {fin('value', 'value')}, unit, status FROM ok""",
    "ingest_findings": f"""WITH {UPLOAD}, {OCC},
      s AS (SELECT code, string_agg(CAST(source_row AS VARCHAR), ',' ORDER BY source_row) AS sample_rows FROM
        (SELECT code, source_row, row_number() OVER (PARTITION BY code ORDER BY source_row) AS r FROM occ) WHERE r <= 5 GROUP BY code),
      l AS (SELECT code, string_agg(lot_id, ',' ORDER BY lot_id) AS affected_lots FROM
        (SELECT code, lot_id, row_number() OVER (PARTITION BY code ORDER BY min(source_row), lot_id) AS r FROM occ
         WHERE lot_id IS NOT NULL GROUP BY code, lot_id) WHERE r <= 5 GROUP BY code),
      b AS (SELECT code, count(*) AS count, min_by("column", source_row) AS "column" FROM occ GROUP BY code)
      SELECT b.code, CASE WHEN b.code IN ('CENSORED_READING', 'NON_MONOTONIC_TIME', 'SINGLE_PART_LOT', 'MISSING_READPOINT')
        THEN 'WARNING' ELSE 'ERROR' END AS severity, count, "column", sample_rows, coalesce(affected_lots, '') AS affected_lots
      FROM b JOIN s ON b.code = s.code LEFT JOIN l ON b.code = l.code""",
    "rejection_classes": f"""WITH {UPLOAD}, d(class) AS (VALUES ('SCHEMA'), ('RANGE'), ('UNIT'), ('DUPLICATE'))
      SELECT class, (SELECT count(*) FROM v WHERE finding_code IS NOT NULL AND class = CASE finding_code
        WHEN 'UNIT_MISMATCH' THEN 'UNIT' WHEN 'DUPLICATE_KEY' THEN 'DUPLICATE' WHEN 'RANGE_VIOLATION' THEN 'RANGE'
        WHEN 'READPOINT_OUT_OF_GRID' THEN 'RANGE' ELSE 'SCHEMA' END) AS rejected FROM d""",
    "ingest_quality": f"""WITH {UPLOAD}, {QUALITY} SELECT component_id, lot_id, parameter, n_missing, n_impossible,
      n_censored, n_valid, n_flatline, {fin('score', 'score')} FROM qs""",
    "lot_summary": f"""WITH {UPLOAD}, {OCC}, {QUALITY}
      SELECT a.lot_id, a.component_type, a.n_parts, a.rows_accepted,
        (SELECT count(*) FROM v WHERE finding_code IS NOT NULL AND v.lot_id = a.lot_id) AS rows_rejected,
        {r6('(SELECT avg(score) FROM qs WHERE qs.lot_id = a.lot_id)')} AS quality_score,
        (SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM occ WHERE occ.lot_id = a.lot_id) AS finding_codes
      FROM (SELECT lot_id, min_by(component_type, source_row) AS component_type, count(DISTINCT component_id) AS n_parts,
        count(*) AS rows_accepted FROM ok GROUP BY lot_id) a""",
    "dataset_quality": f"""WITH {UPLOAD}, {QUALITY}, l AS (SELECT lot_id, avg(score) AS s FROM qs GROUP BY lot_id)
      SELECT {r6('avg(s)')} AS quality_score, count(*) AS n_parts, 0 AS n_excluded, CAST(NULL AS VARCHAR) AS refusal_code FROM l""",
    "validate_store": f"""WITH {UPLOAD}, d AS (SELECT 1 FROM upload GROUP BY component_id, parameter,
        CASE WHEN elapsed_hours = 0.5 THEN NULL ELSE elapsed_hours END HAVING count(*) > 1),
      f AS (SELECT 'ROW_COUNT_MISMATCH' AS code, (SELECT count(*) FROM upload) - (SELECT count(*) FROM ok) AS count
        UNION ALL SELECT 'LATE_OBSERVATION_PRESENT', (SELECT count(*) FROM upload WHERE elapsed_hours NOT IN (0, 24, 0.5))
        UNION ALL SELECT 'DUPLICATE_KEY_IN_STORE', (SELECT count(*) FROM d)
        UNION ALL SELECT 'PROVENANCE_VIOLATION', (SELECT count(*) FROM upload WHERE data_provenance <> 'SYNTHETIC'))
      SELECT code, count, count = 0 AS passed FROM f""",
    "dataset_digest": f"""WITH {UPLOAD}, h AS (SELECT lot_id, sha256(concat_ws('|', component_id, lot_id, component_type, parameter,
        CAST(CAST(elapsed_hours AS BIGINT) AS VARCHAR), CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), unit, status)) AS h FROM ok),
      l AS (SELECT lot_id, count(*) AS n, {', '.join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT)) AS l{i}" for i in range(4))} FROM h GROUP BY lot_id)
      SELECT lot_id, n AS row_count, 'sha256:' || sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(l0 AS VARCHAR), CAST(l1 AS VARCHAR),
        CAST(l2 AS VARCHAR), CAST(l3 AS VARCHAR))) AS dataset_hash FROM l""",
}
