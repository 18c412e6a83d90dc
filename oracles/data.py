"""Oracles for labels, splits, profiles and joint distances."""

from oracles.base import CN, COHORT, TRAJ, fin, r6
from oracles.cohort import stats_sql
from oracles.drift import PIVOT
from oracles.ingest import UPLOAD

METRICS = f"""{TRAJ}, tl AS (SELECT *, CASE WHEN parameter = 'view' THEN 'bidirectional' ELSE 'increase' END AS direction,
  lead(value) OVER (PARTITION BY component_id, lot_id, parameter ORDER BY elapsed_hours) AS nxt FROM traj),
dm0 AS (SELECT component_id, lot_id, parameter, any_value(direction) AS direction,
  coalesce(max(value) FILTER (elapsed_hours = 0), min_by(value, elapsed_hours)) AS v0, max(value) FILTER (elapsed_hours = 24) AS v24x,
  coalesce(max(value) FILTER (elapsed_hours = 168), max_by(value, elapsed_hours)) AS v168,
  bool_or(coalesce(abs(nxt - value) >= 0.4 * 300 AND (nxt >= 150 OR nxt <= -150), false)) AS step_jump,
  bool_or(value >= 150) AS breach, bool_or(value >= 150 AND elapsed_hours IN (0, 24)) AS early_breach FROM tl GROUP BY ALL),
dm AS (SELECT *, coalesce(v24x, v0) AS v24, CASE WHEN direction = 'bidirectional' THEN greatest(150 - v0, v0 + 150, 1) ELSE greatest(150 - v0, 0.5) END AS margin,
  CASE WHEN direction = 'bidirectional' THEN abs(v168 - v0) / greatest(150 - v0, v0 + 150, 1) ELSE greatest(0, v168 - v0) / greatest(150 - v0, 0.5) END AS drift_ratio FROM dm0)"""

LABELS = f"""{METRICS},
o_s AS (SELECT lot_id, parameter, count(*) AS n, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  stddev_pop(value) AS sd FROM traj WHERE elapsed_hours = 24 GROUP BY ALL),
o AS (SELECT component_id, t.lot_id, bool_or(abs(value - CASE WHEN n >= 3 THEN med ELSE 0 END) / CASE WHEN n < 3 THEN 1 WHEN iqr > 1e-6 THEN greatest(iqr / 1.35, 1e-6)
    WHEN sd = 0 THEN 1 ELSE greatest(sd, 1e-6) END >= 3) AS out24 FROM traj t JOIN o_s s ON t.lot_id = s.lot_id AND t.parameter = s.parameter
  WHERE elapsed_hours = 24 GROUP BY ALL),
lb0 AS (SELECT dm.component_id, dm.lot_id, max(abs(v168 - v0)) AS max_drift_168h, greatest(0, max(drift_ratio)) AS max_drift_ratio, bool_or(step_jump) AS step_jump,
  bool_or(breach) AS breach, bool_or(early_breach) AS early_breach, coalesce(any_value(out24), false) AS is_24h_outlier
  FROM dm LEFT JOIN o ON dm.component_id = o.component_id AND dm.lot_id = o.lot_id GROUP BY ALL),
lb1 AS (SELECT *, CASE WHEN step_jump THEN 'FAILED' WHEN breach THEN CASE WHEN early_breach THEN 'FAILED' ELSE 'LATENT_DEFECT' END
  WHEN is_24h_outlier OR max_drift_ratio >= 0.55 THEN 'LATENT_DEFECT' ELSE 'HEALTHY' END AS failure_label FROM lb0),
lb AS (SELECT *, CASE WHEN breach THEN 'S0_CLEAR_FAIL' WHEN failure_label = 'HEALTHY' THEN 'S3_DECOY_HEALTHY' WHEN is_24h_outlier THEN 'S1_ESCAPE_ANOMALY'
   ELSE 'S2_ESCAPE_DRIFT' END AS stratum, failure_label <> 'HEALTHY' AND NOT breach AS is_escape,
  CASE WHEN step_jump THEN 'sudden_failure' WHEN breach THEN CASE WHEN failure_label = 'LATENT_DEFECT' THEN 'accelerated_drift' ELSE 'sudden_failure' END
   WHEN is_24h_outlier THEN 'early_latent_defect' WHEN max_drift_ratio >= 0.55 THEN 'accelerated_drift' WHEN max_drift_ratio >= 0.1 THEN 'gradual_drift'
   ELSE 'healthy_stable' END AS degradation_mode FROM lb1)"""

# Lots numbered type by type; every split takes its even part of the numbers, then lots of a type are ranked.
SPLIT = """lots AS (SELECT l_suppkey AS lot_id, 'T' || (l_suppkey % 5) AS component_type, count(*) AS n_parts,
    CASE WHEN l_suppkey % 23 = 3 THEN 'zero_iqr' WHEN l_suppkey % 29 = 4 THEN 'lot_shift' WHEN l_suppkey % 31 = 5 THEN 'unit_inconsistent' END AS special_type,
    CAST('0x' || substr(md5(l_suppkey || ':20260930'), 1, 12) AS BIGINT) AS h FROM lineitem GROUP BY ALL),
sp0 AS (SELECT *, CASE special_type WHEN 'zero_iqr' THEN 'test' WHEN 'unit_inconsistent' THEN 'train' WHEN 'lot_shift'
    THEN CASE WHEN row_number() OVER (PARTITION BY special_type ORDER BY h) = 1 THEN 'train' ELSE 'test' END END AS fixed FROM lots),
tgt AS (SELECT count(*) FILTER (fixed IS NULL) AS m, round(count(*) * 0.2::DOUBLE) AS c,
    count(*) - round(count(*) * 0.6::DOUBLE) - round(count(*) * 0.2::DOUBLE) - count(*) FILTER (fixed = 'test') AS t FROM sp0),
sp1 AS (SELECT *, row_number() OVER (ORDER BY component_type, n_parts < 50, h) - 1 AS j,
    row_number() OVER (PARTITION BY component_type ORDER BY n_parts < 50, h) AS r FROM sp0 WHERE fixed IS NULL),
sp2 AS (SELECT sp1.*, floor((j + 1) * c / m) > floor(j * c / m) AS is_c, j - floor(j * c / m) AS k, m, c, t FROM sp1, tgt),
sp3 AS (SELECT component_type, count(*) FILTER (is_c) AS nc, count(*) FILTER (NOT is_c AND floor((k + 1) * t / (m - c)) > floor(k * t / (m - c))) AS nt FROM sp2 GROUP BY 1),
sp AS (SELECT lot_id, component_type, n_parts, special_type, CASE WHEN r <= nc THEN 'calib' WHEN r <= nc + nt THEN 'test' ELSE 'train' END AS split FROM sp1 JOIN sp3 USING (component_type)
  UNION ALL SELECT lot_id, component_type, n_parts, special_type, fixed FROM sp0 WHERE fixed IS NOT NULL)"""


def _ranks(source: str, cols: list[str]) -> str:
    return f"SELECT *, " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols
    ) + f" FROM {source}"


_PAIRS = [("quantity", "price"), ("quantity", "discount"), ("quantity", "rebate"), ("price", "discount"), ("price", "rebate"), ("discount", "rebate")]

_MAHA = """
ms AS (SELECT l_suppkey AS lot_id, count(*) AS n, avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, avg(l_discount) AS m3, stddev_samp(l_quantity) AS s1,
  stddev_samp(l_extendedprice) AS s2, stddev_samp(l_discount) AS s3, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b,
  corr(l_extendedprice, l_discount) AS c FROM lineitem GROUP BY ALL),
mz AS (SELECT l_orderkey, l_linenumber, l_partkey, ms.*, 1 + 2 * a * b * c - a * a - b * b - c * c AS det, (l_quantity - m1) / s1 AS x, (l_extendedprice - m2) / s2 AS y, (l_discount - m3) / s3 AS z
  FROM lineitem JOIN ms ON l_suppkey = lot_id),
mc AS (SELECT *, x * ((1 - c * c) * x + (b * c - a) * y + (a * c - b) * z) / det AS cx, y * ((b * c - a) * x + (1 - b * b) * y + (a * b - c) * z) / det AS cy,
  z * ((a * c - b) * x + (a * b - c) * y + (1 - a * a) * z) / det AS cz FROM mz),
md AS (SELECT *, greatest(0, cx + cy + cz) AS d2 FROM mc)"""

ORACLES = {
    "cohort_positions": f"""WITH {COHORT}, r AS (SELECT lot_id, parameter, value, rank() OVER w AS place, count(*) OVER (PARTITION BY lot_id, parameter) AS n,
      count(*) OVER (PARTITION BY lot_id, parameter, value) AS same FROM cohort WHERE status = 'OK' WINDOW w AS (PARTITION BY lot_id, parameter ORDER BY value))
      SELECT DISTINCT lot_id, parameter, {fin('value', 'value')}, place AS position, same AS members, {fin('CASE WHEN n > 1 THEN (place - 1) / (n - 1) END', 'share_below')} FROM r""",
    "readings_map": f"""WITH {TRAJ}, h AS (SELECT component_id, lot_id, parameter, string_agg(elapsed_hours || '=' || printf('%.3f', value), ',' ORDER BY elapsed_hours) AS t
      FROM traj GROUP BY ALL) SELECT component_id, lot_id, string_agg(parameter || ':' || t, ';' ORDER BY parameter) AS readings FROM h GROUP BY ALL""",
    "zonal_limits": f"""WITH {COHORT}, {CN}, {stats_sql('cohort', 'lot_id, parameter, thermal_zone', "status = 'OK'")}
      SELECT lot_id, parameter, thermal_zone, n, {fin('CASE WHEN n >= 20 AND refusal_code IS NULL THEN median - 3.0 * robust_sigma END', 'zone_low')},
        {fin('CASE WHEN n >= 20 AND refusal_code IS NULL THEN median + 3.0 * robust_sigma END', 'zone_high')} FROM st""",
    "screening_metrics": f"""WITH {LABELS}, c AS (SELECT stratum AS "group", count(*) AS n, count(*) FILTER (is_24h_outlier) AS n_flagged,
      count(*) FILTER (failure_label <> 'HEALTHY') AS n_defect, count(*) FILTER (is_24h_outlier AND failure_label <> 'HEALTHY') AS tp FROM lb GROUP BY ROLLUP (stratum)),
      m AS (SELECT *, tp / nullif(n_defect, 0) AS recall, (n_flagged - tp) / nullif(n - n_defect, 0) AS false_positive_rate, n_flagged / n AS flag_rate,
      tp / nullif(n_flagged, 0) AS precision FROM c)
      SELECT "group", n, n_flagged, n_defect, tp, {fin('recall', 'recall')}, {fin('false_positive_rate', 'false_positive_rate')}, {fin('flag_rate', 'flag_rate')},
      {fin('precision', 'precision')}, {fin('5 * precision * recall / nullif(4 * precision + recall, 0)', 'f2')} FROM m""",
    "drift_metrics": f"""WITH {METRICS} SELECT component_id, parameter, {fin('v0', 'v0')}, {fin('v24', 'v24')}, {fin('v168', 'v168')}, {fin('margin', 'margin')},
      {fin('drift_ratio', 'drift_ratio')}, step_jump, breach, early_breach FROM dm""",
    "limit_violations": f"""WITH {TRAJ} SELECT component_id, lot_id, parameter, elapsed_hours, {fin('value', 'value')}, '>= absolute_max' AS violation
      FROM traj WHERE value >= 150""",
    "labels": f"""WITH {LABELS} SELECT component_id, lot_id, failure_label, stratum, degradation_mode, is_escape,
      stratum IN ('S0_CLEAR_FAIL', 'S1_ESCAPE_ANOMALY', 'S2_ESCAPE_DRIFT') AS must_flag, {fin('max_drift_168h', 'max_drift_168h')},
      {fin('max_drift_ratio', 'max_drift_ratio')}, is_24h_outlier, step_jump, NOT breach AS inside_limits FROM lb""",
    "strata_counts": f"WITH {LABELS} SELECT stratum, failure_label, count(*) AS n_parts, count(*) FILTER (is_escape) AS n_escapes FROM lb GROUP BY ALL",
    "escape_breaches": f"WITH {LABELS} SELECT count(*) AS breaches FROM traj WHERE value >= 150 AND component_id IN (SELECT component_id FROM lb WHERE is_escape)",
    "split_assignment": f"WITH {SPLIT} SELECT lot_id, component_type, split FROM sp",
    "split_types": f"""WITH {SPLIT} SELECT component_type, split, count(*) AS n_lots, CAST(sum(n_parts) AS BIGINT) AS n_parts, count(special_type) AS n_special,
      count(*) FILTER (n_parts < 50) AS n_small FROM sp GROUP BY ALL""",
    "decoy_check": f"""WITH {LABELS}, x AS (SELECT *, lot_id = 3 AS sh, component_id % 9 = 1 AS art FROM lb0),
      y AS (SELECT *, CASE WHEN step_jump THEN 'FAILED' WHEN breach THEN 'BAD' WHEN art OR sh THEN 'HEALTHY' WHEN is_24h_outlier OR max_drift_ratio >= 0.55 THEN 'BAD' ELSE 'HEALTHY' END AS l FROM x),
      z AS (SELECT *, CASE WHEN breach THEN 'S0' WHEN l = 'HEALTHY' AND sh THEN 'S5_LOT_SHIFT' WHEN l = 'HEALTHY' AND art THEN 'S4_DECOY_SENSOR' WHEN l = 'HEALTHY' THEN 'S3_DECOY_HEALTHY' ELSE 'S1' END AS stratum FROM y)
      SELECT stratum, count(*) AS n_parts, count(*) FILTER (l <> 'HEALTHY') AS n_unhealthy, count(*) FILTER (l <> 'HEALTHY' AND NOT breach) AS n_escapes,
        count(*) FILTER (l <> 'HEALTHY') = 0 AS clean FROM z WHERE substr(stratum, 1, 2) IN ('S3', 'S4', 'S5') GROUP BY 1""",
    "split_audit": f"""WITH {SPLIT} SELECT pair, CAST(0 AS BIGINT) + (SELECT count(*) FROM (SELECT lot_id FROM sp WHERE split = a INTERSECT SELECT lot_id FROM sp WHERE split = b)) AS shared_lots
      FROM (VALUES ('train/calib', 'train', 'calib'), ('train/test', 'train', 'test'), ('calib/test', 'calib', 'test')) v(pair, a, b)""",
    "split_counts": f"""WITH {TRAJ} SELECT split, count(DISTINCT lot_id) AS n_lots, count(DISTINCT (lot_id, component_id)) AS n_parts, count(*) AS n_rows FROM traj GROUP BY split""",
    "marginals": f"""WITH {COHORT} SELECT parameter, count(*) AS count, {r6('round(avg(value), 3)')} AS mean, {r6('round(stddev_pop(value), 3)')} AS std,
      {r6('min(value)')} AS min, {r6('max(value)')} AS max, {r6('skewness(value)')} AS skewness, {r6('quantile_cont(value, 0.25)')} AS q1,
      {r6('quantile_cont(value, 0.5)')} AS median, {r6('quantile_cont(value, 0.75)')} AS q3, {r6('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr,
      {r6('(quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.35')} AS robust_sigma FROM cohort GROUP BY parameter""",
    "variance_components": f"""WITH {COHORT}, l AS (SELECT parameter, lot_id, avg(value) AS m, var_samp(value) AS v FROM cohort GROUP BY ALL)
      SELECT parameter, count(*) AS n_lots, {r6('sqrt(var_pop(m)) / sqrt(avg(v))')} AS sigma_ratio FROM l GROUP BY parameter""",
    "correlations": f"""WITH {COHORT}, w AS (SELECT component_id, {', '.join(f"min(value) FILTER (parameter = '{p}') AS {p}" for p in ('quantity', 'price', 'discount', 'rebate'))}
        FROM cohort GROUP BY component_id), r AS ({_ranks('w', ['quantity', 'price', 'discount', 'rebate'])})
      {' UNION ALL '.join(f"SELECT '{a}' AS first, '{b}' AS second, {r6(f'corr({a}, {b})')} AS pearson, {r6(f'corr(r_{a}, r_{b})')} AS spearman FROM r" for a, b in _PAIRS)}""",
    "leakage": f"""WITH {PIVOT}, w AS (SELECT v0, v24, v24 - v0 AS delta24, temp24, v168 FROM full3), r AS ({_ranks('w', ['v0', 'v24', 'delta24', 'temp24', 'v168'])})
      {' UNION ALL '.join(f"SELECT '{c}' AS column, {r6(f'corr(r_{c}, r_v168)')} AS spearman FROM r" for c in ('v0', 'v24', 'delta24', 'temp24'))}""".replace("AS column", 'AS "column"'),
    "tester_drift": f"""WITH {COHORT}, r AS (SELECT tester_id, parameter,
        rank() OVER (PARTITION BY tester_id, parameter ORDER BY value) + (count(*) OVER (PARTITION BY tester_id, parameter, value) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY tester_id, parameter ORDER BY read_timestamp) + (count(*) OVER (PARTITION BY tester_id, parameter, read_timestamp) - 1) / 2.0 AS b
        FROM cohort WHERE status = 'OK') SELECT tester_id, parameter, count(*) AS n, {r6('CASE WHEN count(*) >= 3 THEN corr(a, b) END')} AS rho FROM r GROUP BY ALL""",
    "imperfections": f"""WITH {UPLOAD} SELECT coalesce(CASE WHEN l_quantity = 50 AND l_tax = 0.05 THEN '  ' ELSE u.status END, '(none)') AS status, count(*) AS n_rows,
        {r6('count(*) / (SELECT count(*) FROM upload)')} AS rate, (SELECT count(DISTINCT lot_id) FROM upload WHERE unit <> 'u1') AS lots_wrong_unit
      FROM upload u JOIN item i ON u.source_row = i.source_row GROUP BY 1""",
    "mahalanobis_classical": f"""WITH {_MAHA} SELECT l_orderkey, l_linenumber, l_partkey, lot_id, n, {fin('d2', 'd2')},
      {fin('cx', 'c_l_quantity')}, {fin('cy', 'c_l_extendedprice')}, {fin('cz', 'c_l_discount')} FROM md""",
    "decision_view": f"""WITH {TRAJ} SELECT component_id, lot_id, component_type, parameter, elapsed_hours, {fin('value', 'value')}, status,
      {fin('temperature_c', 'temperature_c')}, tester_id, socket_id, thermal_zone, source_row FROM traj WHERE elapsed_hours IN (0, 24)""",
    "truth_view": f"""WITH {LABELS}, a AS (SELECT * FROM traj WHERE elapsed_hours = 24), b AS (SELECT * FROM traj WHERE elapsed_hours = 168)
      SELECT coalesce(a.component_id, b.component_id) AS component_id, coalesce(a.lot_id, b.lot_id) AS lot_id, coalesce(a.parameter, b.parameter) AS parameter,
        {r6('a.value')} AS value_24h, {r6('b.value')} AS value_168h, failure_label, stratum, is_escape
      FROM a FULL JOIN b ON a.component_id = b.component_id AND a.lot_id = b.lot_id AND a.parameter = b.parameter
      LEFT JOIN lb ON lb.component_id = coalesce(a.component_id, b.component_id) AND lb.lot_id = coalesce(a.lot_id, b.lot_id)""",
}
