"""Oracles for the lot queries."""

from oracles.base import CN, COHORT, SMALL, fin, loo, r6


def stats_sql(source: str, keys: str, where: str = "TRUE") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
st_q AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
   quantile_cont(value, 0.75) AS q3 FROM {source} WHERE {where} GROUP BY {keys}),
st_m AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, quantile_cont(abs(a.value - b.median), 0.5) AS mad
   FROM {source} a JOIN st_q b ON {on} WHERE {where} GROUP BY {', '.join('a.' + k.strip() for k in keys.split(','))}),
st_f AS (SELECT a.* REPLACE (CASE WHEN n < 3 THEN median ELSE q1 END AS q1, CASE WHEN n < 3 THEN median ELSE q3 END AS q3),
   CASE WHEN n < 3 THEN 0 ELSE mad END AS mad FROM st_q a JOIN st_m b ON {on}),
st AS (SELECT a.*, q3 - q1 AS iqr, CASE WHEN a.n < 3 THEN 1 ELSE coalesce(cn.c_n, 1) END AS c_n,
   CASE WHEN a.n < 3 THEN 'INSUFFICIENT_COHORT' WHEN q3 = q1 AND mad = 0 THEN 'NO_VARIATION' END AS refusal_code,
   CASE WHEN a.n < 3 OR (q3 = q1 AND mad = 0) THEN 'none' WHEN a.n < 20 AND mad > 0 THEN 'mad' ELSE 'iqr' END AS estimator,
   CASE WHEN a.n < 3 OR (q3 = q1 AND mad = 0) THEN 0 WHEN a.n < 20 AND mad > 0 THEN 1.4826 * coalesce(cn.c_n, 1) * mad
     ELSE (q3 - q1) / 1.35 END AS robust_sigma
   FROM st_f a LEFT JOIN cn ON cn.n = a.n)"""


ORACLES = {
    "robust_stats_lot": f"""WITH {COHORT}, {CN}, {stats_sql('cohort', 'lot_id, parameter', "status = 'OK'")}
      SELECT lot_id, parameter, n, {fin('q1', 'q1')}, {fin('median', 'median')}, {fin('q3', 'q3')}, {fin('iqr', 'iqr')},
        {fin('mad', 'mad')}, {fin('robust_sigma', 'robust_sigma')}, estimator, n < 20 AS reduced_power, refusal_code,
        {fin('q1 - 1.5 * iqr', 'tukey_mild_low')}, {fin('q3 + 1.5 * iqr', 'tukey_mild_high')},
        {fin('q1 - 3 * iqr', 'tukey_extreme_low')}, {fin('q3 + 3 * iqr', 'tukey_extreme_high')} FROM st""",
    "robust_ladder_small": f"""WITH {SMALL}, {CN}, {stats_sql('small', 'lot_id')}
      SELECT lot_id, n, {fin('q1', 'q1')}, {fin('median', 'median')}, {fin('q3', 'q3')}, {fin('iqr', 'iqr')},
        {fin('mad', 'mad')}, {fin('c_n', 'c_n')}, {fin('robust_sigma', 'robust_sigma')}, estimator,
        n < 20 AS reduced_power, refusal_code IS NOT NULL AS zero_iqr, refusal_code FROM st""",
    "dpat_loo": f"""WITH {COHORT}, {CN}, {loo('l', 'cohort', ['lot_id', 'parameter'])}
      SELECT component_id, lot_id, parameter, {fin('value', 'value')}, n, {fin('q1', 'q1')}, {fin('median', 'median')},
        {fin('q3', 'q3')}, {fin('robust_sigma', 'robust_sigma')},
        {fin("CASE WHEN refusal_code IS NULL THEN median - 1.2 * robust_sigma END", 'limit_low')},
        {fin("CASE WHEN refusal_code IS NULL THEN median + 1.2 * robust_sigma END", 'limit_high')},
        {fin("CASE WHEN n < 3 THEN NULL WHEN robust_sigma > 0 THEN (value - median) / robust_sigma WHEN value = median THEN 0 END", 'z')},
        CASE WHEN refusal_code IS NOT NULL THEN refusal_code
          WHEN value >= median - 1.2 * robust_sigma AND value <= median + 1.2 * robust_sigma THEN 'PASS' ELSE 'FAIL' END AS verdict,
        refusal_code FROM l""",
    "dpat_loo_small": f"""WITH {SMALL}, s2 AS (SELECT *, 'OK' AS status FROM small), {CN}, {loo('l', 's2', ['lot_id'])}
      SELECT component_id, lot_id, {fin('value', 'value')}, n, {fin('median', 'median')}, {fin('mad', 'mad')},
        {fin('robust_sigma', 'robust_sigma')},
        {fin("CASE WHEN n < 3 THEN NULL WHEN robust_sigma > 0 THEN (value - median) / robust_sigma WHEN value = median THEN 0 END", 'z')},
        CASE WHEN refusal_code IS NOT NULL THEN refusal_code
          WHEN value >= median - 1.2 * robust_sigma AND value <= median + 1.2 * robust_sigma THEN 'PASS' ELSE 'FAIL' END AS verdict,
        refusal_code FROM l""",
    "lot_histogram": f"""WITH {COHORT}, m AS (SELECT * FROM cohort WHERE status = 'OK'),
      s AS (SELECT lot_id, parameter, min(value) AS lo, max(value) AS hi FROM m GROUP BY ALL),
      e AS (SELECT lot_id, parameter, lo, hi, unnest(range(CASE WHEN lo = hi THEN 1 ELSE 30 END)) AS bin FROM s),
      c AS (SELECT m.lot_id, m.parameter, CASE WHEN lo = hi THEN 0 ELSE least(29, floor((value - lo) / ((hi - lo) / 30.0))) END AS bin,
        count(*) AS bin_rows FROM m JOIN s ON m.lot_id = s.lot_id AND m.parameter = s.parameter GROUP BY ALL)
      SELECT e.lot_id, e.parameter, e.bin,
        {r6('CASE WHEN lo = hi THEN lo - 0.5 ELSE lo + e.bin * ((hi - lo) / 30.0) END')} AS bin_low,
        {r6('CASE WHEN lo = hi THEN lo + 0.5 ELSE lo + (e.bin + 1) * ((hi - lo) / 30.0) END')} AS bin_high,
        coalesce(bin_rows, 0) AS bin_rows
      FROM e LEFT JOIN c ON e.lot_id = c.lot_id AND e.parameter = c.parameter AND e.bin = c.bin""",
    "member_z": f"""WITH {COHORT}, {CN}, {stats_sql('cohort', 'lot_id, parameter', "status = 'OK'")}
      SELECT a.component_id, a.lot_id, a.parameter, {r6('a.value')} AS value,
        {r6('(a.value - median) / robust_sigma')} AS z,
        a.value > median + 1.2 * robust_sigma OR a.value < median - 1.2 * robust_sigma AS flagged
      FROM cohort a JOIN st b ON a.lot_id = b.lot_id AND a.parameter = b.parameter
      WHERE a.status = 'OK' AND robust_sigma > 0""",
}
