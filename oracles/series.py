"""Oracles for the series and skewness queries."""

from oracles.base import CN, COHORT, SERIES, SMALL, fin, r6
from oracles.cohort import stats_sql

SCALED = f"{SERIES}, {CN}, {stats_sql('series', 'parameter')}, s AS (SELECT a.*, b.median, b.robust_sigma FROM series a JOIN st b ON a.parameter = b.parameter)"

_Q = f"""WITH {SCALED},
  w AS (SELECT *, row_number() OVER o - 1 AS pos, t - lag(t) OVER o AS tstep FROM s
    WINDOW o AS (PARTITION BY component_id, parameter ORDER BY seq)),
  val AS (SELECT *, value - lag(value) OVER o AS down, lead(value) OVER o - value AS up FROM w
    WHERE value >= 0.05 AND value <= 400 WINDOW o AS (PARTITION BY component_id, parameter ORDER BY seq)),
  sp AS (SELECT component_id, parameter, count(*) AS n_discontinuity, min(pos) AS first_spike FROM val
    WHERE abs(down) > 8 * (robust_sigma / 16) AND abs(up) > 8 * (robust_sigma / 16) GROUP BY ALL),
  md AS (SELECT component_id, parameter, quantile_cont(tstep, 0.5) AS usual FROM w WHERE tstep > 0 GROUP BY ALL),
  g AS (SELECT w.component_id, w.parameter, count(*) AS n_total, count(*) FILTER (value BETWEEN 0.05 AND 400) AS n_valid,
    count(*) FILTER (value < 0.05 OR value > 400) AS n_impossible, count(*) FILTER (tstep <= 0) AS n_disorder,
    count(*) FILTER (tstep > 1.5 * usual) AS n_gap,
    CASE WHEN count(*) FILTER (value BETWEEN 0.05 AND 400) >= 2 AND min(value) FILTER (value BETWEEN 0.05 AND 400)
      = max(value) FILTER (value BETWEEN 0.05 AND 400) THEN 1 ELSE 0 END AS n_flatline
    FROM w LEFT JOIN md ON w.component_id = md.component_id AND w.parameter = md.parameter GROUP BY ALL),
  f AS (SELECT g.component_id, g.parameter, n_total, n_valid, 0 AS n_missing, 0 AS n_nonfinite, n_impossible, 0 AS n_censored,
    n_flatline, coalesce(n_discontinuity, 0) AS n_discontinuity, first_spike, n_disorder, n_gap,
    CASE WHEN n_valid = 0 THEN 0 ELSE greatest(0, 1 - (n_impossible * CAST(0.1 AS DOUBLE) + n_flatline * 0.25 + n_gap * CAST(0.05 AS DOUBLE)
      + n_disorder * CAST(0.05 AS DOUBLE) + coalesce(n_discontinuity, 0) * CAST(0.1 AS DOUBLE))) END AS score
    FROM g LEFT JOIN sp ON g.component_id = sp.component_id AND g.parameter = sp.parameter)"""


def _medcouple(source: str, keys: str, where: str) -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
mc_m AS (SELECT {keys}, count(*) AS n, quantile_cont(value, 0.5) AS med, min(value) AS lo, max(value) AS hi
  FROM {source} WHERE {where} GROUP BY {keys}),
mc_r AS (SELECT {ka}, a.value, b.med, CASE WHEN a.value = b.med THEN row_number() OVER (PARTITION BY {ka}, a.value ORDER BY a.value) END AS tie,
  count(*) FILTER (a.value = b.med) OVER (PARTITION BY {ka}) AS k FROM {source} a JOIN mc_m b ON {on} WHERE {where}),
mc_h AS (SELECT {ka}, CASE WHEN a.value < b.value THEN ((b.value - a.med) - (a.med - a.value)) / (b.value - a.value)
    WHEN a.tie + b.tie - 1 < a.k THEN -1 WHEN a.tie + b.tie - 1 = a.k THEN 0 ELSE 1 END AS h
  FROM mc_r a JOIN mc_r b ON {on} WHERE a.value <= a.med AND b.value >= b.med),
mc_k AS (SELECT {keys}, quantile_cont(h, 0.5) AS mc FROM mc_h GROUP BY {keys}),
mc AS (SELECT a.*, CASE WHEN n < 3 OR lo = hi THEN 0 ELSE mc END AS medcouple FROM mc_m a JOIN mc_k b ON {on})"""


ORACLES = {
    "cusum": f"""WITH {SCALED},
      z AS (SELECT *, (value - median) / robust_sigma AS z FROM s),
      c AS (SELECT *, row_number() OVER o - 1 AS pos, sum(z - 0.5) OVER o AS ch, sum(-z - 0.5) OVER o AS cl FROM z
        WINDOW o AS (PARTITION BY component_id, parameter ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
      p AS (SELECT *, ch - least(0, min(ch) OVER o) AS sh, cl - least(0, min(cl) OVER o) AS sl FROM c
        WINDOW o AS (PARTITION BY component_id, parameter ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
      f AS (SELECT component_id, parameter, max_by(sh, pos) AS sh, max_by(sl, pos) AS sl, min(pos) FILTER (sh > 4) AS fh,
        min(pos) FILTER (sl > 4) AS fl, count(*) AS n FROM p GROUP BY ALL)
      SELECT component_id, parameter, {r6('CASE WHEN n >= 3 THEN sh END')} AS s_high, {r6('CASE WHEN n >= 3 THEN sl END')} AS s_low,
        n >= 3 AND fh IS NOT NULL AS signal_high, n >= 3 AND fl IS NOT NULL AS signal_low,
        CASE WHEN n >= 3 THEN fh END AS first_crossing_high, CASE WHEN n >= 3 THEN fl END AS first_crossing_low,
        n AS n_observations, 0 AS n_gaps, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' END AS refusal_code FROM f""",
    "series_quality": _Q + f" SELECT * REPLACE ({r6('score')} AS score) FROM f",
    "quality_rollup": _Q + f""" SELECT parameter, {r6('avg(score)')} AS quality_score, count(*) AS n_parts, 0 AS n_excluded,
      CAST(NULL AS VARCHAR) AS refusal_code FROM f GROUP BY parameter""",
    "medcouple_lot": f"WITH {SMALL}, {_medcouple('small', 'lot_id', 'TRUE')} SELECT lot_id, n, {fin('medcouple', 'medcouple')} FROM mc",
    "medcouple_loo": f"""WITH {SMALL}, l AS (SELECT a.lot_id AS lot, a.component_id AS own, a.component_id AS lot_id, b.value
        FROM small a LEFT JOIN small b ON a.lot_id = b.lot_id AND a.component_id <> b.component_id),
      own AS (SELECT lot_id, value FROM l WHERE value IS NOT NULL), {_medcouple('own', 'lot_id', 'TRUE')}
      SELECT s.component_id, s.lot_id, {r6('coalesce(mc.medcouple, 0)')} AS medcouple, 'leave_one_out' AS medcouple_mode
      FROM small s LEFT JOIN mc ON mc.lot_id = s.component_id""",
    "adjusted_boxplot": f"""WITH {COHORT}, {CN}, {stats_sql('cohort', 'lot_id, parameter', "status = 'OK'")},
      {_medcouple('cohort', 'lot_id, parameter', "status = 'OK'").replace("WHERE status = 'OK')", "WHERE a.status = 'OK')")}
      SELECT a.lot_id, a.parameter, a.n, {fin('medcouple', 'medcouple')},
        {r6('q1 - 1.5 * exp(CASE WHEN medcouple >= 0 THEN -4 ELSE -3 END * medcouple) * iqr')} AS boxplot_low,
        {r6('q3 + 1.5 * exp(CASE WHEN medcouple >= 0 THEN 3 ELSE 4 END * medcouple) * iqr')} AS boxplot_high
      FROM st a JOIN mc b ON a.lot_id = b.lot_id AND a.parameter = b.parameter""",
}
