"""Oracles for the scoring queries and the leave-one-out joint distances."""

from oracles.base import CN, TRAJ, fin, r6
from oracles.cohort import stats_sql
from oracles.data import LABELS
from oracles.drift import EV, PIVOT, POINT, bound

_CHI_HALF, _CHI_EDGE = 2.365973884375338, 9.348403604496149  # upper quantiles 0.5 and 0.025 of chi-square with 3 degrees


def _sum_tail(low: str, high: str, n: str, p: str) -> str:
    """P(low <= X <= high) of a binomial, term by term."""
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - ({p})))"
    return f"coalesce(list_sum(list_transform(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1), lambda i: {term})), 0)"


# Sixty halvings of (0, 1) per group for both ends of the exact interval.
_INTERVAL = f"""
halve(g, n, k, i, la, lb, ha, hb) AS (
  SELECT "group", n, n_covered, 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE FROM agg
  UNION ALL SELECT g, n, k, i + 1,
    CASE WHEN {_sum_tail('k', 'n', 'n', '(la + lb) / 2')} < 0.025 THEN (la + lb) / 2 ELSE la END,
    CASE WHEN {_sum_tail('k', 'n', 'n', '(la + lb) / 2')} < 0.025 THEN lb ELSE (la + lb) / 2 END,
    CASE WHEN {_sum_tail('0', 'k', 'n', '(ha + hb) / 2')} > 0.025 THEN (ha + hb) / 2 ELSE ha END,
    CASE WHEN {_sum_tail('0', 'k', 'n', '(ha + hb) / 2')} > 0.025 THEN hb ELSE (ha + hb) / 2 END
  FROM halve WHERE i < 50),
ends AS (SELECT g, CASE WHEN k = 0 THEN 0 ELSE (la + lb) / 2 END AS lo, CASE WHEN k = n THEN 1 ELSE (ha + hb) / 2 END AS hi FROM halve WHERE i = 50)"""

_PARTS = f"""{LABELS}, parts AS (SELECT a.component_id, a.lot_id, a.score, failure_label <> 'HEALTHY' AS bad, is_escape FROM
  (SELECT component_id, lot_id, max(value) AS score FROM traj WHERE elapsed_hours = 24 GROUP BY ALL) a JOIN lb USING (component_id, lot_id))"""

_FEATURE = lambda c, n: f"CASE WHEN {n}.n >= 3 AND {n}.robust_sigma > 0 THEN (s.{c} - {n}.median) / {n}.robust_sigma END"

_VEC = "vec AS (SELECT vec_id, label AS lot_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


_ITEMS = """numbered AS (SELECT *, row_number() OVER () AS vec_id FROM lineitem),
vec AS (SELECT vec_id, l_suppkey AS lot_id, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM numbered)"""


def _shape(source: str, keys: str) -> str:
    """Means and inverse of the population covariance of each group of three columns, scaled by the lot's spread."""
    return f"""SELECT *, (c22 * c33 - c23 * c23) / det AS p11, (c13 * c23 - c12 * c33) / det AS p12, (c12 * c23 - c13 * c22) / det AS p13,
      (c11 * c33 - c13 * c13) / det AS p22, (c12 * c13 - c11 * c23) / det AS p23, (c11 * c22 - c12 * c12) / det AS p33
      FROM (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c13 * c23) + c13 * (c12 * c23 - c13 * c22) AS det
        FROM (SELECT {keys}, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS c11, covar_pop(x, y) AS c12, covar_pop(x, z) AS c13,
          var_pop(y) AS c22, covar_pop(y, z) AS c23, var_pop(z) AS c33 FROM {source} GROUP BY {keys}))"""


_D = "((x - mx) * (p11 * (x - mx) + p12 * (y - my) + p13 * (z - mz)) + (y - my) * (p12 * (x - mx) + p22 * (y - my) + p23 * (z - mz)) + (z - mz) * (p13 * (x - mx) + p23 * (y - my) + p33 * (z - mz)))"
STEPS, LOO_STEPS = 30, 12

# Concentration of each label, unrolled; when nothing changes any more, further steps change nothing.
_MCD = f"""{_VEC},
sd AS (SELECT lot_id, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz, quantile_cont(x, 0.5) AS ex, quantile_cont(y, 0.5) AS ey,
  quantile_cont(z, 0.5) AS ez FROM vec GROUP BY lot_id),
v AS (SELECT vec_id, lot_id, n, x / sx AS x, y / sy AS y, z / sz AS z, ex / sx AS ex, ey / sy AS ey, ez / sz AS ez,
  row_number() OVER (PARTITION BY lot_id ORDER BY x, y, z) AS place FROM vec JOIN sd USING (lot_id)),
md AS (SELECT lot_id, quantile_cont(abs(x - ex), 0.5) AS ax, quantile_cont(abs(y - ey), 0.5) AS ay, quantile_cont(abs(z - ez), 0.5) AS az FROM v GROUP BY lot_id),
k0 AS (SELECT v.*, row_number() OVER (PARTITION BY v.lot_id ORDER BY ((x - ex) / ax) ** 2 + ((y - ey) / ay) ** 2 + ((z - ez) / az) ** 2, place) <= ceil(n * 0.75) AS kept
  FROM v JOIN md USING (lot_id))""" + "".join(
    f""",
f{i} AS MATERIALIZED ({_shape(f'(SELECT * FROM k{i - 1} WHERE kept)', 'lot_id')}),
k{i} AS MATERIALIZED (SELECT v.*, {_D} AS d, row_number() OVER (PARTITION BY v.lot_id ORDER BY {_D}, place) <= ceil(n * 0.75) AS kept FROM v JOIN f{i} USING (lot_id))"""
    for i in range(1, STEPS + 1)
) + f""",
hf AS (SELECT lot_id, quantile_cont(d, 0.5) / {_CHI_HALF} AS factor FROM k{STEPS} GROUP BY lot_id),
ff AS ({_shape(f'(SELECT * FROM k{STEPS} JOIN hf USING (lot_id) WHERE d / factor < {_CHI_EDGE})', 'lot_id')})"""

# The same with each vector left out in turn, from its label's concentrated set.
_LOO = f"""{_MCD},
w AS MATERIALIZED (SELECT a.vec_id AS i, a.lot_id, b.n - 1 AS n, b.vec_id AS j, b.x, b.y, b.z, b.place, b.kept FROM k{STEPS} a JOIN k{STEPS} b
  ON a.lot_id = b.lot_id AND a.vec_id <> b.vec_id),
l0 AS (SELECT * FROM w)""" + "".join(
    f""",
g{i} AS MATERIALIZED ({_shape(f'(SELECT * FROM l{i - 1} WHERE kept)', 'i')}),
l{i} AS MATERIALIZED (SELECT w.* EXCLUDE (kept), {_D} AS d, row_number() OVER (PARTITION BY i ORDER BY {_D}, place) <= ceil(n * 0.75) AS kept FROM w JOIN g{i} USING (i))"""
    for i in range(1, LOO_STEPS + 1)
) + f""",
lh AS (SELECT i, quantile_cont(d, 0.5) / {_CHI_HALF} AS factor FROM l{LOO_STEPS} GROUP BY i),
lf AS ({_shape(f'(SELECT * FROM l{LOO_STEPS} JOIN lh USING (i) WHERE d / factor < {_CHI_EDGE})', 'i')})"""

_CX = "(x - mx) * (p11 * (x - mx) + p12 * (y - my) + p13 * (z - mz))"
_CY = "(y - my) * (p12 * (x - mx) + p22 * (y - my) + p23 * (z - mz))"
_CZ = "(z - mz) * (p13 * (x - mx) + p23 * (y - my) + p33 * (z - mz))"
# Upper tail of chi-square with three degrees of freedom, by Simpson's rule on its density in the square root.
_TAIL = """greatest(0, 1 - list_sum(list_transform(range(0, 401), lambda q: CASE WHEN q IN (0, 400) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END
  * 2 * sqrt(d2) * q / 400 * sqrt(d2) * q / 400 * exp(-d2 * q * q / 320000) / sqrt(2 * pi()))) * sqrt(d2) / 1200)"""

ORACLES = {
    "forecast_metrics": f"""WITH RECURSIVE {PIVOT}, {POINT.replace('FROM tr a', "FROM full3 a").replace('pt AS (SELECT a.*', 'pt AS (SELECT a.*')}, {bound('pt', '0.1', 10)},
      one AS (SELECT component_type || '/' || parameter AS g, * FROM bd WHERE split = 'test' AND v0 IS NOT NULL AND v168 IS NOT NULL AND point IS NOT NULL AND upper IS NOT NULL),
      two AS (SELECT g AS "group", abs(v168 - point) AS e, upper - point AS w, abs(v168 - v0) AS drift, v168 <= upper AS hit, upper - point + greatest(0, v168 - upper) / 0.1 AS score FROM one
        UNION ALL SELECT 'all', abs(v168 - point), upper - point, abs(v168 - v0), v168 <= upper, upper - point + greatest(0, v168 - upper) / 0.1 FROM one),
      cut AS (SELECT "group", quantile_cont(drift, 0.9) AS cut FROM two GROUP BY 1),
      agg AS (SELECT "group", count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, quantile_cont(e, 0.5) AS medae, avg(e) FILTER (drift >= cut) AS tail_mae,
        count(*) FILTER (hit) AS n_covered, avg(w) AS mean_width, quantile_cont(w, 0.5) AS median_width, avg(score) AS interval_score FROM two JOIN cut USING ("group") GROUP BY 1),
      {_INTERVAL}
      SELECT "group", n, {fin('mae', 'mae')}, {fin('rmse', 'rmse')}, {fin('medae', 'medae')}, {fin('tail_mae', 'tail_mae')}, n_covered, {r6('n_covered / n')} AS coverage,
        {fin('lo', 'coverage_low')}, {fin('hi', 'coverage_high')}, lo <= 0.9 AND hi >= 0.9 AS target_inside, {fin('mean_width', 'mean_width')}, {fin('median_width', 'median_width')},
        {fin('interval_score', 'interval_score')} FROM agg JOIN ends ON g = "group" """,
    "miss_rate_threshold": f"""WITH {_PARTS}, two AS (SELECT CAST(lot_id AS VARCHAR) AS lot_id, score, bad FROM parts UNION ALL SELECT 'all', score, bad FROM parts),
      c AS (SELECT lot_id, count(*) FILTER (bad) AS n_defect, count(*) FILTER (NOT bad) AS n_sound, list_sort(list(score) FILTER (bad)) AS s FROM two GROUP BY 1),
      t AS (SELECT *, list_filter(range(1, n_defect + 1), lambda r: {_sum_tail('0', 'r - 1', 'n_defect', '0.1::DOUBLE')} <= 0.1) AS rs FROM c),
      u AS (SELECT *, len(rs) AS rank, s[len(rs)] AS tau FROM t),
      f AS (SELECT u.lot_id, any_value(n_defect) AS n_defect, any_value(n_sound) AS n_sound, any_value(rank) AS rank, any_value(tau) AS tau,
        count(*) FILTER (rank > 0 AND score >= tau AND bad) AS tp, count(*) FILTER (rank > 0 AND score >= tau AND NOT bad) AS fp FROM u JOIN two USING (lot_id) GROUP BY 1)
      SELECT lot_id, n_defect, n_sound, rank, {r6('CASE WHEN rank > 0 THEN tau END')} AS threshold,
        {r6(f"CASE WHEN rank > 0 THEN {_sum_tail('0', 'rank - 1', 'n_defect', '0.1::DOUBLE')} END")} AS excess_probability,
        {r6('CASE WHEN rank > 0 THEN (n_defect - tp) / n_defect END')} AS miss_rate, {r6('CASE WHEN rank > 0 THEN fp / nullif(n_sound, 0) END')} AS false_positive_rate,
        {r6('CASE WHEN rank > 0 THEN (tp + fp) / (n_defect + n_sound) END')} AS flag_rate, {r6('CASE WHEN n_defect > 0 THEN 1 - pow(0.1, 1.0 / n_defect) END')} AS smallest_alpha,
        CASE WHEN rank = 0 THEN 'INSUFFICIENT_CALIBRATION' END AS refusal_code FROM f""",
    "curve_areas": f"""WITH {_PARTS}, two AS (SELECT CAST(lot_id AS VARCHAR) AS lot_id, floor(score / 4) AS s, bad FROM parts UNION ALL SELECT 'all', floor(score / 4), bad FROM parts),
      r AS (SELECT lot_id, s, count(*) AS n, count(*) FILTER (bad) AS b FROM two GROUP BY ALL),
      q AS (SELECT *, sum(n) OVER (PARTITION BY lot_id ORDER BY s DESC) AS n_ge, sum(b) OVER (PARTITION BY lot_id ORDER BY s DESC) AS b_ge,
        sum(n - b) OVER (PARTITION BY lot_id ORDER BY s) - (n - b) AS g_below FROM r),
      a AS (SELECT lot_id, sum(n) AS n, sum(b) AS nd, sum(b * b_ge / n_ge) AS p, sum(b * (g_below + (n - b) / 2)) AS a FROM q GROUP BY 1)
      SELECT lot_id, CAST(n AS BIGINT) AS n, CAST(nd AS BIGINT) AS n_defect, {r6('nd / n')} AS prevalence, {r6('p / nullif(nd, 0)')} AS average_precision,
        {r6('a / nullif(nd * (n - nd), 0)')} AS roc_area FROM a""",
    "ablation": f"""WITH {LABELS}, {CN}, t24 AS (SELECT * FROM traj WHERE elapsed_hours = 24), {stats_sql('t24', 'lot_id, component_type, parameter')},
      m AS (SELECT lot_id, component_type, parameter, avg(value) AS mean, stddev_pop(value) AS sd FROM t24 GROUP BY ALL),
      fl AS (SELECT t.component_id, t.lot_id, bool_or(value >= 150) AS a, bool_or(abs(value - mean) > 3 * sd) AS b, bool_or(n >= 3 AND abs(value - median) > 2 * robust_sigma) AS c,
        bool_or(n >= 3 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS d FROM t24 t JOIN m USING (lot_id, component_type, parameter)
        JOIN st USING (lot_id, component_type, parameter) GROUP BY ALL),
      p AS (SELECT fl.*, failure_label <> 'HEALTHY' AS bad, is_escape FROM fl JOIN lb USING (component_id, lot_id)),
      s AS (SELECT 'absolute' AS setting, a AS hit, bad, is_escape FROM p UNION ALL SELECT 'mean_3_sigma', b, bad, is_escape FROM p UNION ALL SELECT 'dpat', c, bad, is_escape FROM p
        UNION ALL SELECT 'dpat_tukey', c OR d, bad, is_escape FROM p UNION ALL SELECT 'dpat_tukey_skewed', b OR c OR d, bad, is_escape FROM p UNION ALL SELECT 'all', a OR b OR c OR d, bad, is_escape FROM p),
      k AS (SELECT setting, count(*) AS n, count(*) FILTER (hit) AS n_flagged, count(*) FILTER (bad) AS nd, count(*) FILTER (bad AND hit) AS tp, count(*) FILTER (is_escape) AS ne,
        count(*) FILTER (is_escape AND hit) AS te FROM s GROUP BY 1)
      SELECT setting, n, n_flagged, {r6('tp / nullif(nd, 0)')} AS recall, {r6('te / nullif(ne, 0)')} AS escape_recall, {r6('(n_flagged - tp) / nullif(n - nd, 0)')} AS false_positive_rate,
        {r6('n_flagged / n')} AS flag_rate, {r6('5 * (tp / nullif(n_flagged, 0)) * (tp / nullif(nd, 0)) / nullif(4 * (tp / nullif(n_flagged, 0)) + tp / nullif(nd, 0), 0)')} AS f2 FROM k""",
    "rank_stability": f"""WITH {EV}, c AS (SELECT {r6('least(1, greatest(0, (abs(z) - 3) / 3))')} AS a, {r6('least(1, greatest(0, slope_ratio / 2))')} AS d,
        {r6('least(1, greatest(0, 1 - predicted_margin_pct))')} AS m, {r6('1 - quality_score')} AS q,
        -CASE WHEN attribution IN ('SOCKET', 'TESTER') THEN 1.0 WHEN attribution = 'ZONE' AND zone_consistent THEN 0.5 ELSE 0.0 END::DOUBLE AS k FROM e2 WHERE risk_code IS NULL),
      dr AS (SELECT draw, {', '.join(f"{w} * (1 + 0.5 * (2 * (CAST('0x' || substr(md5('20260930:' || draw || ':{n}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) - 1)) AS w{n[0]}" for n, w in (('anomaly', '0.3::DOUBLE'), ('drift', '0.3::DOUBLE'), ('margin', '0.2::DOUBLE'), ('quality', '0.1::DOUBLE'), ('credit', '0.1::DOUBLE')))} FROM range(1, 201) t(draw)),
      b AS (SELECT *, row_number() OVER () AS id, rank() OVER o + (count(*) OVER (PARTITION BY i) - 1) / 2.0 AS rb FROM (SELECT *, 0.0::DOUBLE + 0.3::DOUBLE * a + 0.3::DOUBLE * d + 0.2::DOUBLE * m + 0.1::DOUBLE * q + 0.1::DOUBLE * k AS i FROM c) WINDOW o AS (ORDER BY i)),
      x AS (SELECT draw, rb, 0.0::DOUBLE + wa * a + wd * d + wm * m + wq * q + wc * k AS i FROM b, dr),
      y AS (SELECT draw, rb, rank() OVER (PARTITION BY draw ORDER BY i) + (count(*) OVER (PARTITION BY draw, i) - 1) / 2.0 AS r FROM x)
      SELECT draw, count(*) AS n, round(corr(rb, r), 4) AS rho FROM y GROUP BY draw""",
    "drift_features": f"""WITH {PIVOT}, {CN}, s AS (SELECT *, v24 - v0 AS delta_24 FROM full3),
      s0 AS (SELECT lot_id, component_type, parameter, v0 AS value FROM s), s1 AS (SELECT lot_id, component_type, parameter, v24 AS value FROM s), s2 AS (SELECT lot_id, component_type, parameter, delta_24 AS value FROM s),
      {stats_sql('s0', 'lot_id, component_type, parameter')}, a AS (SELECT * FROM st),
      b AS (WITH {stats_sql('s1', 'lot_id, component_type, parameter')} SELECT * FROM st), c AS (WITH {stats_sql('s2', 'lot_id, component_type, parameter')} SELECT * FROM st)
      SELECT component_id, s.lot_id, s.component_type, s.parameter, {fin('v0', 'v0')}, {fin('v24', 'v24')}, {fin('delta_24', 'delta_24')},
        {r6('delta_24 / greatest(abs(v0), 1e-9)')} AS rel_delta_24, {r6(_FEATURE('v0', 'a'))} AS v0_lot_z, {r6(_FEATURE('v24', 'b'))} AS v24_lot_z,
        {r6(_FEATURE('delta_24', 'c'))} AS delta_24_lot_z, {r6('(temp0 + temp24) / 2')} AS temperature_mean
      FROM s JOIN a USING (lot_id, component_type, parameter) JOIN b USING (lot_id, component_type, parameter) JOIN c USING (lot_id, component_type, parameter)""",
    "ridge_corrections": f"""WITH {PIVOT}, r AS (SELECT a.*, v24 - v0 AS u, v168 - (v0 + (v24 - v0) * phi_168) AS y FROM full3 a JOIN phi USING (component_type, parameter) WHERE phi_168 IS NOT NULL),
      m AS (SELECT parameter, count(*) AS n, avg(v0) AS m1, avg(u) AS m2, avg(y) AS my, var_pop(v0) + 10 AS a, covar_pop(v0, u) AS b, var_pop(u) + 10 AS c,
        covar_pop(v0, y) AS e, covar_pop(u, y) AS f FROM r WHERE split = 'train' GROUP BY 1),
      w AS (SELECT *, (c * e - b * f) / (a * c - b * b) AS w1, (a * f - b * e) / (a * c - b * b) AS w2 FROM m),
      t AS (SELECT w.parameter, any_value(n) AS n, any_value(my - w1 * m1 - w2 * m2) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, count(y) AS nh, avg(abs(y)) AS p,
        avg(abs(y - (my - w1 * m1 - w2 * m2 + w1 * v0 + w2 * u))) AS q FROM w LEFT JOIN (SELECT * FROM r WHERE split = 'calib') h ON h.parameter = w.parameter GROUP BY 1)
      SELECT parameter, n AS n_train, nh AS n_held_out, {fin('w0', 'intercept')}, {fin('w1', 'w_v0')}, {fin('w2', 'w_delta_24')}, {fin('p', 'mae_plain')}, {fin('q', 'mae_ridge')}, q < p AS adopted FROM t""",
    "cautious_bounds": f"""WITH {PIVOT}, two AS (SELECT component_type || '/' || parameter AS g, residual FROM cal UNION ALL SELECT 'all', residual FROM cal),
      s AS (SELECT g, count(*) AS n, list_sort(list(residual)) AS up, list_sort(list(-residual)) AS down FROM two GROUP BY 1),
      k AS (SELECT g, n, CASE WHEN ceil((n + 1) * 0.9::DOUBLE) <= n THEN up[CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT)] END AS q,
        CASE WHEN ceil((n + 1) * 0.95::DOUBLE) <= n THEN up[CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT)] END AS qc,
        CASE WHEN ceil((n + 1) * 0.9::DOUBLE) <= n THEN down[CAST(ceil((n + 1) * 0.9::DOUBLE) AS BIGINT)] END AS qd FROM s)
      SELECT k.g AS "group", k.n AS n_cal, {fin('k.q', 'q')}, {fin('a.q', 'q_marginal')}, {fin('k.qc', 'q_conservative')}, {r6('greatest(k.q, a.q, k.qc)')} AS q_void, {fin('k.qd', 'q_down')}
      FROM k, (SELECT q FROM k WHERE g = 'all') a WHERE k.g <> 'all'""",
    "mahalanobis_mcd": f"""WITH {_MCD.replace(_VEC, _ITEMS)}, o AS (SELECT l.*, v.n, {_CX} AS cx, {_CY} AS cy, {_CZ} AS cz, greatest(0, {_CX} + {_CY} + {_CZ}) AS d2
      FROM v JOIN ff USING (lot_id) JOIN numbered l ON l.vec_id = v.vec_id)
      SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_suppkey AS lot_id, {fin('l_quantity', 'l_quantity')}, {fin('l_extendedprice', 'l_extendedprice')}, {fin('l_discount', 'l_discount')},
        n, CAST(NULL AS VARCHAR) AS refusal_code, {fin('d2', 'd2')}, {fin('cx', 'c_l_quantity')}, {fin('cy', 'c_l_extendedprice')}, {fin('cz', 'c_l_discount')}, {r6(_TAIL)} AS p_value,
        'shared' AS fit_mode, true AS adds_up, CASE WHEN abs(cx) >= abs(cy) AND abs(cx) >= abs(cz) THEN 'l_quantity' WHEN abs(cy) >= abs(cz) THEN 'l_extendedprice' ELSE 'l_discount' END AS top_parameter FROM o""",
    "joint_distance": f"""WITH {_MCD}, o AS (SELECT vec_id, lot_id, n, {_CX} AS cx, {_CY} AS cy, {_CZ} AS cz, greatest(0, {_CX} + {_CY} + {_CZ}) AS d2 FROM v JOIN ff USING (lot_id))
      SELECT vec_id, lot_id, n, {fin('d2', 'd2')}, {r6(_TAIL)} AS p_value, {fin('cx', 'c_e0')}, {fin('cy', 'c_e1')}, {fin('cz', 'c_e2')}, CAST(NULL AS VARCHAR) AS refusal_code FROM o""",
    "joint_distance_loo": f"""WITH {_LOO}, o AS (SELECT vec_id, v.lot_id, n - 1 AS n, {_CX} AS cx, {_CY} AS cy, {_CZ} AS cz, greatest(0, {_CX} + {_CY} + {_CZ}) AS d2 FROM v JOIN lf ON lf.i = vec_id)
      SELECT vec_id, lot_id, n, {fin('d2', 'd2')}, {r6(_TAIL)} AS p_value, {fin('cx', 'c_e0')}, {fin('cy', 'c_e1')}, {fin('cz', 'c_e2')},
        CASE WHEN abs(cz) >= abs(cx) AND abs(cz) >= abs(cy) THEN 'e2' WHEN abs(cy) >= abs(cx) THEN 'e1' ELSE 'e0' END AS top_parameter, true AS adds_up,
        CAST(NULL AS VARCHAR) AS refusal_code FROM o""",
}
