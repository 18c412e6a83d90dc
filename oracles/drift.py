"""Oracles for the trajectory, guard, attribution and evidence queries."""

from oracles.base import CN, COHORT, LIMITS, TRAJ, fin, loo, r6

PIVOT = f"""{TRAJ},
tr AS (SELECT component_id, lot_id, component_type, parameter, tester_id, split,
  max(value) FILTER (elapsed_hours = 0) AS v0, max(value) FILTER (elapsed_hours = 24) AS v24,
  max(value) FILTER (elapsed_hours = 168) AS v168, max(temperature_c) FILTER (elapsed_hours = 0) AS temp0,
  max(temperature_c) FILTER (elapsed_hours = 24) AS temp24, max(temperature_c) FILTER (elapsed_hours = 168) AS temp168
  FROM traj GROUP BY ALL),
full3 AS (SELECT * FROM tr WHERE v0 IS NOT NULL AND v24 IS NOT NULL AND v168 IS NOT NULL),
phi AS (SELECT component_type, parameter, CASE WHEN count(*) FILTER (split = 'train' AND v24 <> v0) >= 3 THEN
    quantile_cont((v168 - v0) / nullif(v24 - v0, 0), 0.5) FILTER (split = 'train' AND v24 <> v0) END AS phi_168,
  count(*) FILTER (split = 'train' AND v24 <> v0) AS n_used, count(*) FILTER (split = 'train' AND v24 = v0) AS n_zero_amplitude,
  0 AS n_nonfinite, count(*) FILTER (split <> 'train') AS n_excluded,
  count(DISTINCT lot_id) FILTER (split = 'train' AND v24 <> v0) AS n_lots FROM full3 GROUP BY ALL),
cal AS (SELECT a.*, phi_168, v168 - (v0 + (v24 - v0) * phi_168) AS residual FROM full3 a JOIN phi b
  ON a.component_type = b.component_type AND a.parameter = b.parameter WHERE split = 'calib' AND phi_168 IS NOT NULL)"""


def ladder(alpha: str) -> str:
    return f"""
lv AS (SELECT 0 AS level, component_type || '/' || parameter AS level_key, residual FROM cal
  UNION ALL SELECT 1, parameter, residual FROM cal UNION ALL SELECT 2, 'marginal', residual FROM cal),
lr AS (SELECT *, row_number() OVER (PARTITION BY level, level_key ORDER BY residual) AS r,
  count(*) OVER (PARTITION BY level, level_key) AS n_cal FROM lv),
lt AS (SELECT level, level_key, n_cal, CAST(ceil((n_cal + 1) * CAST(1.0 - {alpha} AS DOUBLE)) AS BIGINT) AS k,
  max(residual) FILTER (r = CAST(ceil((n_cal + 1) * CAST(1.0 - {alpha} AS DOUBLE)) AS BIGINT)) AS q_hat FROM lr GROUP BY ALL)"""


def bound(source: str, alpha: str, n_min: int) -> str:
    """CTE ``bd``: the rows of ``source`` (with ``point``) with their bound."""
    return f"""{ladder(alpha)},
bj AS (SELECT s.*, l0.n_cal AS n0, l0.k AS k0, l0.q_hat AS q0, l1.n_cal AS n1, l1.k AS k1, l1.q_hat AS q1x, l2.n_cal AS n2, l2.k AS k2, l2.q_hat AS q2,
  CASE WHEN l0.q_hat IS NOT NULL AND l0.n_cal >= {n_min} THEN 0 WHEN l1.q_hat IS NOT NULL AND NOT (l0.n_cal IS NULL AND l1.n_cal < {n_min})
    THEN 1 WHEN l2.q_hat IS NOT NULL THEN 2 END AS lvl_at
  FROM {source} s LEFT JOIN lt l0 ON l0.level = 0 AND l0.level_key = s.component_type || '/' || s.parameter
  LEFT JOIN lt l1 ON l1.level = 1 AND l1.level_key = s.parameter LEFT JOIN lt l2 ON l2.level = 2),
bd AS (SELECT * EXCLUDE (n0, k0, q0, n1, k1, q1x, n2, k2, q2, lvl_at),
  CASE WHEN point IS NOT NULL THEN point + CASE lvl_at WHEN 0 THEN q0 WHEN 1 THEN q1x WHEN 2 THEN q2 END END AS upper,
  CASE WHEN point IS NOT NULL THEN CASE lvl_at WHEN 0 THEN q0 WHEN 1 THEN q1x WHEN 2 THEN q2 END END AS q_hat,
  CASE WHEN point IS NOT NULL THEN coalesce(CASE lvl_at WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 END, n2, 0) END AS n_cal,
  CASE WHEN point IS NOT NULL THEN CASE lvl_at WHEN 0 THEN k0 WHEN 1 THEN k1 WHEN 2 THEN k2 END END AS k,
  CASE WHEN point IS NOT NULL AND lvl_at IS NOT NULL THEN lvl_at - CASE WHEN lvl_at >= 1 AND n0 IS NULL THEN 1 ELSE 0 END
    - CASE WHEN lvl_at = 2 AND n1 IS NULL THEN 1 ELSE 0 END ELSE 3 END AS mondrian_level,
  CASE WHEN point IS NOT NULL THEN CASE lvl_at WHEN 0 THEN component_type || '/' || parameter WHEN 1 THEN parameter WHEN 2 THEN 'marginal' END END AS mondrian_group,
  CASE WHEN point IS NOT NULL AND lvl_at IS NULL THEN 1.0 / (coalesce(n2, 0) + 1) END AS attainable_alpha,
  CASE WHEN point IS NULL THEN 'INVALID_INPUT' WHEN lvl_at IS NULL THEN 'INSUFFICIENT_CALIBRATION' END AS bound_code FROM bj)"""


POINT = "pt AS (SELECT a.*, phi_168, v0 + (v24 - v0) * phi_168 AS point FROM tr a LEFT JOIN phi b ON a.component_type = b.component_type AND a.parameter = b.parameter)"

PSI = """
gs AS (SELECT c.*, v24 - v0 AS delta24, m.lot_median, (temp0 + temp24) / 2 AS temp FROM cal c JOIN
  (SELECT lot_id, component_type, parameter, quantile_cont(v0, 0.5) AS lot_median FROM full3 WHERE split = 'calib' GROUP BY ALL) m
  ON c.lot_id = m.lot_id AND c.component_type = m.component_type AND c.parameter = m.parameter),
lp AS (SELECT component_id, lot_id, component_type, parameter, tester_id, v0, v24 - v0 AS delta24 FROM tr)"""


def psi_cte(name: str, value: str) -> str:
    edge = "lo + {i} * ((hi - lo) / 10.0)"

    def inside(x: str) -> str:
        return f"({x} >= lo + b * ((hi - lo) / 10.0) AND ({x} < lo + (b + 1) * ((hi - lo) / 10.0) OR b = 9) AND {x} <= hi AND {x} >= lo)"

    return f"""
{name}_s AS (SELECT component_type, parameter, min({value}) AS lo, max({value}) AS hi, count(*) AS rn FROM gs WHERE {value} IS NOT NULL GROUP BY ALL),
{name}_g AS (SELECT *, unnest(range(10)) AS b FROM {name}_s),
{name}_r AS (SELECT g.component_type, g.parameter, b, count(*) FILTER {'(WHERE ' + inside('r.' + value) + ')'} AS rc FROM {name}_g g
  JOIN gs r ON g.component_type = r.component_type AND g.parameter = r.parameter GROUP BY ALL),
{name}_l AS (SELECT l.lot_id, g.component_type, g.parameter, b, any_value(rn) AS rn, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS ln,
  min(l.{value}) AS llo, max(l.{value}) AS lhi,
  count(*) FILTER {'(WHERE ' + inside('l.' + value) + ')'} AS lc FROM {name}_g g
  JOIN lp l ON g.component_type = l.component_type AND g.parameter = l.parameter WHERE l.{value} IS NOT NULL GROUP BY l.lot_id, g.component_type, g.parameter, b),
{name} AS (SELECT lot_id, l.component_type, l.parameter, CASE WHEN any_value(lo) = any_value(hi) THEN
    CASE WHEN any_value(llo) = any_value(lo) AND any_value(lhi) = any_value(lo) THEN 0 ELSE 0.2501 END
  ELSE sum((CASE WHEN lc = 0 THEN 1e-4 ELSE lc / ln END - CASE WHEN rc = 0 THEN 1e-4 ELSE rc / rn END)
    * ln(CASE WHEN lc = 0 THEN 1e-4 ELSE lc / ln END / CASE WHEN rc = 0 THEN 1e-4 ELSE rc / rn END)) END AS psi
  FROM {name}_l l JOIN {name}_r r ON l.component_type = r.component_type AND l.parameter = r.parameter AND l.b = r.b
  GROUP BY lot_id, l.component_type, l.parameter)"""


KS = """
kx AS (SELECT l.lot_id, l.component_type, l.parameter, l.delta24 AS x, count(*) AS m,
   count(*) FILTER (r.delta24 <= l.delta24) AS ru, count(*) FILTER (r.delta24 < l.delta24) AS rb
   FROM (SELECT DISTINCT lot_id, component_type, parameter, delta24 FROM lp WHERE delta24 IS NOT NULL) l
   JOIN gs r ON l.component_type = r.component_type AND l.parameter = r.parameter GROUP BY ALL),
ky AS (SELECT k.*, (SELECT count(*) FROM lp WHERE lp.lot_id = k.lot_id AND lp.component_type = k.component_type AND lp.parameter = k.parameter AND delta24 IS NOT NULL) AS n,
   (SELECT count(*) FROM lp WHERE lp.lot_id = k.lot_id AND lp.component_type = k.component_type AND lp.parameter = k.parameter AND delta24 <= x) AS lu,
   (SELECT count(*) FROM lp WHERE lp.lot_id = k.lot_id AND lp.component_type = k.component_type AND lp.parameter = k.parameter AND delta24 < x) AS lb FROM kx k),
kd AS (SELECT lot_id, component_type, parameter, max(greatest(abs(lu / n - ru / m), abs(lb / n - rb / m))) AS ks, max(n) AS n_lot, max(m) AS n_reference FROM ky GROUP BY ALL),
kt AS (SELECT *, ks * sqrt(CAST(n_lot AS DOUBLE) * n_reference / (n_lot + n_reference)) AS t FROM kd),
ks AS (SELECT lot_id, component_type, parameter, ks, n_lot, n_reference, CASE WHEN t < 0.04 THEN 1 ELSE least(1, greatest(0, 2 *
   list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * t * t))))) END AS ks_p FROM kt)"""

GUARD = f"""{PSI}, {psi_cte('p0', 'v0')}, {psi_cte('p24', 'delta24')}, {KS}, {CN},
gc_q AS (SELECT component_type, parameter, count(*) AS n, quantile_cont(lot_median, 0.25) AS q1, quantile_cont(lot_median, 0.5) AS median,
  quantile_cont(lot_median, 0.75) AS q3 FROM gs GROUP BY ALL),
gc_m AS (SELECT a.component_type, a.parameter, quantile_cont(abs(lot_median - median), 0.5) AS mad FROM gs a JOIN gc_q b
  ON a.component_type = b.component_type AND a.parameter = b.parameter GROUP BY ALL),
gc AS (SELECT a.component_type, a.parameter, median, CASE WHEN a.n < 3 THEN NULL WHEN q3 = q1 AND mad = 0 THEN NULL
  WHEN a.n < 20 AND mad > 0 THEN 1.4826 * cn.c_n * mad ELSE (q3 - q1) / 1.35 END AS sigma
  FROM gc_q a JOIN gc_m b ON a.component_type = b.component_type AND a.parameter = b.parameter LEFT JOIN cn ON cn.n = a.n),
gt AS (SELECT lot_id, component_type, parameter, avg(temperature_c) AS mt FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY ALL),
gr AS (SELECT component_type, parameter, min(temp) AS tlo, max(temp) AS thi FROM gs GROUP BY ALL),
gm AS (SELECT lot_id, component_type, parameter, quantile_cont(v0, 0.5) AS med FROM lp GROUP BY ALL),
g0 AS (SELECT gt.lot_id, gt.component_type, gt.parameter, p0.psi AS psi_v0, p24.psi AS psi_delta24, (med - median) / sigma AS centre_z,
  CASE WHEN n_lot >= 3 AND n_reference >= 3 THEN ks_p END AS ks_p, mt AS mean_temperature, tlo, thi, phi.n_used
  FROM gt LEFT JOIN p0 USING (lot_id, component_type, parameter) LEFT JOIN p24 USING (lot_id, component_type, parameter)
  LEFT JOIN ks USING (lot_id, component_type, parameter) LEFT JOIN gm USING (lot_id, component_type, parameter)
  LEFT JOIN gc USING (component_type, parameter) LEFT JOIN gr USING (component_type, parameter) LEFT JOIN phi USING (component_type, parameter)),
g1 AS (SELECT *, concat_ws(',', CASE WHEN psi_v0 > 0.25 THEN 'feature_shift:v0' END, CASE WHEN psi_delta24 > 0.25 THEN 'feature_shift:delta_24' END,
  CASE WHEN abs(centre_z) > 3 THEN 'lot_centre_shift' END, CASE WHEN ks_p < 0.01 THEN 'amplitude_shift' END,
  CASE WHEN mean_temperature < tlo OR mean_temperature > thi THEN 'temperature_range' END, CASE WHEN n_used IS NULL THEN 'group_novelty' END) AS signals_fired FROM g0),
gd AS (SELECT *, CASE WHEN signals_fired <> '' THEN 'VOID' WHEN greatest(psi_v0, psi_delta24) >= 0.1 THEN 'DEGRADED' ELSE 'VALID' END AS guarantee_status FROM g1),
nt AS (SELECT DISTINCT component_type, parameter, tester_id FROM traj t WHERE EXISTS (SELECT 1 FROM phi WHERE phi.component_type = t.component_type AND phi.parameter = t.parameter)
  AND elapsed_hours IN (0, 24) AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.component_type = t.component_type AND gs.parameter = t.parameter AND gs.tester_id = t.tester_id))"""


def safety_cte(source: str) -> str:
    return f"""
sf0 AS (SELECT *, CASE WHEN upper IS NULL THEN 'INSUFFICIENT_CALIBRATION' WHEN v0 IS NULL THEN 'INSUFFICIENT_DATA' WHEN point IS NULL THEN 'INVALID_INPUT'
  WHEN 150.0 - v0 <= 0 THEN 'INVALID_INPUT' END AS safety_code, CAST(150 AS DOUBLE) - v0 AS headroom FROM {source}),
sf1 AS (SELECT *, headroom * CAST(0.8 AS DOUBLE) AS usable_margin, headroom * CAST(0.8 AS DOUBLE) / 168 AS safety_slope, (point - v0) / 168 AS long_slope,
  CAST(150 AS DOUBLE) - upper AS predicted_margin FROM sf0),
sf2 AS (SELECT *, long_slope / safety_slope AS slope_ratio, CAST(150 AS DOUBLE) - usable_margin AS safe_threshold, predicted_margin / headroom AS predicted_margin_pct FROM sf1),
sf AS (SELECT *, CASE WHEN safety_code IS NOT NULL THEN NULL WHEN upper >= 150 THEN 'REJECT' WHEN slope_ratio >= 1 THEN 'EARLY_WARNING'
  WHEN slope_ratio >= 0.7 OR upper >= safe_threshold THEN 'WATCH' ELSE 'SAFE' END AS band FROM sf2)"""


def setup_cte(source: str, names: dict[str, list[str]]) -> str:
    """CTEs for the lot, socket, zone and tester statistics of every row, chained."""
    out = [loo("at_lot", source, ["lot_id", "component_type", "parameter"], prefix="lot_")]
    previous = "at_lot"
    for name, keys in names.items():
        out.append(loo(f"at_{name}", previous, keys, prefix=f"{name}_"))
        previous = f"at_{name}"
    return ", ".join(out)


SETUP_KEYS = {
    "socket": ["socket_id", "component_type", "parameter"],
    "zone": ["lot_id", "thermal_zone", "component_type", "parameter"],
    "tester": ["tester_id", "component_type", "parameter"],
}


def attribution_cte(source: str) -> str:
    def ev(name: str) -> str:
        return f"({name}_n >= 3 AND lot_refusal_code IS NULL)"

    far = "socket_id, component_type, parameter, lot_median AS far_median, lot_robust_sigma AS far_sigma"

    def z(name: str) -> str:
        return f"CASE WHEN {ev(name)} THEN CASE WHEN {name}_robust_sigma > 0 THEN (value - {name}_median) / {name}_robust_sigma WHEN value = {name}_median THEN 0 END END"

    def claim(name: str) -> str:
        return (
            f"coalesce({ev(name)} AND abs(({name}_median - lot_median) / nullif(lot_robust_sigma, 0)) >= 2 AND"
            f" CASE WHEN {name}_robust_sigma > 0 THEN abs((value - {name}_median) / {name}_robust_sigma) < 3 ELSE value = {name}_median END, false)"
        )

    offsets = ", ".join(
        f"CASE WHEN {ev(n)} THEN ({n}_median - lot_median) / nullif(lot_robust_sigma, 0) END AS {n}_offset_sigma, {z(n)} AS z_{n},"
        f" CASE WHEN {ev(n)} THEN {n}_n END AS {n}_size"
        for n in SETUP_KEYS
    )
    return f"""{CN}, {setup_cte(source, SETUP_KEYS)},
at_probe AS (SELECT DISTINCT {far} FROM at_tester
  WHERE lot_refusal_code IS NULL AND lot_robust_sigma > 0),
at_count AS (SELECT p.*, count(*) FILTER (m.value <= p.far_median - 3 * p.far_sigma OR m.value >= p.far_median + 3 * p.far_sigma) AS far
  FROM at_probe p LEFT JOIN {source} m ON m.status = 'OK' AND m.socket_id = p.socket_id AND m.component_type = p.component_type AND m.parameter = p.parameter GROUP BY ALL),
at_e AS (SELECT a.*, {offsets}, CASE WHEN {ev('socket').replace('lot_refusal', 'a.lot_refusal')} THEN far - CASE WHEN a.status = 'OK' AND (value <= a.lot_median - 3 * a.lot_robust_sigma
    OR value >= a.lot_median + 3 * a.lot_robust_sigma) THEN 1 ELSE 0 END END AS socket_coherent_count,
  {claim('socket')} AS cs, {claim('zone')} AS cz, {claim('tester')} AS ct,
  CASE WHEN value IS NULL THEN 'INVALID_INPUT' WHEN lot_n < 3 THEN 'INSUFFICIENT_COHORT' WHEN lot_refusal_code IS NOT NULL OR lot_robust_sigma <= 0 THEN 'NO_VARIATION' END AS attribution_code
  FROM at_tester a LEFT JOIN at_count c ON a.socket_id = c.socket_id AND a.component_type = c.component_type AND a.parameter = c.parameter
   AND a.lot_median = c.far_median AND a.lot_robust_sigma = c.far_sigma),
at_c AS (SELECT *, CASE WHEN attribution_code IS NULL THEN concat_ws(',', CASE WHEN cs AND socket_coherent_count >= 3 THEN 'SOCKET' END,
  CASE WHEN cz THEN 'ZONE' END, CASE WHEN ct THEN 'TESTER' END) ELSE '' END AS setup_claims FROM at_e),
lvl_at AS (SELECT *, CASE WHEN attribution_code IS NOT NULL OR NOT ({' OR '.join(ev(n) for n in SETUP_KEYS)}) OR setup_claims LIKE '%,%' THEN 'INDETERMINATE'
  WHEN setup_claims <> '' THEN setup_claims ELSE 'PART' END AS attribution FROM at_c)"""


ESCAPE = f"""{COHORT}, {CN}, {LIMITS}, {loo('l', 'cohort', ['lot_id', 'parameter'])},
esc0 AS (SELECT a.*, coalesce(value > high, false) OR coalesce(value < low, false) AS absolute_fail,
  CASE WHEN n < 3 THEN NULL WHEN robust_sigma > 0 THEN (value - median) / robust_sigma WHEN value = median THEN 0 END AS z,
  CASE WHEN refusal_code IS NOT NULL THEN refusal_code WHEN value >= median - 1.2 * robust_sigma AND value <= median + 1.2 * robust_sigma
    THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l a LEFT JOIN limits b ON a.parameter = b.parameter),
esc AS (SELECT *, CASE WHEN absolute_fail THEN 'ABSOLUTE_FAIL' WHEN abs(z) >= 6 THEN 'SEVERE' WHEN abs(z) >= 4.5 THEN 'ANOMALOUS'
   WHEN abs(z) >= 3 THEN 'ELEVATED' ELSE 'NOMINAL' END AS severity FROM esc0),
worst AS (SELECT * FROM (SELECT *, CASE severity WHEN 'ABSOLUTE_FAIL' THEN 4 WHEN 'SEVERE' THEN 3 WHEN 'ANOMALOUS' THEN 2 WHEN 'ELEVATED' THEN 1 ELSE 0 END AS severity_rank,
  row_number() OVER (PARTITION BY component_id ORDER BY CASE severity WHEN 'ABSOLUTE_FAIL' THEN 4 WHEN 'SEVERE' THEN 3 WHEN 'ANOMALOUS' THEN 2
    WHEN 'ELEVATED' THEN 1 ELSE 0 END DESC, coalesce(abs(z), -1) DESC,
    CASE parameter WHEN 'quantity' THEN 0 WHEN 'price' THEN 1 WHEN 'discount' THEN 2 ELSE 3 END) AS rn FROM esc) WHERE rn = 1)"""

EV = f"""{PIVOT}, {POINT}, {bound('pt', '0.1', 10)}, {safety_cte('bd')}, {GUARD},
ev_src AS (SELECT a.*, b.socket_id, b.thermal_zone, a.v24 AS value, CASE WHEN a.v24 IS NOT NULL THEN 'OK' END AS status FROM sf a
  JOIN (SELECT component_id, parameter, any_value(socket_id) AS socket_id, any_value(thermal_zone) AS thermal_zone FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY ALL) b
  ON a.component_id = b.component_id AND a.parameter = b.parameter),
{attribution_cte('ev_src').replace(CN + ', ', '', 1)},
lt_l AS (SELECT lot_id, avg(temperature_c) AS lot_temp FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY lot_id),
lt_z AS (SELECT lot_id, thermal_zone, avg(temperature_c) AS zone_temp FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY ALL),
e0 AS (SELECT a.*, a.lot_n AS n, a.lot_median AS median, a.lot_robust_sigma AS robust_sigma,
  coalesce(v0 > 150, false) OR coalesce(v24 > 150, false) AS absolute_fail,
  (150 - v24) / nullif(150 - coalesce(v0, v24), 0) AS observed_margin_pct,
  CASE WHEN (v0 IS NULL OR v0 > 150) AND (v24 IS NULL OR v24 > 150) THEN 0 ELSE 1 - ((CASE WHEN v0 IS NULL THEN 1 ELSE 0 END + CASE WHEN v24 IS NULL THEN 1 ELSE 0 END) * CAST(0.05 AS DOUBLE)
    + (CASE WHEN v0 > 150 THEN 1 ELSE 0 END + CASE WHEN v24 > 150 THEN 1 ELSE 0 END) * CAST(0.1 AS DOUBLE)
    + CASE WHEN v0 = v24 AND v0 <= 150 THEN 0.25 ELSE 0 END) END AS quality_score,
  CASE WHEN lot_n < 3 THEN NULL WHEN lot_robust_sigma > 0 THEN (v24 - lot_median) / lot_robust_sigma WHEN v24 = lot_median THEN 0 END AS z,
  CASE WHEN lot_n < 3 THEN 'INSUFFICIENT_COHORT' WHEN v24 IS NULL THEN NULL WHEN lot_refusal_code IS NOT NULL THEN lot_refusal_code
    WHEN v24 >= lot_median - 6 * lot_robust_sigma AND v24 <= lot_median + 6 * lot_robust_sigma THEN 'PASS' ELSE 'FAIL' END AS dpat_verdict,
  CASE WHEN gd.signals_fired <> '' OR nt.tester_id IS NOT NULL THEN 'VOID' WHEN greatest(psi_v0, psi_delta24) >= 0.1 THEN 'DEGRADED' ELSE 'VALID' END AS guarantee_status,
  CASE WHEN a.parameter = 'view' OR v24 IS NULL OR zone_offset_sigma IS NULL OR zone_temp = lot_temp OR zone_offset_sigma = 0 THEN false
    ELSE (zone_temp > lot_temp) = (zone_offset_sigma > 0) END AS zone_consistent
  FROM lvl_at a LEFT JOIN gd ON a.lot_id = gd.lot_id AND a.component_type = gd.component_type AND a.parameter = gd.parameter
  LEFT JOIN nt ON a.component_type = nt.component_type AND a.parameter = nt.parameter AND a.tester_id = nt.tester_id
  LEFT JOIN lt_l ON a.lot_id = lt_l.lot_id LEFT JOIN lt_z ON a.lot_id = lt_z.lot_id AND a.thermal_zone = lt_z.thermal_zone),
e1 AS (SELECT * REPLACE (CASE WHEN v24 IS NULL THEN 'INDETERMINATE' ELSE attribution END AS attribution), CASE WHEN z IS NULL THEN 'INSUFFICIENT_DATA' WHEN safety_code IS NOT NULL THEN safety_code END AS risk_code,
  n < 20 OR quality_score < 0.5 OR mondrian_level > 0 OR guarantee_status <> 'VALID' AS evidence_weak FROM e0),
e2 AS (SELECT *, CASE WHEN risk_code IS NULL THEN 0.3 * least(1, greatest(0, (abs(z) - 3) / 3)) + 0.3 * least(1, greatest(0, slope_ratio / 2))
   + 0.2 * least(1, greatest(0, 1 - predicted_margin_pct)) + 0.1 * (1 - quality_score)
   - 0.1 * CASE WHEN attribution IN ('SOCKET', 'TESTER') THEN 1 WHEN attribution = 'ZONE' AND zone_consistent THEN 0.5 ELSE 0 END END AS risk_index,
  CASE WHEN band IS NULL OR z IS NULL OR observed_margin_pct IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN absolute_fail THEN 'REJECT'
   WHEN attribution IN ('SOCKET', 'TESTER') THEN 'RETEST_DIFFERENT_SOCKET' WHEN attribution = 'ZONE' THEN CASE WHEN zone_consistent THEN 'ZONAL_REVIEW' ELSE 'INVESTIGATE' END
   WHEN band = 'REJECT' THEN 'REJECT' WHEN band = 'EARLY_WARNING' AND observed_margin_pct > 0 THEN 'EXTEND_BURN_IN'
   WHEN band = 'WATCH' AND abs(z) < 4.5 AND attribution = 'PART' THEN 'MONITOR'
   WHEN band = 'SAFE' AND abs(z) < 3 AND NOT evidence_weak AND attribution = 'PART' THEN 'ACCEPT' ELSE 'INVESTIGATE' END AS action,
  CASE WHEN absolute_fail THEN 'ABSOLUTE_FAIL' WHEN band IS NULL OR z IS NULL THEN 'NOMINAL' WHEN abs(z) >= 6 THEN 'SEVERE' WHEN abs(z) >= 4.5 THEN 'ANOMALOUS'
   WHEN abs(z) >= 3 THEN 'ELEVATED' ELSE 'NOMINAL' END AS severity FROM e1),
ew AS (SELECT * FROM (SELECT *, CASE band WHEN 'REJECT' THEN 3 WHEN 'EARLY_WARNING' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'SAFE' THEN 0 ELSE -1 END AS band_rank,
  row_number() OVER (PARTITION BY component_id ORDER BY
   CASE severity WHEN 'ABSOLUTE_FAIL' THEN 4 WHEN 'SEVERE' THEN 3 WHEN 'ANOMALOUS' THEN 2 WHEN 'ELEVATED' THEN 1 ELSE 0 END DESC,
   CASE band WHEN 'REJECT' THEN 3 WHEN 'EARLY_WARNING' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'SAFE' THEN 0 ELSE -1 END DESC, coalesce(abs(z), -1) DESC,
   CASE parameter WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS rn FROM e2) WHERE rn = 1)"""


def rollup(source: str, band: str) -> str:
    return f"""lr1 AS (SELECT lot_id, count(*) AS n, count(*) FILTER (absolute_fail OR coalesce({band} = 'REJECT', false)) AS n_reject,
   count(*) FILTER (NOT absolute_fail AND coalesce({band} = 'EARLY_WARNING', false)) AS n_early_warning, count(*) FILTER (NOT absolute_fail AND {band} IS NULL) AS n_excluded FROM {source} GROUP BY lot_id)
  SELECT lot_id, n - n_excluded AS n_tested, n_reject, n_early_warning, n_excluded, {r6('100.0 * n_reject / nullif(n - n_excluded, 0)')} AS pda_pct,
   {r6('100.0 * (n_reject + n_early_warning) / nullif(n - n_excluded, 0)')} AS pda_pct_with_early_warning,
   CASE WHEN n = n_excluded THEN NULL WHEN 100.0 * n_reject / nullif(n - n_excluded, 0) > 5 THEN 'FAIL_LOT' WHEN 100.0 * n_reject / nullif(n - n_excluded, 0) > 4 THEN 'REVIEW' ELSE 'PASS_LOT' END AS lot_verdict,
   CASE WHEN n = n_excluded THEN 'INSUFFICIENT_DATA' END AS refusal_code FROM lr1"""


def _bound_query(alpha: str, n_min: int) -> str:
    return f"""WITH {PIVOT}, {POINT}, {bound('pt', alpha, n_min)} SELECT component_id, parameter, {fin('upper', 'upper')}, {fin('q_hat', 'q_hat')},
      n_cal, k, mondrian_level, mondrian_group, {fin('attainable_alpha', 'attainable_alpha')}, bound_code FROM bd"""


ORACLES = {
    "escape_list": f"""WITH {ESCAPE} SELECT component_id, lot_id, parameter, {fin('value', 'value')}, {fin('median', 'median')},
      {fin('robust_sigma', 'robust_sigma')}, {fin('z', 'z')} FROM esc WHERE verdict = 'FAIL' AND NOT absolute_fail""",
    "escape_spotlight": f"""WITH {ESCAPE} SELECT lot_id, component_id, parameter FROM esc WHERE verdict = 'FAIL' AND NOT absolute_fail
      ORDER BY lot_id, component_id, parameter LIMIT 1""",
    "worst_parameter": f"""WITH {ESCAPE} SELECT component_id, lot_id, parameter, severity, {fin('z', 'z')}, verdict AS dpat_verdict, absolute_fail FROM worst""",
    "worklist": f"""WITH {ESCAPE} SELECT component_id, lot_id, severity, severity_rank, parameter FROM worst ORDER BY severity_rank DESC, component_id""",
    "lot_ranking": f"""WITH {ESCAPE} SELECT lot_id, count(*) AS n_parts, count(*) FILTER (verdict = 'FAIL' OR absolute_fail) AS n_flagged FROM worst GROUP BY lot_id
      ORDER BY n_flagged DESC, lot_id""",
    "pda_rollup_items": f"WITH {ESCAPE}, {rollup('worst', 'CAST(NULL AS VARCHAR)')}",
    "series_pivot": f"""WITH {PIVOT} SELECT component_id, lot_id, component_type, parameter, tester_id, {fin('v0', 'v0')}, {fin('temp0', 'temp0')},
      {fin('v24', 'v24')}, {fin('temp24', 'temp24')}, {fin('v168', 'v168')}, {fin('temp168', 'temp168')} FROM tr""",
    "shape_phi": f"""WITH {PIVOT} SELECT component_type, parameter, {fin('phi_168', 'phi_168')},
      {r6('CASE WHEN phi_168 > 0 THEN ln(phi_168) / ln(7) END')} AS family_param, n_used, n_zero_amplitude, n_nonfinite, n_excluded, n_lots,
      CASE WHEN n_used < 3 THEN CASE WHEN n_used = 0 AND n_zero_amplitude >= 3 THEN 'NO_VARIATION' ELSE 'INSUFFICIENT_COHORT' END END AS refusal_code FROM phi""",
    "shape_points": f"""WITH {PIVOT}, g AS (SELECT component_type, parameter, phi_168, unnest([0.0, 6, 12, 24, 48, 96, 168])::DOUBLE AS hour FROM phi),
      f AS (SELECT *, unnest(['power_law', 'linear', 'log_time', 'saturating']) AS family FROM g)
      SELECT component_type, parameter, family, {fin('hour', 'hour')}, {r6('''CASE WHEN hour = 0 THEN 0 WHEN hour = 24 THEN 1 WHEN family = 'linear' THEN hour / 24
        WHEN family = 'power_law' THEN CASE WHEN phi_168 > 0 THEN CASE WHEN hour = 168 THEN phi_168 ELSE pow(hour / 24, ln(phi_168) / ln(7)) END END
        WHEN family = 'log_time' THEN ln(1 + hour / 36) / ln(1 + 24.0 / 36) ELSE (1 - exp(-hour / 36)) / (1 - exp(-24.0 / 36)) END''')} AS phi FROM f""",
    "forecast": f"""WITH {PIVOT}, {POINT} SELECT component_id, parameter, {r6('point + 1.5')} AS point, {r6('point')} AS shape_point,
      {r6('CASE WHEN point IS NOT NULL THEN v0 + (v24 - v0) * 7 END')} AS baseline_linear, {r6('CASE WHEN point IS NOT NULL THEN v24 - v0 END')} AS amplitude,
      point IS NOT NULL AS residual_applied, CASE WHEN v0 IS NULL OR v24 IS NULL THEN 'INSUFFICIENT_DATA' WHEN phi_168 IS NULL THEN 'INVALID_INPUT' END AS refusal_code FROM pt""",
    "conformal_residuals": f"WITH {PIVOT} SELECT component_id, parameter, {fin('phi_168', 'phi_168')}, {fin('residual', 'residual')} FROM cal",
    "conformal_ladder": f"""WITH {PIVOT}, {ladder('0.1')} SELECT level, level_key, n_cal, k, {fin('q_hat', 'q_hat')},
      {r6('CASE WHEN k > n_cal OR k < 1 THEN 1.0 / (n_cal + 1) END')} AS attainable_alpha FROM lt""",
    "conformal_bound": _bound_query("0.1", 10),
    "conformal_bound_coarse": _bound_query("0.02", 50),
    "calibration_capacity": f"""WITH {PIVOT}, d AS (SELECT t AS component_type, p AS parameter FROM (SELECT unnest(['0', '1', '2', '3']) AS t), (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS p)),
      c AS (SELECT d.*, (SELECT count(*) FROM full3 WHERE split = 'calib' AND full3.component_type = d.component_type AND full3.parameter = d.parameter) AS n FROM d)
      SELECT component_type, parameter, n AS n_cal, {r6('CASE WHEN n > 0 THEN 1.0 / (n + 1) ELSE 1 END')} AS attainable_alpha,
        n >= 10 AND 1.0 / (n + 1) <= 0.1 AS alpha_supported, CASE WHEN n >= 10 AND 1.0 / (n + 1) <= 0.1 THEN 0 WHEN n > 0 THEN 1 ELSE 3 END AS level_supported FROM c""",
    "calibration_manifest": f"""WITH {PIVOT} SELECT component_type || '/' || parameter AS "group", {fin('phi_168', 'phi_168')},
      {r6('CASE WHEN phi_168 > 0 THEN ln(phi_168) / ln(7) END')} AS family_param, n_used AS n_phi_used,
      (SELECT count(*) FROM cal WHERE cal.component_type = phi.component_type AND cal.parameter = phi.parameter) AS n_cal,
      CASE WHEN n_used < 3 THEN CASE WHEN n_used = 0 AND n_zero_amplitude >= 3 THEN 'NO_VARIATION' ELSE 'INSUFFICIENT_COHORT' END END AS refusal_code
      FROM phi WHERE n_used + n_zero_amplitude > 0""",
    "psi": f"WITH {PIVOT}, {PSI}, {psi_cte('p24', 'delta24')} SELECT lot_id, component_type, parameter, {fin('psi', 'psi')} FROM p24",
    "ks_statistic": f"WITH {PIVOT}, {PSI}, {KS} SELECT lot_id, component_type, parameter, {fin('ks', 'ks')}, n_lot, n_reference, {fin('ks_p', 'ks_p')} FROM ks",
    "guard": f"""WITH {PIVOT}, {GUARD} SELECT lot_id, component_type, parameter, {fin('psi_v0', 'psi_v0')}, {fin('psi_delta24', 'psi_delta24')},
      {fin('centre_z', 'centre_z')}, {fin('ks_p', 'ks_p')}, {fin('mean_temperature', 'mean_temperature')}, signals_fired, guarantee_status FROM gd""",
    "novel_testers": f"WITH {PIVOT}, {GUARD} SELECT component_type, parameter, tester_id FROM nt",
    "attribution": f"""WITH {COHORT}, {attribution_cte('cohort')} SELECT component_id, lot_id, parameter, lot_n, socket_size AS socket_n,
      {fin('socket_offset_sigma', 'socket_offset_sigma')}, {fin('z_socket', 'z_socket')}, socket_coherent_count, zone_size AS zone_n,
      {fin('zone_offset_sigma', 'zone_offset_sigma')}, {fin('z_zone', 'z_zone')}, tester_size AS tester_n,
      {fin('tester_offset_sigma', 'tester_offset_sigma')}, {fin('z_tester', 'z_tester')}, setup_claims, attribution, attribution_code FROM lvl_at""",
    "arrhenius_zone": f"""WITH {TRAJ}, l AS (SELECT lot_id, avg(temperature_c) AS lot_temp FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY lot_id),
      z AS (SELECT lot_id, thermal_zone, avg(temperature_c) AS zone_temp FROM traj WHERE elapsed_hours IN (0, 24) GROUP BY ALL),
      j AS (SELECT z.lot_id, thermal_zone, zone_temp, lot_temp, exp(0.7 / 8.617333262145e-5 * (1 / (lot_temp + 273.15) - 1 / (zone_temp + 273.15))) AS af,
        exp(0.7 / 8.617333262145e-5 * (1 / (55 + 273.15) - 1 / (zone_temp + 273.15))) AS uf FROM z JOIN l ON z.lot_id = l.lot_id)
      SELECT lot_id, thermal_zone, {fin('zone_temp', 'zone_temp')}, {fin('lot_temp', 'lot_temp')}, {fin('af', 'af')},
        CASE WHEN af <> 1 THEN CASE WHEN zone_temp = lot_temp THEN false ELSE (af > 1) = (zone_temp > lot_temp) END END AS consistent,
        CASE WHEN af = 1 THEN 'INSUFFICIENT_DATA' END AS refusal_code, {r6('168 * uf / 1000')} AS field_khours FROM j""",
    "safety_band": f"""WITH {PIVOT}, {POINT}, {bound('pt', '0.1', 10)}, {safety_cte('bd')} SELECT component_id, parameter, band,
      {', '.join(r6(f'CASE WHEN safety_code IS NULL THEN {c} END') + f' AS {c}' for c in ('headroom', 'usable_margin', 'safety_slope', 'long_slope', 'predicted_margin', 'predicted_margin_pct', 'slope_ratio', 'safe_threshold'))},
      {r6('CASE WHEN safety_code IS NULL THEN (v24 - v0) / 24 END')} AS early_slope, safety_code AS refusal_code FROM sf""",
    "evidence": f"""WITH {EV} SELECT component_id, lot_id, parameter, {fin('v0', 'v0')}, {fin('v24', 'v24')}, n, {fin('median', 'median')},
      {fin('robust_sigma', 'robust_sigma')}, {r6('CASE WHEN lot_refusal_code IS NULL THEN median - 6 * robust_sigma END')} AS dpat_low,
      {r6('CASE WHEN lot_refusal_code IS NULL THEN median + 6 * robust_sigma END')} AS dpat_high, {fin('z', 'z')}, dpat_verdict, absolute_fail,
      {fin('observed_margin_pct', 'observed_margin_pct')}, {fin('quality_score', 'quality_score')}, {fin('phi_168', 'phi_168')}, {fin('point', 'point')},
      {fin('upper', 'upper')}, mondrian_level, guarantee_status, band,
      {r6('CASE WHEN safety_code IS NULL THEN predicted_margin_pct END')} AS predicted_margin_pct, {r6('CASE WHEN safety_code IS NULL THEN slope_ratio END')} AS slope_ratio,
      safety_code, attribution, zone_consistent, {fin('risk_index', 'risk_index')}, risk_code, evidence_weak, action, severity FROM e2""",
    "evidence_worst": f"""WITH {EV} SELECT component_id, lot_id, parameter, severity, band, {fin('z', 'z')}, dpat_verdict, absolute_fail,
      {fin('risk_index', 'risk_index')}, action FROM ew""",
    "drift_queue": f"WITH {EV} SELECT component_id, lot_id, band, band_rank, parameter FROM ew ORDER BY band_rank DESC, component_id",
    "pda_rollup": f"WITH {EV}, {rollup('ew', 'band')}",
}
