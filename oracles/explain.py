"""Oracles for what is shown of the evidence."""

from oracles.base import fin, r6
from oracles.drift import EV, PIVOT, rollup
from oracles.trace import SCORED


def num(expr: str, digits: int) -> str:
    scale = f"CAST(1{'0' * digits} AS DOUBLE)"
    return f"printf('%.{digits}f', floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


# Evidence with the factor to the unit shown and that unit
X = f"""{EV}, x AS (SELECT *, CAST(CASE parameter WHEN 'error' THEN 0.001 WHEN 'purchase' THEN 1000 ELSE 1 END AS DOUBLE) AS f,
  CASE parameter WHEN 'click' THEN 'uA' WHEN 'error' THEN 'uA' WHEN 'purchase' THEN 'uA' WHEN 'signup' THEN 'ns' END AS u,
  lot_refusal_code IS NULL AS window, safety_code IS NULL AS safe,
  CASE WHEN lot_refusal_code IS NOT NULL THEN 'none' WHEN lot_n < 20 AND lot_mad > 0 THEN 'mad' ELSE 'iqr' END AS kind,
  CASE WHEN lot_refusal_code IS NULL THEN lot_median - 6 * lot_robust_sigma END AS dpat_low,
  CASE WHEN lot_refusal_code IS NULL THEN lot_median + 6 * lot_robust_sigma END AS dpat_high FROM e2)"""

_NOTES = """CASE WHEN n < 20 THEN ' Small-cohort statistics apply; statistical power is reduced.' ELSE '' END
  || CASE WHEN mondrian_level > 0 THEN ' Conformal bound uses fallback grouping level ' || mondrian_level || '.' ELSE '' END
  || CASE WHEN guarantee_status <> 'VALID' THEN ' Exchangeability guarantee is ' || guarantee_status || '; the bound is conservative.' ELSE '' END"""

# Texts, layers and counterfactual of every row
TOLD = f"""{X}, t0 AS (SELECT *, CASE WHEN dpat_verdict IN ('PASS', 'FAIL') THEN component_id || ' reads ' || {num('v24 * f', 2)} || ' ' || u || ' for ' || parameter
   || ' at read point 24 h. Its lot cohort of ' || (n + 1) || ' sibling parts has median ' || {num('median * f', 2)} || ' ' || u || ' and robust sigma '
   || {num('robust_sigma * f', 2)} || ' ' || u || ', giving a Dynamic PAT upper limit of ' || {num('dpat_high * f', 2)} || ' ' || u || ' at k 6.0. The part sits '
   || {num('z', 2)} || ' robust sigma from its lot median. Absolute limit ' || {num('150::DOUBLE * f', 2)} || ' ' || u || ' is '
   || CASE WHEN absolute_fail THEN 'violated' ELSE 'not violated' END || '.' || {_NOTES} END AS anomaly_text,
  CASE WHEN safe THEN 'Forecast to horizon 168 h: point ' || {num('point * f', 2)} || ' ' || u || ' with one-sided conformal upper bound ' || {num('upper * f', 2)}
   || ' ' || u || ' at alpha 0.1. Linear baseline ' || {num('(v0 + (v24 - v0) * 7) * f', 2)} || ' ' || u || '. Predicted slope ' || {num('long_slope * f', 4)}
   || ' ' || u || '/h against safety slope ' || {num('safety_slope * f', 4)} || ' ' || u || '/h gives slope ratio ' || {num('slope_ratio', 3)} || ' and band '
   || band || '.' || {_NOTES} END AS drift_text,
  'Attribution is ' || attribution || '. See the structured evidence for socket, zone and tester offsets; setup-attributable evidence reduces risk and routes'
   || ' to retest rather than rejection.' AS attribution_text,
  CASE WHEN robust_sigma <> 0 THEN abs(z) END AS k_star,
  CASE WHEN robust_sigma <> 0 AND z IS NOT NULL THEN (CASE WHEN v24 >= median THEN median * f + 6 * (robust_sigma * f) ELSE median * f - 6 * (robust_sigma * f) END) END AS clearing_value FROM x),
told AS (SELECT *, concat_ws(',', CASE WHEN anomaly_text IS NOT NULL OR drift_text IS NOT NULL THEN 'arithmetic' END, 'attribution',
   CASE WHEN k_star IS NOT NULL THEN 'counterfactual' END, CASE WHEN anomaly_text IS NOT NULL THEN 'verdict' END) AS layers,
  'This part flags at any k below ' || {num('k_star', 1)} || '. The configured k is 6.0.' AS k_sentence FROM t0)"""

_MARGIN = "(CAST(150 AS DOUBLE) - upper)"
# formula, kind, value, condition; values of the second list are in the unit shown
_PLAIN = (
    ("dpat.z_v1", "e", "z", "lot_robust_sigma > 0"),
    ("shape.phi_168_v1", "p", "phi_168", "true"),
    ("risk.anomaly_v1", "e", "least(1, greatest(0, (abs(z) - 3) / 3))", "risk_code IS NULL"),
    ("risk.drift_v1", "e", "least(1, greatest(0, slope_ratio / 2))", "risk_code IS NULL"),
    ("risk.margin_v1", "e", "least(1, greatest(0, 1 - predicted_margin_pct))", "risk_code IS NULL"),
    ("risk.quality_v1", "e", "1 - quality_score", "risk_code IS NULL"),
    ("risk.credit_v1", "p", "0", "risk_code IS NULL"),
    ("risk.total_v1", "e", "risk_index", "risk_code IS NULL"),
)
_SHOWN = (
    ("raw.measurement", "e", "v24 * f", "true"),
    ("robust.median_v1", "p", "median * f", "true"),
    ("robust.q1_v1", "p", "lot_q1 * f", "true"),
    ("robust.q3_v1", "p", "lot_q3 * f", "true"),
    ("robust.iqr_v1", "e", "lot_q3 * f - lot_q1 * f", "true"),
    ("robust.sigma_iqr_v1", "e", "robust_sigma * f", "kind = 'iqr'"),
    ("robust.sigma_mad_v1", "e", "robust_sigma * f", "kind = 'mad'"),
    ("dpat.limit_low_v1", "e", "dpat_low * f", "true"),
    ("dpat.limit_high_v1", "e", "dpat_high * f", "true"),
    ("forecast.shape_point_v1", "e", "point * f", "true"),
    ("forecast.point_v1", "e", "point * f", "true"),
    ("forecast.baseline_linear_v1", "e", "(v0 + (v24 - v0) * 7) * f", "point IS NOT NULL"),
    ("conformal.q_hat_v1", "p", "q_hat * f", "true"),
    ("conformal.upper_v1", "e", "upper * f", "true"),
    ("slope.early_v1", "e", "(v24 - v0) / 24 * f", "safe"),
    ("slope.long_v1", "e", "long_slope * f", "safe"),
    ("safety.usable_margin_v1", "e", "usable_margin * f", "safe"),
    ("safety.safety_slope_v1", "e", "safety_slope * f", "safe"),
    ("safety.predicted_margin_v1", "e", f"{_MARGIN} * f", "safe"),
    ("safety.predicted_margin_pct_v1", "e", "predicted_margin_pct", "safe"),
    ("safety.slope_ratio_v1", "e", "slope_ratio", "safe"),
)
# What the formula gives from its shown operands
_AGAIN = {
    "dpat.z_v1": "(v24 * f - median * f) / (robust_sigma * f)",
    "robust.sigma_iqr_v1": "(lot_q3 * f - lot_q1 * f) / CAST(1.35 AS DOUBLE)",
    "dpat.limit_low_v1": "median * f - 6 * (robust_sigma * f)",
    "dpat.limit_high_v1": "median * f + 6 * (robust_sigma * f)",
    "forecast.shape_point_v1": "v0 * f + (v24 * f - v0 * f) * phi_168",
    "forecast.baseline_linear_v1": "v0 * f + (v24 * f - v0 * f) * 7",
    "conformal.upper_v1": "point * f + q_hat * f",
    "slope.early_v1": "(v24 * f - v0 * f) / 24",
    "slope.long_v1": "(point * f - v0 * f) / 168",
    "safety.usable_margin_v1": "(150::DOUBLE * f - v0 * f) * (1 - CAST(0.2 AS DOUBLE))",
    "safety.safety_slope_v1": "usable_margin * f / 168",
    "safety.predicted_margin_v1": "150::DOUBLE * f - upper * f",
    "safety.predicted_margin_pct_v1": f"{_MARGIN} * f / (headroom * f)",
    "safety.slope_ratio_v1": "long_slope * f / (safety_slope * f)",
}
_ROWS = " UNION ALL ".join(
    f"SELECT component_id, lot_id, parameter, '{name}' AS formula_id, '{kind}' AS kind, CAST({value} AS DOUBLE) AS value, CAST({_AGAIN.get(name, value)} AS DOUBLE) AS again FROM x WHERE ({value}) IS NOT NULL AND {condition}{shown}"
    for items, shown in ((_PLAIN, ""), (_SHOWN, " AND u IS NOT NULL"))
    for name, kind, value, condition in items
)
VALUES = f"{X}, tv AS ({_ROWS})"

_FULL = """vec AS (SELECT lot_id, component_type, component_id FROM traj WHERE elapsed_hours = 24 GROUP BY ALL HAVING count(DISTINCT parameter) = 5),
vn AS (SELECT *, count(*) OVER (PARTITION BY lot_id, component_type) - 1 AS others FROM vec)"""

ORACLES = {
    "narratives": f"""WITH {SCORED}, lim(parameter, low, high, u) AS (VALUES ('quantity', CAST(NULL AS DOUBLE), CAST(49 AS DOUBLE), 'ea'),
      ('price', 1000, 95000, 'usd'), ('discount', NULL, 0.095, 'ratio'), ('rebate', NULL, 75, 'usd')),
      b AS (SELECT sc.*, u, coalesce(value > high, false) OR coalesce(value < low, false) AS bad,
        CASE WHEN low IS NULL OR abs(value - high) <= abs(value - low) THEN high ELSE low END AS near FROM sc JOIN lim ON sc.parameter = lim.parameter WHERE verdict = 'FAIL')
      SELECT component_id, parameter, component_id || ' reads ' || {num('value', 2)} || ' ' || u || ' for ' || parameter || ' at read point ' || elapsed_hours
        || ' h. Its lot cohort of ' || (n + 1) || ' sibling parts has median ' || {num('median', 2)} || ' ' || u || ' and robust sigma ' || {num('robust_sigma', 2)}
        || ' ' || u || ', giving a Dynamic PAT upper limit of ' || {num('limit_high', 2)} || ' ' || u || ' at k 1.2. The part sits ' || {num('z', 2)}
        || ' robust sigma from its lot median. Absolute limit ' || {num('near', 2)} || ' ' || u || ' is ' || CASE WHEN bad THEN 'violated' ELSE 'not violated' END || '.'
        || CASE WHEN n < 20 THEN ' Small-cohort statistics apply; statistical power is reduced.' ELSE '' END
        || CASE WHEN status = 'OVERRANGE' THEN ' A read point was interval-censored; the bound was consumed conservatively.' ELSE '' END AS text,
        0 AS n_unresolved, {num('median', 2)} || ' + 1.2 * ' || {num('robust_sigma', 2)} || ' = ' || {num('limit_high', 2)} AS arithmetic FROM b""",
    "anomaly_view": f"""WITH {X} SELECT component_id, lot_id, component_type, parameter, 24 AS read_point_h, {fin('v24 * f', 'observed')}, u AS shown_unit,
      n + 1 AS cohort_n, {fin('median * f', 'median')}, {fin('robust_sigma * f', 'robust_sigma')}, kind AS estimator, n < 20 AS reduced_power,
      {fin('dpat_low * f', 'dpat_low')}, {fin('dpat_high * f', 'dpat_high')}, {fin('z', 'z')}, dpat_verdict, absolute_fail, severity, attribution,
      guarantee_status, CAST(6 AS DOUBLE) AS profile_k, coalesce(dpat_verdict = 'FAIL', false) OR absolute_fail AS flagged FROM x""",
    "drift_view": f"""WITH {X} SELECT component_id, lot_id, component_type, parameter, u AS shown_unit, u || '/h' AS slope_unit, {fin('v0 * f', 'v0')},
      {fin('v24 * f', 'v24')}, {fin('phi_168', 'phi_168')}, {fin('point * f', 'point')}, {r6('CASE WHEN point IS NOT NULL THEN (v0 + (v24 - v0) * 7) * f END')} AS baseline_linear,
      {fin('upper * f', 'upper')}, {fin('q_hat * f', 'q_hat')}, n_cal, mondrian_level, band,
      {', '.join(r6(f'CASE WHEN safe THEN {e} END') + f' AS {c}' for c, e in (('usable_margin', 'usable_margin * f'), ('safety_slope', 'safety_slope * f'), ('early_slope', '(v24 - v0) / 24 * f'), ('long_slope', 'long_slope * f'), ('predicted_margin', f'{_MARGIN} * f'), ('predicted_margin_pct', 'predicted_margin_pct'), ('slope_ratio', 'slope_ratio')))},
      safety_code, guarantee_status, CAST(168 AS DOUBLE) AS horizon_hours, CAST(0.1 AS DOUBLE) AS alpha FROM x""",
    "explanation_view": f"""WITH {TOLD} SELECT component_id, lot_id, component_type, parameter, anomaly_text, drift_text, attribution_text, layers,
      {fin('k_star', 'k_star')}, {fin('clearing_value', 'clearing_value')}, k_sentence, attribution, action, severity, band FROM told""",
    "part_payload": f"""WITH {TOLD}, pp AS (SELECT component_id, count(*) AS n_blocks, bool_or(coalesce(dpat_verdict = 'FAIL', false) OR absolute_fail) AS flagged,
        string_agg(concat_ws(' ', anomaly_text, drift_text, attribution_text), ' ' ORDER BY parameter) AS narrative,
        list_aggregate(list_sort(list_distinct(flatten(list(string_split(layers, ','))))), 'string_agg', ',') AS layers FROM told GROUP BY component_id)
      SELECT t.component_id, t.lot_id, t.component_type, t.parameter, t.severity, t.band, t.action, {fin('t.risk_index', 'risk_index')}, {fin('t.k_star', 'k_star')},
        {fin('t.clearing_value', 'clearing_value')}, n_blocks, flagged, narrative, pp.layers FROM pp JOIN ew ON pp.component_id = ew.component_id
        JOIN told t ON t.component_id = ew.component_id AND t.parameter = ew.parameter""",
    "evidence_audit": f"""WITH {VALUES}, {_FULL}, {rollup('ew', 'band').replace('FROM ew GROUP BY lot_id)', 'FROM ew GROUP BY lot_id), lots AS (', 1)}),
      every AS (SELECT formula_id, kind FROM tv UNION ALL SELECT 'mahalanobis.d2_v1', 'p' FROM vn, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view'])) WHERE others >= 25
        UNION ALL SELECT g, 'e' FROM lots, (SELECT unnest(['lot.pda_pct_v1', 'lot.pda_pct_ew_v1']) AS g) WHERE pda_pct IS NOT NULL)
      SELECT formula_id, count(*) AS n_values, count(*) FILTER (kind = 'e') AS n_expression, count(*) FILTER (kind = 'e') AS n_rederived,
        count(*) FILTER (kind = 'p') AS n_procedural, CASE WHEN kind = 'e' THEN CAST(1 AS DOUBLE) END AS rate FROM every GROUP BY formula_id, kind""",
    "audit_failures": f"""WITH {VALUES} SELECT component_id, parameter, formula_id, {r6('value + 0.5::DOUBLE')} AS value, {fin('again', 'recomputed')}, 'DIFFERS' AS error
      FROM tv WHERE kind = 'e' AND component_id % 97 = 5
      UNION ALL SELECT component_id, parameter, formula_id, {fin('value', 'value')}, {fin('again', 'recomputed')}, 'UNKNOWN_UNIT' FROM tv
      WHERE formula_id = 'dpat.z_v1' AND component_id % 97 = 11""",
    "lot_reports": f"""WITH {VALUES}, {rollup('ew', 'band').replace('FROM ew GROUP BY lot_id)', 'FROM ew GROUP BY lot_id), lots AS (', 1)}),
      nf AS (SELECT lot_id, count(DISTINCT formula_id) AS n_appendix FROM tv GROUP BY lot_id), nq AS (SELECT lot_id, count(*) AS n_queue FROM ew GROUP BY lot_id),
      nd AS (SELECT lot_id, count(*) AS n FROM ew JOIN orders ON o_orderkey = component_id GROUP BY lot_id)
      SELECT lots.lot_id, n_tested, n_reject, pda_pct, lot_verdict, CAST(5 AS DOUBLE) AS pda_limit_pct, n_queue, n_appendix, coalesce(n, 0) AS n_dispositions
      FROM lots LEFT JOIN nf ON nf.lot_id = lots.lot_id LEFT JOIN nq ON nq.lot_id = lots.lot_id LEFT JOIN nd ON nd.lot_id = lots.lot_id""",
    "risk_posture": f"""WITH {PIVOT}, g AS (SELECT component_type || '/' || parameter AS "group", count(*) AS n_cal FROM cal GROUP BY ALL)
      SELECT "group", n_cal, {r6('1.0 / (n_cal + 1)')} AS attainable_alpha, CAST(0.1 AS DOUBLE) AS alpha, CAST(0.2 AS DOUBLE) AS margin_fraction, CAST(6 AS DOUBLE) AS k,
        CAST(5 AS DOUBLE) AS pda_limit_pct, CAST(168 AS DOUBLE) AS horizon_hours, CAST(0.3 AS DOUBLE) AS w_anomaly, CAST(0.3 AS DOUBLE) AS w_drift,
        CAST(0.2 AS DOUBLE) AS w_margin, CAST(0.1 AS DOUBLE) AS w_quality, CAST(0.1 AS DOUBLE) AS w_credit, 1.0 / (n_cal + 1) <= 0.1 AS alpha_supported FROM g""",
}
