"""Oracles for traced values and member positions."""

from oracles.base import CN, COHORT, loo, r6
from oracles.series import _medcouple

SCORED = f"""{COHORT}, {CN}, {loo('l', 'cohort', ['lot_id', 'parameter'])},
sc AS (SELECT *, (value - median) / robust_sigma AS z, median - 1.2 * robust_sigma AS limit_low, median + 1.2 * robust_sigma AS limit_high,
  CASE WHEN value >= median - 1.2 * robust_sigma AND value <= median + 1.2 * robust_sigma THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN n < 20 AND mad > 0 THEN 'mad' ELSE 'iqr' END AS estimator FROM l WHERE refusal_code IS NULL)"""

_USED = """u AS (SELECT f.formula_id, f.kind, count(*) AS n FROM sc, (VALUES ('robust.median_v1', 'procedural'), ('robust.iqr_v1', 'expression'),
  ('robust.sigma_iqr_v1', 'expression'), ('dpat.limit_low_v1', 'expression'), ('dpat.limit_high_v1', 'expression'), ('dpat.z_v1', 'expression')) f(formula_id, kind)
  WHERE f.formula_id <> 'robust.sigma_iqr_v1' OR estimator = 'iqr' GROUP BY ALL)"""

_FENCE = f"{_medcouple('cohort', 'lot_id, parameter', chr(39).join(['status = ', 'OK', '']))}".replace("WHERE status = 'OK')", "WHERE a.status = 'OK')")

ORACLES = {
    "rederivation_rate": f"""WITH {SCORED}, {_USED} SELECT formula_id, n AS n_values, CASE WHEN kind = 'expression' THEN n ELSE 0 END AS n_expression,
      CASE WHEN kind = 'expression' THEN n ELSE 0 END AS n_rederived, CASE WHEN kind = 'procedural' THEN n ELSE 0 END AS n_procedural,
      CASE WHEN kind = 'expression' THEN 1.0 END::DOUBLE AS rate FROM u""",
    "trace_errors": f"WITH {SCORED}, {_USED} SELECT formula_id, 'NONE' AS error, n AS n_values FROM u",
    "formula_appendix": f"""WITH {SCORED}, {_USED} SELECT u.formula_id, expression, unit_rule, derivation FROM u JOIN (VALUES
      ('robust.median_v1', 'type7_median(leave_one_out_cohort_values)', 'explicit', 'procedural'), ('robust.iqr_v1', 'q3 - q1', 'same_as:q3', 'expression'),
      ('robust.sigma_iqr_v1', 'iqr / divisor', 'same_as:iqr', 'expression'), ('dpat.limit_low_v1', 'median - k * robust_sigma', 'same_as:median', 'expression'),
      ('dpat.limit_high_v1', 'median + k * robust_sigma', 'same_as:median', 'expression'), ('dpat.z_v1', '(x - median) / robust_sigma', 'sigma', 'expression'))
      r(formula_id, expression, unit_rule, derivation) ON u.formula_id = r.formula_id""",
    "member_positions": f"""WITH {SCORED}, {_FENCE},
      p AS (SELECT s.*, CASE WHEN value < q1 - 3 * iqr OR value > q3 + 3 * iqr THEN 'EXTREME' WHEN value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr THEN 'MILD' ELSE 'INSIDE' END AS tukey,
        value < q1 - 1.5 * exp(CASE WHEN medcouple >= 0 THEN -4 ELSE -3 END * medcouple) * iqr
          OR value > q3 + 1.5 * exp(CASE WHEN medcouple >= 0 THEN 3 ELSE 4 END * medcouple) * iqr AS outside_boxplot
        FROM sc s JOIN mc ON s.lot_id = mc.lot_id AND s.parameter = mc.parameter)
      SELECT component_id, lot_id, parameter, tukey, outside_boxplot, verdict, CAST(verdict = 'FAIL' AS INT) + CAST(tukey <> 'INSIDE' AS INT)
        + CAST(outside_boxplot AS INT) AS members_fired FROM p""",
    "severity_counts": f"""WITH {SCORED}, every AS (SELECT parameter, CASE WHEN refusal_code IS NULL THEN (value - median) / robust_sigma END AS z FROM l)
      SELECT parameter, CASE WHEN abs(z) >= 6 THEN 'SEVERE' WHEN abs(z) >= 4.5 THEN 'ANOMALOUS' WHEN abs(z) >= 3 THEN 'ELEVATED'
      ELSE 'NOMINAL' END AS severity, count(*) AS n_readings FROM every GROUP BY ALL""",
    "counterfactuals": f"""WITH {SCORED} SELECT component_id, parameter, {r6('abs(z)')} AS k_star,
      {r6('CASE WHEN value >= median THEN limit_high ELSE limit_low END')} AS clearing_value FROM sc WHERE verdict = 'FAIL'""",
}
