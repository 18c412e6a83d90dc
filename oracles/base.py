"""SQL building blocks shared by the DuckDB oracles."""

from __future__ import annotations


def r6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5) / 1e6)"


def fin(expr: str, name: str) -> str:
    return f"{r6(expr)} AS {name}"


_CID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"


def _item(parameter: str, column: str) -> str:
    return f"""SELECT {_CID} AS component_id, l_suppkey AS lot_id, 'ITEM' AS component_type,
      '{parameter}' AS parameter, {column} AS value, 24 AS elapsed_hours,
      CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 THEN 'OVERRANGE' ELSE 'OK' END AS status,
      l_partkey % 50 AS socket_id, l_linestatus AS thermal_zone, l_returnflag AS tester_id,
      l_shipdate AS read_timestamp FROM lineitem"""


COHORT = "cohort AS (" + " UNION ALL ".join(
    _item(p, c)
    for p, c in (
        ("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("rebate", "l_extendedprice * l_discount * l_tax / 7.0")
    )
) + ")"

LIMITS = """limits(parameter, low, high) AS (VALUES ('quantity', CAST(NULL AS DOUBLE), CAST(49 AS DOUBLE)),
  ('price', 1000.0, 95000.0), ('discount', NULL, 0.095), ('rebate', NULL, 75))"""

CN = """cn(n, c_n) AS (VALUES (1, CAST(1.0 AS DOUBLE)), (2, 1.1955), (3, 1.4872), (4, 1.3606), (5, 1.2168), (6, 1.1896),
  (7, 1.1379), (8, 1.1274), (9, 1.1012), (10, 1.0957), (11, 1.0799), (12, 1.0766), (13, 1.0661), (14, 1.0638),
  (15, 1.0563), (16, 1.0547), (17, 1.0491), (18, 1.0479), (19, 1.0435))"""

SMALL = """small AS (SELECT concat_ws('/', p_brand, p_size) AS lot_id, p_partkey AS component_id,
  p_retailprice AS value FROM part)"""

SERIES = """series AS (SELECT user_id AS component_id, event_type AS parameter, epoch_us(ts) / 3.6e9 AS t,
  event_id AS seq, value, ts AS read_timestamp FROM events)"""

TRAJ = """traj AS (SELECT user_id + place // 3 * 1000000000 AS component_id, user_id % 10 AS lot_id,
    CAST(user_id % 3 AS VARCHAR) AS component_type, event_type AS parameter,
    CASE place % 3 WHEN 0 THEN 0 WHEN 1 THEN 24 ELSE 168 END AS elapsed_hours,
    value, 'OK' AS status, CAST(120 + user_id % 5 AS DOUBLE) AS temperature_c,
    CASE WHEN user_id % 10 >= 8 AND user_id % 3 = 0 THEN 'new' ELSE CAST(user_id % 4 AS VARCHAR) END AS tester_id,
    CAST(user_id % 7 AS VARCHAR) AS socket_id,
    CAST(user_id % 2 AS VARCHAR) AS thermal_zone, ts AS read_timestamp, event_id AS source_row,
    CASE WHEN user_id % 10 < 6 THEN 'train' WHEN user_id % 10 < 8 THEN 'calib' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS place FROM events))"""


def loo(name: str, source: str, keys: list[str], value: str = "value", prefix: str = "") -> str:
    """CTEs ``{name}_s`` and ``{name}``: leave-one-out statistics of every row of ``source`` by rank shift.

    Members are the OK rows; others are compared with the whole group. MAD is exact for small cohorts only.
    """
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)

    def pick(pos: str) -> str:
        """Value at 0-based position pos of the cohort, own copy removed."""
        return (
            f"CASE WHEN a.status = 'OK' AND ({pos}) >= list_position(b.vals, a.{value}) - 1"
            f" THEN b.vals[CAST({pos} AS BIGINT) + 2] ELSE b.vals[CAST({pos} AS BIGINT) + 1] END"
        )

    def quant(p: str) -> str:
        pos = f"floor((m - 1) * {p})"
        lo, hi = pick(pos), pick(f"least(m - 1, {pos} + 1)")
        return f"({lo}) + (({hi}) - ({lo})) * ((m - 1) * {p} - {pos})"

    return f"""
{name}_g AS (SELECT {k}, list_sort(list({value})) AS vals FROM {source} WHERE status = 'OK' GROUP BY {k}),
{name}_m AS (SELECT a.*, b.vals, CASE WHEN b.vals IS NULL THEN 0 WHEN a.status = 'OK' THEN len(b.vals) - 1
   ELSE len(b.vals) END AS m FROM {source} a LEFT JOIN {name}_g b ON {on}),
{name}_q AS (SELECT a.*, CASE WHEN m >= 1 THEN {quant('0.25').replace('b.vals', 'a.vals')} END AS {prefix}q1,
   CASE WHEN m >= 1 THEN {quant('0.5').replace('b.vals', 'a.vals')} END AS {prefix}median,
   CASE WHEN m >= 1 THEN {quant('0.75').replace('b.vals', 'a.vals')} END AS {prefix}q3 FROM {name}_m a),
{name}_d AS (SELECT a.*, CASE WHEN m >= 1 AND m < 20 THEN list_sort(list_transform(
   CASE WHEN a.status = 'OK' THEN list_concat(vals[1:list_position(vals, {value}) - 1],
        vals[list_position(vals, {value}) + 1:len(vals)]) ELSE vals END,
   lambda v: abs(v - {prefix}median))) END AS devs FROM {name}_q a),
{name} AS (SELECT a.* EXCLUDE (vals, devs, m), m AS {prefix}n, {prefix}q3 - {prefix}q1 AS {prefix}iqr,
   (devs[CAST(floor((m - 1) / 2.0) AS BIGINT) + 1] + devs[CAST(ceil((m - 1) / 2.0) AS BIGINT) + 1]) / 2.0 AS {prefix}mad,
   CASE WHEN m < 3 THEN 'INSUFFICIENT_COHORT' WHEN {prefix}q3 = {prefix}q1 THEN 'NO_VARIATION' END AS {prefix}refusal_code,
   CASE WHEN m < 3 OR {prefix}q3 = {prefix}q1 THEN 0.0
     WHEN m < 20 AND (devs[CAST(floor((m - 1) / 2.0) AS BIGINT) + 1] + devs[CAST(ceil((m - 1) / 2.0) AS BIGINT) + 1]) > 0
       THEN 1.4826 * cn.c_n * (devs[CAST(floor((m - 1) / 2.0) AS BIGINT) + 1] + devs[CAST(ceil((m - 1) / 2.0) AS BIGINT) + 1]) / 2.0
     ELSE ({prefix}q3 - {prefix}q1) / 1.35 END AS {prefix}robust_sigma
   FROM {name}_d a LEFT JOIN cn ON cn.n = m)"""
