"""Oracles for the streaming queries: the same results from the whole tables at once."""

from oracles.ingest import UPLOAD
from oracles.series import ORACLES as SERIES_ORACLES

# Slices by date with some rows a slice behind, and the watermark before each slice.
_INGEST = UPLOAD.replace(
    "claimed AS (",
    """sliced AS (SELECT *, epoch(strptime(read_timestamp, '%Y-%m-%dT%H:%M:%S')) / 3600.0 AS h,
     least(3, (CAST(substr(read_timestamp, 1, 4) AS INT) - 1995) // 2) + CASE WHEN source_row % 97 = 5 THEN 1 ELSE 0 END AS slice FROM early),
marks AS (SELECT slice, (SELECT max(h) FROM sliced x WHERE x.slice < b.slice) - 48 AS mark FROM (SELECT DISTINCT slice FROM sliced) b),
arrived AS (SELECT sliced.* REPLACE (CASE WHEN c1 IS NULL AND h < mark THEN 'LATE_ARRIVAL' ELSE c1 END AS c1) FROM sliced JOIN marks USING (slice)),
claimed AS (""",
).replace("ORDER BY source_row) AS nth FROM early", "ORDER BY slice, source_row) AS nth FROM arrived")

_CUSUM = (
    SERIES_ORACLES["cusum"]
    .replace(
        "z AS (SELECT *, (value - median) / robust_sigma AS z FROM s)",
        """cut AS (SELECT *, (day(read_timestamp) - 1) // 8 + CASE WHEN seq % 50 = 7 THEN 1 ELSE 0 END AS slice FROM s),
      marks AS (SELECT slice, (SELECT max(t) FROM cut x WHERE x.slice < b.slice) - 6 AS mark FROM (SELECT DISTINCT slice FROM cut) b),
      arrived AS (SELECT cut.*, coalesce(t < mark, false) AS late FROM cut JOIN marks USING (slice)),
      lt AS (SELECT component_id, parameter, count(*) FILTER (late) AS n_late FROM arrived GROUP BY ALL),
      z AS (SELECT *, (value - median) / robust_sigma AS z FROM arrived WHERE NOT late)""",
    )
    .replace("AS refusal_code FROM f", "AS refusal_code, n_late FROM (SELECT lt.*, sh, sl, fh, fl, coalesce(n, 0) AS n FROM lt LEFT JOIN f USING (component_id, parameter)) f")
)

ORACLES = {
    "stream_ingest": f"""WITH {_INGEST} SELECT coalesce(finding_code, 'ACCEPTED') AS outcome, CASE WHEN finding_code IS NULL THEN 'accepted' ELSE 'quarantine' END AS side,
        count(*) AS n_rows, count(*) FILTER (censored) AS n_censored, CAST(sum(source_row) AS BIGINT) AS row_sum FROM v GROUP BY ALL""",
    "stream_cusum": _CUSUM,
    "stream_quality": """SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS n_total, 0 AS n_missing, 0 AS n_nonfinite,
      count(*) FILTER (value < 0.05 OR value > 400) AS n_impossible FROM events GROUP BY ALL""",
}
