"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lotwise.llm import importance
from lotwise.llm.cascade import LISTED_PARTS, RULES
from lotwise.llm.mixing import BLOCK_TOKENS, REPETITION_LIMIT, SEED, STEPS, TARGET_ENTROPY
from lotwise.llm.secret_scan import RULES as SECRET_RULES

WORD = r"[^\x20\x09-\x0D]+"


def _secret_sql() -> str:
    ctes, kinds = [], []
    for n, r in enumerate(SECRET_RULES):
        quoted = r.pattern.replace("'", "''")
        ctes.append(f"""
        m{n} AS (
            SELECT row, t, list_zip(regexp_extract_all(t, '{quoted}', 0), regexp_extract_all(t, '{quoted}', {r.group})) AS ms
            FROM docs WHERE regexp_matches(t, '{quoted}')
        ),
        w{n}(row, t, ms, i, pos, s, e, v) AS (
            SELECT row, t, ms, 0, 0, 0, 0, -1 FROM m{n}
            UNION ALL
            SELECT row, t, ms, i + 1,
                   pos + instr(substr(t, pos + 1), ms[i + 1][1]) - 1 + length(ms[i + 1][1]),
                   pos + instr(substr(t, pos + 1), ms[i + 1][1]) - 1,
                   pos + instr(substr(t, pos + 1), ms[i + 1][1]) - 1 + length(ms[i + 1][1]),
                   length(ms[i + 1][2])
            FROM w{n} WHERE i < len(ms)
        )""")
        kinds.append(f"SELECT row, {n} AS number, '{r.kind}' AS kind, s, e FROM w{n} WHERE v >= {r.least}")
    one = "kind || ':' || s || ':' || e"
    return f"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    {','.join(ctes)},
    spans AS ({' UNION ALL '.join(kinds)})
    SELECT any_value(doc_id) AS doc_id,
           count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
           sha256(coalesce(string_agg({one}, ',' ORDER BY s, number) FILTER (number < 3), '')) AS base_sha256,
           coalesce(string_agg({one}, ',' ORDER BY s, number) FILTER (number >= 0), '') AS spans
    FROM docs LEFT JOIN spans USING (row) GROUP BY row
    """


def _url_sql() -> str:
    fits = [
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"{w} '{h}{p}'" for w, (h, p, _) in zip(fits, ordered))
    says = " ".join(f"{w} '{v}'" for w, (_, _, v) in zip(fits, ordered))
    parts = ", ".join(f"'{p}'" for p in LISTED_PARTS)
    return f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parsed AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    )
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {says} WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{parts}]) THEN 'block' ELSE 'allow' END AS verdict
    FROM parsed
    """


def _mix_sql() -> str:
    place = f"md5('{SEED}:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    entropy = "(SELECT ln(sum(exp(l * {t}))) - sum(exp(l * {t}) * l * {t}) / sum(exp(l * {t})) FROM logs)"
    return f"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents
    ), totals AS (
        SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY source
    ), logs AS (
        SELECT ln(tokens / (SELECT sum(tokens) FROM totals)) AS l FROM totals WHERE tokens > 0
    ), steps(i, lo, hi) AS (
        SELECT 0, 0::DOUBLE, 1::DOUBLE
        UNION ALL
        SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
            SELECT i, lo, hi, (lo + hi) / 2 AS mid,
                   list_reduce(list_transform(ls, lambda x: exp(x * ((lo + hi) / 2))), lambda a, b: a + b) AS z,
                   list_reduce(list_transform(ls, lambda x: exp(x * ((lo + hi) / 2)) * x * ((lo + hi) / 2)), lambda a, b: a + b) AS zw,
                   ln(z) - zw / z >= {TARGET_ENTROPY} * ln(len(ls)) AS good
            FROM steps, (SELECT list(l ORDER BY l) AS ls FROM logs) WHERE i < {STEPS}
        )
    ), by_entropy AS (
        SELECT CASE WHEN {entropy.format(t='1')} >= {TARGET_ENTROPY} * ln((SELECT count(*) FROM logs)) THEN 1 ELSE max(lo) END AS t FROM steps
    ), exponent AS (
        SELECT round(greatest(t, coalesce(1 - ln({REPETITION_LIMIT}) / nullif((SELECT max(l) - min(l) FROM logs), 0), 0), 0), 9) AS t FROM by_entropy
    ), powers AS (
        SELECT source, tokens, CASE WHEN tokens > 0 THEN exp(ln(tokens / (SELECT sum(tokens) FROM totals)) * t) ELSE 0 END AS power
        FROM totals, exponent
    ), quotas AS (
        SELECT source, tokens, CASE WHEN tokens > 0 THEN round(power * (SELECT max(tokens / power) FROM powers WHERE tokens > 0) / tokens, 6) ELSE 1 END AS epochs
        FROM powers
    ), plan AS (
        SELECT source, tokens, CAST(floor(epochs) AS INT) AS full_, CAST(floor(tokens * (epochs - floor(epochs))) AS BIGINT) AS rest,
               tokens * CAST(floor(epochs) AS INT) + CAST(floor(tokens * (epochs - floor(epochs))) AS BIGINT) AS quota FROM quotas
    ), every AS (
        SELECT s.*, p.tokens, p.rest, p.full_, p.quota, e, {place} AS place
        FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.full_ + 1)) AS e)
    ), summed AS (
        SELECT *, sum(n_tokens) OVER (PARTITION BY source, e ORDER BY place) AS upto,
               coalesce(sum(n_tokens) OVER (PARTITION BY source, e ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM every
    ), taken AS (
        SELECT *, (SELECT greatest(1, CAST(ceil(sum(quota) / {BLOCK_TOKENS}) AS BIGINT)) FROM plan) AS n_blocks
        FROM summed WHERE e < full_ OR rest > 0 AND upto <= rest
    ), blocked AS (
        SELECT *, CASE WHEN quota > 0 THEN least(CAST(floor((CAST(e AS BIGINT) * tokens + before) * n_blocks / quota) AS BIGINT), n_blocks - 1) ELSE 0 END AS block
        FROM taken
    )
    SELECT doc_id, source, n_tokens, e AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY place, doc_id, e) AS position FROM blocked
    """


def _warc_sql() -> str:
    kinds = (
        "SELECT page_id * 8 + 1 AS record_id, 1 AS days, 'tag' AS ask, * FROM p",
        "SELECT page_id * 8 + 2, 2, 'date', * FROM p WHERE page_id % 2 = 0",
        "SELECT page_id * 8 + 3, 3, 'other', * FROM p WHERE page_id % 5 = 0",
        "SELECT page_id * 8 + 4, -200, 'tag', * FROM p WHERE page_id % 7 = 0",
    )
    return f"""
    WITH u AS (
        SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
               '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 97) AS modified FROM pages
    ), q AS (
        SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS kept FROM u
    ), p AS (
        SELECT page_id, html, tag, modified,
               regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\\.', '')
               || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS uri FROM q
    ), revisits AS ({' UNION ALL '.join(kinds)}
    ), matched AS (
        SELECT r.*, b.page_id AS rp, b.html AS body, b.tag AS btag, b.modified AS bmod,
               row_number() OVER (PARTITION BY r.record_id ORDER BY b.page_id DESC) AS k
        FROM revisits r LEFT JOIN p b ON r.uri = b.uri AND b.html IS NOT NULL AND b.page_id * 60 < r.page_id * 60 + 86400 * r.days
    ), judged AS (
        SELECT *, CASE WHEN rp IS NULL THEN 'no_response' WHEN ask = 'date' THEN CASE WHEN modified = bmod THEN 'resolved' ELSE 'last_modified_differs' END
                       WHEN (CASE ask WHEN 'tag' THEN tag ELSE '"0"' END) = btag THEN 'resolved' ELSE 'etag_differs' END AS resolution
        FROM matched WHERE k = 1
    )
    SELECT record_id, uri, rp * 8 AS response_id, resolution,
           CASE WHEN resolution = 'resolved' THEN CASE ask
             WHEN 'tag' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || tag || chr(10) || 'last-modified: ' || bmod
             ELSE 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: day two' || chr(10) || 'etag: ' || btag || chr(10) || 'last-modified: ' || modified END
           END AS headers,
           CASE WHEN resolution = 'resolved' THEN length(body) END AS n_chars, CASE WHEN resolution = 'resolved' THEN sha256(body) END AS body_sha256
    FROM judged
    """


def _importance_sql() -> str:
    grams = " UNION ALL ".join(
        f"SELECT kind, row, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM texts, unnest(range(1, CAST(len(w) AS BIGINT) - {n} + 2)) AS t(i)"
        for n in range(1, importance.LONGEST + 1)
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    one, size, percent = "'0123456789ABCDEF'", importance.BUCKETS, importance.PERCENT
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    texts AS (
        SELECT kind, row, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM (SELECT 'd' AS kind, row, text FROM docs UNION ALL SELECT 'b', 0, text FROM benchmark)
    ), grams AS ({grams}),
    steps AS (
        SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
        FROM range(256) AS r(n)
    ), each AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
    buckets AS (
        SELECT g, xor(list_reduce(
            list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: 16 * instr({one}, h[i]) + instr({one}, h[i + 1]) - 17)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {size} AS bucket
        FROM each, steps
    ), counts AS (
        SELECT n AS bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t
        FROM range({size}) AS r(n) LEFT JOIN (SELECT kind, bucket FROM grams JOIN buckets USING (g)) ON bucket = n GROUP BY n
    ), gains AS (
        SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + {size})) / ((s + 1)::DOUBLE * (all_t + {size})))) AS BIGINT) AS gain
        FROM counts, (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts)
    ), sums AS (
        SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM grams JOIN buckets USING (g) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row
    ), scored AS (
        SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM docs d JOIN texts x ON x.kind = 'd' AND x.row = d.row LEFT JOIN sums z ON z.row = d.row
    ), placed AS (
        SELECT *, n_words >= {importance.LEAST_WORDS} AS fit, row_number() OVER (ORDER BY n_words < {importance.LEAST_WORDS}, score DESC, doc_id) AS place FROM scored
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN fit AND place <= (SELECT count(*) FROM placed WHERE fit) * {percent} // 100 THEN place END AS rank
    FROM placed
    """


ORACLES = {
    "op1_warc_revisits": _warc_sql(),
    "op4_secret_trigrams": _secret_sql(),
    "op5_url_cascade": _url_sql(),
    "op9_temperature_mix": _mix_sql(),
    "op12_crc_importance": _importance_sql(),
}
