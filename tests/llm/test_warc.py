import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.llm import warc as W

SCHEMA = "record_id long, record_type string, target_uri string, record_date timestamp, status int, headers map<string,string>, body string, uri string, response string"
T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("hot", [5, 10**6])
def test_against_brute_force(spark, hot):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        url = None if rng.random() < 0.03 else rng.choice(["http://hot.org/a", "HTTPS://www.Hot.org:443/a/#x", f"http://b.org/{rng.randrange(9)}"])
        at = None if rng.random() < 0.03 else T0 + timedelta(hours=rng.randrange(60))
        tag, day = rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "mon", "tue"])
        headers = {k: v for k, v in (("ETag", tag), ("last-modified", day), ("X", str(i)), ("Content-Length", "7")) if v} if rng.random() < 0.95 else None
        full = rng.random() < 0.4
        rows.append((i, "response" if full else "revisit", url, at, rng.choice([200, 200, 404]) if full else 304, headers, rng.choice(["b%d" % i, "", None]) if full else None, "u", "r"))
    rows += [rows[0], rows[1]]
    found = W.resolve(spark.createDataFrame(rows, SCHEMA), hot)
    got = {r.record_id: r for r in found.withColumn("names", F.map_keys("headers")).collect()}
    key = lambda u: None if u is None else "hot.org/a" if "ot.org" in u else u[7:]
    revisits = {r[0]: r for r in rows if r[1] == "revisit"}
    assert got.keys() == revisits.keys()
    kinds = set()
    for i, r in revisits.items():
        earlier = [x for x in rows if x[1] == "response" and x[4] == 200 and x[6] is not None and key(x[2]) == key(r[2]) and None not in (r[2], r[3], x[3]) and x[3] < r[3]]
        want = max(earlier, key=lambda x: (x[3], x[0]), default=None)
        assert got[i].response_id == (want[0] if want else None), i
        low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
        if want is None:
            state = "no_response"
        else:
            a, b = low(r[5]), low(want[5])
            if "etag" in a and "etag" in b:
                state = "resolved" if a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/") else "etag_differs"
            elif "last-modified" in a and "last-modified" in b:
                state = "resolved" if a["last-modified"] == b["last-modified"] else "last_modified_differs"
            else:
                state = "unchecked"
        kinds.add(state)
        assert got[i].resolution == state, i
        if state in ("resolved", "unchecked"):
            merged = b | {k: v for k, v in a.items() if k not in W.NOT_PERMITTED}
            assert got[i].headers == merged and got[i].names == sorted(merged) and got[i].body == want[6]
        else:
            assert got[i].headers is None and got[i].body is None
    assert len(kinds) == 5


def test_canonical_urls(spark):
    cases = {
        "http://WWW2.Example.com:80/A/b/?utm_source=x&b=2&a=1#t": "example.com/A/b?a=1&b=2", "https://x.org": "x.org", "x.org/": "x.org",
        "http://x.org:8080/?": "x.org:8080", "": "", "http://x.org/p?utm_a=1": "x.org/p",
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string").select("u", W.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases | {None: None}


def test_empty_and_repeated_header_names(spark):
    assert W.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.range(1).select(W.merged_headers(F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit("2")), F.create_map(F.lit("Content-Type"), F.lit("x"), F.lit("B"), F.lit("3"))).alias("h"))
    assert df.first().h == {"a": "2", "b": "3"}


def test_records_without_an_id(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [
        (1, "response", "http://a.org/", at(1), 200, {"ETag": '"1"'}, "one", None, None), (None, "response", "http://a.org/", at(3), 200, {"ETag": '"2"'}, "two", None, None),
        (None, "revisit", "http://a.org/", at(2), 304, {"ETag": '"1"'}, None, None, None), (None, "revisit", "http://a.org/", at(2), 304, {"ETag": '"9"'}, None, None, None),
        (None, "revisit", "http://a.org/", at(4), 304, {"ETag": '"2"'}, None, None, None), (None, "revisit", "http://a.org/", at(4), 304, {"ETag": '"2"'}, None, None, None),
        (None, "revisit", None, at(4), 304, {}, None, None, None), (7, "revisit", "http://a.org/", at(5), 304, {"ETag": '"2"'}, None, None, None),
    ]
    got = sorted((str(r.record_id), str(r.response_id), r.resolution, str(r.body)) for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(
        [
            ("None", "1", "resolved", "one"), ("None", "1", "etag_differs", "None"), ("None", "None", "resolved", "two"), ("None", "None", "resolved", "two"),
            ("None", "None", "no_response", "None"), ("7", "None", "resolved", "two"),
        ]
    )
