import pytest
from pyspark.sql import functions as F

from lotwise.llm import cascade as C


@pytest.mark.parametrize("listed", [0, 1, 37, 2000, 5000])
def test_exact_over_the_universe(spark, listed):
    keys = spark.range(5000).select(F.concat(F.lit("host"), "id").alias("key"))
    on = keys.where(F.regexp_extract("key", "([0-9]+)", 1).cast("int") * 7919 % 5000 < listed)
    levels = C.build(keys.unionByName(keys.limit(10)), on.unionByName(on))
    asked = C.member(keys, "key", levels, "hit").join(on.withColumn("on", F.lit(True)), "key", "left")
    assert asked.where("hit <> coalesce(on, false)").count() == 0
    assert len(levels) > 2 or listed in (0, 1, 5000)


def test_null_keys_and_keys_outside(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    levels = C.build(keys, spark.createDataFrame([("b",), (None,), ("z",)], "k string"))
    assert {(r.key, r.hit) for r in C.member(keys, "key", levels, "hit").collect()} == {("a", False), ("b", True), (None, False)}


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Spam-Farm.COM/x?y#z", "http://a.b.org/es/1", "http://example.org/es/2", "http://www.example.org/es",
        "http://example.org/en/12?q", "http://x.com/de/1", "https://com/fr/", "http://xcom/de/", "http://notexample.org/es/", "ftp://k\u00d6LN.de/a://b",
        "http://host?x/y", "http://example.org/es/2",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, url_verdict string")
    got = {r.page_id: tuple(r.url_verdict) for r in C.judge_urls(pages).collect()}
    want = {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("www.spam-farm.com", "/x", None, "block"), 5: ("a.b.org", "/es/1", "org/", "allow"), 6: ("example.org", "/es/2", "example.org/es/", "block"),
        7: ("www.example.org", "/es", "org/", "allow"), 8: ("example.org", "/en/12", "example.org/en/1", "block"), 9: ("x.com", "/de/1", "com/de/", "block"),
        10: ("com", "/fr/", "com/fr/", "allow"), 11: ("xcom", "/de/", None, "allow"), 12: ("notexample.org", "/es/", "org/", "allow"),
        13: ("k\u00d6ln.de", "/a://b", None, "allow"), 14: ("host", "", None, "allow"), 15: ("example.org", "/es/2", "example.org/es/", "block"),
    }
    assert got == want
    assert C.judge_urls(pages.where("false")).count() == 0
