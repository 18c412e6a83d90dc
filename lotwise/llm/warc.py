"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same canonical URL.

The as-of join is one union of responses and revisits, ordered by time within a URL, that carries the last response
forward; bodies take no part in it. A URL with more records than ``hot`` is cut into time slices by a mergeable quantile
sketch, and the last response of each slice is carried to the next by a small table, so no task gets a whole hot URL.
Only then the body and headers of the chosen response are fetched by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, stage

HOT = 200_000
# Header fields of a 304 answer that must not replace stored ones
NOT_PERMITTED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, ``utm_`` parameters and closing slash dropped; host lower case, parameters sorted.

    A null URL stays null; one without ``://`` is taken as host and path.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """Entries with lower-case names, sorted, the last value of a repeated name."""
    entries = F.array_sort(
        F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    )
    following = lambda e, i: F.get(entries, i + 1)["key"] == e["key"]
    return F.filter(entries, lambda e, i: ~F.coalesce(following(e, i), F.lit(False)))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields with the permitted ones of the 304 answer put in their place, as a map sorted by name."""
    new = F.filter(_lower_keys(fresh), lambda e: ~e["key"].isin(*NOT_PERMITTED))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter(_lower_keys(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(old, new)))


def _slices(slim: DataFrame, hot: int) -> DataFrame:
    """Adds ``slice``: 0 for most, the time slice for URLs with more than ``hot`` records."""
    sizes = slim.groupBy("uri").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    sizes = stage(sizes)
    largest = sizes.agg(F.max("n")).first()[0]
    if largest is None:
        return slim.withColumn("slice", F.lit(0))
    parts = -(-2 * largest // hot)
    marks = [i / parts for i in range(1, parts)]
    cuts = slim.join(broadcast_if_small(sizes.select("uri")), "uri", "left_semi").groupBy("uri")
    cuts = cuts.agg(F.percentile_approx(F.unix_micros("at"), marks, 10_000).alias("cuts"))
    slim = slim.join(broadcast_if_small(stage(cuts), 10_000), "uri", "left")
    return slim.withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.unix_micros("at"))), F.lit(0))).drop("cuts")


def as_of(records: DataFrame, hot: int = HOT) -> DataFrame:
    """(revisit, response) ids: for each revisit the latest response of its URL with an earlier time, else null.

    ``records``: id, uri, at, full (boolean). Of responses with one time the larger id counts as later. Records without
    a URL or time match nothing.
    """
    slim = _slices(stage(records.select("id", "uri", "at", "full")), hot)
    usable = slim.where("uri IS NOT NULL AND at IS NOT NULL")
    pointer = F.when(F.col("full"), F.struct("at", "id"))
    ends = usable.groupBy("uri", "slice").agg(F.max(pointer).alias("last"))
    before = Window.partitionBy("uri").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("uri", "slice", F.max("last").over(before).alias("carried"))
    earlier = Window.partitionBy("uri", "slice").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -1)
    own = usable.withColumn("own", F.max(pointer).over(earlier)).where("NOT full")
    joined = own.join(carried, ["uri", "slice"], "left")
    found = joined.select(F.col("id").alias("revisit"), F.coalesce("own", "carried")["id"].alias("response"))
    lost = slim.where("NOT full AND (uri IS NULL OR at IS NULL)").select(F.col("id").alias("revisit"), F.lit(None).cast(records.schema["id"].dataType).alias("response"))
    return found.unionByName(lost)


def resolve(records: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per revisit: record_id, uri, response_id, resolution, headers and body (both null unless resolved).

    ``records``: record_id (distinct), record_type ('response' or 'revisit'), target_uri, record_date, status, headers
    (map), body; other columns are ignored. Full responses have status 200 and a body. Entity tags are compared weakly;
    where either side has none, Last-Modified is compared. Resolutions: ``resolved``, ``unchecked`` (nothing to compare;
    resolved too), ``etag_differs``, ``last_modified_differs``, ``no_response``. A repeated record_id is taken as one
    record; revisits without a record_id keep a row each, and a response without one resolves others under a null
    response_id. Null headers are empty. Empty tables give no rows.
    """
    kind = F.col("record_type")
    full = (kind == "response") & (F.col("status") == 200) & F.col("body").isNotNull()
    # Records without an id are told apart by URL and time, on which alone the latest earlier response depends.
    note = F.when(F.col("record_id").isNull(), F.xxhash64("target_uri", "record_date", kind))
    name = F.struct("record_id", note.alias("note"))
    keys = records.select(name.alias("id"), canonical_url(F.col("target_uri")).alias("uri"), F.col("record_date").alias("at"), F.coalesce(full, F.lit(False)).alias("full"), kind.alias("kind"))
    keys = keys.where("full OR kind = 'revisit'").dropDuplicates(["id"])
    pairs = as_of(keys.drop("kind"), hot)
    asks = records.where(kind == "revisit").select(name.alias("revisit"), canonical_url(F.col("target_uri")).alias("uri"), F.col("headers").alias("fresh"))
    asks = asks.where("revisit.record_id IS NOT NULL").dropDuplicates(["revisit"]).unionByName(asks.where("revisit.record_id IS NULL"))
    revisits = stage(asks.join(pairs, "revisit").select(F.col("revisit.record_id").alias("record_id"), "uri", "fresh", "response"))
    stored = records.where(full).select(name.alias("response"), F.col("headers").alias("old"), "body").dropDuplicates(["response"])
    # Revisits without a response would all meet under the null key; they need no join.
    alone = revisits.where("response IS NULL").withColumn("old", F.lit(None).cast(records.schema["headers"].dataType))
    alone = alone.withColumn("body", F.lit(None).cast(records.schema["body"].dataType))
    rows = revisits.where("response IS NOT NULL").join(stored, "response", "left").unionByName(alone)

    def value(headers: str, name: str) -> Column:
        return F.get(F.filter(_lower_keys(F.col(headers)), lambda e: e["key"] == name), F.lit(0))["value"]

    tag = lambda h: F.regexp_replace(value(h, "etag"), "^W/", "")
    by_tag, by_date = tag("fresh") == tag("old"), value("fresh", "last-modified") == value("old", "last-modified")
    resolution = (
        F.when(F.col("response").isNull(), "no_response")
        .when(by_tag.isNotNull(), F.when(by_tag, "resolved").otherwise("etag_differs"))
        .when(by_date.isNotNull(), F.when(by_date, "resolved").otherwise("last_modified_differs"))
        .otherwise("unchecked")
    )
    rows = rows.withColumn("resolution", resolution)
    good = F.col("resolution").isin("resolved", "unchecked")
    return rows.select(
        "record_id", "uri", F.col("response.record_id").alias("response_id"), "resolution",
        F.when(good, merged_headers(F.col("old"), F.col("fresh"))).alias("headers"), F.when(good, F.col("body")).alias("body"),
    )
