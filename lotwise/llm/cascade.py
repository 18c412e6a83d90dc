"""Exact set membership by a cascade of Bloom filters, and URL verdicts that use it.

Level 1 encodes the listed keys. The other keys of the universe that it lets through are encoded by level 2, the listed
keys that level 2 lets through by level 3, and so on until a level lets nothing wrong through. For every key of the
universe the first level that rejects it tells its side, so the answer is exact and no join with the list is needed.

A level is one row: an array of 64-bit words. It reaches the tasks as the value of a scalar subquery. Its size follows
from counts (about ``1.44 * log2(universe / listed) + 3`` bits per listed key over all levels) and is checked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import stage

# Largest single level; a list that needs more is split by the caller (each part is a cascade of its own).
MAX_LEVEL_BYTES = 256 << 20


@dataclass(frozen=True)
class Level:
    table: DataFrame  # one row, one column ``words``
    bits: int
    hashes: int
    seed: int

    def contains(self, key: Column, words: Column) -> Column:
        def bit(i: int) -> Column:
            at = position(key, self.seed, i, self.bits)
            return F.call_function("shiftright", F.get(words, F.call_function("shiftright", at, F.lit(6)).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        return reduce(lambda a, b: a & b, [bit(i) for i in range(self.hashes)])


def position(key: Column, seed: int, i: int, bits: int) -> Column:
    """Bit that the i-th hash of a key sets: double hashing."""
    first, step = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key).bitwiseOR(F.lit(1))
    return F.pmod(F.shiftright(first, 2) + F.lit(i) * F.shiftright(step, 8), F.lit(bits).cast("long"))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, math.ceil(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(1.4427 * n * -math.log2(rate) / 64))
    if bits // 8 > MAX_LEVEL_BYTES:
        raise ValueError(f"a level of {bits // 8} bytes is above {MAX_LEVEL_BYTES}; split the list")
    at = F.explode(F.array(*[position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("at")
    words = (
        keys.select(at)
        .select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    full = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    pair = F.struct(F.col("id"), F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = full.agg(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["bits"]).alias("words"))
    return Level(stage(table), bits, hashes, seed)


def build(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Cascade for ``listed`` (one column) within ``universe`` (one column, every key that will ever be asked).

    Null keys are left out, repeats count once, listed keys outside the universe are left out. With no listed key the
    cascade has no level (nothing is a member); with every key listed, one level that admits the whole universe.
    """
    named = lambda df: df.select(F.col(df.columns[0]).alias("key")).where("key IS NOT NULL")
    marks = named(universe).select("key", F.lit(0).alias("on")).unionByName(named(listed).select("key", F.lit(1).alias("on")))
    keys = stage(
        marks.groupBy("key").agg(F.max("on").alias("on"), F.min("on").alias("known")).where("known = 0").select("key", "on")
    )
    # The sides swap at each level; both are re-read from a staged table, so no level recomputes the ones before.
    levels: list[Level] = []
    inside = keys.where("on = 1").select("key")
    outside = keys.where("on = 0").select("key")
    n, rest = inside.count(), outside.count()
    while n:
        rate = min(0.5, max(2.0**-30, math.sqrt(0.5) * n / max(rest, 1))) if not levels else 0.5
        level = _level(inside, n, rate, seed=len(levels))
        levels.append(level)
        if not rest:
            break
        wrong = outside.select("key", level.table.scalar().alias("_w")).where(level.contains(F.col("key"), F.col("_w"))).select("key")
        inside, outside, rest = stage(wrong), inside, n
        n = inside.count()
    return levels


def member(df: DataFrame, key: str, levels: list[Level], name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: the key is listed. Exact for keys of the universe; a null key is not listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(levels[i].contains(F.col(key), F.col(f"_level{i}")), answer).otherwise(F.lit(i % 2 == 1))
    wide = df.select("*", *[x.table.scalar().alias(f"_level{i}") for i, x in enumerate(levels)])
    return wide.withColumn(name, F.coalesce(answer, F.lit(False))).drop(*[f"_level{i}" for i in range(len(levels))])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


# Fixed values: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Parts of a host name that put the host on the list
LISTED_PARTS = ("spam", "pills", "casino", "porn", "xxx", "viagra", "malware", "phishing", "warez", "adult")


def listed_hosts(hosts: DataFrame, parts: tuple[str, ...] = LISTED_PARTS) -> DataFrame:
    """Hosts with one of the parts between dots and dashes."""
    return hosts.where(F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(p) for p in parts])))


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``pages`` with a struct ``url_verdict`` (host, path, rule, verdict); an input column of that name is replaced.

    The longest fitting rule (host and path together) decides; where none fits, a listed host is blocked and any other
    allowed. ``listed`` has one column of hosts; left out, the hosts of the pages with one of ``LISTED_PARTS``. A null
    URL has an empty host and path. Repeated rows are judged each; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c != "url_verdict"]
    host, path = host_and_path(F.col("url"))
    hosts = stage(pages.select(host.alias("host")).distinct())
    levels = build(hosts, listed_hosts(hosts) if listed is None else listed)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    at, there = F.col("_u.host"), F.col("_u.path")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((at == name) | at.endswith("." + name)) & there.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    rows = pages.select(F.struct(*others).alias("_row"), F.struct(host.alias("host"), path.alias("path")).alias("_u"))
    rows = member(rows.withColumn("_host", at), "_host", levels, "_listed")
    found = F.struct(
        at.alias("host"), there.alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )
    return rows.select("_row.*", found.alias("url_verdict"))
