"""Secret scan with a trigram inverted index.

For each rule a Boolean trigram query is derived from its expression. Postings (trigram, document) are intersected by
collecting the trigrams of a document and evaluating the queries on them: the key of that shuffle is the document, so a
frequent trigram is no hot key, and the set is bounded by the number of trigrams the rules can ask for. The expressions
then run on the candidates only; rules without a mandatory trigram run on every document. Results do not depend on the
index: it only spares work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, let, stage, whole_text
from lotwise.llm.trigrams import Query, query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# Names that may be assigned a secret, and the rules in the order in which kinds are listed
NAMES = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule("assign", f"({'|'.join(map(_either_case, NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more: the same matches as all runs with the shorter ones dropped.
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
SLICE = 1024


def postings(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """Distinct (trigram, doc_id), letters folded. With a vocabulary only its trigrams are posted (nobody asks for others)."""
    text = F.lower(whole_text(F.col("text")))
    if vocabulary is not None:
        found = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in vocabulary]))
        return docs.select(F.explode(found if vocabulary else F.array().cast("array<string>")).alias("trigram"), "doc_id")
    # Slices that overlap by two characters, so that finding a trigram does not count characters from the start.
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(SLICE))
    pieces = docs.select("doc_id", F.explode(F.transform(starts, lambda i: F.substr(text, i, F.lit(SLICE + 2)))).alias("piece"))
    pieces = pieces.where(F.length("piece") >= 3)
    grams = F.transform(F.sequence(F.lit(1), F.length("piece") - 2), lambda i: F.substr(F.col("piece"), i, F.lit(3)))
    return pieces.select(F.explode(F.array_distinct(grams)).alias("trigram"), "doc_id").distinct()


def _holds(query: Query, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_holds(q, have) for q in query[1:]])


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the document's postings satisfy."""
    have = index.where(F.col("trigram").isin(sorted(set().union(*map(trigrams_of, queries.values())))))
    sets = have.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in queries.items()]))
    return sets.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches, in code points; lengths between matches add up to places."""
    regex = F.lit(rule.pattern)

    def walk(found: Column) -> Column:
        parts = F.arrays_zip(
            found.alias("m"), F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("v"), F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)).alias("gap")
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["m"])
            span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"))
            keep = F.length(x["v"]) >= rule.least
            return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(start["out"])

    return let(F.regexp_extract_all(text, regex, F.lit(0)), walk)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) with ``secrets``: an array of (kind, start, end) by start, then rule.

    Places are code points, the end exclusive. A null text is empty and has no spans. Rows with one doc_id share
    candidates and are scanned each; a null doc_id is a value like any other. Extra columns pass through (one named
    ``secrets`` is replaced); an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "secrets"]
    queries = {r.kind: query_of(r.pattern) for r in rules}
    queries = {k: q for k, q in queries.items() if q is not None}
    vocabulary = sorted(set().union(*map(trigrams_of, queries.values()))) if queries else []
    index = stage(postings(docs.select("doc_id", "text"), vocabulary))
    hits = stage(candidates(index, queries)) if queries else index.select("doc_id", F.array().cast("array<string>").alias("kinds"))
    hits = broadcast_if_small(hits.select(F.col("doc_id").alias("_key"), "kinds"))
    rows = docs.select(F.struct(*others).alias("_row")).join(hits, F.col("_row.doc_id").eqNullSafe(F.col("_key")), "left")
    text = whole_text(F.col("_row.text"))
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(text, rule, number)
        asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        found.append(F.when(asked, spans).otherwise(none) if rule.kind in queries else spans)
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.sort_array(F.concat(none, *found)),
        lambda s: F.struct(F.get(names, s["number"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return rows.select("_row.*", spans.alias("secrets"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; a span that overlaps an earlier one extends it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, out).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
