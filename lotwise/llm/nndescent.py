"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

Equal vectors are one node (their smallest ids are kept, as many as an answer can name). The graph is built on one-byte
codes of the vectors, each with its own scale, so that a long vector doesn't flatten the others. A component is added
that makes all norms equal, so that the nearest by angle are meant; it is kept apart from the codes as its distance from
that of the zero vector, and compared by distance, which stays precise for short vectors beside long ones. The graph
starts from blocks of nodes that are neighbours along random projections. A round joins each node with those it points
to and those that point to it, and compares the nodes met there with each other (neighbours of neighbours): pairs with a
new edge among them, and only what improves a list is passed on. Rounds end when fewer than ``DELTA`` of the edges change.

A query walks the graph: a beam of the best nodes so far, of which the best not yet visited are expanded together, all
queries at once, one join per step, until every beam is expanded. The best of the beam are scored again in double
precision on the original vectors. A node's reverse edges, unbounded as they are, are dealt in chunks, so no hub meets
in one task; vectors travel as codes, state lies in written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, stage

NEIGHBOURS = 32
BLOCK = 256
TREES = 3
DELTA = 0.005
MAX_ROUNDS = 12
CHUNK = 64  # reverse edges met at once
BUCKET = 2048  # nodes in one task's group
BEAM = 256
EXPAND = 32
ENTRIES = 16
RESCORED = 48
SEED = 11

EDGE = "node long, other long, near double, fresh boolean"


@dataclass(frozen=True)
class Index:
    members: DataFrame  # node, ids (smallest of the equal vectors), vector
    codes: DataFrame  # node, code
    graph: DataFrame  # node, other, code of other; edges of both directions
    dim: int
    unit: float  # largest component of any vector


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector) of rows with an id and a finite vector that isn't zero."""
    name, column = vectors.columns[:2]
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(name).isNotNull() & x.isNotNull() & fine).select(F.col(name).cast("long").alias("id"), x.alias("vector"))


def _code(dim: int) -> np.dtype:
    """Components in steps of ``step``, what the norm lacks below ``sqrt(limit)``, half the square of both together.

    All in units of the largest component of any vector, in double: one long vector neither overflows nor flattens the others.
    """
    return np.dtype([("x", np.int8, (dim,)), ("step", np.float64), ("lack", np.float64), ("half", np.float64)])


def _encode(limit: float, unit: float):
    root = np.sqrt(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()) / unit
                square = (x * x).sum(axis=1)
                codes = np.zeros(len(x), _code(x.shape[1]))
                step = np.abs(x).max(axis=1) / 127.0
                codes["x"] = np.rint(x / step[:, None]).clip(-127, 127)
                codes["step"] = step
                codes["lack"] = lack = square / (root + np.sqrt(np.maximum(limit - square, 0.0)))
                codes["half"] = root * lack
                yield pd.DataFrame({"node": batch["node"], "code": [c.tobytes() for c in codes]})

    return run


def _matrix(codes) -> np.ndarray:
    """Components, lack and half of each code."""
    rows = np.frombuffer(b"".join(codes), _code(len(codes[0]) - 24))
    return np.column_stack([rows["x"] * rows["step"][:, None], rows["lack"], rows["half"]])


def _near(x: np.ndarray) -> np.ndarray:
    """Minus half the squared distances between vectors of equal norm: their products less the square of the norm."""
    return x[:, :-1] @ x[:, :-1].T - x[:, -1:] - x[:, -1]


def _top(rows: np.ndarray, other: np.ndarray, near: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest distinct others of every row; of equal pairs the one that isn't new."""
    order = np.lexsort((fresh, other, rows))
    r, o = rows[order], other[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -near[order], rows[order]))]
    r = rows[order]
    start = np.ones(len(order), bool)
    start[1:] = r[1:] != r[:-1]
    begin = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < k]


def _blocks(k: int):
    """Edges to the nearest within runs of ``BLOCK`` rows, in the order they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes: list[int] = []
        codes: list[bytes] = []

        def edges() -> pd.DataFrame:
            x, ids = _matrix(codes), np.array(nodes, np.int64)
            near = _near(x)
            np.fill_diagonal(near, -np.inf)
            best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
            rows = np.repeat(np.arange(len(ids)), best.shape[1])
            best = best.reshape(-1)
            out = pd.DataFrame({"node": ids[rows], "other": ids[best], "near": near[rows, best], "fresh": True})
            nodes.clear()
            codes.clear()
            return out

        for batch in batches:
            for node, code in zip(batch["node"], batch["code"]):
                nodes.append(node)
                codes.append(code)
                if len(nodes) == BLOCK:
                    yield edges()
        if len(nodes) > 1:
            yield edges()

    return run


def _project(seed: int, dim: int):
    """Key of a node along random directions: signs of ten of them, then the place along another."""
    way = np.random.default_rng(seed).standard_normal((dim, 11)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = _matrix(batch["code"].tolist())[:, :dim] @ way
                signs = (at[:, :10] > 0) @ (1 << np.arange(10))
                yield batch[["node", "code"]].assign(key=signs * 1e9 + at[:, 10])

    return run


def _best(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept = _top(*(group[c].to_numpy() for c in ("node", "other", "near", "fresh")), k)
        return group.iloc[kept][["node", "other", "near", "fresh"]]

    return run


def _meet(k: int):
    """Improvements found among the nodes that meet at the same (node, chunk)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["chunk"].to_numpy(), group["via"].to_numpy()))
        group = group.iloc[order]
        via, chunk = group["via"].to_numpy(), group["chunk"].to_numpy()
        nodes, fresh, least = (group[c].to_numpy() for c in ("node", "fresh", "least"))
        codes = _matrix(group["code"].tolist())
        cuts = np.flatnonzero((via[1:] != via[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(via)]):
            new = fresh[a:b]
            if b - a < 2 or not new.any():
                continue
            near = _near(codes[a:b])
            ids = nodes[a:b]
            better = (near > least[a:b, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
            i, j = np.nonzero(better)
            out.append((ids[i], ids[j], near[i, j]))
        if not out:
            return pd.DataFrame({"node": [], "other": [], "near": [], "fresh": []}).astype({"node": "int64", "other": "int64", "near": "float64", "fresh": bool})
        node, other, near = (np.concatenate(x) for x in zip(*out))
        kept = _top(node, other, near, np.ones(len(node), bool), k)
        return pd.DataFrame({"node": node[kept], "other": other[kept], "near": near[kept], "fresh": True})

    return run


def _square(unit: float):
    return F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit))


def build(vectors: DataFrame, k: int = NEIGHBOURS, same: int = 21) -> Index:
    """Index over the first two columns of ``vectors`` (id, array of numbers); every usable row is in it.

    Null ids and vectors, zeros and vectors with a null or non-finite component take no part. Vectors must have one
    length. Rows with one id and vector count once. ``same``: ids kept of equal vectors, one more than an answer names.
    """
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, same)
    rows = usable(vectors).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(4096)))
    salted = rows.groupBy("vector", "salt").agg(smallest(F.collect_list("id")).alias("ids"))
    members = salted.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    members = stage(members.select(F.col("ids")[0].alias("node"), "ids", "vector"))
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    facts = members.agg(F.count("*"), F.max(largest), F.max(F.size("vector"))).first()
    n, unit, dim = facts[0], facts[1] or 1.0, facts[2] or 1
    limit = members.agg(F.max(_square(unit))).first()[0] or 1.0
    codes = stage(members.select("node", "vector").mapInPandas(_encode(limit, unit), "node long, code binary"))
    edges = _descend(codes, n, k, dim)
    both = edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    graph = both.join(codes.select(F.col("node").alias("other"), "code"), "other").select("node", "other", "code")
    return Index(members, codes, stage(graph), dim, unit)


def _descend(codes: DataFrame, n: int, k: int, width: int) -> DataFrame:
    spark = codes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = -(-max(n, 1) // BUCKET)
    start = None
    for tree in range(TREES):
        keyed = codes.mapInPandas(_project(SEED + tree, width), "node long, code binary, key double")
        dealt = keyed.repartitionByRange(min(parts, -(-n // (4 * BLOCK)) or 1), "key", "node").sortWithinPartitions("key", "node")
        near = dealt.select("node", "code").mapInPandas(_blocks(k), EDGE)
        start = near if start is None else start.unionByName(near)
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket")
    edges = stage(start.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_best(k), EDGE))
    for _ in range(MAX_ROUNDS):
        # What a list must be beaten by: its last entry once it is full.
        floors = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.min("near")).otherwise(F.lit(float("-inf"))).alias("least"))
        known = codes.join(floors, "node", "left").select("node", "code", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        back = edges.select(F.col("other").alias("via"), F.col("node"), "fresh")
        sizes = back.groupBy("via").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        back = back.join(sizes, "via").select("via", F.pmod(F.xxhash64("node", "via"), F.col("chunks")).cast("int").alias("chunk"), "node", "fresh")
        ahead = edges.select(F.col("node").alias("via"), F.col("other").alias("node"), "fresh").join(sizes, "via", "left")
        ahead = ahead.select("via", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), "node", "fresh")
        met = ahead.unionByName(back).groupBy("via", "chunk", "node").agg(F.max("fresh").alias("fresh"))
        met = met.join(known, "node").withColumn("bucket", F.pmod(F.xxhash64("via"), F.lit(buckets)))
        found = met.groupBy("bucket").applyInPandas(_meet(k), EDGE)
        old = edges.withColumn("fresh", F.lit(False))
        # An edge is new in the round after it came in; of a pair met again the old entry stays.
        every = old.unionByName(found).withColumn("bucket", bucket)
        edges = stage(every.groupBy("bucket").applyInPandas(_best(k), EDGE))
        if edges.where("fresh").count() <= DELTA * n * k:
            break
    return edges


def _walk(beam: int):
    """New state of the queries of a bucket from their old one and the neighbours they have come to."""

    def run(key, state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        by_query = {q: g for q, g in found.groupby("query")}
        out = []
        for row in state.itertuples(index=False):
            ids = np.asarray(row.ids, np.int64)
            near, done = np.asarray(row.near, np.float64), np.asarray(row.done, bool)
            visited = np.asarray(row.visited, np.int64)
            # What was handed out last time is expanded now.
            open_ = np.flatnonzero(~done)[:EXPAND]
            done[open_] = True
            group = by_query.get(row.query)
            if group is not None:
                other, at = np.unique(group["other"].to_numpy(np.int64), return_index=True)
                new = ~np.isin(other, visited, assume_unique=True)
                other, at = other[new], at[new]
                if len(other):
                    x = _matrix(group["code"].to_numpy()[at].tolist())[:, : len(row.vector)]
                    ids = np.concatenate([ids, other])
                    near = np.concatenate([near, x @ np.asarray(row.vector, np.float64)])
                    done = np.concatenate([done, np.zeros(len(other), bool)])
                    visited = np.concatenate([visited, other])
                    order = np.lexsort((ids, -near))[:beam]
                    ids, near, done = ids[order], near[order], done[order]
            out.append((row.query, row.vector, ids, near, done, visited))
        return pd.DataFrame(out, columns=["query", "vector", "ids", "near", "done", "visited"])

    return run


STATE = "query long, vector array<double>, ids array<long>, near array<double>, done array<boolean>, visited array<long>"


def search(index: Index, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries`` (id, vector, optionally start).

    ``start``: a node to begin at (a query that is itself in the index begins at its own node); all begin at ``ENTRIES``
    fixed nodes besides and at as many of the longest, which may be the best of a query that is near none of them. A query never finds its own id. Scores are inner products of the original vectors in double
    precision, added in order; ties go to the smaller vec_id. Unusable queries are left out, a repeated id is asked once.
    """
    asked = usable(queries.select("id", "vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    starts = queries.select("id", "start").where("start IS NOT NULL").distinct() if "start" in queries.columns else None
    n = asked.count()
    buckets = -(-max(n, 1) // 256)
    entries = index.codes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(ENTRIES)
    longest = index.members.orderBy(_square(index.unit).desc(), "node").limit(ENTRIES).select("node").join(index.codes, "node")
    entries = entries.select("node", "code").unionByName(longest.select("node", "code")).distinct()
    entries = entries.agg(F.collect_list(F.struct(F.col("node").alias("other"), "code")).alias("entries"))
    asked = stage(asked.withColumnRenamed("id", "query"))
    found = asked.select("query", F.explode(entries.scalar()).alias("e")).select("query", "e.other", "e.code")
    if starts is not None:
        own = starts.join(index.codes, F.col("start") == F.col("node")).select(F.col("id").alias("query"), F.col("start").alias("other"), "code")
        found = found.unionByName(own)
    found = stage(found)
    empty = lambda t: F.array().cast(f"array<{t}>")
    # In units of its own largest component: the order of its products stays.
    own_unit = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    state = asked.withColumn("_unit", own_unit).select(
        "query", F.transform("vector", lambda x: x / F.col("_unit")).alias("vector"), empty("long").alias("ids"), empty("double").alias("near"), empty("boolean").alias("done"), empty("long").alias("visited")
    )
    bucket = F.pmod(F.xxhash64("query"), F.lit(buckets)).alias("bucket")
    while True:
        left, right = state.withColumn("bucket", bucket).groupBy("bucket"), found.withColumn("bucket", bucket).groupBy("bucket")
        state = stage(left.cogroup(right).applyInPandas(_walk(beam), STATE))
        open_ = F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"])
        front = state.select("query", F.explode(F.slice(open_, 1, EXPAND)).alias("x")).select("query", F.col("x.ids").alias("node"))
        front = stage(front)
        if front.isEmpty():
            break
        found = index.graph.join(broadcast_if_small(front, 2_000_000), "node").select("query", "other", "code")
    best = state.select("query", F.explode(F.slice("ids", 1, max(RESCORED, k + 1))).alias("node"))
    pairs = best.join(index.members, "node").join(asked.withColumnRenamed("vector", "asked"), "query")
    product = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = pairs.select("query", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def own_starts(index: Index, queries: DataFrame) -> DataFrame:
    """(id, vector) with ``start``: the node of the index that holds the same vector."""
    rows = usable(queries)
    nodes = index.members.select(F.col("vector").alias("_v"), F.col("node").alias("start"))
    return rows.join(nodes, F.col("vector") == F.col("_v"), "left").select("id", "vector", "start")
