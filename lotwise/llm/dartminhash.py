"""Near-duplicate classes by DartMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles; similarity is weighted Jaccard (sum of minima over sum of maxima).
Over each element lies a plane of weight by rank, cut into regions: unit cells of weight, and slabs of rank that double
up to one and then have height one. The darts of a region - a Poisson number, their ranks, weights and coordinates - come
from a hash of element and region alone, so two texts that share an element share its darts. A dart counts where its
weight lies within the element's. Slabs are thrown in ascending order until each of the ``BANDS * ROWS`` coordinates has
a dart; the earliest is its value. Large texts fill up in the first thin slabs, so the work is about one dart per element
and not one hash per element and coordinate. Two texts agree in a coordinate with probability equal to their similarity.

Classes: exact copies are one node. Nodes that share a band meet in a bucket, where each is compared, by its whole
shingles, with one leader, the node that meets most others. That joins most of a group of near copies, and nothing is
taken for settled by it: at last, in every bucket that still holds two components, each row outside the largest one is
compared with all rows of other components, joined ones too. A large bucket is dealt in blocks of rows against rows.
Only pairs with a leader and pairs that join are emitted. A leader with thousands of members is sent to each salt.
Components are contracted by minima and pointer jumps on tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, stage, whole_text

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
# Words handled at once in a task, words remembered with their hash, members per salt.
CHUNK_WORDS = 200_000
REMEMBERED = 1_000_000
PER_SALT = 500
# Rows of a bucket compared in one group; larger buckets are dealt in blocks of half as many against half as many.
REST = 1000
# Further leaders that buckets with more rows than that outside their leaders' components get before the blocks.
LEADERS = 3
# Upper ends of the first slabs of rank; then one per unit.
SLABS = [2.0**-i for i in range(6, -1, -1)]
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(texts: list[list[str]], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted; a text of one to four words is one shingle."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.fromiter((words[w] for t in texts for w in t), dtype=np.uint64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
    length = sizes[owner]
    start = np.flatnonzero((place + SHINGLE <= length) | (place == 0))
    value = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        value = _mix(value ^ np.where(place[start] + k < length[start], padded[start + k], np.uint64(k)))
    text = owner[start]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return text[at], value[at], np.diff(np.append(at, len(text))).astype(np.float64)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) array of dart ids: for each text and coordinate the dart of lowest rank. Texts without elements keep zeros."""
    out, filled = np.zeros((n, k), np.uint64), np.zeros((n, k), bool)
    cells = np.ceil(weight).astype(np.int64)
    rows = np.repeat(np.arange(len(text)), cells)
    cell = np.arange(len(rows)) - np.repeat(np.cumsum(cells) - cells, cells)
    text, element, weight = text[rows], element[rows], weight[rows]
    base = _mix(element ^ _mix(cell.astype(np.uint64)))
    slab, low = 0, 0.0
    while len(text):
        high = SLABS[slab] if slab < len(SLABS) else low + 1.0
        area = high - low
        region = _mix(base ^ _mix(base + np.array([slab + 1], np.uint64) * _M2))
        draw, count = _unit(region), np.zeros(len(region), np.int64)
        term = total = np.exp(-area)
        for j in range(1, 24):  # Poisson by inversion; the area is at most one
            more = draw >= total
            if not more.any():
                break
            count += more
            term *= area / j
            total += term
        at = np.repeat(np.arange(len(region)), count)
        if len(at):
            number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            dart = _mix(region[at] ^ _mix((number + 1).astype(np.uint64) * _M3))
            rank, part = _unit(_mix(dart ^ _M1)), _unit(_mix(dart ^ _M3))
            hit = cell[at] + part <= weight[at]
            at, dart, rank = at[hit], dart[hit], rank[hit]
            slot = text[at] * k + (_mix(dart ^ _M2) % np.uint64(k)).astype(np.int64)
            free = ~filled.reshape(-1)[slot]
            slot, dart, rank = slot[free], dart[free], rank[free]
            order = np.lexsort((dart, rank, slot))
            slot, dart = slot[order], dart[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            out.reshape(-1)[slot[first]] = dart[first]
            filled.reshape(-1)[slot[first]] = True
        open_ = ~filled.all(axis=1)
        keep = open_[text]
        if not keep.all():
            text, base, cell, weight = text[keep], base[keep], cell[keep], weight[keep]
        slab, low = slab + 1, high
    return out


def _chunks(texts: Iterable[list[str]]) -> Iterator[list[list[str]]]:
    held: list[list[str]] = []
    total = 0
    for t in texts:
        if total and total + len(t) > CHUNK_WORDS:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            found: list = []
            # Words of a chunk at a time: those of a whole batch take hundreds of MB.
            for texts in _chunks(split_words(t) for t in batch["text"]):
                signs = signatures(*shingles(texts, words), len(texts), bands * rows).reshape(len(texts), bands, rows)
                value = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    value = _mix(value ^ signs[:, :, r])
                found += [v if t else [] for v, t in zip(value.view(np.int64), texts)]
            yield batch[["doc_id", "node"]].assign(bands=found)

    return run


def split_words(text: str) -> list[str]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return _WORD.findall(text)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 0.0


def _compare(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, leader, own = _Words(), None, None
        one = lambda text: shingles([split_words(text)], words)[1:]
        for batch in batches:
            rows = []
            # A leader's own row (node equal to leader) comes first among the rows of its (leader, salt).
            for name, node, text in zip(batch["leader"], batch["node"], batch["text"]):
                if node == name:
                    leader, own = name, one(text)
                else:
                    assert leader == name, "a leader's text comes before its members'"
                    rows.append((node, name, weighted_jaccard(own, one(text))))
            out = pd.DataFrame(rows, columns=["node", "leader", "similarity"])
            yield out[out["similarity"] >= threshold]

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(node, leader, similarity) of the pairs whose whole texts reach the threshold."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    sizes = stage(sizes)
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    members = pairs.join(broadcast_if_small(sizes), "leader").select("leader", salt, "node")
    leaders = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"))
    rows = members.unionByName(leaders).join(texts, "node").select("leader", "salt", "node", "text")
    own_first = F.when(F.col("node") == F.col("leader"), 0).otherwise(1)
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", own_first)
    return dealt.select("leader", "node", "text").mapInPandas(_compare(threshold), "node string, leader string, similarity double")


def join_block(nodes: list[str], component: list, asks: np.ndarray, answers: np.ndarray, outer: np.ndarray, texts: list, threshold: float) -> list:
    """(node, leader, similarity) that join the components of rows met in one group, whose texts are (shingles, counts).

    Each row that asks is compared with every answering row of another component; of two outer rows the larger node asks.
    Components joined here count as one from then on, so that a group of near copies isn't compared pair by pair.
    """
    group = np.unique(np.array(component, object), return_inverse=True)[1]
    name = np.array(nodes, object)
    weight = np.array([c.sum() for _, c in texts])
    there = np.flatnonzero(answers)
    flat = np.concatenate([texts[i][0] for i in there] or [np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(there)), [len(texts[i][0]) for i in there])[order]
    count = np.concatenate([texts[i][1] for i in there] or [np.zeros(0)])[order]
    flat = flat[order]
    links = []
    for u in np.flatnonzero(asks):
        fits = (group[there] != group[u]) & (np.minimum(weight[there], weight[u]) >= threshold * np.maximum(weight[there], weight[u]))
        if outer[u]:
            fits &= ~outer[there] | (name[there] < name[u])
        if not fits.any():
            continue
        element, mine = texts[u]
        low = np.searchsorted(flat, element, "left")
        n = np.searchsorted(flat, element, "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], np.minimum(count[at], np.repeat(mine, n)), len(there))
        near = both / (weight[there] + weight[u] - both)
        for m in np.flatnonzero(fits & (near >= threshold)):
            if group[there[m]] != group[u]:
                links.append((nodes[u], nodes[there[m]], float(near[m])))
                group[group == group[there[m]]] = group[u]
    return links


def _join(threshold: float):
    """Links of the groups (bucket, i, j) of rows, which come together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, key = _Words(), [], None

        def links() -> list:
            if not held:
                return []
            nodes, component, asks, answers, outer, texts = zip(*held)
            held.clear()
            return join_block(list(nodes), list(component), np.array(asks), np.array(answers), np.array(outer), list(texts), threshold)

        for batch in batches:
            rows = []
            each = (batch[c] for c in ("bucket", "i", "j", "node", "component", "asks", "answers", "outer", "text"))
            for bucket, i, j, node, component, asks, answers, outer, text in zip(*each):
                if (bucket, i, j) != key:
                    rows += links()
                    key = (bucket, i, j)
                held.append((node, component, asks, answers, outer, shingles([split_words(text)], words)[1:]))
            yield pd.DataFrame(rows, columns=["node", "leader", "similarity"])
        yield pd.DataFrame(links(), columns=["node", "leader", "similarity"])

    return run


def settle(places: DataFrame, texts: DataFrame, threshold: float = SIMILARITY, labels: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(node, leader, similarity) that join all rows of a bucket of ``places`` (bucket, node) that reach the threshold.

    ``labels`` are the components known so far; a bucket within one component is done, and one with fewer rows than
    ``least`` is left out. Buckets with the same nodes are compared once.
    """
    known = places.withColumn("component", F.col("node"))
    if labels is not None:
        known = places.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stage(known.select("bucket", "node", "component"))
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    each = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("base")
    )
    each = each.where((F.col("parts") > 1) & (F.col("n") >= least))
    once = each.groupBy("n", "s").agg(F.min(F.struct("bucket", "base")).alias("b")).select("b.bucket", "b.base", "n")
    blocks = lambda n: F.when(F.col("n") <= REST, 1).otherwise(F.ceil(n / (REST // 2))).cast("int")
    once = stage(once.select("bucket", F.col("base.component").alias("base"), blocks(F.col("n") - F.col("base.n")).alias("us"), blocks(F.col("n")).alias("ms")))
    rows = known.join(broadcast_if_small(once), "bucket").withColumn("outer", F.col("component") != F.col("base"))
    whole = F.col("ms") == 1
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(SHINGLE)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "i", "j", "node", "component", "asks", "answers", "outer"]
    answer = rows.withColumn("j", dealt("ms")).withColumn("i", every("us")).withColumn("asks", whole & F.col("outer")).withColumn("answers", F.lit(True))
    ask = rows.where(~whole & F.col("outer")).withColumn("i", dealt("us")).withColumn("j", every("ms"))
    ask = ask.withColumn("asks", F.lit(True)).withColumn("answers", F.lit(False))
    met = answer.select(*columns).unionByName(ask.select(*columns)).join(texts, "node").select(*columns, "text")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return met.mapInPandas(_join(threshold), "node string, leader string, similarity double")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node with a link: the smallest node it is connected to. ``labels`` are those found so far."""
    edges = links.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    edges = stage(edges.where("a <> b").distinct())
    out = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        # Each component takes the smallest component that an edge leads to, then pointers are followed to their ends.
        ends = edges.join(out.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        ends = ends.join(out.select(F.col("node").alias("b"), F.col("component").alias("y")), "b").where("x <> y")
        lower = stage(ends.groupBy(F.greatest("x", "y").alias("old")).agg(F.min(F.least("x", "y")).alias("new")))
        if lower.isEmpty():
            return out
        while True:
            step = lower.alias("p").join(lower.alias("q"), F.col("p.new") == F.col("q.old"), "left")
            jumped = stage(step.select(F.col("p.old"), F.coalesce("q.new", "p.new").alias("new"), F.col("q.new").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            lower = jumped.drop("moved")
            if not moved:
                break
        merged = out.join(lower, F.col("component") == F.col("old"), "left")
        out = stage(merged.select("node", F.coalesce("new", "component").alias("component")))


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, node, component) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``node`` is the md5 of the text, ``component`` the smallest node of the class.

    The class is the smallest doc_id connected by copies or by similarity of at least the threshold. A null text is
    empty; texts without words equal only themselves, texts of fewer than five words are one shingle. Rows with equal
    texts are one node, whatever their ids; a null doc_id gets the class of its text and never names it unless all are
    null. An empty table gives no rows.
    """
    text = whole_text(F.col("text"))
    signed = docs.select("doc_id", F.md5(text).alias("node"), text.alias("text"))
    signed = stage(signed.mapInPandas(_sign(bands, rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node string, bands array<long>"))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"))
    places = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    places = places.select("node", F.xxhash64("band", "value").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    places = places.join(shared, "bucket").select("bucket", "node", "n")
    # Leaders are taken in one order everywhere: first the nodes that meet most others.
    central = places.groupBy("node").agg(F.struct(-F.sum("n"), "node").alias("order"))
    places = stage(places.drop("n").join(central, "node").select("bucket", "node", "order"))
    wanted = broadcast_if_small(stage(places.select("node").distinct()))
    texts = stage(
        docs.select(F.md5(text).alias("node"), text.alias("text")).join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    )
    labels: DataFrame | None = None

    def beside(places: DataFrame) -> DataFrame:
        """(bucket, node, order, leader, first): rows outside the component of their bucket's leader."""
        known = places.withColumn("component", F.col("node"))
        if labels is not None:
            known = places.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        leaders = known.groupBy("bucket").agg(F.min(F.struct("order", "node", "component")).alias("l"))
        rows = known.join(leaders, "bucket").where("component <> l.component")
        return stage(rows.select("bucket", "node", "order", F.col("l.node").alias("leader"), F.col("l.order").alias("first")))

    # First each node with the first of its leaders: that mostly settles the others.
    pairs = stage(beside(places).groupBy("node").agg(F.min(F.struct("first", "leader")).alias("l")).select("node", "l.leader"))
    tried = pairs
    if not pairs.isEmpty():
        labels = components(verify(pairs, texts, threshold))
    left = places
    for _ in range(1 + LEADERS):
        rows = beside(left)
        pairs = stage(rows.select("node", "leader").distinct().join(tried, ["node", "leader"], "left_anti"))
        if not pairs.isEmpty():
            labels = components(verify(pairs, texts, threshold), labels)
            tried = tried.unionByName(pairs)
        # Where many rows stay outside, these get another leader, so that fewer are left for the blocks.
        if labels is not None:
            rows = rows.join(labels.withColumnRenamed("component", "now"), "node", "left")
            rows = rows.join(labels.select(F.col("node").alias("leader"), F.col("component").alias("lead_now")), "leader", "left")
            rows = rows.where("coalesce(now, node) <> coalesce(lead_now, leader)")
        left = rows.select("bucket", "node", "order")
        many = left.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > REST)
        left = stage(left.join(many, "bucket", "left_semi"))
        if left.isEmpty():
            break
    # Buckets of two have been compared with their leader.
    labels = components(settle(places.select("bucket", "node"), texts, threshold, labels, least=3), labels)
    named = signed.select("doc_id", "node").join(labels, "node", "left")
    named = stage(named.select("doc_id", "node", F.coalesce("component", "node").alias("component")))
    ids = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return named.join(ids, "component").select("doc_id", "class_id", "node", "component")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: the smallest doc_id, of equal ones the smallest node.

    Of several equal rows (doc_id and text) one stays. A class whose ids are all null keeps one row too.
    """
    found = classes(docs, threshold=threshold)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    kept = found.groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.node")
    kept = stage(kept.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))
    node = F.md5(whole_text(F.col("text")))
    rows = docs.withColumn("_text_node", node).join(
        broadcast_if_small(kept), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_node") == F.col("_node")), "left_semi"
    )
    repeated = found.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not repeated.isEmpty():
        rows = rows.dropDuplicates(["doc_id", "_text_node"])
    return rows.select(*docs.columns)
