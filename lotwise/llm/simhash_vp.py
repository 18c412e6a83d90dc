"""SimHash classes by vantage-point trees over Hamming space.

A text's fingerprint has a bit set where over half of the hashes of its three-word shingles have it. Distinct fingerprints
are cut into shards by a vantage-point tree: each node keeps points within a radius of its vantage point on one side, the
others on the other. By the triangle inequality a point farther than the linking distance from a node's radius has all
its partners on its own side, so the branch beyond is pruned. A point near the radius is also sent, as a visitor, into
the shards beyond that its ball overlaps. Only the inner of two points visits the outer's branch, so each pair meets once.
Within a shard the same tree, grown to small leaves, decides which members and visitors are compared, bit by bit; no link
is missed or approximate.

The upper tree is grown from a sample of at most ``SAMPLE`` fingerprints and routes every one of them. A shard's members
(8 bytes each) are held in a task; visitors stream past them, and where they are many they are dealt over several tasks,
each with the members. Members that hold together already aren't compared again, and a task gives the links that join
components only. Equal texts are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, stage
from lotwise.llm.dartminhash import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Members of a shard and of a leaf in it that are aimed at, fingerprints the upper tree is grown from, and those for a shard.
SHARD, LEAF, SAMPLE, PER_SHARD = 30_000, 96, 1_000_000, 64
# Visitors routed at once, and those of a shard that one task takes.
VISITORS, PER_TASK = 100_000, 2_000_000
CHUNK = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text in UTF-8; 0 without words. Fewer words than a shingle takes are one shingle."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.concatenate([[0], ends + 1])[: len(last)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, len(first), CHUNK):
        pairs = zip(first[a : a + CHUNK].tolist(), last[a : a + CHUNK].tolist())
        hashes = np.array([digest(joined[b:e], seed) for b, e in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int64) if len(bits) < 128 else _column_sums(bits)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of the columns of zeros and ones, through one-byte sums of blocks of rows, which are faster."""
    whole = len(bits) // 128 * 128
    blocks = np.add.reduce(bits[:whole].reshape(-1, 128, 64), axis=1, dtype=np.uint8)
    return blocks.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


class VantageTree:
    """Vantage points, radii and branches; a branch below zero is leaf -1 - branch."""

    def __init__(self, points: np.ndarray, leaf: int, distance: int = DISTANCE) -> None:
        self.distance, self.leaves = distance, 0
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.near: list[int] = []
        self.far: list[int] = []
        self.root = self._grow(points, max(1, leaf))

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        # Depth is bounded: a cut leaves at least a twentieth on either side.
        found = self._cut(points) if len(points) > leaf else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        vantage, radius = found
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.radius.append(radius)
        self.near.append(0)
        self.far.append(0)
        inside = np.bitwise_count(points ^ vantage) <= radius
        self.near[node] = self._grow(points[inside], leaf)
        self.far[node] = self._grow(points[~inside], leaf)
        return node

    def _cut(self, points: np.ndarray) -> tuple[np.uint64, int] | None:
        """The vantage point and radius with the fewest points to visit the other side; None where nothing divides them."""
        some = points[:: max(1, len(points) // 1024)]
        best = None
        for vantage in points[:: max(1, len(points) // 8)][:8]:
            upto = np.cumsum(np.bincount(np.bitwise_count(some ^ vantage), minlength=65 + 2 * self.distance))
            for radius in range(64):
                inside = int(upto[radius])
                if 20 * inside < len(some) or 20 * (len(some) - inside) < len(some):
                    continue
                visit = int(upto[radius + self.distance] - (upto[radius - self.distance] if radius >= self.distance else 0))
                # Visits double the work, a lopsided cut halves it late.
                cost = (len(some) + visit) / (1e-9 + min(inside, len(some) - inside)) ** 0.5
                if best is None or cost < best[0]:
                    best = (cost, vantage, radius)
        return None if best is None else best[1:]

    def route(self, points: np.ndarray, home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf of each point; leaves visited, by which points). Without ``home`` all points are visitors everywhere."""
        none = np.zeros(0, np.int64)
        at = np.full(len(points), -1, np.int64)
        leaves, who = [none], [none]
        every = np.arange(len(points))
        work = [(self.root, every if home else none, none if home else every)]
        while work:
            node, own, guests = work.pop()
            if not len(own) and not len(guests):
                continue
            if node < 0:
                at[own] = -1 - node
                leaves.append(np.full(len(guests), -1 - node, np.int64))
                who.append(guests)
                continue
            vantage, radius = np.uint64(self.vantage[node]), self.radius[node]
            d = np.bitwise_count(points[own] ^ vantage).astype(np.int64)
            g = np.bitwise_count(points[guests] ^ vantage).astype(np.int64)
            inside = d <= radius
            out = inside & (d + self.distance > radius)
            work.append((self.near[node], own[inside], guests[g - self.distance <= radius]))
            work.append((self.far[node], own[~inside], np.concatenate([own[out], guests[g + self.distance > radius]])))
        return at, np.concatenate(leaves), np.concatenate(who)


class _Shard:
    """The members of a shard, the components known among them and their visitors, and the links that made these."""

    def __init__(self, members: np.ndarray, distance: int, compare: bool) -> None:
        self.members, self.distance = members, distance
        self.parent = np.arange(len(members))
        self.links: list[tuple[int, int]] = []
        self.tree = VantageTree(members, LEAF, distance)
        at, leaves, who = self.tree.route(members)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(self.tree.leaves + 1))
        self.of = [order[bounds[i] : bounds[i + 1]] for i in range(self.tree.leaves)]
        if compare:
            for leaf, guests in enumerate(_grouped(leaves, who, self.tree.leaves)):
                own = self.of[leaf]
                self._meet(np.concatenate([own, guests]), members, own, 0)

    def _roots(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def _meet(self, asking: np.ndarray, points: np.ndarray, own: np.ndarray, offset: int) -> None:
        """Link what lies within the distance; ``asking`` are places in ``points``, known under place plus ``offset``."""
        mine, theirs = self._roots(own), self._roots(asking + offset)
        if not len(mine) or not len(theirs) or (mine[0] == mine).all() and (mine[0] == theirs).all():
            return
        near = np.bitwise_count(points[asking][:, None] ^ self.members[own][None, :]) <= self.distance
        near &= theirs[:, None] != mine[None, :]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            a, b = asking[i] + offset, own[j]
            ra, rb = self._root(a), self._root(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.links.append((int(points[asking[i]]), int(self.members[b])))

    def _root(self, at: int) -> int:
        while (up := self.parent[at]) != at:
            self.parent[at] = at = self.parent[up]
        return at

    def visit(self, points: np.ndarray) -> None:
        size = len(self.members)
        self.parent = np.concatenate([self.parent[:size], np.arange(size, size + len(points))])
        _, leaves, who = self.tree.route(points, home=False)
        for leaf, guests in enumerate(_grouped(leaves, who, self.tree.leaves)):
            if len(guests):
                self._meet(guests, points, self.of[leaf], size)

    def take(self) -> pd.DataFrame:
        """The links since the last call. Roots are the smallest places, so members never hang on a visitor."""
        found = np.array(self.links or np.zeros((0, 2)), np.uint64).reshape(-1, 2).view(np.int64)
        self.links = []
        return pd.DataFrame({"node": found[:, 0], "leader": found[:, 1]})


def _grouped(leaves: np.ndarray, who: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(leaves, kind="stable")
    bounds = np.searchsorted(leaves[order], np.arange(n + 1))
    who = who[order]
    return [who[bounds[i] : bounds[i + 1]] for i in range(n)]


def _route(tree: VantageTree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            at, leaves, who = tree.route(own.view(np.uint64))
            yield pd.DataFrame({"shard": at, "guest": False, "fp": own})
            for a in range(0, len(who), VISITORS):
                yield pd.DataFrame({"shard": leaves[a : a + VISITORS], "guest": True, "fp": own[who[a : a + VISITORS]]})

    return run


def _search(distance: int):
    """Links of the rows of each (shard, salt), its members first; salt 0 also compares the members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members, shard = None, [], None
        for batch in batches:
            names = batch["shard"].to_numpy(np.int64) << 20 | batch["salt"].to_numpy(np.int64)
            guest, fps = batch["guest"].to_numpy(bool), batch["fp"].to_numpy(np.int64).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (guest[1:] != guest[:-1])) + 1, [len(names)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != key:
                    if members:  # a shard without visitors
                        yield _Shard(np.concatenate(members), distance, key & 0xFFFFF == 0).take()
                    key, members, shard = names[a], [], None
                if not guest[a]:
                    members.append(fps[a:b])
                    continue
                if members:
                    shard, members = _Shard(np.concatenate(members), distance, key & 0xFFFFF == 0), []
                if shard is not None:
                    shard.visit(fps[a:b])
                    yield shard.take()
        if members:
            yield _Shard(np.concatenate(members), distance, key & 0xFFFFF == 0).take()

    return run


def links(fingerprints: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """(node, leader) pairs of ``fp`` within the distance, enough to connect all that are; ``fp`` (long) are distinct."""
    total = fingerprints.count()
    shards = max(1, min(-(-total // shard), SAMPLE // PER_SHARD))
    none = fingerprints.sparkSession.createDataFrame([], "node long, leader long")
    if total < 2:
        return none
    share = min(1.0, shards * PER_SHARD / total)
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    # At most SAMPLE fingerprints, however many there are.
    points = np.array(sorted(r.fp for r in fingerprints.where(chosen).limit(SAMPLE).collect()), np.int64).view(np.uint64)
    tree = VantageTree(points, max(1, len(points) // shards), distance)
    routed = stage(fingerprints.mapInPandas(_route(tree), "shard long, guest boolean, fp long"))
    sizes = routed.groupBy("shard").agg(F.ceil(F.count_if("guest") / PER_TASK).cast("int").alias("salts"))
    # One row per shard, of which there are at most SAMPLE.
    rows = routed.join(F.broadcast(sizes), "shard")
    own = rows.where("not guest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest("salts", F.lit(1)) - 1)))
    guests = rows.where("guest").withColumn("salt", F.pmod(F.xxhash64("fp"), F.greatest("salts", F.lit(1))).cast("int"))
    dealt = own.unionByName(guests).select("shard", "salt", "guest", "fp").repartition(max(1, min(tree.leaves, 20_000)), "shard", "salt")
    dealt = dealt.sortWithinPartitions("shard", "salt", "guest")
    return dealt.mapInPandas(_search(distance), "node long, leader long")


def _sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``fp`` is the fingerprint as a signed long, ``component_id`` the smallest doc_id that links of at most ``distance``
    differing bits reach. A null text is empty; texts without words have fingerprint 0 and link like any other. Repeated
    rows keep their number. A null doc_id is in its class but names it only if all are null. An empty table gives no rows.
    """
    signed = stage(docs.select("doc_id", F.pandas_udf(_sign, "long")(F.col("text").cast("binary")).alias("fp")))
    nodes = stage(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = components(links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    firsts = stage(named.join(nodes, "fp").groupBy("component").agg(F.min("first").alias("least")))
    known = named.join(broadcast_if_small(firsts), "component").select("fp", "least")
    nodes = stage(nodes.join(known, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return signed.join(broadcast_if_small(nodes), "fp").select("doc_id", "fp", "component_id")
