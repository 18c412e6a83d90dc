import random

import numpy as np
import pytest
import xxhash

from lotwise.llm import simhash_vp as S

WHITE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def clustered(seed, far=300, centres=30, each=20, flips=4):
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(far)}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            x = centre
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    return np.array(sorted(points), np.uint64)


def near_pairs(points, distance=2):
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= distance, 1))
    return list(zip(i.tolist(), j.tolist()))


def test_fingerprint():
    rng = random.Random(1)
    words = ["Alpha", "BETA", "é", "É", "日本", "\x1c", "a\xa0b"]
    texts = ["", None, "One", "two WORDS", "a b c", " \n\t", *["".join(rng.choice(words) + rng.choice(WHITE) for _ in range(rng.randrange(400))) for _ in range(40)]]
    for t in texts:
        assert S.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_long_text(monkeypatch):
    text = " ".join(str(i * 7 % 1000) for i in range(3000))
    monkeypatch.setattr(S, "CHUNK", 170)
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("seed,distance", [(1, 2), (2, 2), (3, 0), (4, 5)])
def test_every_pair_meets_once(seed, distance):
    points = clustered(seed)
    tree = S.VantageTree(points[::3], 15, distance)
    at, leaves, who = tree.route(points)
    assert tree.leaves > 10 and (at >= 0).all()
    home = {i: {int(a)} for i, a in enumerate(at)}
    visits = {}
    for leaf, i in zip(leaves.tolist(), who.tolist()):
        assert leaf not in visits.setdefault(i, set()) and leaf not in home[i]
        visits[i].add(leaf)
    for i, j in near_pairs(points, distance):
        met = (at[i] == at[j]) + (int(at[j]) in visits.get(i, ())) + (int(at[i]) in visits.get(j, ()))
        assert met == 1


@pytest.mark.parametrize("shard,per_task,visitors", [(60, 50, 17), (10_000, 10, 10), (200, 1_000_000, 100_000)])
def test_links_connect_what_is_near(spark, monkeypatch, shard, per_task, visitors):
    monkeypatch.setattr(S, "PER_TASK", per_task)
    monkeypatch.setattr(S, "VISITORS", visitors)
    monkeypatch.setattr(S, "LEAF", 12)
    points = clustered(9)
    rows = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    got = [(place[r.node], place[r.leader]) for r in S.links(rows, shard=shard).collect()]
    assert all(np.bitwise_count(points[a] ^ points[b]) <= 2 for a, b in got)
    assert connected(len(points), got) == connected(len(points), near_pairs(points))
    assert len(got) < 4 * len(points)


def test_dense_cluster(spark):
    rng = random.Random(3)
    points = np.array(sorted({sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(4000)}), np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = S.links(rows, shard=500).collect()
    assert len(set(connected(len(points), near_pairs(points)))) == 1
    place = {int(x): i for i, x in enumerate(points.view(np.int64))}
    assert len(set(connected(len(points), [(place[r.node], place[r.leader]) for r in got]))) == 1


def test_classes(spark, prose):
    rng = random.Random(5)
    rows = [(i, prose(i, 60)) for i in range(60)] + [(100 + i, prose(i, 60)) for i in range(20)] + [(7, prose(3, 60)), (8, prose(8, 60))]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a B"), (None, prose(2, 60)), (None, "alone here"), (9, None)]
    for i in range(30):
        words = prose(50, 900).split()
        words[rng.randrange(900)] = "other"
        rows.append((300 + i, " ".join(words)))
    found = S.classes(spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")).collect()
    points = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    parts = connected(len(rows), near_pairs(points))
    least = {}
    for (i, _), p in zip(rows, parts):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = sorted((str(i), int(np.int64(np.uint64(x).view(np.int64))), str(least.get(p))) for (i, _), x, p in zip(rows, points, parts))
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in found) == want


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in S.classes(spark.createDataFrame([(4, None)], "doc_id long, text string")).collect()] == [(4, 0, 4)]
