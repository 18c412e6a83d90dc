import math
import random

import numpy as np

from lotwise.llm import nndescent as N


def brute(rows, asked, k):
    """rows: (id, vector) usable ones. {(query, rank): (id, score)}."""
    out = {}
    for q, x in rows:
        if q in asked:
            found = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in {(i, tuple(y)) for i, y in rows} if i != q))[:k]
            out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(found)}
    return out


def recall(got, want):
    hit = {(q, i) for (q, _), (i, _) in got.items()} & {(q, i) for (q, _), (i, _) in want.items()}
    return len(hit) / len(want)


def run(spark, rows, asked, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long")
    index = N.build(df.select("vec_id", "embedding"))
    queries = N.own_starts(index, df.where(df.vec_id.isin(asked)).select("vec_id", "embedding"))
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in N.search(index, queries, k).collect()}, index


def test_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)).astype(np.float32)
    v[:700] /= np.linalg.norm(v[:700], axis=1, keepdims=True)  # norms differ
    v[800:900] = v[800]  # copies
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [math.nan] * 24, 0), (5003, [math.inf] + [1.0] * 23, 0), (5004, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0)]
    asked = list(range(0, 1500, 20)) + [800, 5000, 5001]
    got, _ = run(spark, rows + bad + rows[:3], asked)
    want = brute([(i, x) for i, x, _ in rows], set(asked), 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    exact = {i: np.array(x) for i, x, _ in rows}
    assert all(abs(float(exact[q] @ exact[i]) - s) < 1e-9 for (q, _), (i, s) in got.items())
    assert [got[800, r][0] for r in range(1, 21)] == list(range(801, 821))
    for (q, r), (i, s) in got.items():
        if (q, r + 1) in got:
            assert (-s, i) < (-got[q, r + 1][1], got[q, r + 1][0])


def test_recall_beside_vectors_of_any_size(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((900, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5] *= 1e25
    v[77] *= 1e160
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = N.build(df)
    queries = N.own_starts(index, df.where("vec_id % 30 = 0"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in N.search(index, queries).collect()}
    want = brute(rows, set(range(0, 900, 30)), 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_recall_beside_a_few_long_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((2000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[[7, 400, 1203]] *= [[100.0], [100.0], [1000.0]]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v.astype(np.float32))]
    asked = list(range(0, 2000, 40)) + [7, 1203]
    got, _ = run(spark, rows, asked)
    want = brute([(i, x) for i, x, _ in rows], set(asked), 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95, recall(got, want)


def test_few_rows_and_none(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(5)]
    got, _ = run(spark, rows, [0, 4])
    assert {k: i for k, (i, _) in got.items()} == {(0, r): 5 - r for r in range(1, 5)} | {(4, r): 4 - r for r in range(1, 5)}
    assert run(spark, rows[:1], [0])[0] == {}
    assert run(spark, [], [0])[0] == {}


def test_search_without_starts(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long")
    index = N.build(df.select("vec_id", "embedding"))
    fresh = [(10_000 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(20)]
    found = N.search(index, spark.createDataFrame(fresh, "id long, vector array<double>"), 10)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    stored = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows]
    want = {}
    for q, x in fresh:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in stored)[:10]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert recall(got, want) >= 0.9
