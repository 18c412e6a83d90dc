import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotwise.llm import mixing as M


def digest(epoch, key):
    return hashlib.md5(f"{M.SEED}:{epoch}:{'' if key is None else key}".encode()).hexdigest()


def brute(rows, target, limit):
    """rows: (doc_id, source, tokens). Rows taken, (doc_id, source, epoch)."""
    tokens = defaultdict(int)
    for _, s, n in rows:
        tokens[s] += n
    logs = sorted(math.log(n / sum(tokens.values())) for n in tokens.values() if n)

    def entropy(t):
        z = sum(math.exp(x * t) for x in logs)
        return math.log(z) - sum(math.exp(x * t) * x * t for x in logs) / z

    t = 1.0
    if logs and entropy(1.0) < target * math.log(len(logs)):
        lo, hi = 0.0, 1.0
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(mid) >= target * math.log(len(logs)) else (lo, mid)
        t = lo
    if logs and logs[-1] > logs[0]:
        t = round(max(t, 1 - math.log(limit) / (logs[-1] - logs[0])), 9)
    power = {s: (n / sum(tokens.values())) ** t for s, n in tokens.items() if n}
    cover = max((tokens[s] / p for s, p in power.items()), default=0)
    out = []
    for s, n in tokens.items():
        epochs = round(power[s] * cover / n, 6) if n else 1.0
        full, rest = int(epochs), int(n * (epochs - int(epochs)))
        own = [(i, k) for i, x, k in rows if x == s]
        for e in range(full):
            out += [(i, s, e) for i, _ in own]
        if rest:
            done = 0
            for place in sorted({digest(full, i) for i, _ in own}):
                same = [(i, k) for i, k in own if digest(full, i) == place]
                done += sum(k for _, k in same)
                if done > rest:
                    break
                out += [(i, s, full) for i, _ in same]
    return out


@pytest.mark.parametrize("target,limit", [(0.9, 2.0), (0.99, 1.5), (0.5, 4.0), (0.999, 10.0)])
def test_against_brute_force(spark, target, limit):
    rows = [(i, "big", 1 + i % 50) for i in range(3000)] + [(10_000 + i, f"s{i % 6}", i % 90) for i in range(700)]
    rows += [(20_000, None, 40), (20_001, None, 3), (20_002, "empty", 0), (20_003, "one", 5), (20_003, "one", 5)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n), n, "m") for i, s, n in rows], "doc_id long, source string, text string, n_tokens long, mix string")
    slim = M.sized(docs)
    plan = M.plan(slim, target, limit)
    taken = M.realise(slim, plan)
    got = sorted(((r.doc_id, r.source, r.mix.epoch) for r in taken.collect()), key=str)
    assert got == sorted(brute(rows, target, limit), key=str)
    assert {r[0] for r in got} == {r[0] for r in rows}  # nothing is left out
    kept = M.realise(docs, plan)
    assert kept.count() == len(got) and kept.columns == ["doc_id", "source", "text", "n_tokens", "mix"]
    most = plan.agg(F.max("epochs")).first()[0]
    assert most <= limit + 1e-6
    blocks = M.arrange(taken, plan, block_tokens=5000)
    assert blocks.count() == len(got)
    places = blocks.groupBy("block").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert all(p.a == 1 and p.b == p.n for p in places) and max(p.t for p in places) < 6000
    share = blocks.where("source = 'big'").groupBy("block").agg(F.sum("n_tokens").alias("t")).collect()
    assert max(s.t for s in share) - min(s.t for s in share) < 150  # each block holds the source at its weight


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    slim = M.sized(none)
    assert M.arrange(M.realise(slim, M.plan(slim)), M.plan(slim)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, ""), (None, "a", " ")], "doc_id long, source string, text string")
    slim = M.sized(blank)
    plan = M.plan(slim)
    assert M.realise(slim, plan).count() == 3 and M.arrange(M.realise(slim, plan), plan).count() == 3
