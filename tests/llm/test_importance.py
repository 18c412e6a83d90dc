import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lotwise.llm import importance as I
from lotwise.llm.oracles import ORACLES
from lotwise.llm.queries import op12_crc_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % I.BUCKETS for g in found]


def brute(docs, target):
    made = [(i, *grams(t)) for i, t in docs]
    s = Counter(b for _, _, bs in made for b in bs)
    t = Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for i, n, bs in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in bs)
        rows.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((str(r[0]), *r[2:], rank.get(id(r), 0)) for r in rows)


@pytest.fixture
def texts():
    rng = random.Random(4)
    words = ["Alpha", "beta", "Ünï", "日本", "x9", "a'b", "-", "THE", "straße", "\x00", "q\tr"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    return [*enumerate(made), (200, None), (201, ""), (202, "one"), (203, "ab " * 9000), (204, "w" * 3000 + " " + "v" * 500 + " z"), (5, made[5]), (None, made[7])]


@pytest.mark.parametrize("size", [16, 1 << 19])
def test_features(monkeypatch, texts, size):
    monkeypatch.setattr(I, "SLICE", size)
    monkeypatch.setattr(I, "CHUNK_WORDS", 50)
    got, words = [[] for _ in texts], [0] * len(texts)
    for owner, bucket, slices, n in I.features([None if t is None else t.encode() for _, t in texts]):
        for a, b in zip(owner.tolist(), bucket.tolist()):
            got[a].append(b)
        for a, b in zip(slices.tolist(), n.tolist()):
            words[a] += b
    assert [(n, sorted(b)) for n, b in zip(words, got)] == [(n, sorted(b)) for n, b in (grams(t) for _, t in texts)]


def test_shift():
    rng = np.random.default_rng(3)
    crc = rng.integers(0, 2**32, 50, dtype=np.uint32)
    n = rng.integers(0, 70_000, 50)
    tail = b"\x07" * 70_000
    # Appending to a message moves its CRC on; what the tail adds is its own CRC.
    for c, k in zip(crc.tolist(), n.tolist()):
        want = zlib.crc32(tail[:k], c) ^ zlib.crc32(tail[:k])
        assert int(I.shift(np.array([c], np.uint32), np.array([k]))[0]) == want


def test_against_brute_force(spark, texts):
    target = ["alpha THE the beta", None, "", "x9 x9 x9 日本"]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in texts], "doc_id long, text string, importance int, rank string")
    found = I.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.columns == ["doc_id", "text", "rank", "importance"]
    got = sorted((str(r.doc_id), r.importance.n_features, r.importance.weight, r.importance.score, r.importance.rank or 0) for r in found.collect())
    assert got == brute(texts, target)
    assert sum(g[4] > 0 for g in got) == 4 or sum(g[4] > 0 for g in got) == 5


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert I.resample(none, some).count() == 0
    assert I.resample(some, none).first().importance.weight < 0


def test_sql(spark, tmp_path, texts):
    kept = [(i, t) for i, t in texts if i is not None and i < 203 and "\x00" not in (t or "")]
    spark.createDataFrame(kept, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha the THE beta beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sql = con.execute(ORACLES["op12_crc_importance"])
    names = [d[0] for d in sql.description]
    want = sorted(map(str, (tuple(r[names.index(c)] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in sql.fetchall())))
    assert sorted(str(tuple(r)) for r in op12_crc_importance(spark, str(tmp_path)).collect()) == want
