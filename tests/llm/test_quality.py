import math
import random
import re
from collections import Counter

import xxhash

from lotwise.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(texts, trusted, bins, threshold):
    """texts: {id: text}; (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)."""
    grams = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        grams[i] = [long_hash(x) % bins for x in w] + [long_hash(a, b) % bins + bins for a, b in zip(w, w[1:])]
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    total = [(sum(n for b, n in c.items() if (b >= bins) == kind)) for c in (raw, target) for kind in (False, True)]
    part = [total[2 + k] / total[k] for k in (0, 1)]
    ratio = [math.log((target[b] + Q.PRIOR * part[b >= bins]) / (raw[b] + Q.PRIOR) / part[b >= bins]) for b in range(2 * bins)]
    out = {}
    for i, t in texts.items():
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(g)
        cov = {k + d for k, x in enumerate(g) if c[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        score = sum(ratio[b] for b in grams[i]) / (2 * len(w) - 1) if w else None
        out[i] = (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), failed,
            not failed and score >= threshold, score,
        )
    return out


def rows_of(spark, texts, trusted, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, quality string, n_words int")
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    return Q.judge(docs, ids, **kw)


def test_against_brute_force(spark, prose):
    rng = random.Random(5)
    texts = {i: prose(i, rng.randrange(0, 300)) for i in range(40)}
    texts |= {
        100: None, 101: "", 102: " \t\n\x0b\x0c\r ", 103: "one", 104: "a b", 105: "x y z\nx y z\n\nx y z", 106: "| # <>| " * 40,
        107: "same line here\n" * 60, 108: "a\u00a0b c", 109: " ".join(["loop"] * 30_000), 110: prose(1, 200), 111: "\u00e9t\u00e9 \U0001f600 " * 30,
    }
    trusted = {i for i in range(0, 40, 2)} | {None, 999}
    want = brute(texts, trusted - {None}, 256, -0.05)
    got = {r.doc_id: r.quality for r in rows_of(spark, texts, trusted, bins=256, threshold=-0.05).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == w[:6], i
        assert (q.score is None) == (w[7] is None) and (w[7] is None or abs(q.score - w[7]) < 1e-9), i
        if w[7] is None or abs(w[7] + 0.05) > 1e-9:
            assert q.kept == w[6], i


def test_shape_and_edges(spark):
    out = rows_of(spark, {}, {1})
    assert out.columns == ["doc_id", "text", "n_words", "quality"] and out.count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = [(r.doc_id, r.quality.n_words) for r in Q.judge(twice, none).collect()]
    assert sorted(got, key=str) == sorted([(1, 2), (1, 2), (None, 1)], key=str)


def test_labels_of_held_out_documents(spark):
    """Fitted on the even ids' labels, the score keeps good odd ones and drops most of the bad."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    judged = Q.judge(docs, Q.trusted_documents(labels.where("doc_id % 2 = 0"))).where("doc_id % 2 = 1 AND NOT quality.base_failed")
    found = judged.select("doc_id", judged.quality.kept.alias("kept")).join(labels, "doc_id").where("toxic = 0").groupBy("quality").agg({"*": "count"}).collect()
    assert len(found) == 2
    kept = judged.select("doc_id", judged.quality.kept.alias("kept")).join(labels, "doc_id")
    good = kept.where("quality = 1").selectExpr("avg(int(kept)) AS share").first().share
    bad = kept.where("quality = 0").selectExpr("avg(int(kept)) AS share").first().share
    assert good > 0.97 and bad < 0.3


def test_no_python_in_the_plan(spark, capsys):
    d = "/root/testdata/sf0.001"
    trusted = Q.trusted_documents(spark.read.parquet(f"{d}/labels.parquet"))
    Q.judge(spark.read.parquet(f"{d}/documents.parquet"), trusted).explain("formatted")
    assert not re.search("EvalPython|InPandas|InArrow", capsys.readouterr().out)
