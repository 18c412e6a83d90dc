import random

import numpy as np

from lotwise.llm import dartminhash as D


def brute(rows, threshold=0.8):
    """{place of the row: class} by comparing all texts."""
    words = D._Words()
    texts = sorted({t or "" for _, t in rows})
    sets = {t: D.shingles([D.split_words(t)], words)[1:] for t in texts}
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if D.weighted_jaccard(sets[a], sets[b]) >= threshold:
                up[top(a)] = top(b)
    ids = {}
    for i, t in rows:
        k = top(t or "")
        ids.setdefault(k, []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, least[top(t or "")]) for i, t in rows), key=str)


def near(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_estimates_are_unbiased():
    a, b = [f"w{i}" for i in range(400)] * 2, [f"w{i}" for i in range(400)]
    b[10] = b[200] = "other"
    text, element, weight = D.shingles([a, b], D._Words())
    signs = D.signatures(text, element, weight, 2, 6000)
    true = D.weighted_jaccard(*[(element[text == i], weight[text == i]) for i in (0, 1)])
    assert abs((signs[0] == signs[1]).mean() - true) < 0.03
    half = D.signatures(text, element, weight / 2, 2, 4000)  # weights that are not whole numbers
    assert abs((half[0] == half[1]).mean() - true) < 0.03
    assert (D.signatures(text[text == 1] * 0, element[text == 1], weight[text == 1], 1, 6000)[0] == signs[1]).all()


def test_classes_against_brute_force(spark, prose):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randrange(20, 120))) for i in range(60)]
    base = prose(99, 200)
    rows += [(1000 + i, near(rng, base, i % 4)) for i in range(120)] + [(2000 + i, rows[3][1]) for i in range(50)]
    rows += [(3000, None), (3001, ""), (3002, "one two"), (3003, "one two"), (3004, "one two three"), (3005, "one  two"), (None, base), (None, "lonely text here"), (1000, base)]
    chain = prose(77, 150).split(" ")
    for k in range(8):  # each like the next, the ends not alike
        rows.append((4000 + k, " ".join(chain)))
        chain[10 * k : 10 * k + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, class_id int, node string").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in D.classes(df).collect()), key=str)
    assert got == brute(rows)
    kept = D.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in got if c is not None})


def test_empty_table_and_settling(spark):
    assert D.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    texts = [("a", "x y z " * 9), ("b", "x y z " * 9 + "q"), ("c", "other words in this text")]
    places = spark.createDataFrame([("1", n) for n, _ in texts] + [("2", n) for n, _ in texts], "bucket string, node string")
    links = D.settle(places, spark.createDataFrame(texts, "node string, text string")).collect()
    assert [(r.node, r.leader) for r in links] == [("b", "a")] and links[0].similarity < 1
    rows = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "node string, leader string")
    assert {r.component for r in D.components(rows).collect()} == {"0"}


def test_family_of_variants_against_brute_force(spark, prose):
    rng = random.Random(21)
    base = prose(5, 200).split(" ")

    def edited(n):
        words = list(base)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"new{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(0, " ".join(base))] + [(i, edited(1 + i % 4)) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in D.classes(df).collect()), key=str)
    assert got == brute(rows)


def test_rows_like_a_joined_row_only(spark, monkeypatch):
    # b is like a and c like b, but c isn't like a; also where the bucket is dealt in blocks.
    words = [f"w{i}" for i in range(100)]
    texts = [("a", words), ("b", [*words[:90], *(f"b{i}" for i in range(10))]), ("c", [*(f"c{i}" for i in range(10)), *words[10:90], *(f"b{i}" for i in range(10))])]
    texts += [(f"d{i}", [f"d{i}x{k}" for k in range(100)]) for i in range(20)]
    frame = spark.createDataFrame([(n, " ".join(t)) for n, t in texts], "node string, text string")
    places = spark.createDataFrame([("1", n) for n, _ in texts], "bucket string, node string")
    labels = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    for rest in (1000, 8):
        monkeypatch.setattr(D, "REST", rest)
        assert {(r.node, r.leader) for r in D.settle(places, frame, 0.8, labels).collect()} == {("c", "b")}
        joined = D.components(D.settle(places, frame)).collect()
        assert {(r.node, r.component) for r in joined} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_jaccard():
    a, b = (np.array([1, 2, 3], np.uint64), np.array([2.0, 1, 1])), (np.array([2, 3, 9], np.uint64), np.array([1.0, 3, 1]))
    assert D.weighted_jaccard(a, b) == 2 / 7
