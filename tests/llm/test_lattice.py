import random

import public_tokenizers
import pytest
import sentencepiece

from lotwise.llm import lattice as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def arrays(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, -1, "w") for i, t in enumerate(texts)], "doc_id long, text string, row long, word string")
    pieces = L.load_pieces(spark, PATH)
    encoded = L.encode(docs, pieces, **kw)
    return {r.doc_id: list(r.ids) for r in L.assemble(encoded).collect()}, {r.doc_id: r for r in L.summarise(encoded).collect()}


@pytest.mark.parametrize("hot", [40, 10**6])
def test_equals_the_library(spark, prose, hot):
    rng = random.Random(3)
    texts = [prose(i, 60) for i in range(6)] + [None, "", " ", "  two  spaces ", "a\nb\n\n c\t", "café \U0001f600中文 \x00x", "x" * 900, "aaaaaaaaab" * 40, "ab" * 300]
    texts += ["".join(rng.choice("theiraonsl  .,'\n-Eé") for _ in range(200)) for _ in range(10)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, sums = arrays(spark, texts, hot=hot)
    for i, t in enumerate(texts):
        want = model.encode(t or "")
        assert ids[i] == want, (i, t)
        assert sums[i].n_pieces == len(want) and sums[i].exact
        assert model.decode(ids[i]) == (t or "")


def test_scores_against_brute_force(spark):
    """A model without merges: the best sum of scores among all segmentations."""
    rows = [(0, "<unk>", 0.0, "special", "")] + [
        (i + 1, p, s, "normal", p.replace(L.SPACE, " ").encode().hex()) for i, (p, s) in enumerate(
            {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "ba": -2.2, "aba": -3.9, "▁a": -2.9, "bab": -3.1}.items())
    ]
    pieces = spark.createDataFrame(rows, L.PIECES)
    by_name = {r[1]: (r[0], r[2]) for r in rows[1:]}
    rng = random.Random(1)
    words = {"▁" + "".join(rng.choice("abz") for _ in range(rng.randrange(0, 9))) for _ in range(60)}

    def best(word):
        paths = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            found = []
            for s in range(e):
                if paths[s] is not None:
                    if word[s:e] in by_name:
                        i, score = by_name[word[s:e]]
                        found.append((paths[s][0] + score, paths[s][1] + [i]))
                    elif e - s == 1:
                        found.append((paths[s][0] - 3.9 - 10.0, paths[s][1] + [0]))
            paths[e] = max(found) if found else None
        return paths[-1]

    got = {r.word: list(r.ids) for r in L.dictionary(spark.createDataFrame([(w,) for w in words], "word string"), pieces, merges=False).collect()}
    for w in words:
        want = best(w)
        score = sum(by_name[rows[i][1]][1] if i else -13.9 for i in got[w])
        assert abs(score - want[0]) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x")], "doc_id long, text string")
    rows = L.summarise(L.encode(docs, L.load_pieces(spark, PATH))).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert L.summarise(L.encode(docs.where("false"), L.load_pieces(spark, PATH))).count() == 0


def test_merges_helper():
    assert L._merge("abc", {"ab": -2.0, "bc": -1.0}) == ["a", "bc"] and L._merge("aaa", {"aa": 0.0}) == ["aa", "a"]


def test_edges_on_no_whole_path_go(spark):
    """Merges leave one path through a word, so the fold gets its edges only."""
    import pandas as pd

    pieces = L.load_pieces(spark, PATH)
    score = {r.piece: r.score for r in pieces.where("kind = 'normal'").collect()}
    ids = {r.piece: r.id for r in pieces.where("kind = 'normal'").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = [L.SPACE + w for w in ("thlyly", "ofthinorwh", "unbelievably", "Öwhining", "x" * 40)]
    edges = [
        sorted((s, e, ids[w[s:e]]) for s in range(len(w)) for e in range(s + 1, min(len(w), s + 16) + 1) if w[s:e] in ids) for w in words
    ]
    import numpy as np

    columns = [pd.Series([np.array([x[k] for x in es]) for es in edges]) for k in range(3)]
    (got,) = L._steps(score).func(iter([(pd.Series(words), *columns)]))
    for w, es, keep in zip(words, edges, got["keep"]):
        assert [es[j][2] for j in keep] == model.encode(w[1:]) and len(keep) < len(es)


def test_only_pairs_on_the_way_are_compared(spark, monkeypatch):
    """A word is searched for its one path; not every pair of neighbours in its lattice is merged."""
    import numpy as np
    import pandas as pd

    pieces = L.load_pieces(spark, PATH)
    rows = pieces.where("kind = 'normal'").collect()
    score, ids = {r.piece: r.score for r in rows}, {r.piece: r.id for r in rows}
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = [L.SPACE + w for w in ("unbelievably", "oftionnten", "thonsintheringand", "anhe", "ndshanreea", "中a")]
    edges, pairs = [], 0
    for w in words:
        es = [(s, e, ids.get(w[s:e], L.OUTSIDE - s)) for s in range(len(w)) for e in range(s + 1, min(len(w), s + 16) + 1) if w[s:e] in ids or e == s + 1]
        edges.append(es)
        pairs += sum(a[1] == b[0] for a in es for b in es)
    merged = []
    merge = L._merge
    monkeypatch.setattr(L, "_merge", lambda text, score: merged.append(text) or merge(text, score))
    columns = [pd.Series([np.array([x[k] for x in es]) for es in edges]) for k in range(3)]
    (got,) = L._steps(score).func(iter([(pd.Series(words), *columns)]))
    for w, es, keep in zip(words, edges, got["keep"]):
        if all(es[j][2] >= 0 for j in keep):
            assert [es[j][2] for j in keep] == model.encode(w[1:])
        assert "".join(w[es[j][0] : es[j][1]] for j in keep) == w
    assert len(merged) < pairs / 4
