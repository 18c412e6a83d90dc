import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lotwise.llm import alignment as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [*" \n\t\r", "  ", "a", "ab", "The", "é", "日", "ʼ", "٣", "́", "Ж", "\x85", "\xa0", "　", "\x1c", ".", ",", "'s", "12", "<|endoftext|>", "</s>", "▁", "\x00", "😀"]


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(PATH_A, PATH_B)


class Whole:
    """Tokens of whole texts by the libraries and links by comparing every two of them."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        self.chars = A.byte_of_char()

    def of_a(self, i):
        return bytes(self.chars[c] for c in self.a.id_to_token(i))

    def of_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def spans(self, ids, of):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at += len(of(i))
        return out

    def __call__(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not b"".join(map(self.of_a, a)) == b"".join(map(self.of_b, b)) == (" " + text).encode():
            return None
        a, b = self.spans(a, self.of_a), self.spans(b, self.of_b)
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [
            ",".join(str(x) for x, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(y) for y, s, e in b if lo <= s and e <= hi)
            for lo, hi in zip([0, *cuts[:-1]], cuts)
        ]
        return len(a), len(b), links, groups


def brute(rows):
    whole = Whole()
    found = [(i, whole(t)) for i, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[2]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((str(i), 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = f
        good = sum(count[p] == best[p[0]] for p in links)
        out.append((str(i), n_a, n_b, len(groups), len(links), good, sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out)


def figures(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r.doc_id), *(r[c] for c in names)) for r in df.collect())


def corpus(prose, n=40):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    rows += [(200 + i, prose(i, rng.randrange(1, 120))) for i in range(n)] + [(7, prose(1, 50)), (7, prose(1, 50)), (None, "null id, here")]
    rows += [(300, None), (301, ""), (302, " "), (303, "\n"), (304, "a\r"), (305, "x" * 5000), (306, "don't can't 'tis it'll"), (307, "end. "), (308, "▁")]
    return rows


def test_cut_keeps_both_tokenizations(aligner, prose):
    whole, seen = Whole(), 0
    for _, text in corpus(prose, 10):
        if text and len(text) < 1000:
            pieces = aligner.cut(" " + text)
            assert "".join(pieces) == " " + text
            aligner.learn(pieces)
            codes = [aligner.known[p] for p in pieces]
            want = whole(text)
            assert (want is None) == (not all(aligner.sizes[c, 4] for c in codes))
            if want:
                seen += 1
                assert b";".join(aligner.groups[c] for c in codes).decode() == ";".join(want[3])
    assert seen > 60


def test_against_brute_force(spark, prose, monkeypatch):
    rows = corpus(prose)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, radix int, task string").repartition(3)
    assert figures(A.align(frame, PATH_A, PATH_B)) == brute(rows)
    # Many small runs, merged a few at a time in small blocks, dealt over several tasks.
    for name, value in (("HELD", 300), ("CHUNK", 40), ("BLOCK", 7), ("AT_ONCE", 3), ("TASK_BYTES", 2000), ("REMEMBERED", 60)):
        monkeypatch.setattr(A, name, value)
    small = A.align(frame, PATH_A, PATH_B, keep_groups=True)
    assert figures(small) == brute(rows)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in small.collect())


def test_merge_runs():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 300, rng.integers(0, 120))).astype(np.uint32)
        runs.append((keys, rng.integers(1, 9, len(keys))))
    want = Counter()
    for keys, counts in runs:
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    blocks = lambda k, c: iter([(k[a : a + 10], c[a : a + 10]) for a in range(0, len(k), 10)])
    out = list(A.merge_runs([blocks(*r) for r in runs]))
    keys = np.concatenate([k for k, _ in out])
    assert (np.diff(keys.astype(int)) > 0).all()
    assert dict(zip(keys.tolist(), np.concatenate([c for _, c in out]).tolist())) == dict(want)


def test_codes(aligner):
    a, b = np.array([0, 31, 32, 50_256]), np.array([0, 31_999, 5, 7])
    back = aligner.ids(aligner.code(a, b).astype(np.uint32))
    assert back[0].tolist() == a.tolist() and back[1].tolist() == b.tolist()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(none, PATH_A, PATH_B).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert figures(A.align(blank, PATH_A, PATH_B)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]
