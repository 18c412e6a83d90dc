import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotwise.llm import rangecoder as R
from lotwise.llm import tokenfiles as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("vocabulary", [2, 300, 65_536])
def test_coder_round_trip(vocabulary):
    rng = np.random.default_rng(vocabulary)
    blocks = [rng.integers(0, vocabulary, n) for n in (0, 1, 2, 3000)] + [np.minimum(rng.zipf(1.4, n) - 1, vocabulary - 1) for n in (5, 700, 2500)]
    blocks += [np.full(4000, vocabulary - 1), np.arange(2000) % vocabulary, np.tile(rng.integers(0, vocabulary, 50), 60)]
    units = R.encode_blocks(blocks, vocabulary)
    back = R.decode_blocks(units, [len(b) for b in blocks], vocabulary)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    alone = R.encode_blocks([blocks[5]], vocabulary)[0]
    assert (alone == units[5]).all()  # a block does not depend on those beside it
    if vocabulary > 2:
        assert 16 * len(units[-1]) < 0.6 * 3000 * np.log2(vocabulary) + 64  # what repeats is predicted


def test_damage_is_noticed():
    ids = np.arange(100)
    block = R.pack([1, None], [40, 60], ids, R.encode_blocks([ids], 200)[0], 200)
    keys, sizes, units, vocabulary, crc, marks = R.unpack(block)
    assert marks.tolist() == [0, R.NULL]
    assert keys == [1, None] and sizes.tolist() == [40, 60] and crc == zlib.crc32(ids.astype("<u4").tobytes())
    assert (R.decode_blocks([units], [100], vocabulary)[0] == ids).all()
    for at in (0, 9, 30, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            R.unpack(bytes(broken))


def test_cuts_do_not_change_the_encoding():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t\x1c\x85\xa0 　'st1,é中<|endoftext|>") for _ in range(rng.randrange(30))) for _ in range(500)]
    texts += ["a  <|endoftext|>  b", "", " x  ", "it's  we'll\r\n"]
    plain = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert all(a[:-1].tolist() == b.ids and a[-1] == 0 for a, b in zip(T._Encoder(PATH)(texts), plain))


@pytest.mark.parametrize("block", [50, T.BLOCK_IDS])
def test_files_against_the_library(spark, prose, block):
    rng = random.Random(7)
    rows = [(i * 3 % 61, prose(i, rng.randrange(0, 200))) for i in range(61)] + [(70, None), (71, ""), (72, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start long").repartition(5)
    got = {r.doc_id: r for r in T.read_back(T.write(df, PATH, block)).collect()}
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for i, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)) and bytes(got[i].ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    assert len(got) == len(rows)


def test_texts_of_hundreds_of_thousands_of_ids(spark):
    rng = random.Random(3)
    rows = [(1, "short"), (2, " ".join(f"{rng.randrange(10**6)}" for _ in range(110_000))), (3, ""), (4, "ab " * 300_000), (5, "end")]
    got = {r.doc_id: r for r in T.read_back(T.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).collect()}
    tokenizer, start = Tokenizer.from_file(PATH), 0
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)) and bytes(got[i].ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    assert got[2].n_tokens > 262_144 and len(got) == 5


def test_a_block_has_a_size():
    with pytest.raises(ValueError):
        R.encode_blocks([np.zeros(R.LONGEST + 1, np.int64)], 10)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert T.read_back(T.write(spark.createDataFrame([], schema), PATH)).count() == 0
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], schema)
    got = sorted((r.start, r.doc_id) for r in T.read_back(T.write(odd, PATH)).collect())
    assert got == [(0, None), (2, 1), (4, 1)]


def test_frequencies_of_a_wave_are_kept_once(spark):
    import numpy as np

    from lotwise.llm import rangecoder as R

    model = R._Model(40, 1000)
    model.seen[37, 5] = 3
    model.rebuild(40)
    assert np.shares_memory(model.flat, model.sums) and model.sums.itemsize == 4
    assert R._Model(1, 65_536).span * R.LANES < 1 << 31
    lanes = np.array([0, 37])
    assert model.below(lanes, np.array([6, 6])).tolist() == [6, 6 + 3 * R.WEIGHT] and model.total[37] == 1000 + 3 * R.WEIGHT


def test_a_block_is_coded_in_strands():
    """A full block takes as many steps as its longest strand has ids, and its strands share what they learn."""
    assert [R._strands(n).tolist() for n in (0, 1, 511, 512, 515)] == [[0], [1], [511], [256, 256], [258, 257]]
    assert R._strands(T.BLOCK_IDS).tolist() == [T.BLOCK_IDS // R.STRANDS] * R.STRANDS
    rng = np.random.default_rng(5)
    sizes = [0, 1, 255, 256, 511, 513, 5000, 4097, 20_001]
    blocks = [np.minimum(rng.zipf(1.3, n) - 1, 50_256) for n in sizes]
    units = R.encode_blocks(blocks, 50_257)
    assert all((a == b).all() for a, b in zip(blocks, R.decode_blocks(units, sizes, 50_257)))
    words = units[-1][: R.STRANDS].astype(int)
    assert len(units[-1]) == R.STRANDS + 2 * words.sum() and words.min() > 2
    text = np.tile(rng.integers(0, 50_257, 499), 33)[:16_000]
    (repeated,) = R.encode_blocks([text], 50_257)
    assert 16 * len(repeated) < 2.5 * len(text)  # strands apart would take over 15 bits for half of their ids
