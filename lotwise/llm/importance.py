"""Importance resampling towards a target distribution: hashed word n-grams weighed by target against raw frequency.

A text is normalised to words joined by one space, and the running CRC-32 of that string is noted at each end of a word.
The CRC of any n-gram, a substring, follows from the two prefixes around it: a CRC is linear over GF(2), so shifting the
earlier prefix by the n-gram's length and adding it to the later one cancels everything before the n-gram. Each byte is
read once, whatever the sizes of the n-grams; shifts are four table look-ups for lengths below 256 and one more such step
for each set bit above.

Texts are handled in slices of words, so a very long one costs no more memory than its own bytes. Bucket counts leave a
task as one row per bucket. The draw is a Gumbel top-k: rows are dealt by ranges of their score, and a row's rank is its
place in its range and the sizes of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import stage

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
# Words handled at once, bytes of a text split into words at once.
CHUNK_WORDS = 100_000
SLICE = 1 << 19
KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in KEPT or b >= 128 else 32 for b in range(256))


def _step(c: np.ndarray) -> np.ndarray:
    """The register after one zero byte more."""
    return _BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_BYTE = _byte_table()


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear operator, as tables of its four bytes, applied to each register."""
    out = table[0][c & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= table[k][(c >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Operators for 0 to 255 zero bytes, and for 256 times each power of two."""
    low = np.empty((256, 4, 256), np.uint32)
    low[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 256):
        low[n] = _step(low[n - 1])
    high = [_step(low[255])]
    for _ in range(23):
        high.append(_through(high[-1], high[-1]))
    return low, high


_LOW, _HIGH = _shift_tables()
_LOW_FLAT = _LOW.reshape(-1)


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes of what follows them."""
    base = (length & 255).astype(np.int64) << 10
    out = _LOW_FLAT[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= _LOW_FLAT[base + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    rest = length >> 8
    bit = 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        if len(at):
            out[at] = _through(_HIGH[bit], out[at])
        rest, bit = rest >> 1, bit + 1
    return out


def _slices(data: bytes) -> Iterator[bytes]:
    """The folded text in parts that end between words."""
    data = data.translate(FOLD)
    at = 0
    while len(data) - at > SLICE:
        cut = data.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _chunks(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """Words of some slices, and for each slice its text, words and how many at its front were in the slice before."""
    words: list[bytes] = []
    owner, size, again = [], [], []
    for number, text in enumerate(texts):
        tail: list[bytes] = []
        for part in _slices(text or b""):
            new = part.split()
            words += tail
            words += new
            owner.append(number)
            size.append(len(tail) + len(new))
            again.append(len(tail))
            tail = (tail + new)[1 - LONGEST :]
            if len(words) >= CHUNK_WORDS:
                yield words, owner, size, again
                words, owner, size, again = [], [], [], []
    yield words, owner, size, again


def _after_space(crc: np.ndarray) -> np.ndarray:
    """CRCs of what they stand for and one space more."""
    register = ~crc
    return ~(_BYTE[(register ^ np.uint32(0x20)) & np.uint32(255)] ^ (register >> np.uint32(8)))


def features(texts: Iterable[bytes | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of texts: (text number of every feature, its bucket), (text numbers of slices, their new words)."""
    run = lambda c, w: crc32(w, c)
    for words, owner, size, again in _chunks(texts):
        n = len(words)
        owners, sizes, seen = (np.array(x, np.int64) for x in (owner, size, again))
        part = np.repeat(np.arange(len(sizes)), sizes)
        old = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) < seen[part]
        length = np.fromiter(map(len, words), np.int64, n)
        # Prefixes up to each end of a word, over all slices in a row; before a word they have one space more.
        ends = np.fromiter(accumulate(words[:1] + [b" " + w for w in words[1:]], run, initial=0), np.uint32, n + 1)[1:]
        begins = np.zeros(n, np.uint32)
        begins[1:] = _after_space(ends[:-1])
        stop = np.cumsum(length + 1) - 1
        start = stop - length
        texts_of, found = [], []
        for size_n in range(1, LONGEST + 1):
            first = np.arange(max(0, n - size_n + 1))
            last = first + size_n - 1
            inside = (part[first] == part[last]) & ~old[last]
            first, last = first[inside], last[inside]
            crc = ends[last] ^ shift(begins[first], stop[last] - start[first])
            texts_of.append(owners[part[first]])
            found.append(crc % np.uint32(buckets))
        yield np.concatenate(texts_of), np.concatenate(found).astype(np.int64), owners, sizes - seen


def _count(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _, _ in features(batch["text"], buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of every row of ``texts`` (text; other columns are ignored)."""
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(_count(buckets), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the smoothed log ratio of target and raw frequency, rounded down."""
    raw = bucket_counts(docs, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(target, buckets).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(aim, "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (text) with a struct ``_sum`` of n_words, n_features and weight, the sum of gains over the features.

    ``gain`` has one number per bucket, so its size is fixed; they go to the tasks as one array. A null text has none.
    """
    table = np.zeros(buckets, np.int64)
    for row in gain.collect():
        table[row.bucket] = row.gain

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            out = {c: np.zeros(n, np.int64) for c in ("n_words", "n_features", "weight")}
            for text, found, slices, words in features(texts, buckets):
                np.add.at(out["n_words"], slices, words)
                if len(text):
                    low = int(text.min())
                    each = np.bincount(text - low)
                    out["n_features"][low : low + len(each)] += each
                    # Exact: sums of whole numbers far below 2 ** 53.
                    out["weight"][low : low + len(each)] += np.bincount(text - low, table[found]).astype(np.int64)
            yield pd.DataFrame(out)

    sums = F.pandas_udf(run, "n_words long, n_features long, weight long")
    return docs.withColumn("_sum", sums(F.col("text").cast("binary")))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on seed and id alone, rounded down; a null id counts as an empty string."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, weight, score, others) with ``rank``: 1, 2, 3... of those drawn, else null.

    Drawn are floor(percent * N / 100) of the N rows with at least ``least_words`` words: the highest scores, ties to
    smaller doc_id, a null one last. Rows alike in all of these may change places, which shows in no other column of theirs.
    """
    short = F.col("n_words") < least_words
    keys = [short.asc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum(F.when(short, 0).otherwise(1)).alias("_long"))
    # One row per range.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    eligible = sizes.agg(F.sum("_long")).first()[0] or 0
    rank = F.col("_before") + place + 1
    found = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    drawn = F.when(rank <= eligible * percent // 100, rank).cast("long")
    return found.select(*rows.columns, drawn.alias("rank"))


def score(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score; ``docs`` must hold no columns of those names."""
    rows = weigh(docs, gains(docs, target, buckets), buckets)
    rows = rows.select(*docs.columns, "_sum.*")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, others) with a struct ``importance``: n_words, n_features, weight, score, rank.

    ``target`` has texts of the distribution aimed at. Features are runs of one to three words (letters a to z in lower
    case, digits and all beyond ASCII), repeats counted. A null or empty text has none and weight 0. Rank is null for rows
    that aren't drawn. Repeated rows are ranked each. An input column ``importance`` is replaced; an empty table gives no
    rows, an empty target the same gain structure with no target counts.
    """
    names = ["n_words", "n_features", "weight", "score"]
    others = [c for c in docs.columns if c != "importance"]
    held = docs.select("doc_id", "text", F.struct(*others).alias("_row"))
    found = draw(score(held, target, buckets, seed).drop("text"), percent, least_words)
    return found.select("_row.*", F.struct(*names, "rank").alias("importance"))
