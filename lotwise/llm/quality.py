"""Quality rules: counting rules, then a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and pairs of neighbouring words are hashed into a fixed number of bins each. Two multinomials over the bins are
counted over whole corpora: the trusted documents and all documents. A document's score is the mean over its n-grams of
``ln p_target - ln p_raw``; it is kept when no counting rule fails and the score is at least the threshold.

Only the table of bins (its size is the parameter ``bins``) passes the driver, as the value of a scalar subquery; texts
are never shuffled. Trusted keys are broadcast when counted small and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, let, stage, whole_text, words_of

# Bins for words, and as many again for pairs.
BINS = 1 << 14
# Raw occurrences that smoothing adds to each bin, and to the target in proportion to its size: a bin that is rare in the
# raw corpus says little, whether or not the target has it.
PRIOR = 20.0
# Mean log ratio below which a text is unlike the target.
THRESHOLD = -0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Characters counted as symbols
SYMBOLS = "#*$%&|<>"


def _bin_pairs(words: Column, bins: int) -> Column:
    """One struct per word: its own bin, and the bin of the pair it begins (null at the last word)."""
    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.transform(
        F.arrays_zip(words.alias("a"), following.alias("b")),
        lambda p: F.struct(
            F.pmod(F.xxhash64(p["a"]), F.lit(bins)).cast("int").alias("one"),
            F.when(p["b"].isNotNull(), F.pmod(F.xxhash64(p["a"], p["b"]), F.lit(bins)).cast("int") + bins).alias("two"),
        ),
    )


def ngram_counts(docs: DataFrame, trusted: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, raw, target) for every bin that occurs; ``trusted`` has one column, the key of trusted documents.

    Null texts have no n-grams; a repeated key counts each of its rows; keys without a document are ignored.
    """
    keys = trusted.select(F.col(trusted.columns[0]).alias("_key")).where("_key IS NOT NULL").distinct()
    keys = keys.withColumn("_trusted", F.lit(1))
    words = words_of(whole_text(F.col("text")))
    rows = (
        docs.select("doc_id", "text")
        .join(broadcast_if_small(keys), F.col("doc_id") == F.col("_key"), "left")
        .select(F.coalesce("_trusted", F.lit(0)).alias("t"), words.alias("w"))
        .select("t", F.explode(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v"))).alias("p"))
        .select("t", F.col("p.w").alias("a"), F.col("p.v").alias("b"))
    )
    one = F.pmod(F.xxhash64("a"), F.lit(bins)).cast("int")
    two = F.pmod(F.xxhash64("a", "b"), F.lit(bins)).cast("int") + bins
    return (
        rows.select("t", F.explode(F.array(one, F.when(F.col("b").isNotNull(), two))).alias("bin"))
        .where("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count("*").alias("raw"), F.sum(F.col("t").cast("long")).alias("target"))
    )


def log_ratio_table(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """One row with ``ratio``, an array over all bins. Without target n-grams of a size all its ratios are 0."""
    spark = counts.sparkSession
    kind = (F.col("bin") >= bins).cast("int")
    full = (
        spark.range(2 * bins).select(F.col("id").cast("int").alias("bin"))
        .join(counts, "bin", "left")
        .select("bin", kind.alias("kind"), F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    )
    totals = full.groupBy("kind").agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    part = F.try_divide("all_target", "all_raw")
    ratio = F.when(part > 0, F.log((F.col("target") + PRIOR * part) / (F.col("raw") + PRIOR) / part)).otherwise(F.lit(0.0))
    rows = full.join(F.broadcast(totals), "kind").select(F.struct("bin", ratio.alias("ratio")).alias("x"))
    return rows.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["ratio"]).alias("ratio"))


def _repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text."""
    # One long per window, hash bits above the start: sorts as a primitive array. Neighbours are compared by their words.
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 24).bitwiseOR(i.cast("long")),
    )

    def covered(ordered: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(F.lit(0xFFFFFF)).cast("int"), y.bitwiseAND(F.lit(0xFFFFFF)).cast("int")
            equal = F.shiftright(x, 24) == F.shiftright(y, 24)
            for k in range(3):
                equal = equal & (F.get(words, i + k) == F.get(words, j + k))
            return F.coalesce(equal, F.lit(False))

        twice = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k + 1)) | same(x, F.get(ordered, k - 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(0xFFFFFF))))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(words) >= 3, let(F.sort_array(windows), covered)).otherwise(F.lit(0).cast("long"))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def judge(
    docs: DataFrame, trusted: DataFrame, bins: int = BINS, threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Every column of ``docs`` (doc_id, text, any others) with the counts, the score and the verdict in one struct ``quality``.

    A null or empty text has no words and fails the counting rules, with a null score; a document of one word is scored
    by that word. Repeated rows are judged each. Extra columns pass through, whatever their names (``quality`` excepted,
    which is replaced). Without trusted documents all scores are 0. Empty tables give no rows.
    """
    table = stage(log_ratio_table(ngram_counts(docs, trusted, bins), bins))
    others = [c for c in docs.columns if c != "quality"]
    rows = docs.select(*others, F.struct(whole_text(F.col("text")).alias("t"), words_of(whole_text(F.col("text"))).alias("w")).alias("_q"))
    text, words = F.col("_q.t"), F.col("_q.w")
    ratio = table.scalar()

    def score(w: Column) -> Column:
        total = F.aggregate(
            _bin_pairs(w, bins),
            F.lit(0.0),
            lambda acc, p: acc + F.get(F.col("_ratio"), p["one"]) + F.coalesce(F.get(F.col("_ratio"), p["two"]), F.lit(0.0)),
        )
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1))

    rows = rows.withColumn("_ratio", ratio).select(
        *others,
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(text, "[ \\t-\\r]+", "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _duplicate_lines(text).alias("n_dup_lines"),
                _repeated_words(w).alias("n_repeat_words"),
                score(w).alias("score"),
            ),
        ).alias("quality"),
    )
    n, repeat = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
    kept = ~failed & (F.coalesce(F.col("quality.score"), F.lit(float("-inf"))) >= threshold)
    return rows.withColumn("quality", F.col("quality").withField("base_failed", failed)).withColumn(
        "quality", F.col("quality").withField("kept", kept)
    )


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Keys labelled good and not toxic; null labels are not trusted."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")
