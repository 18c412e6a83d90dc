"""Mixing sources by temperature: token shares raised to an exponent that meets a target, realised in budgeted blocks.

The weight of a source is its token share to the power ``t``, normalised. ``t`` in [0, 1] is bisected: the largest that
still gives the target entropy (a fraction of the logarithm of the number of sources), raised if needed to the smallest
that keeps every source within the repetition limit. The budget is what passes the source that is cut most exactly
once, so no document is left out; a smaller or larger one may be given.

Each source is read in epochs. An epoch is a permutation of its documents by a digest of (seed, epoch, key); the last
epoch ends where its budget does. That end is one digest per source (the *cut*), found from token sums of 4096 digest
ranges and a running sum inside the one range that holds it, so no window spans a source. Which rows are taken is then
a map-side decision. The mixed stream is cut into blocks of equal budget; each block holds every source at its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import broadcast_if_small, stage, whole_text, words_of

TARGET_ENTROPY = 0.9
REPETITION_LIMIT = 2.0
BLOCK_TOKENS = 1 << 20
SEED = 20
STEPS = 50


def digest(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a row in the permutation of an epoch: 32 hex digits. Null keys share one place."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of every row; tokens are words, a null text has none."""
    return docs.select("doc_id", "source", F.size(words_of(whole_text(F.col("text")))).cast("long").alias("n_tokens"))


def _bisect(holds, up: bool) -> Column:
    """Exponent in [0, 1] next to where ``holds`` changes; ``up``: it holds below the change, else above it."""

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        good = holds(mid)
        raise_it = good if up else ~good
        return F.struct(F.when(raise_it, mid).otherwise(acc["lo"]).alias("lo"), F.when(raise_it, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["lo"] if up else acc["hi"])
    at_end = F.lit(1.0) if up else F.lit(0.0)
    return F.when(holds(at_end), at_end).otherwise(inner)


def exponent(
    totals: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repetition_limit: float | None = REPETITION_LIMIT
) -> DataFrame:
    """One row with ``t`` from (source, tokens). The shares meet in one row: eight bytes for each source."""
    shares = F.transform("_t", lambda x: x / F.col("_sum"))
    logs = F.transform("_p", lambda x: F.log(x))
    row = totals.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("_t"), F.sum("tokens").cast("double").alias("_sum"))
    row = row.select(shares.alias("_p")).select("_p", logs.alias("_l"))

    def entropy(t: Column) -> Column:
        powers = F.transform("_l", lambda x: F.exp(x * t))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        weighted = F.aggregate(F.zip_with(powers, F.col("_l"), lambda w, x: w * x * t), F.lit(0.0), lambda a, x: a + x)
        return F.log(total) - weighted / total

    t = F.lit(1.0)
    if target_entropy is not None:
        t = _bisect(lambda x: entropy(x) >= F.lit(target_entropy) * F.log(F.size("_l").cast("double")), up=True)
    if repetition_limit is not None:
        spread = F.element_at("_l", -1) - F.get("_l", F.lit(0))
        t = F.greatest(t, _bisect(lambda x: (F.lit(1.0) - x) * spread <= F.log(F.lit(repetition_limit)), up=False))
    return row.select(F.round(F.when(F.size("_l") > 0, t).otherwise(F.lit(1.0)), 9).alias("t"))


def plan(
    rows: DataFrame, target_entropy: float | None = TARGET_ENTROPY, repetition_limit: float | None = REPETITION_LIMIT,
    budget: int | None = None, seed: int = SEED,
) -> DataFrame:
    """One row per source: tokens, weight, quota, full epochs and the cut of the last one, from the rows of ``sized``.

    A null source is a source of its own. A source without tokens has weight 0 and is read once, as documents without
    tokens cost nothing. The cut is null where no document fits into the last epoch. Equal places count together.
    """
    totals = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    t = exponent(totals, target_entropy, repetition_limit).scalar()
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.col("_all")) * F.col("_x"))).otherwise(0.0)
    sums = totals.agg(F.sum("tokens").alias("_all"))
    weighed = totals.select("source", "tokens", sums.scalar().alias("_all"), t.alias("_x")).select("*", power.alias("_power"))
    whole = weighed.agg(F.sum("_power").alias("s"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("_power"))).alias("cover"))
    whole = stage(whole)
    epochs = F.col("_power") * (F.col("_cover") if budget is None else F.lit(float(budget)) / F.col("_s")) / F.col("tokens")
    weighed = weighed.select("*", whole.select("s").scalar().alias("_s"), whole.select("cover").scalar().alias("_cover"))
    sources = weighed.select(
        "source", "tokens", F.round(F.when(F.col("_s") > 0, F.col("_power") / F.col("_s")).otherwise(0.0), 9).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(epochs, 6)).otherwise(1.0).alias("epochs"),
    )
    sources = stage(
        sources.withColumn("full", F.floor("epochs").cast("int"))
        .withColumn("rest", F.floor(F.col("tokens") * (F.col("epochs") - F.floor("epochs"))).cast("long"))
        .withColumn("quota", F.col("tokens") * F.col("full") + F.col("rest"))
    )
    small = broadcast_if_small(sources.where("rest > 0").select(F.col("source").alias("_s"), "full", "rest"))
    last = rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).select("source", "rest", "n_tokens", digest(seed, F.col("full"), F.col("doc_id")).alias("h"))
    last = last.withColumn("range", F.substring("h", 1, 3))
    sums = last.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    ordered = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("n").over(ordered) - F.col("n"))
    # In the range that the budget ends in, and before it, everything that fits is below the cut.
    edge = sums.where("before <= rest AND before + n > rest").select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before")
    # The edge has one range of each source, its rows one 4096th of the source's.
    inside = last.join(broadcast_if_small(edge), F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h"))
    cuts = inside.withColumn("upto", running).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("h"), F.max("range").alias("range")
    )
    # No document of that range fits: the cut lies just below the range.
    cuts = cuts.select(F.col("source").alias("_s"), F.coalesce("h", F.col("range")).alias("cut"))
    return stage(sources.join(broadcast_if_small(cuts), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def realise(docs: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` once per epoch that takes it, with a struct ``mix`` (epoch, place); no shuffle of texts.

    Other columns pass through; an input column named ``mix`` is replaced. Repeated rows are taken together.
    """
    others = [c for c in docs.columns if c != "mix"]
    small = broadcast_if_small(sources.select(F.col("source").alias("_s"), "full", "cut", "rest"))
    rows = docs.select(F.struct(*others).alias("_row")).join(small, F.col("_row.source").eqNullSafe(F.col("_s")))
    key = F.col("_row.doc_id")
    more = (F.col("rest") > 0) & (digest(seed, F.col("full"), key) <= F.col("cut"))
    upto = F.col("full") + F.coalesce(more, F.lit(False)).cast("int")
    rows = rows.where(upto > 0).select("_row", F.explode(F.sequence(F.lit(0), upto - 1)).alias("epoch"))
    return rows.select("_row.*", F.struct("epoch", digest(seed, F.col("epoch"), key).alias("place")).alias("mix"))


def arrange(taken: DataFrame, sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Slim rows (doc_id, source, n_tokens, mix) with their block of the mixed stream and their position inside it."""
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("quota") / block_tokens)).cast("long")
    per = broadcast_if_small(sources.select(F.col("source").alias("_s"), "tokens", "quota", F.lit(1).alias("_j")))
    number = sources.agg(F.coalesce(blocks, F.lit(1).cast("long")).alias("n"))
    rows = taken.select("doc_id", "source", "n_tokens", F.col("mix.epoch").alias("epoch"), F.col("mix.place").alias("place"))
    rows = rows.withColumn("range", F.substring("place", 1, 3))
    keys = ["source", "epoch", "range"]
    sums = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source", "epoch").orderBy("range")) - F.col("n"))
    sums = sums.select(F.col("source").alias("_a"), F.col("epoch").alias("_b"), F.col("range").alias("_c"), "before")
    same = F.col("source").eqNullSafe(F.col("_a")) & (F.col("epoch") == F.col("_b")) & (F.col("range") == F.col("_c"))
    inner = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sums, same).withColumn("at", F.col("before") + F.coalesce(inner, F.lit(0)))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).select("*", number.scalar().alias("_n"))
    along = (F.col("epoch") * F.col("tokens") + F.col("at")) * F.col("_n")
    block = F.when(F.col("quota") > 0, F.least(F.floor(along / F.col("quota")), F.col("_n") - 1)).otherwise(0)
    rows = rows.withColumn("block", block.cast("long"))
    position = F.row_number().over(Window.partitionBy("block").orderBy("place", "doc_id", "epoch"))
    return rows.select("doc_id", "source", "n_tokens", "epoch", "block", position.cast("long").alias("position"))
