"""Evidence from ordered series: persistent shift (CUSUM) and data quality.

A series is cut into ordered chunks when it is hot (``ordered.bucketed``); otherwise it is one chunk. Inside a chunk
plain windows do the work, and a small chunk table carries running sums, minima and last values across chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import robust as R
from lotwise.operators.ordered import GroupSizes, _hot_limit, bucketed, group_sizes, lookup_join, quantiles


class Chunks:
    """Rows of many series with the windows that walk them in order."""

    def __init__(self, df, keys, order, limit=None, sizes=None):
        self.keys, self.order = list(keys), list(order)
        self.df, self.split = bucketed(df, self.keys, self.order[0], limit, sizes)
        self.part = [*self.keys, "_bucket"] if self.split else self.keys
        w = Window.partitionBy(*self.part).orderBy(*self.order)
        self.upto = w.rowsBetween(Window.unboundedPreceding, 0)
        self.before = w.rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*self.keys).orderBy("_bucket")
        self.chunks_before = across.rowsBetween(Window.unboundedPreceding, -1)

    def last_before(self, source: str, target: str) -> None:
        """``target`` = last non-NULL ``source`` strictly before the row."""
        local = F.last(source, ignorenulls=True).over(self.before)
        if not self.split:
            self.df = self.df.withColumn(target, local)
            return
        place = F.struct(*self.order)
        tails = self.df.groupBy(*self.part).agg(
            F.max_by(source, F.when(F.col(source).isNotNull(), place)).alias("_tail")
        )
        tails = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(self.chunks_before)).drop("_tail")
        self.df = (
            self.df.withColumn(target, local)
            .join(tails, self.part, "left")
            .withColumn(target, F.coalesce(F.col(target), F.col("_carry")))
            .drop("_carry")
        )

    def position(self, target: str) -> None:
        """``target`` = 0-based position of the row in its series."""
        local = F.count(F.lit(1)).over(self.upto) - 1
        self.df = self.df.withColumn(target, local)
        if self.split:
            counts = self.df.groupBy(*self.part).agg(F.count(F.lit(1)).alias("_c"))
            counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(self.chunks_before), F.lit(0))).drop("_c")
            self.df = self.df.join(counts, self.part).withColumn(target, F.col(target) + F.col("_off")).drop("_off")

    def reflected_sum(self, step: str, target: str) -> None:
        """``target`` = max(0, previous + step) along the series, in closed form C - min(0, min C)."""
        self.df = self.df.withColumn("_c", F.sum(step).over(self.upto))
        self.df = self.df.withColumn("_m", F.min("_c").over(self.upto))
        total, low = F.col("_c"), F.col("_m")
        if self.split:
            chunk = self.df.groupBy(*self.part).agg(F.sum(step).alias("_sum"), F.min("_c").alias("_min"))
            chunk = chunk.withColumn("_off", F.coalesce(F.sum("_sum").over(self.chunks_before), R.d(0.0)))
            chunk = chunk.withColumn("_abs", F.col("_off") + F.col("_min"))
            chunk = chunk.withColumn("_past", F.min("_abs").over(self.chunks_before))
            self.df = self.df.join(chunk.select(*self.part, "_off", "_past"), self.part)
            total = F.col("_off") + total
            low = F.least(F.col("_past"), F.col("_off") + low)
        self.df = self.df.withColumn(target, total - F.least(R.d(0.0), low))
        self.df = self.df.drop("_c", "_m", "_off", "_past")


def cusum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    reference: str,
    scale: str,
    k: float = K.CUSUM_K,
    h: float = K.CUSUM_H,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Two-sided tabular CUSUM of every series.

    NULL readings are gaps: they pause the sums and are counted. A non-finite reading, reference or scale refuses
    the series (INVALID_INPUT), and so do fewer than three readings (INSUFFICIENT_DATA). ``order[0]`` must be numeric
    and ``order`` must be total within a series.
    """
    x, ref, sigma = F.col(value), F.col(reference), F.col(scale)
    usable = R.finite(ref) & R.finite(sigma) & (sigma > 0)
    bad = ~usable | (x.isNotNull() & ~R.finite(x))
    z = F.when(~bad & x.isNotNull(), (x - ref) / sigma)
    rows = df.select(*keys, *order, x.alias("_x"), bad.alias("_bad"), z.alias("_z"))
    rows = rows.withColumn("_up", F.coalesce(F.col("_z") - k, R.d(0.0))).withColumn(
        "_down", F.coalesce(-F.col("_z") - k, R.d(0.0))
    )
    walk = Chunks(rows, keys, order, limit, sizes)
    walk.position("_pos")
    walk.reflected_sum("_up", "_high")
    walk.reflected_sum("_down", "_low")
    seen = F.col("_z").isNotNull()
    out = walk.df.groupBy(*keys).agg(
        F.max_by("_high", "_pos").alias("s_high"),
        F.max_by("_low", "_pos").alias("s_low"),
        F.min(F.when(seen & (F.col("_high") > h), F.col("_pos"))).alias("first_crossing_high"),
        F.min(F.when(seen & (F.col("_low") > h), F.col("_pos"))).alias("first_crossing_low"),
        F.count("_x").alias("n_observations"),
        F.count_if(F.col("_x").isNull()).alias("n_gaps"),
        F.max("_bad").alias("_bad"),
    )
    code = F.when(F.col("_bad"), "INVALID_INPUT").when(
        F.col("n_observations") < K.CUSUM_MIN, "INSUFFICIENT_DATA"
    )
    out = out.withColumn("refusal_code", code)
    ok = F.col("refusal_code").isNull()
    for name in ("s_high", "s_low", "first_crossing_high", "first_crossing_low"):
        out = out.withColumn(name, F.when(ok, F.col(name)))
    return out.select(
        *keys,
        "s_high",
        "s_low",
        (ok & F.col("first_crossing_high").isNotNull()).alias("signal_high"),
        (ok & F.col("first_crossing_low").isNotNull()).alias("signal_low"),
        "first_crossing_high",
        "first_crossing_low",
        "n_observations",
        "n_gaps",
        "refusal_code",
    )


def cusum_fold(values: Column, reference: Column, scale: Column, k: float = K.CUSUM_K, h: float = K.CUSUM_H) -> Column:
    """The same sums over one bounded array of readings, as struct(s_high, s_low)."""
    start = F.struct(R.d(0.0).alias("s_high"), R.d(0.0).alias("s_low"))

    def step(acc: Column, x: Column) -> Column:
        z = (x - reference) / scale
        return F.struct(
            F.when(x.isNull(), acc["s_high"]).otherwise(F.greatest(R.d(0.0), acc["s_high"] + z - k)).alias("s_high"),
            F.when(x.isNull(), acc["s_low"]).otherwise(F.greatest(R.d(0.0), acc["s_low"] - z - k)).alias("s_low"),
        )

    return F.aggregate(values, start, step)


def quality_score(counts: dict[str, Column], n_valid: Column) -> Column:
    """1 - sum(count * rate), at least 0, and 0 when nothing valid was seen."""
    lost = R.d(0.0)
    for code, count in counts.items():
        lost = lost + count * R.d(K.QUALITY_RATES[code])
    return F.when(n_valid == 0, R.d(0.0)).otherwise(F.greatest(R.d(0.0), R.d(1.0) - lost))


# What happens to each kind of finding
QUALITY_ACTIONS = {
    "MISSING_OBSERVATION": "recorded as missing, nothing imputed",
    "NON_FINITE_VALUE": "excluded from all evidence",
    "IMPOSSIBLE_VALUE": "excluded from all evidence",
    "CENSORED_READING": "kept as censored",
    "FLATLINE": "check the sensor",
    "TIMESTAMP_GAP": "check the cadence",
    "TIMESTAMP_DISORDER": "check the clock",
    "DISCONTINUITY": "check the reading",
}


def quality_findings(counts: dict[str, Column]) -> Column:
    """ARRAY<STRUCT<code, count, detail, action>> of the kinds that occurred, in fixed order."""
    items = [
        F.when(
            count > 0,
            F.struct(
                F.lit(code).alias("code"),
                count.cast("long").alias("count"),
                F.format_string("%d x " + code.lower().replace("_", " "), count.cast("long")).alias("detail"),
                F.lit(QUALITY_ACTIONS[code]).alias("action"),
            ),
        )
        for code, count in counts.items()
    ]
    return F.filter(F.array(*items), lambda item: item.isNotNull())


def series_quality(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    time: str | None = None,
    scale: str | None = None,
    low: Column | None = None,
    high: Column | None = None,
    censored: Column | None = None,
    limit: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Counts of every kind of defect and the quality score of each series."""
    limit = _hot_limit(df, limit)
    x = F.col(value)
    outside = F.lit(False)
    if low is not None:
        outside = outside | F.coalesce(x < low, F.lit(False))
    if high is not None:
        outside = outside | F.coalesce(x > high, F.lit(False))
    kind = (
        F.when(x.isNull(), "missing").when(~R.finite(x), "nonfinite").when(outside, "impossible").otherwise("valid")
    )
    gate = R.d(K.SPIKE_SIGMA) * F.col(scale) if scale else F.lit(None).cast("double")
    rows = df.select(
        *keys,
        *order,
        kind.alias("_kind"),
        F.when(kind == "valid", x).alias("_v"),
        (F.col(time) if time else F.lit(None).cast("double")).alias("_t"),
        gate.alias("_gate"),
        (censored if censored is not None else F.lit(False)).alias("_cens"),
    )
    sizes = sizes or group_sizes(rows, keys)
    walk = Chunks(rows, keys, order, limit, sizes)
    if scale:
        walk.position("_pos")
        walk.last_before("_v", "_pv")
        walk.df = walk.df.withColumn("_step", F.col("_v") - F.col("_pv")).withColumn(
            "_vpos", F.when(F.col("_v").isNotNull(), F.col("_pos"))
        )
        walk.last_before("_step", "_pstep")
        walk.last_before("_vpos", "_ppos")
    if time:
        walk.last_before("_t", "_pt")
    out = walk.df
    spike = (
        (F.abs("_step") > F.col("_gate")) & (F.abs("_pstep") > F.col("_gate")) if scale else F.lit(False)
    )
    tstep = F.col("_t") - F.col("_pt") if time else F.lit(None).cast("double")
    out = out.withColumn("_spike", F.coalesce(spike, F.lit(False))).withColumn("_tstep", tstep)
    aggs = [
        F.count(F.lit(1)).alias("n_total"),
        F.count("_v").alias("n_valid"),
        F.count_if(F.col("_kind") == "missing").alias("n_missing"),
        F.count_if(F.col("_kind") == "nonfinite").alias("n_nonfinite"),
        F.count_if(F.col("_kind") == "impossible").alias("n_impossible"),
        F.count_if(F.col("_cens")).alias("n_censored"),
        F.when((F.count("_v") >= 2) & (F.min("_v") == F.max("_v")), 1).otherwise(0).alias("n_flatline"),
        F.count_if(F.col("_spike")).alias("n_discontinuity"),
        (F.min(F.when(F.col("_spike"), F.col("_ppos"))) if scale else F.lit(None).cast("long")).alias("first_spike"),
    ]
    if time:
        steps = out.filter("_tstep > 0").select(*keys, "_tstep")
        gates = quantiles(steps, keys, "_tstep", {"_usual": 0.5}, limit=limit).select(*keys, "_usual")
        out = lookup_join(out, gates, keys, sizes, "left", limit)
        aggs += [
            F.count_if(F.col("_tstep") <= 0).alias("n_disorder"),
            (
                F.count_if(F.col("_t").isNull()) + F.count_if(F.col("_tstep") > R.d(K.GAP_FACTOR) * F.col("_usual"))
            ).alias("n_gap"),
        ]
    else:
        aggs += [F.lit(0).alias("n_disorder"), F.lit(0).alias("n_gap")]
    done = out.groupBy(*keys).agg(*aggs)
    counts = {
        "MISSING_OBSERVATION": F.col("n_missing"),
        "NON_FINITE_VALUE": F.col("n_nonfinite"),
        "IMPOSSIBLE_VALUE": F.col("n_impossible"),
        "CENSORED_READING": F.col("n_censored"),
        "FLATLINE": F.col("n_flatline"),
        "TIMESTAMP_GAP": F.col("n_gap"),
        "TIMESTAMP_DISORDER": F.col("n_disorder"),
        "DISCONTINUITY": F.col("n_discontinuity"),
    }
    return done.withColumn("score", quality_score(counts, F.col("n_valid"))).withColumn(
        "findings", quality_findings(counts)
    )


def quality_rollup(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Mean of the assessable scores of a group, with the excluded ones counted."""
    s = F.col(score)
    bad = s.isNotNull() & (~R.finite(s) | (s < 0) | (s > 1))
    out = scores.groupBy(*keys).agg(
        F.avg(s).alias("quality_score"),
        F.count(F.lit(1)).alias("n_parts"),
        F.count_if(s.isNull()).alias("n_excluded"),
        F.max(F.coalesce(bad, F.lit(False))).alias("_bad"),
    )
    code = F.when(F.col("_bad"), "INVALID_INPUT").when(F.col("n_parts") == F.col("n_excluded"), "INSUFFICIENT_DATA")
    return (
        out.withColumn("refusal_code", code)
        .withColumn("quality_score", F.when(code.isNull(), F.col("quality_score")))
        .drop("_bad")
    )
