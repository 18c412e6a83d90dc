"""How good a screen, a forecast and a work list are: thresholds with a proven miss rate, curves, ablations, stability."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import binomial as B
from lotwise.functions.robust import d
from lotwise.operators.ordered import checked_broadcast, group_sizes, lookup_join, order_statistics, quantiles, sorted_runs, with_rank
from lotwise.session import hot_rows, stage

ALL = "all"
# Rows that a task sorts at a time by each draw, those aimed at between two cuts, and marks per cut that cuts are chosen from
CHUNK_ROWS = 250_000
CUT_ROWS = 250_000
CUT_MARKS = 256


def with_total(rows: DataFrame, group: str) -> DataFrame:
    """Each row in its group and once more in the group of all."""
    return rows.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(ALL))))


def forecast_metrics(rows: DataFrame, group: str, alpha: float = K.ALPHA, limit: int | None = None) -> DataFrame:
    """Errors of the point forecast and coverage of the upper bound, per group and over all.

    ``rows`` holds the group, v0, v168 (the truth), point and upper; rows that lack one are left out. ``tail_mae`` is over
    the rows whose true drift reaches the ninth decile of their group. The width of a one-sided bound is upper - point, its
    interval score the width plus what the truth lies above the bound, over alpha. ``target_inside`` tells whether
    1 - alpha lies in the exact 95 % interval of the coverage.
    """
    use = rows.filter("v0 IS NOT NULL AND v168 IS NOT NULL AND point IS NOT NULL AND upper IS NOT NULL")
    use = with_total(use.select(group, "v0", "v168", "point", "upper"), group)
    error, width = F.abs(F.col("v168") - F.col("point")), F.col("upper") - F.col("point")
    miss = F.greatest(d(0.0), F.col("v168") - F.col("upper"))
    use = use.select(
        group, error.alias("e"), width.alias("w"), F.abs(F.col("v168") - F.col("v0")).alias("drift"),
        (F.col("v168") <= F.col("upper")).cast("int").alias("hit"), (width + miss / d(alpha)).alias("score"),
    )
    sizes = group_sizes(use, [group])
    at = quantiles(use, [group], "drift", {"cut": 0.9}, limit=limit, sizes=sizes).select(group, "cut")
    med = quantiles(use, [group], "e", {"medae": 0.5}, limit=limit, sizes=sizes).select(group, "medae")
    wide = quantiles(use, [group], "w", {"median_width": 0.5}, limit=limit, sizes=sizes).select(group, "median_width")
    out = lookup_join(use, at, [group], sizes, limit=limit).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.when(F.col("drift") >= F.col("cut"), F.col("e"))).alias("tail_mae"), F.sum("hit").alias("n_covered"),
        F.avg("w").alias("mean_width"), F.avg("score").alias("interval_score"),
    )
    out = out.join(med, group).join(wide, group)
    inside = B.clopper_pearson("n_covered", "n")
    out = out.withColumn("coverage", F.col("n_covered") / F.col("n")).withColumn("_ci", inside)
    return out.select(
        group, "n", "mae", "rmse", "medae", "tail_mae", "n_covered", "coverage", F.col("_ci.low").alias("coverage_low"),
        F.col("_ci.high").alias("coverage_high"), ((F.col("_ci.low") <= 1 - alpha) & (F.col("_ci.high") >= 1 - alpha)).alias("target_inside"),
        "mean_width", "median_width", "interval_score",
    )


def miss_rate_threshold(
    parts: DataFrame, group: str, score: str, defect: str, alpha: float, delta: float, limit: int | None = None
) -> DataFrame:
    """Per group and over all, the threshold of ``score`` at which at most ``alpha`` of defects are missed.

    The threshold is the r-th smallest score of the defective parts, r the largest rank whose exact binomial tail keeps the
    chance of a miss rate above alpha at or below ``delta``. With too few defective parts for rank 1 the group is refused
    and the smallest alpha that its parts could support is given. A part is flagged at or above the threshold.
    """
    rows = with_total(parts.select(group, F.col(score).alias("s"), F.col(defect).alias("bad")).filter("s IS NOT NULL"), group)
    counts = rows.groupBy(group).agg(F.count_if("bad").alias("n_defect"), F.count_if(~F.col("bad")).alias("n_sound"))
    # Ranks and tails once per group; every row then carries its group's rank as part of the key.
    table = stage(counts.withColumn("_o", B.order_rank("n_defect", alpha, delta)).select(group, "n_defect", "n_sound", F.col("_o.rank").alias("rank"), F.col("_o.tail").alias("tail")))
    sizes = group_sizes(rows, [group])
    ranked = lookup_join(rows, table.select(group, "rank"), [group], sizes, limit=limit)
    at = order_statistics(ranked.filter("bad AND rank > 0").select(group, "rank", "s"), [group, "rank"], "s", {"tau": lambda n: F.col("rank") - 1}, limit=limit)
    table = table.join(at.select(group, "tau"), group, "left")
    flagged = lookup_join(rows, table.select(group, "tau"), [group], sizes, limit=limit)
    flag = F.coalesce(F.col("s") >= F.col("tau"), F.lit(False))
    hits = flagged.groupBy(group).agg(F.count_if(flag & F.col("bad")).alias("tp"), F.count_if(flag & ~F.col("bad")).alias("fp"))
    out = table.join(hits, group)
    ok, n = F.col("rank") > 0, F.col("n_defect")
    return out.select(
        group, "n_defect", "n_sound", "rank", F.when(ok, F.col("tau")).alias("threshold"), F.when(ok, F.col("tail")).alias("excess_probability"),
        F.when(ok, F.try_divide(n - F.col("tp"), n)).alias("miss_rate"), F.when(ok, F.try_divide("fp", "n_sound")).alias("false_positive_rate"),
        F.when(ok, F.try_divide(F.col("tp") + F.col("fp"), n + F.col("n_sound"))).alias("flag_rate"),
        F.when(n > 0, d(1.0) - F.pow(d(delta), d(1.0) / n)).alias("smallest_alpha"), F.when(~ok, "INSUFFICIENT_CALIBRATION").alias("refusal_code"),
    )


def curve_areas(parts: DataFrame, group: str, score: str, defect: str, limit: int | None = None) -> DataFrame:
    """Per group and over all: prevalence, average precision and area under the ROC curve of a score; ties share a threshold.

    Counts at or above each distinct score are cumulative counts over ranges of the score, so no group is sorted whole.
    """
    rows = with_total(parts.select(group, F.col(score).alias("s"), F.col(defect).cast("int").alias("bad")).filter("s IS NOT NULL"), group)
    every = sorted_runs(rows, [group], "s", limit=limit).select(group, "s", "run_rows", "run_start", "group_rows")
    bads = sorted_runs(rows, [group], "s", weight="bad", limit=limit).select(
        group, "s", F.col("run_rows").alias("_b"), F.col("run_start").alias("_b_below"), F.col("group_rows").alias("_b_all")
    )
    at = every.join(bads, [group, "s"])
    share = F.try_divide(F.col("_b_all") - F.col("_b_below"), F.col("group_rows") - F.col("run_start"))
    sound_below = F.col("run_start") - F.col("_b_below")
    half = (F.col("run_rows") - F.col("_b")) / 2
    out = at.groupBy(group).agg(
        F.max("group_rows").alias("n"), F.max("_b_all").alias("n_defect"), F.sum(F.col("_b") * share).alias("_p"),
        F.sum(F.col("_b") * (sound_below + half)).alias("_a"),
    )
    sound = F.col("n") - F.col("n_defect")
    return out.select(
        group, "n", "n_defect", F.try_divide("n_defect", "n").alias("prevalence"), F.try_divide("_p", "n_defect").alias("average_precision"),
        F.try_divide(F.col("_a"), F.col("n_defect") * sound).alias("roc_area"),
    )


def ablation(parts: DataFrame, screens: Sequence[str], settings: Mapping[str, Sequence[str]], defect: str, escape: str) -> DataFrame:
    """Recall, false positives, flag rate and F2 of unions of screens.

    ``screens`` are boolean columns. A part is one bit mask of the screens that flag it; parts are counted by mask once, and
    every setting sums over the masks that meet its own.
    """
    bits = F.lit(0)
    for i, s in enumerate(screens):
        bits = bits + F.when(F.coalesce(F.col(s), F.lit(False)), 1 << i).otherwise(0)
    masks = parts.groupBy(bits.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(defect)).alias("bad"), F.count_if(F.col(escape)).alias("esc")
    )
    place = {s: i for i, s in enumerate(screens)}
    wanted = F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(sum(1 << place[s] for s in own)).alias("own")) for name, own in settings.items()])
    each = masks.withColumn("_s", F.explode(wanted)).select("*", "_s.*")
    hit = F.col("mask").bitwiseAND(F.col("own")) != 0
    sums = each.groupBy("setting").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("n_defect"), F.sum("esc").alias("n_escape"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_flagged"),
        F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("esc")).otherwise(0)).alias("tp_escape"),
    )
    recall, precision = F.try_divide("tp", "n_defect"), F.try_divide("tp", "n_flagged")
    return sums.select(
        "setting", "n", "n_flagged", recall.alias("recall"), F.try_divide("tp_escape", "n_escape").alias("escape_recall"),
        F.try_divide(F.col("n_flagged") - F.col("tp"), F.col("n") - F.col("n_defect")).alias("false_positive_rate"),
        F.try_divide("n_flagged", "n").alias("flag_rate"), F.try_divide(5 * precision * recall, 4 * precision + recall).alias("f2"),
    )


def weight_draw(seed: int, draw: int, name: str) -> float:
    """A number in [0, 1) that depends on seed, draw and name alone."""
    digest = hashlib.md5(f"{seed}:{draw}:{name}".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) / float(1 << 32)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task, about CHUNK_ROWS at a time."""
    held, kept = [], 0
    for batch in batches:
        held.append(batch)
        kept += len(batch)
        if kept >= CHUNK_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, kept = [], 0
    if kept:
        yield pd.concat(held, ignore_index=True)


def _drawn(chunk: pd.DataFrame, drawn: list[dict[str, float]]) -> Iterator[np.ndarray]:
    """The index of a chunk's rows under each draw, summed in the order of the weights."""
    for weights in drawn:
        out = np.zeros(len(chunk))
        for name, w in weights.items():
            out += w * chunk[name].to_numpy()
        yield out


def _evenly(drawn: list[dict[str, float]], step: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            marks = [np.sort(x)[step - 1 :: step] for x in _drawn(chunk, drawn)]
            yield pd.DataFrame({"draw": np.arange(len(drawn), dtype="int32"), "marks": marks})

    return run


def _combined(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, with the sums of their rows' n and s."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.add.reduceat(n[order], first), np.add.reduceat(s[order], first)


def _cut(drawn: list[dict[str, float]], cuts: list[np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            n, s = chunk["_rows"].to_numpy(), chunk["_sum"].to_numpy()
            for draw, x in enumerate(_drawn(chunk, drawn)):
                sorted_rows = _combined(x, n, s)
                ends = np.searchsorted(sorted_rows[0], cuts[draw], side="right")
                pieces = [[part.tobytes() for part in np.split(column, ends)] for column in sorted_rows]
                out = pd.DataFrame(dict(zip("xns", pieces))).assign(draw=np.int32(draw), cut=np.arange(len(ends) + 1, dtype="int32"))
                yield out[out["x"].map(len) > 0]

    return run


def _merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    """Sums of one draw between two cuts, with ranks counted from the middle of these rows."""
    _, n, s = _combined(*(np.frombuffer(b"".join(pieces[c])) for c in "xns"))
    total = n.sum()
    rank = np.cumsum(n) - (n - 1) / 2 - (total + 1) / 2
    return pd.DataFrame([(*key, total, s.sum(), (s * rank).sum(), (n * rank * rank).sum())], columns=["draw", "cut", "n", "s", "sr", "rr"])


def rank_stability(
    rows: DataFrame, weights: Mapping[str, float], draws: int = 200, jitter: float = 0.5, seed: int = 20260930, limit: int | None = None
) -> DataFrame:
    """Spearman correlation of the work list with itself under each draw of jittered weights.

    ``rows`` holds a component per weight, none of them NULL; the index is their weighted sum. Equal rows are combined
    first, and no row is written once per draw: a task sorts a chunk of rows by each draw's index, cuts it at values common
    to all chunks and hands on the pieces as arrays. Pieces between the same cuts are merged in one group, whose sums
    need no more than the number of rows below. Cuts steer the work only; results are exact whatever they are.
    """
    index = d(0.0)
    for name, w in weights.items():
        index = index + d(w) * F.col(name)
    points = stage(rows.groupBy(*weights).agg(F.count(F.lit(1)).alias("_rows")))
    size, total = points.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    middle = d(((total or 0) + 1) / 2)
    ranked = with_rank(points.withColumns({"_one": F.lit(0), "_base": index}), ["_one"], "_base", "_rank", limit, "_rows")
    n = F.col("_rows").cast("double")
    ranked = stage(ranked.select(*weights, n.alias("_rows"), (n * (F.col("_rank") - middle)).alias("_sum")))
    drawn = [
        {name: w * (1.0 + jitter * (2.0 * weight_draw(seed, draw, name) - 1.0)) for name, w in weights.items()} for draw in range(1, draws + 1)
    ]
    piece = min(hot_rows(rows.sparkSession) if limit is None else limit, CUT_ROWS)
    cuts = [np.empty(0)] * draws
    if size > piece:
        marks = ranked.mapInPandas(_evenly(drawn, max(1, piece // CUT_MARKS)), "draw int, marks array<double>")
        marks = marks.groupBy("draw").agg(F.sort_array(F.flatten(F.collect_list("marks"))).alias("_all"))
        for draw, values in marks.select("draw", F.expr(f"filter(_all, (v, i) -> i % {CUT_MARKS} = {CUT_MARKS - 1})")).collect():
            cuts[draw] = np.unique(values)
    pieces = ranked.mapInPandas(_cut(drawn, cuts), "draw int, cut int, x binary, n binary, s binary")
    sums = pieces.groupBy("draw", "cut").applyInPandas(_merge, "draw int, cut int, n double, s double, sr double, rr double")
    before = Window.partitionBy("draw").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), d(0.0)) + (F.col("n") + 1) / 2 - middle
    base = ranked.agg(F.sum(F.col("_sum") * F.col("_sum") / F.col("_rows"))).first()[0]
    out = sums.withColumn("_shift", shift).groupBy((F.col("draw") + 1).alias("draw")).agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("sr") + F.col("_shift") * F.col("s")).alias("_xy"),
        F.sum(F.col("rr") + F.col("n") * F.col("_shift") * F.col("_shift")).alias("_yy"),
    )
    return out.select("draw", "n", F.try_divide("_xy", F.sqrt(F.col("_yy") * d(base or 0.0))).alias("rho"))


def ridge_corrections(
    train: DataFrame, held_out: DataFrame, group: Sequence[str], features: Sequence[str], penalty: float, target: str = "residual"
) -> DataFrame:
    """Per group the ridge coefficients of the residual on the features, adopted only if the held-out error falls.

    One aggregation gives the moments of all groups; the normal equations (covariance + penalty) w = covariance with the
    target are solved per group. ``adopted`` compares mean absolute errors with and without the correction on ``held_out``.
    """
    names, p = list(features), len(features)
    group = list(group)
    cells = [F.covar_pop(a, b) for a in names for b in names]
    sides = [F.covar_pop(a, target) for a in names]
    moments = train.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_train"), F.array(*[F.avg(c) for c in names]).alias("_mean"), F.avg(target).alias("_y"), F.array(*cells).alias("_xx"),
        F.array(*sides).alias("_xy"),
    )

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, mean: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b, m, t in zip(xx, xy, mean, y):
            a, b = np.array(a, float).reshape(p, p) + penalty * np.eye(p), np.array(b, float)
            if not np.isfinite(a).all() or np.linalg.matrix_rank(a) < p:
                out.append(None)
                continue
            w = np.linalg.solve(a, b)
            out.append([float(t - w @ np.array(m, float)), *w.tolist()])
        return pd.Series(out)

    fits = moments.withColumn("_w", solve("_xx", "_xy", "_mean", "_y"))
    point = F.get("_w", F.lit(0))
    for i, c in enumerate(names):
        point = point + F.get("_w", F.lit(i + 1)) * F.col(c)
    tried = held_out.join(checked_broadcast(fits.select(*group, "_w")), group).withColumn("_fix", point)
    errors = tried.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_held_out"), F.avg(F.abs(target)).alias("mae_plain"), F.avg(F.abs(F.col(target) - F.col("_fix"))).alias("mae_ridge")
    )
    out = fits.join(errors, group, "left")
    return out.select(
        *group, "n_train", "n_held_out", F.get("_w", F.lit(0)).alias("intercept"), *[F.get("_w", F.lit(i + 1)).alias(f"w_{c}") for i, c in enumerate(names)],
        "mae_plain", "mae_ridge", F.coalesce(F.col("mae_ridge") < F.col("mae_plain"), F.lit(False)).alias("adopted"),
    )


def cautious_bounds(res: DataFrame, alpha: float = K.ALPHA, limit: int | None = None) -> DataFrame:
    """Per ladder group what a void guarantee uses: the largest of its own, the marginal and the 1 - alpha / 2 quantile.

    ``res`` holds component_type, parameter and residual. Also the lower bound's quantile, from the negated residuals, for
    parameters with limits on both sides. Quantiles a group can't support are left out of the largest.
    """
    keyed = res.select(F.concat_ws("/", "component_type", "parameter").alias("group"), "residual")
    rows = with_total(keyed, "group")
    rank = lambda n, a: F.ceil((n + 1).cast("double") * d(1.0 - a)) - 1
    up = order_statistics(rows, ["group"], "residual", {"q": lambda n: rank(n, alpha), "q_half": lambda n: rank(n, alpha / 2)}, limit=limit)
    down = order_statistics(rows.withColumn("residual", -F.col("residual")), ["group"], "residual", {"q_down": lambda n: rank(n, alpha)}, limit=limit)
    table = up.join(down.select("group", "q_down"), "group")
    whole = table.filter(F.col("group") == ALL).select(F.col("q").alias("q_marginal"))
    out = table.filter(F.col("group") != ALL).join(F.broadcast(whole), how="left")
    return out.select(
        "group", F.col("n").alias("n_cal"), "q", "q_marginal", F.col("q_half").alias("q_conservative"),
        F.greatest("q", "q_marginal", "q_half").alias("q_void"), "q_down",
    )
