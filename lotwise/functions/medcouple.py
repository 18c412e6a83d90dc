"""Medcouple of one bounded sorted sample, used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIRECT_PAIRS = 4096


def _kernel_value(up: np.ndarray, down: np.ndarray, position: int) -> float:
    """The ``position``-th smallest (u - d) / (u + d) over all u in up, d in down; both positive and ascending.

    The kernel is at most t exactly when d >= u (1 - t) / (1 + t), so pairs are counted by binary search and the
    value is found by halving the interval (-1, 1), in O((n log n) * 60) and O(n) memory.
    """
    if up.size * down.size <= DIRECT_PAIRS:
        h = ((up[:, None] - down[None, :]) / (up[:, None] + down[None, :])).ravel()
        return float(np.partition(h, position)[position])
    low, high = -1.0, 1.0
    for _ in range(64):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        at = np.searchsorted(down, up * (1 - mid) / (1 + mid), side="left")
        if int((down.size - at).sum()) > position:
            high = mid
        else:
            low = mid
    # Snap to the largest kernel value not above the interval.
    at = np.searchsorted(down, up * (1 - high) / (1 + high), side="left")
    has = at < down.size
    return float(np.max((up[has] - down[at[has]]) / (up[has] + down[at[has]])))


def medcouple(sorted_values: np.ndarray) -> float:
    v = np.asarray(sorted_values, dtype=np.float64)
    n = v.size
    if n < 3 or v[0] == v[-1]:
        return 0.0
    centre = np.percentile(v, 50)
    z = v - centre
    up, down, ties = z[z > 0], np.sort(-z[z < 0]), int((z == 0).sum())
    pairs = (up.size + ties) * (down.size + ties)
    lows = down.size * ties + ties * (ties - 1) // 2
    inner = up.size * down.size
    # Order: all -1, then the kernel with `ties` zeros among it, then all +1.
    below_zero = _count_at_most(up, down, strict=True)
    zeros = _count_at_most(up, down, strict=False) - below_zero + ties

    def at(position: int) -> float:
        if position < lows:
            return -1.0
        position -= lows
        if position >= inner + ties:
            return 1.0
        if position < below_zero:
            return _kernel_value(up, down, position)
        if position < below_zero + zeros:
            return 0.0
        return _kernel_value(up, down, position - ties)

    return (at((pairs - 1) // 2) + at(pairs // 2)) / 2


def _count_at_most(up: np.ndarray, down: np.ndarray, strict: bool) -> int:
    """Pairs with kernel below (or at most) zero: d > u (or d >= u)."""
    side = "right" if strict else "left"
    return int((down.size - np.searchsorted(down, up, side=side)).sum())


def medcouple_of_sorted(values: Column | str) -> Column:
    @F.pandas_udf(DoubleType())
    def every(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda v: medcouple(np.asarray(v, dtype=np.float64)))

    return every(values)


class _Kernel:
    """Pairs of distances above and below one centre, distinct and weighted; h = (u - d) / (u + d) falls with d."""

    def __init__(self, up: np.ndarray, up_rows: np.ndarray, down: np.ndarray, down_rows: np.ndarray):
        self.up, self.up_rows, self.down, self.down_rows = up, up_rows, down, down_rows
        self.down_from = np.concatenate([np.cumsum(down_rows[::-1])[::-1], [0]])
        self.up_below = np.concatenate([[0], np.cumsum(up_rows)])

    def first_down(self, u: np.ndarray, t: np.ndarray | float) -> np.ndarray:
        """Index of the nearest distance below whose h with u is at most t; settled by h itself, not by its inverse."""
        with np.errstate(divide="ignore"):
            at = np.searchsorted(self.down, u * (1 - t) / (1 + t), side="left")
        t = np.broadcast_to(t, u.shape)
        while True:
            before = np.maximum(at - 1, 0)
            move = (at > 0) & ((u - self.down[before]) / (u + self.down[before]) <= t)
            if not move.any():
                break
            at = at - move
        while True:
            here = np.minimum(at, self.down.size - 1)
            move = (at < self.down.size) & ((u - self.down[here]) / (u + self.down[here]) > t)
            if not move.any():
                return at
            at = at + move

    def last_up(self, low: np.ndarray, t: np.ndarray) -> np.ndarray:
        """How many distances above have an h of at most t with the given distances below."""
        with np.errstate(divide="ignore", invalid="ignore"):
            edge = low * (1 + t) / (1 - t)
        at = np.searchsorted(self.up, np.where(np.isnan(edge), np.inf, edge), side="right")
        while True:
            before = np.maximum(at - 1, 0)
            move = (at > 0) & ((self.up[before] - low) / (self.up[before] + low) > t)
            if not move.any():
                break
            at = at - move
        while True:
            here = np.minimum(at, self.up.size - 1)
            move = (at < self.up.size) & ((self.up[here] - low) / (self.up[here] + low) <= t)
            if not move.any():
                return at
            at = at + move

    def at_most(self, t: float, zeros: int) -> int:
        return int((self.up_rows * self.down_from[self.first_down(self.up, t)]).sum()) + (zeros if t >= 0 else 0)

    def kth(self, position: int, zeros: int) -> float:
        """The value at a position of all pairs, ``zeros`` zeros among them."""
        low, high = -1.0, 1.0
        while True:
            mid = (low + high) / 2
            if mid in (low, high):
                break
            if self.at_most(mid, zeros) > position:
                high = mid
            else:
                low = mid
        at = self.first_down(self.up, high)
        has = at < self.down.size
        best = (self.up[has] - self.down[at[has]]) / (self.up[has] + self.down[at[has]])
        found = float(best.max()) if best.size else -1.0
        return max(found, 0.0) if zeros and high >= 0 else found

    def window(self, position: int, spread: int, zeros: int) -> tuple[np.ndarray, np.ndarray]:
        """(values from ``position`` to ``position + spread``, how many of all are at most each).

        Only values strictly between both ends are listed, at most ``spread`` of them, however often the ends repeat.
        """
        total = int(self.up_rows.sum() * self.down_rows.sum()) + zeros
        low, high = self.kth(position, zeros), self.kth(min(position + spread, total - 1), zeros)
        if low == high:
            return np.array([low]), np.array([self.at_most(low, zeros)])
        until = self.first_down(self.up, low)
        since = self.first_down(self.up, np.nextafter(high, -2.0))
        sizes = np.maximum(until - since, 0)
        u = np.repeat(np.arange(self.up.size), sizes)
        j = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(since, sizes)
        h = (self.up[u] - self.down[j]) / (self.up[u] + self.down[j])
        rows = self.up_rows[u] * self.down_rows[j]
        if zeros and low < 0 < high:
            h, rows = np.append(h, 0.0), np.append(rows, zeros)
        values, where = np.unique(h, return_inverse=True)
        added = np.bincount(where, weights=rows, minlength=values.size).astype(np.int64) if values.size else np.zeros(0, np.int64)
        reached = self.at_most(low, zeros) + np.concatenate([[0], np.cumsum(added)])
        return np.concatenate([[low], values, [high]]), np.append(reached, self.at_most(high, zeros))

    def without(self, position: int, zeros: int, own: np.ndarray, above: bool) -> np.ndarray:
        """The value at a position when one copy of each of ``own`` in turn is left out."""
        spread = int(self.down_rows.sum() if above else self.up_rows.sum())
        values, reached = self.window(position, spread, zeros)
        low, high = np.zeros(own.size, np.int64), np.full(own.size, values.size - 1)
        while (low < high).any():
            mid = (low + high) // 2
            t = values[mid]
            mine = self.down_from[self.first_down(own, t)] if above else self.up_below[self.last_up(own, t)]
            enough = reached[mid] - mine > position
            low, high = np.where(enough, low, np.minimum(mid + 1, high)), np.where(enough, mid, high)
        return values[low]


def medcouples_without_each(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Medcouple of a sample with one copy of each distinct value left out, in O(n log n) for all of them.

    ``values`` are distinct and ascending, ``rows`` how often each occurs. Without one reading at most three centres are
    possible. For each of them the pairs are counted once; leaving a reading out moves the median of the pairs within a
    window no longer than the readings on the other side.
    """
    v, w = np.asarray(values, np.float64), np.asarray(rows, np.int64)
    out = np.zeros(v.size)
    m = int(w.sum()) - 1
    if m < 3:
        return out
    until = np.cumsum(w)

    def left(position: int) -> np.ndarray:
        here = np.searchsorted(until, position + (position >= until - 1), side="right")
        return v[np.minimum(here, v.size - 1)]

    a, b = left((m - 1) // 2), left(m // 2)
    centres = b - (b - a) * 0.5
    for centre in np.unique(centres):
        mine = centres == centre
        z = v - centre
        above, below = z > 0, z < 0
        pairs = _Kernel(z[above], w[above], -z[below][::-1], w[below][::-1])
        n_up, n_down, n_tie = (int(w[side].sum()) for side in (above, below, z == 0))
        for side, name in ((above, "up"), (below, "down"), (z == 0, "tie")):
            who = np.flatnonzero(mine & side)
            if not who.size:
                continue
            nu, nd, k = n_up - (name == "up"), n_down - (name == "down"), n_tie - (name == "tie")
            if nu == 0 and nd == 0:
                continue
            total, lows = (nu + k) * (nd + k), nd * k + k * (k - 1) // 2
            for q in ((total - 1) // 2, total // 2):
                position = q - lows
                if position < 0:
                    found = -1.0
                elif position >= nu * nd + k:
                    found = 1.0
                elif nu * nd == 0:
                    found = 0.0
                elif name == "tie":
                    found = pairs.kth(position, k)
                else:
                    found = pairs.without(position, k, np.abs(z[who]), name == "up")
                out[who] += found / 2
    return out


def medcouples_of_runs(values: Column | str, rows: Column | str) -> Column:
    """Array of the medcouples without each of the distinct values of an ascending array."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def every(arrays: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([medcouples_without_each(v, n).tolist() for v, n in zip(arrays, counts)])

    return every(values, rows)
