"""Leave-one-out minimum covariance determinant of a lot, by downdating, for Arrow batches.

Leaving a part out moves the concentrated set, the median distance and the set inside the ellipsoid by a few points only,
all of them near the place where the whole lot's distances are cut. How far a distance can move follows from the extreme
eigenvalues of the new precision in the old metric and from the shift of the centre, so points away from the three cuts
(support, median, ellipsoid) keep their side. A lot is therefore kept as the moments of what lies before each cut and a
window of points around it; for a part, moments are downdated by its own row and by the window's points that change side,
concentration steps are repeated in the window until nothing changes, and no step reads the other points again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from lotwise import constants as K
from lotwise.functions.mcd import chi2_isf

STEPS = 30
# Points on either side of a cut that a window holds at first.
WINDOW = 48


def support(n: int) -> int:
    return math.ceil(K.MCD_SUPPORT * n)


def moments(y: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of rows, as one vector; moments add."""
    return np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])


def _each(y: np.ndarray) -> np.ndarray:
    n, p = y.shape
    return np.concatenate([np.ones((n, 1)), y, (y[:, :, None] * y[:, None, :]).reshape(n, p * p)], axis=1)


def _shape(m: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and covariances of many moments."""
    n = m[:, :1]
    centre = m[:, 1 : p + 1] / n
    cov = m[:, p + 1 :].reshape(-1, p, p) / n[:, :, None] - centre[:, :, None] * centre[:, None, :]
    return centre, cov


@dataclass
class Window:
    """The points around one cut, in order of distance; what lies before them is known by its moments.

    ``low`` and ``high`` are the square roots of the distances just outside, infinite at the ends of the lot.
    """

    points: np.ndarray
    lexical: np.ndarray  # the points' order among equal distances
    before: np.ndarray
    n_before: int
    low: float
    high: float

    @staticmethod
    def around(y: np.ndarray, order: np.ndarray, far: np.ndarray, rank: int, width: int) -> Window:
        a, b = max(0, rank - width), min(len(y), rank + width + 1)
        low, high = far[a - 1] if a else -np.inf, far[b] if b < len(y) else np.inf
        return Window(y[a:b], np.argsort(order[a:b], kind="stable"), moments(y[:a]), a, float(low), float(high))


@dataclass
class Lot:
    """What scoring a part against all the others of its lot needs, in coordinates that make its own fit a unit ball."""

    n: int
    p: int
    centre: np.ndarray
    root: np.ndarray  # lower Cholesky factor of the concentrated covariance
    at_support: Window
    at_median: Window
    at_ellipsoid: Window


class Widen(Exception):
    """A window is too narrow to rule out a change of side beyond it."""


def whiten(x: np.ndarray, centre: np.ndarray, root: np.ndarray) -> np.ndarray:
    return np.linalg.solve(root, (x - centre).T).T


def concentrate(x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows kept, centre, covariance) when concentration ends; None when a covariance is singular.

    Without ``keep`` it starts from the rows nearest to the median in MAD units. Equal distances go by row number.
    """
    n, p = x.shape
    h = support(n)
    if keep is None:
        med = np.median(x, axis=0)
        mad = np.median(np.abs(x - med), axis=0)
        mad[mad == 0] = 1.0
        keep = np.argsort((((x - med) / mad) ** 2).sum(axis=1), kind="stable")[:h]
    keep = np.sort(keep)
    for _ in range(STEPS):
        centre, cov = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True).reshape(p, p)
        try:
            far = (whiten(x, centre, np.linalg.cholesky(cov)) ** 2).sum(axis=1)
        except np.linalg.LinAlgError:
            return None
        new = np.sort(np.argsort(far, kind="stable")[:h])
        if np.array_equal(new, keep):
            break
        keep = new
    return keep, centre, cov


def refit(x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(centre, covariance) of the rows inside the 97.5 % ellipsoid of the concentrated fit."""
    p = x.shape[1]
    found = concentrate(x, keep)
    if found is None:
        return None
    _, centre, cov = found
    far = (whiten(x, centre, np.linalg.cholesky(cov)) ** 2).sum(axis=1)
    inside = far / (np.median(far) / chi2_isf(0.5, p)) < chi2_isf(0.025, p)
    return x[inside].mean(axis=0), np.cov(x[inside].T, bias=True).reshape(p, p)


def lot_of(x: np.ndarray, width: int = WINDOW) -> tuple[Lot, np.ndarray, np.ndarray] | None:
    """(the lot, its rows whitened, their ranks by distance) of rows in lexical order; None when singular."""
    n, p = x.shape
    found = concentrate(x)
    if found is None:
        return None
    keep, centre, cov = found
    root = np.linalg.cholesky(cov)
    y = whiten(x, centre, root)
    far = np.sqrt((y**2).sum(axis=1))
    # The kept rows come first even if concentration was cut short.
    outside = np.ones(n, bool)
    outside[keep] = False
    order = np.lexsort((far, outside)) if (outside[np.argsort(far, kind="stable")[: len(keep)]]).any() else np.argsort(far, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    inside = far**2 / (np.median(far**2) / chi2_isf(0.5, p)) < chi2_isf(0.025, p)
    cuts = (len(keep), n // 2, int(inside.sum()))
    windows = [Window.around(y[order], order, far[order], cut, width) for cut in cuts]
    return Lot(n, p, centre, root, *windows), y, rank


class _Others:
    """Some parts of a lot, each against all the others."""

    def __init__(self, lot: Lot, y: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.lot, self.y, self.mine = lot, y, _each(y)
        self.places = {id(w): x for w, x in zip((lot.at_support, lot.at_median, lot.at_ellipsoid), places)}

    def own(self, window: Window) -> tuple[np.ndarray, np.ndarray]:
        """(which of the window's points a part is, whether it lies before the window)."""
        place = self.places[id(window)]
        return place[:, None] == np.arange(len(window.points))[None, :], place < 0

    def moments_of(self, window: Window, chosen: np.ndarray) -> np.ndarray:
        _, ahead = self.own(window)
        return window.before[None, :] - ahead[:, None] * self.mine + chosen @ _each(window.points)

    def moved(self, window: Window, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """New distances of the window's points for each part; its own is infinite."""
        delta = window.points[None, :, :] - centre[:, None, :]
        out = np.einsum("ibp,ipq,ibq->ib", delta, inverse, delta, optimize=True)
        out[self.own(window)[0]] = np.inf
        return out

    def sure(self, window: Window, cut: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> None:
        """No point beyond the window may come to lie on the other side of the distance ``cut``."""
        eigen = np.linalg.eigvalsh(inverse)
        shift = np.sqrt((centre**2).sum(axis=1))
        if np.isfinite(window.low) and not (eigen[:, -1] * (window.low + shift) ** 2 < cut).all():
            raise Widen
        if np.isfinite(window.high) and not (eigen[:, 0] * np.maximum(0.0, window.high - shift) ** 2 > cut).all():
            raise Widen

    def nearest(self, window: Window, k: int, centre: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the window's points are among the ``k`` nearest others, the distance of the last of them)."""
        same, ahead = self.own(window)
        moved = self.moved(window, centre, inverse)
        need = k - (window.n_before - ahead)
        if (need < 1).any() or (need > moved.shape[1] - same.sum(axis=1)).any():
            raise Widen
        order = window.lexical[np.argsort(moved[:, window.lexical], axis=1, kind="stable")]
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        last = np.take_along_axis(moved, np.take_along_axis(order, (need - 1)[:, None], axis=1), axis=1)[:, 0]
        self.sure(window, last, centre, inverse)
        return rank < need[:, None], last

    def fits(self) -> tuple[np.ndarray, np.ndarray]:
        lot, p = self.lot, self.lot.p
        n, window = lot.n - 1, lot.at_support
        same, _ = self.own(window)
        chosen = (np.arange(len(window.points)) + window.n_before < support(lot.n))[None, :] & ~same
        for _ in range(STEPS):
            centre, cov = _shape(self.moments_of(window, chosen), p)
            inverse = np.linalg.inv(cov)
            new, _ = self.nearest(window, support(n), centre, inverse)
            if np.array_equal(new, chosen):
                break
            chosen = new
        low = self.nearest(lot.at_median, (n - 1) // 2 + 1, centre, inverse)[1]
        high = self.nearest(lot.at_median, n // 2 + 1, centre, inverse)[1]
        factor = (low + high) / 2 / chi2_isf(0.5, p)
        edge = lot.at_ellipsoid
        self.sure(edge, factor * chi2_isf(0.025, p), centre, inverse)
        inside = self.moved(edge, centre, inverse) / factor[:, None] < chi2_isf(0.025, p)
        return _shape(self.moments_of(edge, inside), p)


def fits(lot: Lot, y: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centres, covariances), whitened, of the fits without each of the parts ``y`` of a lot.

    ``places`` are the parts' places in the three windows, below zero before them.
    """
    return _Others(lot, y, places).fits()


def _result(lot: Lot, x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = lot.centre + centre @ lot.root.T
    spread = lot.root @ cov @ lot.root.T
    delta = x - mean
    try:
        weight = np.linalg.solve(spread, delta[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        # The others of some rows lie on a plane; only those rows stay without a distance.
        sound = np.linalg.cond(spread) <= K.MCD_CONDITION
        weight = np.full(delta.shape, np.nan)
        weight[sound] = np.linalg.solve(spread[sound], delta[sound][:, :, None])[:, :, 0]
    return delta * weight, mean, spread


def score(x: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(contributions, centres, covariances) of each row against the others; rows in lexical order. None when singular.

    ``x`` has unit spread in each column. Windows grow until they hold every change of side.
    """
    width = WINDOW
    while True:
        found = lot_of(x, width)
        if found is None:
            return None
        lot, y, rank = found
        try:
            windows = (lot.at_support, lot.at_median, lot.at_ellipsoid)
            each = (slice(a, a + chunk) for a in range(0, len(x), chunk))
            parts = [fits(lot, y[e], tuple(rank[e] - w.n_before for w in windows)) for e in each]
        except Widen:
            width *= 4
            continue
        except np.linalg.LinAlgError:
            return None
        centre, cov = (np.concatenate(z) for z in zip(*parts))
        return _result(lot, x, centre, cov)


def against_others(x: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """(contributions to each row's distance from the others, refusal of each row) of the rows of a lot, in any order."""
    n, p = x.shape
    none = np.full((n, p), np.nan)
    others = n - 1
    if others < K.MIN_COHORT or others <= p:
        return none, ["INSUFFICIENT_COHORT"] * n
    if others < K.MCD_SAMPLE_FACTOR * p:
        return none, ["INSUFFICIENT_SAMPLE_RATIO"] * n
    # A column is constant among the others of a row if all but that row agree in it.
    constant = np.zeros((n, p), bool)
    for j in range(p):
        values, counts = np.unique(x[:, j], return_counts=True)
        if len(values) == 1:
            constant[:, j] = True
        elif len(values) == 2 and counts.min() == 1:
            constant[:, j] = x[:, j] == values[counts.argmin()]
    codes = np.where(constant.all(axis=1), "NO_VARIATION", np.where(constant.any(axis=1), "SINGULAR_COVARIANCE", "")).astype(object)
    good = np.flatnonzero(codes == "")
    spread = x.std(axis=0)
    if len(good) and (spread > 0).all():
        y = x / spread
        order = np.lexsort(y.T[::-1])
        found = score(y[order])
        if found is None:
            codes[good] = "SINGULAR_COVARIANCE"
        else:
            parts, _, cov = (np.empty_like(z) for z in found)
            parts[order], cov[order] = found[0], found[2]
            ill = ~(np.linalg.cond(cov) <= K.MCD_CONDITION) & (codes == "")
            codes[ill] = "SINGULAR_COVARIANCE"
            none[codes == ""] = parts[codes == ""]
    elif len(good):
        codes[good] = "SINGULAR_COVARIANCE"
    return none, [c or None for c in codes]


def lot_from(n: int, centre: np.ndarray, cov: np.ndarray, windows: list[tuple]) -> tuple[Lot, list[dict]]:
    """(the lot, for each window the place of each point) from figures gathered over many tasks.

    A window is (its points, moments of what lies before, distance just below, distance just above), not whitened; the
    order of its points is by distance, then lexical.
    """
    p = len(centre)
    root = np.linalg.cholesky(cov)
    back = np.linalg.inv(root)
    made, places = [], []
    for points, before, low, high in windows:
        points = points[np.lexsort(points.T[::-1])]
        y = whiten(points, centre, root)
        order = np.argsort((y**2).sum(axis=1), kind="stable")
        m, s, q = before[0], before[1 : p + 1], before[p + 1 :].reshape(p, p)
        whitened = back @ (q - np.outer(s, centre) - np.outer(centre, s) + m * np.outer(centre, centre)) @ back.T
        moved = np.concatenate([[m], back @ (s - m * centre), whitened.ravel()])
        edges = (-np.inf if low is None else math.sqrt(low), np.inf if high is None else math.sqrt(high))
        made.append(Window(y[order], np.argsort(order, kind="stable"), moved, int(m), *edges))
        places.append({tuple(x): i for i, x in enumerate(points[order].tolist())})
    return Lot(n, p, centre, root, *made), places


def score_some(lot: Lot, places: list[dict], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``score`` for some of the rows of a lot; raises Widen when a window is too narrow."""
    y = whiten(x, lot.centre, lot.root)
    far = np.sqrt((y**2).sum(axis=1))
    rows = list(map(tuple, x.tolist()))
    at = []
    for known, window in zip(places, (lot.at_support, lot.at_median, lot.at_ellipsoid)):
        found = np.array([known.get(r, -1) for r in rows])
        middle = np.sqrt((window.points[len(window.points) // 2] ** 2).sum()) if len(window.points) else window.low
        at.append(np.where(found >= 0, found, np.where(far < middle, -1, len(window.points))))
    return _result(lot, x, *fits(lot, y, tuple(at)))
