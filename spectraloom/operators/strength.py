"""Search of the regularisation strength, many objects at a time.

``search`` needs no knowledge of the fit: it asks for trials at (object, strength) and moves every object's bracket by
what comes back, so a whole batch of objects grows, bisects and falls back together and finished ones cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FIELDS = ("chi2", "peaks", "v", "sigma")


def count_peaks(b: np.ndarray, prominence: float = 0.1) -> np.ndarray:
    """Strict local maxima of each row whose height over the higher key col reaches a share of the row's top; at least 1."""
    b = np.maximum(b, 0.0)
    top = b.max(1)
    out = np.zeros(len(b), np.int64)
    for i in range(1, b.shape[1] - 1):
        rows = np.flatnonzero((b[:, i] > b[:, i - 1]) & (b[:, i] > b[:, i + 1]))
        if not len(rows):
            continue
        own = b[rows, i]
        cols = []
        for side in (b[rows, :i][:, ::-1], b[rows, i + 1 :]):
            # The lowest bin on the way to the first higher one; 0 where there is none. A peak's neighbours are lower.
            higher = side > own[:, None]
            low = np.minimum.accumulate(side, axis=1)
            cols.append(np.where(higher.any(1), low[np.arange(len(rows)), np.maximum(np.argmax(higher, axis=1) - 1, 0)], 0.0))
        out[rows] += own - np.maximum(*cols) >= prominence * top[rows]
    return np.maximum(out, 1)


def search(
    evaluate: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], count: int, ngood: np.ndarray, lo: float, hi: float, v_center: np.ndarray,
    nsigma: float = 0.3, max_peaks: int = 1, expansions: int = 6, bisections: int = 8, dex: float = 0.05,
) -> dict[str, np.ndarray]:
    """Strength at which chi2 has risen by ``nsigma`` of its own fluctuation above the smallest strength's.

    ``evaluate(rows, lam)`` returns chi2, peaks, v, sigma for each. The upper end grows tenfold up to ``expansions`` times
    until the target chi2_min * (1 + nsigma * sqrt(2 / ngood)) is reached, then the bracket is halved in log strength down to
    ``dex``. A multi-peaked answer gives way to the smallest unimodal trial at or above the target, or to the first unimodal
    one on further growth. A centroid far from ``v_center`` (5 sigma) or from the other unimodal trials (5 MAD, 3 at
    least) gives way to the largest other unimodal trial that is sane.

    Returns ``lam``, ``target``, ``reached`` (the first answer met the target), ``expansions``, ``suspicious`` (three or more),
    ``sane``, ``trials`` (evaluations) and ``pool`` with all trials as (object, trial) arrays, NaN where there is none.
    """
    room = 2 + expansions + bisections + expansions
    pool = {k: np.full((count, room), np.nan) for k in ("lam", *FIELDS)}
    used = np.zeros(count, np.int64)

    def ask(rows: np.ndarray, lam: np.ndarray) -> np.ndarray:
        if len(rows):
            got = evaluate(rows, lam)
            pool["lam"][rows, used[rows]] = lam
            for k in FIELDS:
                pool[k][rows, used[rows]] = got[k]
            used[rows] += 1
        last = np.maximum(used[rows] - 1, 0)
        return pool["chi2"][rows, last]

    every = np.arange(count)
    lows, highs = np.full(count, float(lo)), np.full(count, float(hi))
    target = ask(every, lows) * (1 + nsigma * np.sqrt(2.0 / np.maximum(ngood, 1)))
    at_high = ask(every, highs)
    grown = np.zeros(count, np.int64)
    for _ in range(expansions):
        rows = np.flatnonzero(at_high < target)
        if not len(rows):
            break
        lows[rows] = highs[rows]
        highs[rows] = highs[rows] * 10
        grown[rows] += 1
        at_high[rows] = ask(rows, highs[rows])
    reached = at_high >= target
    for _ in range(bisections):
        rows = np.flatnonzero(reached & (np.log10(highs) - np.log10(lows) >= dex))
        if not len(rows):
            break
        mid = 10 ** ((np.log10(lows[rows]) + np.log10(highs[rows])) / 2)
        below = ask(rows, mid) < target[rows]
        lows[rows[below]] = mid[below]
        highs[rows[~below]] = mid[~below]
    best = highs.copy()

    single = lambda: pool["peaks"] <= max_peaks  # noqa: E731  NaN compares false
    is_best = lambda: pool["lam"] == best[:, None]
    many = np.flatnonzero((is_best() & ~single() & ~np.isnan(pool["lam"])).any(1))
    if len(many):
        fit = np.where(single() & (pool["chi2"] >= target[:, None]), pool["lam"], np.inf)[many].min(1)
        best[many] = np.where(np.isfinite(fit), fit, best[many])
        left, top = many[~np.isfinite(fit)], highs.copy()
        for _ in range(expansions):
            if not len(left):
                break
            top[left] *= 10
            ask(left, top[left])
            good = pool["peaks"][left, used[left] - 1] <= max_peaks
            best[left[good]] = top[left[good]]
            left = left[~good]

    def sane(lam: np.ndarray) -> np.ndarray:
        """Of every object's trial at ``lam``."""
        here = pool["lam"] == lam[:, None]
        at = np.argmax(here, axis=1)
        v, s = pool["v"][every, at], np.maximum(pool["sigma"][every, at], 1.0)
        near = np.abs(v - v_center) <= 5 * s
        others = np.where(single() & ~here, pool["v"], np.nan)
        enough = (~np.isnan(others)).sum(1) >= 2
        safe = np.where(enough[:, None], others, 0.0)
        middle = np.nanmedian(safe, axis=1)
        mad = np.nanmedian(np.abs(safe - middle[:, None]), axis=1)
        return near & (~enough | (np.abs(v - middle) <= 5 * np.maximum(mad, 3.0))) & here.any(1)

    ok = sane(best)
    if not ok.all():
        left = ~ok
        order = np.sort(np.where(single() & (pool["lam"] != best[:, None]), pool["lam"], -np.inf), axis=1)[:, ::-1]
        for lam in order.T:
            if not left.any():
                break
            hit = left & np.isfinite(lam) & sane(lam)
            best[hit] = lam[hit]
            left &= ~hit
    return {"lam": best, "target": target, "reached": reached, "expansions": grown, "suspicious": grown >= 3, "sane": sane(best), "trials": used, "pool": pool}
