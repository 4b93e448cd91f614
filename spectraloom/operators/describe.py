"""Gauss-Hermite description of histograms, many packed histograms per Arrow batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.pixels import OBJ
from spectraloom.plans.scale import spread

HERMITE_BOUND = {"classic": 1.0, "higher": 0.5}
SLICE = 512


def _terms(w: np.ndarray, orders: list[int], convention: str) -> list[np.ndarray]:
    """1 and the Hermite terms of the given orders; the two conventions never mix."""
    if convention == "classic":
        by_order = {3: (2 * w**3 - 3 * w) / math.sqrt(3.0), 4: (4 * w**4 - 12 * w**2 + 3) / math.sqrt(24.0)}
        return [np.ones_like(w), *[by_order[n] for n in orders]]
    he = [np.ones_like(w), w]
    for k in range(1, max(orders, default=1)):
        he.append(w * he[k] - k * he[k - 1])
    return [np.ones_like(w), *[he[n] / math.sqrt(math.factorial(n)) for n in orders]]


def _linear(v, y, vel, sig, orders, convention, bound):
    """Best amplitude and Hermite terms for given (vel, sig) and what the model leaves; leading axes are broadcast."""
    w = (v - vel[..., None]) / sig[..., None]
    g = np.exp(-0.5 * w * w) / (math.sqrt(2 * math.pi) * sig[..., None])
    cols = np.stack([g * t for t in _terms(w, orders, convention)], axis=-2)
    a = cols @ np.swapaxes(cols, -1, -2)
    r = (cols @ y[..., None])[..., 0]
    d = np.sqrt(np.maximum(np.einsum("...ii->...i", a), 1e-300))
    a = a / d[..., :, None] / d[..., None, :] + 1e-12 * np.eye(len(orders) + 1)
    c = np.linalg.solve(a, (r / d)[..., None])[..., 0] / d
    amp = np.maximum(c[..., 0], 1e-300)
    h = np.clip(c[..., 1:] / amp[..., None], -bound, bound)
    return amp, h, amp[..., None] * (cols[..., 0, :] + np.einsum("...k,...kn->...n", h, cols[..., 1:, :])) - y


def _half_width(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.argmax(y, axis=1)
    row = np.arange(len(y))
    half = y[row, top][:, None] / 2
    idx = np.arange(y.shape[1])[None, :]
    lower = y < half
    left = np.where(lower & (idx < top[:, None]), idx, 0).max(1)
    right = np.where(lower & (idx > top[:, None]), idx, y.shape[1] - 1).min(1)
    return v[row, top], (v[row, right] - v[row, left]) / 2.35


def describe_batch(v: np.ndarray, y: np.ndarray, orders: list[int], convention: str, steps: int = 300) -> np.ndarray:
    """(amp, V, sigma, h..., sse, converged) per row: damped Gauss-Newton on V and log sigma, the rest projected out.

    The descent starts close to the half-maximum width, as a wide start would end in a second solution with twice the width
    and a large h4. A second one starts at the moments, for profiles whose peak is a narrow spike; it is taken if clearly
    better.
    """
    weight = np.maximum(y, 0) / np.maximum(np.maximum(y, 0).sum(1, keepdims=True), 1e-300)
    mean = (weight * v).sum(1)
    starts = [_half_width(v, y), (mean, np.sqrt((weight * (v - mean[:, None]) ** 2).sum(1)))]
    found = [_descend(v, y, vel, sig, orders, convention, steps) for vel, sig in starts]
    better = found[1][:, -2] < 0.99 * found[0][:, -2]
    return np.where(better[:, None], found[1], found[0])


def _descend(v: np.ndarray, y: np.ndarray, vel: np.ndarray, sig: np.ndarray, orders: list[int], convention: str, steps: int) -> np.ndarray:
    """One descent of every row; rows leave the batch when no step gains anything any more."""
    bound, small = HERMITE_BOUND[convention], 1e-5
    dv = np.maximum(np.diff(v, axis=1).mean(1), 1e-12)
    lo, hi, left, right = 0.2 * dv, np.ptp(v, axis=1), v.min(1), v.max(1)
    vel, sig = np.clip(vel, left, right), np.clip(sig, dv, hi)
    damp, done, live, idle = np.full(len(y), 1e-2), np.zeros(len(y), bool), np.arange(len(y)), np.zeros(len(y), np.int64)
    fit = lambda rows, a, b: _linear(v[rows], y[rows], a, b, orders, convention, bound)[2]
    rest = fit(live, vel, sig)
    for _ in range(steps):
        if not len(live):
            break
        a, b, r = vel[live], sig[live], rest[live]
        slope = np.stack([fit(live, a + small * b, b) - r, fit(live, a, b * math.exp(small)) - r], axis=1) / small
        g, h = slope @ r[..., None], slope @ np.swapaxes(slope, 1, 2)
        size = np.maximum(np.einsum("bii->bi", h), 1e-300)
        h = h + (damp[live][:, None] * size + 1e-300)[:, :, None] * np.eye(2)
        move = np.clip(-np.linalg.solve(h, g)[..., 0], -0.5, 0.5)
        new_a, new_b = np.clip(a + move[:, 0] * b, left[live], right[live]), np.clip(b * np.exp(move[:, 1]), lo[live], hi[live])
        new = fit(live, new_a, new_b)
        old_sse, new_sse = (r * r).sum(1), (new * new).sum(1)
        gain = new_sse < old_sse
        at = live[gain]
        vel[at], sig[at], rest[at] = new_a[gain], new_b[gain], new[gain]
        damp[live] = np.where(gain, damp[live] * 0.3, damp[live] * 5)
        # Several steps in a row that gain next to nothing: along a bound of the terms the surface has a kink and steps stay short.
        idle[live] = np.where(gain & (old_sse - new_sse > 1e-7 * old_sse), 0, idle[live] + gain)
        still = (np.abs(move).max(1) < 1e-8) | (gain & (old_sse - new_sse <= 1e-13 * old_sse)) | (idle[live] >= 8) | (damp[live] > 1e12)
        done[live] = still
        live = live[~still]
    amp, h, rest = _linear(v, y, vel, sig, orders, convention, bound)
    return np.column_stack([amp, vel, sig, h, (rest * rest).sum(1), done])


def _batches(keys: list[str], orders: list[int], convention: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, SLICE):
                b = big.slice(start, SLICE)
                vs = [np.asarray(x, float) for x in b.column("_v").to_pylist()]
                ys = [np.asarray(x, float) for x in b.column("_y").to_pylist()]
                out = np.full((len(vs), len(names)), np.nan)
                sizes = np.array([len(x) for x in vs])
                for n in np.unique(sizes[sizes >= 5]):
                    at = np.flatnonzero(sizes == n)
                    out[at] = describe_batch(np.stack([vs[i] for i in at]), np.stack([ys[i] for i in at]), orders, convention)
                cols = [pa.array(out[:, i], pa.float64(), from_pandas=True) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *cols], [*keys, *names])

    return run


def gh_fit(df: DataFrame, keys: list[str] = OBJ, h3h4: bool = True) -> DataFrame:
    """Four-moment description ``amp, vel, sigma, h3, h4, sse, converged``; null and not converged below 5 finite points."""
    return _describe(df, keys, [3, 4] if h3h4 else [], "classic")


def gh_fit_higher(df: DataFrame, keys: list[str] = OBJ, max_order: int = 6) -> DataFrame:
    """Description up to h_max_order (at least 4) in the other normalisation."""
    return _describe(df, keys, list(range(3, max(max_order, 4) + 1)), "higher")


def gh_fit_packed(fits: DataFrame, vmin: float, vmax: float, n: int, keys: list[str] = OBJ) -> DataFrame:
    """``gh_fit`` of packed histograms ``b`` on a uniform grid."""
    grid = F.array(*[F.lit(float(vmin + (vmax - vmin) * i / (n - 1))) for i in range(n)])
    return _described(spread(fits.select(*keys, grid.alias("_v"), F.col("b").alias("_y")), *keys), keys, [3, 4], "classic")


def _describe(df: DataFrame, keys: list[str], orders: list[int], convention: str) -> DataFrame:
    usable = F.col("b").isNotNull() & ~F.isnan("b")
    packed = spread(df, *keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct("bin", F.col("v").alias("v"), F.col("b").cast("double").alias("b"))))).alias("_p")
    ).select(*keys, F.transform("_p", lambda e: e["v"]).alias("_v"), F.transform("_p", lambda e: e["b"]).alias("_y"))
    return _described(packed, keys, orders, convention)


def _described(packed: DataFrame, keys: list[str], orders: list[int], convention: str) -> DataFrame:
    names = ["amp", "vel", "sigma", *[f"h{n}" for n in orders], "sse", "converged"]
    types = dict(packed.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + ", ".join(f"{n} double" for n in names)
    out = packed.mapInArrow(_batches(keys, orders, convention, names), schema)
    out = out.withColumn("converged", F.coalesce(F.col("converged") > 0, F.lit(False)))
    if not orders:
        out = out.withColumn("h3", F.lit(0.0)).withColumn("h4", F.lit(0.0))
    return out
