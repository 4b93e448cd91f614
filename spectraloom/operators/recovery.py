"""Regularised recovery of velocity histograms without a stored design.

The pixels of a series travel as packed blocks, one row per (object, block of positions) with the neighbours that a block's
pixels are spread from. A round is one pass over the blocks: numpy scatters each block's template pixels over the velocity
bins, linearises the model around the object's current state and emits the block's share of the normal equations, which
is all that is added up or solved; nothing per pixel is ever written. Where every series is one block, an object's rounds
follow each other on its scattered pixels in one pass. Unknowns are the histogram b, the coefficients of a
multiplicative spline continuum and the template weights, together; sum(b) = 1 and sum(w) = 1 are exact constraints of
the joint model. Rounds are Gauss-Newton steps that are shortened until the objective falls; an object leaves the table
when a step gains nothing any more, and says whether it converged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import C_KMS, valid_pixel
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.solve import FLOOR, difference_matrix, penalty_batch, spline_basis, start_shape
from spectraloom.operators.strength import count_peaks, search
from spectraloom.plans.scale import BLOCK_ROWS, cut, is_small, setting, spread

KEYS = [*OBJ, "_blk"]


@dataclass(frozen=True)
class Model:
    """What is fitted. ``joint`` means sum(b) = 1 and a spline continuum of ``interior`` knots (none: no continuum)."""

    n: int = 29
    vmin: float = -300.0
    vmax: float = 300.0
    step: float = 1.25
    joint: bool = False
    interior: int = 10
    lam_cont: float = 3.0
    templates: int = 1
    n_fine: int = 0
    size: int = 65_536
    single: bool = True

    @property
    def nc(self) -> int:
        return self.interior + 4 if self.joint and self.interior >= 0 else 0

    @property
    def nw(self) -> int:
        return self.templates if self.templates > 1 else 0

    @property
    def total(self) -> int:
        return self.n + self.nc + self.nw

    @property
    def sums(self) -> list[slice]:
        """Groups of unknowns that add up to one."""
        out = [slice(0, self.n)] if self.joint else []
        return out + ([slice(self.n + self.nc, self.total)] if self.nw else [])


# --- constrained solves ----------------------------------------------------------------------------


def constrained_batch(mat: np.ndarray, rhs: np.ndarray, low: np.ndarray, sums: Sequence[slice], rounds: int = 120, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """min z'Mz/2 - q'z with z >= low (-inf: free) and the unknowns of each slice of ``sums`` adding up to one.

    ``start`` is a guess of the minimisers: the active sets begin with the unknowns that it has at their bounds. Block pivoting on the active sets of a stack of problems, each round solving the bordered systems of the live ones.
    Returns the minimisers and whether all conditions hold.
    """
    count, n = rhs.shape
    bound = np.isfinite(low)
    floor = np.where(bound, low, 0.0)
    scale = np.sqrt(np.maximum(np.einsum("ijj->ij", mat), 1e-300))
    m = mat / scale[:, :, None]
    m /= scale[:, None, :]
    m[:, np.arange(n), np.arange(n)] += 1e-12
    q = (rhs - np.einsum("bij,j->bi", mat, floor)) / scale
    k = len(sums)
    rows = np.zeros((k, n))
    for i, s in enumerate(sums):
        rows[i, s] = 1.0
    total = 1.0 - rows @ floor
    free = np.ones((count, n), bool) if start is None else ~bound | (start > low)
    out, solved = np.zeros((count, n)), np.zeros(count, bool)
    best, patience, live = np.full(count, n + 1), np.full(count, 3), np.arange(count)
    at = np.arange(n)
    for _ in range(rounds):
        if not len(live):
            break
        f, c, now = free[live], q[live], m if len(live) == count else m[live]
        e = rows[None] / scale[live][:, None, :]
        a = np.zeros((len(live), n + k, n + k)) if k else np.empty(now.shape)
        np.multiply(now, f[:, :, None] & f[:, None, :], out=a[:, :n, :n])
        a[:, at, at] += ~f
        if k:
            a[:, n:, :n] = np.where(f[:, None, :], e, 0.0)
            a[:, :n, n:] = np.swapaxes(a[:, n:, :n], 1, 2)
        right = np.concatenate([np.where(f, c, 0.0), np.broadcast_to(total, (len(live), k))], axis=1)
        y = np.linalg.solve(a, right[..., None])[..., 0]
        z, price = y[:, :n], y[:, n:]
        slope = (now @ z[..., None])[..., 0] - c + np.einsum("bki,bk->bi", e, price)
        tol = 1e-11 * np.maximum(np.maximum(np.abs(z).max(1, keepdims=True), np.abs(c).max(1, keepdims=True)), 1e-300)
        bad = bound & np.where(f, z < -tol, slope < -tol)
        out[live] = z
        nbad = bad.sum(1)
        better = nbad < best[live]
        best[live] = np.where(better, nbad, best[live])
        patience[live] = np.where(better, 3, patience[live] - 1)
        last = np.zeros_like(bad)
        last[np.arange(len(live)), n - 1 - np.argmax(bad[:, ::-1], axis=1)] = True
        new = f ^ np.where((patience[live] < 0)[:, None], bad & last, bad)
        for s in sums:  # a group needs one free member to reach its sum
            empty = ~new[:, s].any(1)
            if empty.any():
                keep = s.start + np.argmax(z[empty][:, s], axis=1)
                new[np.flatnonzero(empty), keep] = True
        free[live] = new
        solved[live] = nbad == 0
        live = live[nbad > 0]
    z = np.where(bound[None], np.maximum(out / scale, 0.0), out / scale) + floor
    for i, s in enumerate(sums):  # exact to rounding, also where pivoting gave up
        part = z[:, s] - floor[s]
        z[:, s] = floor[s] + part * (total[i] / np.maximum(part.sum(1, keepdims=True), 1e-300))
    return z, solved


# --- blocks ----------------------------------------------------------------------------------------


def pack_blocks(pix: DataFrame, n: int, vmin: float, vmax: float, step: float, joint: bool = False, interior: int = 10, lam_cont: float = 3.0,
                value: str = "t", cont: str | None = None) -> tuple[DataFrame, DataFrame, Model]:
    """(blocks, ends, model): the packed pixels, one row per object of what a fit needs to know, and the model's sizes.

    ``pix(object_id, pix, x, g, gerr, good, t)`` where ``t`` is a number (one template mixture) or an array (a value per
    template); ``cont`` names a fixed multiplicative continuum. Positions are dense from 0.
    """
    size = setting(pix.sparkSession, BLOCK_ROWS)
    many = dict(pix.dtypes)[value].startswith("array")
    t = F.col(value) if many else F.array(F.col(value).cast("double"))
    ok = valid_pixel()
    row = pix.select(
        *OBJ, F.col("pix").cast("long").alias("pix"), F.col("x").cast("double").alias("x"), F.when(ok, F.col("g")).otherwise(0.0).cast("double").alias("g"),
        F.when(ok, 1 / (F.col("gerr") * F.col("gerr"))).otherwise(0.0).cast("double").alias("w"),
        (F.col(cont).cast("double") if cont else F.lit(1.0)).alias("c"), t.cast("array<double>").alias("t"),
    )
    mean_t = F.aggregate("t", F.lit(0.0), lambda a, b: a + b) / F.size("t")
    used = F.col("w") > 0
    ends = cut(row.groupBy(*OBJ).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("pix").alias("last"), F.avg(F.when(used, F.col("g"))).alias("_g"),
        F.avg(F.when(used, mean_t)).alias("_t"), F.avg(F.when(used, F.abs("g"))).alias("scale"), F.max(F.size("t")).alias("nt"),
    ))
    top = ends.agg(F.max("x1"), F.max("last"), F.max("nt")).first()
    x_hi, last, nt = top[0] or 0.0, top[1] or 0, top[2] or 1
    reach = int(math.ceil(max(abs(vmin), abs(vmax)) / C_KMS * x_hi / step)) + 2
    model = Model(n, float(vmin), float(vmax), float(step), joint, interior, lam_cont, nt, max(3, 2 * round((vmax - vmin) / step * x_hi / C_KMS)), size, last < size)
    lo, hi = F.greatest(F.floor((F.col("pix") - reach) / size), F.lit(0).cast("long")), F.floor((F.col("pix") + reach) / size)
    parts = row.withColumn("_blk", F.explode(F.sequence(lo, hi)))
    numbers = F.concat(F.array(F.col("pix").cast("double"), "x", "g", "w", "c"), F.slice(F.concat("t", F.array_repeat(F.lit(0.0), nt)), 1, nt))
    blocks = spread(parts, *KEYS).groupBy(*KEYS).agg(F.flatten(F.collect_list(numbers)).alias("px"))
    level = F.when(F.abs("_t") > 0, F.col("_g") / F.col("_t")).otherwise(F.col("_g"))
    ends = ends.select(*OBJ, "x0", "x1", "last", F.coalesce(level, F.lit(1.0)).alias("level"), F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))
    return cut(blocks), ends, model


def _fine(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factor of every fine velocity sample, the bin at or below it and the share of the bin above."""
    j = np.arange(model.n_fine)
    place = j * (model.n - 1) / (model.n_fine - 1)
    low = np.minimum(np.floor(place + 1e-12).astype(np.int64), model.n - 1)
    v = model.vmin + (model.vmax - model.vmin) * j / (model.n_fine - 1)
    return (1 + v / C_KMS) / model.step, low, np.maximum(place - low, 0.0)


class Stack:
    """The pixels of several blocks: their own (data, one block after the other) and those around them (templates).

    ``px`` has a row per pixel (position, x, g, w, c and the template values), block r those from ``at[r]`` to ``at[r + 1]``.
    """

    def __init__(self, model: Model, number: np.ndarray, px: np.ndarray, at: np.ndarray, x0: np.ndarray, x1: np.ndarray, last: np.ndarray):
        row, position = np.repeat(np.arange(len(number)), np.diff(at)), px[:, 0].astype(np.int64)
        own = np.flatnonzero(position // model.size == number[row])
        own = own[np.lexsort((position[own], row[own]))]
        self.model, self.row, self.pix = model, row[own], position[own]
        self.x, self.g, self.weight, self.fixed = (px[own, i] for i in range(1, 5))
        self.count = np.bincount(self.row, minlength=len(number))
        self.start = np.cumsum(self.count) - self.count
        first, m = number * model.size, len(own)
        if (self.pix - first[self.row] != np.arange(m) - self.start[self.row]).any():
            raise ValueError("positions of a series are not dense")
        factor, low, share = _fine(model)
        place = (1 - x0 / model.step)[row][:, None] + px[:, 1:2] * factor
        to = np.where(place >= 0, np.floor(place + 0.5), np.ceil(place - 0.5)).astype(np.int64) - 1
        ok = (to >= first[row][:, None]) & (to < (first + self.count)[row][:, None]) & (to <= last[row][:, None])
        self.a = np.zeros((model.templates, m, model.n))
        self.w = np.zeros((m, model.n))
        base = (to + (self.start - first)[row][:, None]) * model.n
        high = np.minimum(low + 1, model.n - 1)
        source = np.broadcast_to(np.arange(len(px))[:, None], to.shape)[ok]
        for bins, part in ((low, 1 - share), (high, share)):
            flat, s = (base + bins)[ok], np.broadcast_to(part, to.shape)[ok]
            self.w += np.bincount(flat, s, m * model.n).reshape(m, model.n)
            for i in range(model.templates):
                self.a[i] += np.bincount(flat, s * px[source, 5 + i], m * model.n).reshape(m, model.n)
        self.basis = None
        if model.nc:
            self.basis = spline_basis(self.x, x0[self.row], x1[self.row], model.interior)

    def groups(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of one length, a bounded number together: which of ``rows`` they are and their pixels, a row for each."""
        for m in np.unique(self.count[rows]):
            which = np.flatnonzero(self.count[rows] == m)
            some = max(1, STACK_VALUES // max(1, m * self.model.total))
            for i in range(0, len(which), some):
                part = which[i : i + some]
                yield part, self.start[rows[part]][:, None] + np.arange(m)

    def at(self, z: np.ndarray, pixels: np.ndarray, slopes: bool = True):
        """(model, continuum, jacobian) of the blocks of ``pixels`` at their unknowns, the rows of ``z``."""
        m = self.model
        b, c, w = z[:, : m.n, None], z[:, m.n : m.n + m.nc, None], z[:, m.n + m.nc :]
        each = [a[pixels] for a in self.a]
        a = sum(w[:, i, None, None] * x for i, x in enumerate(each)) if m.nw else each[0]
        under, total = self.w[pixels], b.sum(1)
        top, bottom = (a @ b)[..., 0], (under @ b)[..., 0]
        free = bottom != 0
        safe = np.where(free, bottom, 1.0)
        ratio = np.where(free, top / safe, top)
        flux = np.where(free, total * ratio, top)
        fixed = self.fixed[pixels]
        cont = fixed * (self.basis[pixels] @ c)[..., 0] if m.nc else fixed
        if not slopes:
            return flux * cont, cont, None
        by_bin = np.where(free[..., None], ratio[..., None] + (total / safe)[..., None] * (a - ratio[..., None] * under), a)
        parts = [by_bin * cont[..., None]]
        if m.nc:
            parts.append(self.basis[pixels] * (flux * fixed)[..., None])
        if m.nw:
            by_template = [(x @ b)[..., 0] for x in each]
            parts.append(np.stack([np.where(free, total * x / safe, x) for x in by_template], axis=-1) * cont[..., None])
        return flux * cont, cont, np.concatenate(parts, axis=-1) if len(parts) > 1 else parts[0]

    def seen(self, z: np.ndarray, pixels: np.ndarray) -> tuple[np.ndarray, ...]:
        """(model, jacobian, weight) where pixels without a weight or a finite model count for nothing."""
        flux, _, j = self.at(z, pixels)
        w = np.where(np.isfinite(flux), self.weight[pixels], 0.0)
        return np.where(w > 0, flux, 0.0), np.where(w[..., None] > 0, j, 0.0), w

    def normals(self, z: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Each block's share of J'WJ, J'Wy, y'Wy, chi2 and the number of valid pixels, y being the data as J sees it."""
        rows, t = np.arange(len(self.count)) if rows is None else rows, self.model.total
        out = np.empty((len(rows), t * t + t + 3))
        for which, pixels in self.groups(rows):
            flux, j, w = self.seen(z[which], pixels)
            r = np.where(w > 0, self.g[pixels] - flux, 0.0)
            y = r + (j @ z[which][..., None])[..., 0]
            jw = j * w[..., None]
            out[which, : t * t] = (np.swapaxes(jw, 1, 2) @ j).reshape(len(which), -1)
            out[which, t * t : -3] = (y[:, None] @ jw)[:, 0]
            out[which, -3], out[which, -2], out[which, -1] = (w * y * y).sum(1), (w * r * r).sum(1), np.count_nonzero(w, axis=1)
        return out


class Block(Stack):
    """A stack of one block."""

    def __init__(self, model: Model, number: int, px: dict[str, np.ndarray], x0: float, x1: float, last: int):
        rows = np.column_stack([np.asarray(px[c], float) for c in ("pix", "x", "g", "w", "c", "t")])
        super().__init__(model, np.array([number]), rows, np.array([0, len(rows)]), np.array([x0]), np.array([x1]), np.array([last]))

    def at(self, z: np.ndarray, slopes: bool = True):
        flux, cont, j = super().at(z[None], np.arange(len(self.pix))[None], slopes)
        return flux[0], cont[0], None if j is None else j[0]


def _stack(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), float).reshape(batch.num_rows, -1)


# --- one round ---------------------------------------------------------------------------------------

#: What an object carries from round to round.
STATE = (
    "object_id long, x0 double, x1 double, last long, scale double, sigma0 double, centre double, v_center double, lam double, z array<double>, "
    "f double, cand array<double>, round int, short int, reached boolean, expansions int, sane boolean, trials int"
)
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
FIT = "struct<lam: double, z: array<double>, chi2: double, smooth: double, solved: boolean>"
ROUND = f"{STATE}, done boolean, converged boolean, residual double, ngood long, fits array<{FIT}>"
#: Objects solved together, numbers in their matrices, and numbers in the scattered templates held for them.
PASS_ROWS, PASS_MATRICES, PASS_VALUES = 256, 4_000_000, 8_000_000
#: Numbers in the jacobians that are held together.
STACK_VALUES = 250_000


@dataclass(frozen=True)
class Plan:
    """How strengths are chosen: a ``grid`` fitted in full around the middle one, a search between ``lo`` and ``hi``, or each row's ``own``."""

    grid: tuple[float, ...] = ()
    own: bool = False
    lo: float = 1e2
    hi: float = 1e6
    nsigma: float = 0.3
    max_peaks: int = 1
    freeze: int = 3
    rounds: int = 25


def _advance(model: Model, plan: Plan, s: dict[str, np.ndarray], normals: np.ndarray) -> dict[str, np.ndarray]:
    """The next state of a batch of objects, given the normal equations at their candidates."""
    n, total, count = model.n, model.total, len(normals)
    h = normals[:, : total * total].reshape(-1, total, total)
    q, yy, chi2, ngood = normals[:, total * total : -3], normals[:, -3], normals[:, -2], normals[:, -1]
    v = np.linspace(model.vmin, model.vmax, n)
    pen = penalty_batch(v, s["sigma0"], s["centre"], model.step)
    rough = np.zeros((count, total, total))
    if model.nc:
        d = difference_matrix(model.nc, 2)
        rough[:, n : n + model.nc, n : n + model.nc] = (model.lam_cont / s["scale"] ** 2)[:, None, None] * (d.T @ d)
    low = np.full(total, -np.inf)
    low[:n], low[n + model.nc :] = FLOOR, 0.0
    quad = lambda m, z: np.einsum("bi,bi->b", z, (m @ z[..., None])[..., 0])
    smooth = lambda z, rows=slice(None): quad(pen[rows], z[:, :n])

    guess = s["cand"].copy()  # neighbouring solves mostly share their active sets

    def solve(rows: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mat = h[rows] + rough[rows] if model.nc else h[rows].copy()
        mat[:, :n, :n] += lam[:, None, None] * pen[rows]
        z, ok = constrained_batch(mat, q[rows], low, model.sums, start=guess[rows])
        guess[rows] = z
        return z, ok, yy[rows] - 2 * np.einsum("bi,bi->b", q[rows], z) + quad(h[rows], z)

    def trial(rows: np.ndarray, lam: np.ndarray) -> dict[str, np.ndarray]:
        z, _, c = solve(rows, lam)
        b = np.maximum(z[:, :n], 0.0)
        weight = b / np.maximum(b.sum(1, keepdims=True), 1e-300)
        mean = weight @ v
        return {"chi2": c, "peaks": count_peaks(b), "v": mean, "sigma": np.sqrt(np.einsum("bi,bi->b", weight, (v[None] - mean[:, None]) ** 2))}

    out = {k: a.copy() for k, a in s.items()}
    every = np.arange(count)
    lam = np.where(np.isnan(s["lam"]), 1.0, s["lam"])
    here = chi2 + lam * smooth(s["cand"]) + quad(rough, s["cand"])
    took = np.isnan(s["f"]) | (here <= s["f"] * (1 + 1e-12) + 1e-12)
    back = np.flatnonzero(~took)
    out["cand"][back] = s["z"][back] + 0.3 * (s["cand"][back] - s["z"][back])
    out["short"][back] += 1
    rows = np.flatnonzero(took)
    out["z"][rows], out["short"][rows] = s["cand"][rows], 0
    if plan.own:
        pass
    elif not plan.grid:
        look = rows[(s["round"][rows] < plan.freeze) | np.isnan(s["lam"][rows])]
        if len(look):
            found = search(lambda r, x: trial(look[r], x), len(look), ngood[look], plan.lo, plan.hi, s["v_center"][look], plan.nsigma, plan.max_peaks)
            lam[look] = found["lam"]
            for k in ("reached", "expansions", "sane", "trials"):
                out[k][look] = found[k]
    else:
        lam[:] = sorted(plan.grid)[len(plan.grid) // 2]
    out["lam"] = lam
    f = chi2 + lam * smooth(out["z"]) + quad(rough, out["z"])
    out["f"][rows] = f[rows]
    new, ok = out["cand"].copy(), np.zeros(count, bool)
    gain, residual = np.full(count, np.inf), np.full(count, np.nan)
    if len(rows):
        new[rows], ok[rows], c = solve(rows, lam[rows])
        gain[rows] = f[rows] - (c + lam[rows] * smooth(new[rows], rows) + quad(rough[rows], new[rows]))
        move = np.abs(new[rows, :n] - out["z"][rows, :n]).max(1)
        residual[rows] = move / np.maximum(out["z"][rows, :n].max(1), 1e-300)
    settled = took & (gain <= 1e-6 + 1e-9 * np.abs(f)) & (s["round"] > 0)
    out["cand"][rows] = new[rows]
    out["round"] = s["round"] + 1
    out["done"] = settled | (out["round"] >= plan.rounds) | (out["short"] > 25) | (ngood == 0)
    out["converged"], out["residual"], out["ngood"] = settled & ok, residual, ngood.astype(np.int64)
    fits = [[] for _ in range(count)]
    at = np.flatnonzero(out["done"])
    if len(at):
        for x in plan.grid or (None,):
            if x is None and not plan.own:
                z, good, c, strength = out["z"][at], ok[at], chi2[at], lam[at]
                late = ~took[at]  # gave up on a shortened step: these normal equations belong to the candidate
                c = np.where(late, out["f"][at] - strength * smooth(z, at) - quad(rough[at], z), c)
            else:
                strength = lam[at] if plan.own else np.full(len(at), float(x))
                z, good, c = solve(at, strength)
            p = strength * smooth(z, at)
            for i, r in enumerate(at):
                fits[r].append({"lam": strength[i], "z": z[i].tolist(), "chi2": c[i], "smooth": p[i], "solved": bool(good[i])})
    out["fits"] = fits
    return out


def _read_state(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    s = {c: _stack(b, c) if c in ("z", "cand") else np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in STATE_NAMES}
    return {k: v.copy() for k, v in s.items()}


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    count, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _write(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in schema:
        v = out[f.name]
        cols.append(_lists(v) if isinstance(v, np.ndarray) and v.ndim == 2 else pa.array(v, f.type, from_pandas=f.name in ("lam", "f", "residual")))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _solve_rows(model: Model) -> int:
    return max(16, min(PASS_ROWS, PASS_MATRICES // model.total**2))


def _slices(big: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, big.num_rows, rows):
        yield big.slice(start, rows)


def _pixel_slices(big: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose scattered templates take bounded memory together."""
    cells = np.diff(np.asarray(big.column("px").offsets)) // (5 + model.templates) * (model.n * (model.templates + 1))
    start, held, most = 0, 0, _solve_rows(model)
    for i, c in enumerate(cells.tolist()):
        if i > start and (held + c > PASS_VALUES or i - start >= most):
            yield big.slice(start, i - start)
            start, held = i, 0
        held += c
    if start < big.num_rows:
        yield big.slice(start)


_LIST = pa.list_(pa.float64())
_FIT_TYPE = pa.struct([("lam", pa.float64()), ("z", _LIST), ("chi2", pa.float64()), ("smooth", pa.float64()), ("solved", pa.bool_())])
_ARROW = {"long": pa.int64(), "double": pa.float64(), "array<double>": _LIST, "int": pa.int32(), "boolean": pa.bool_()}
_ROUND_SCHEMA = pa.schema([*[(c.split()[0], _ARROW[c.split()[1]]) for c in STATE.split(", ")], ("done", pa.bool_()), ("converged", pa.bool_()),
                           ("residual", pa.float64()), ("ngood", pa.int64()), ("fits", pa.list_(_FIT_TYPE))])


def _blocks_of(model: Model, b: pa.RecordBatch) -> Stack:
    x0, x1, last, number = (np.asarray(b.column(c)) for c in ("x0", "x1", "last", "_blk"))
    px, at, width = b.column("px"), np.asarray(b.column("px").offsets), 5 + model.templates
    return Stack(model, number, np.asarray(px.flatten(), float).reshape(-1, width), (at - at[0]) // width, x0, x1, last)


def _all_rounds(model: Model, plan: Plan):
    """Every round of objects that are one block each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _pixel_slices(big, model):
                blocks, s, live = _blocks_of(model, b), _read_state(b), np.arange(b.num_rows)
                while len(live):
                    out = _advance(model, plan, s, blocks.normals(s["cand"], live))
                    done, left = np.flatnonzero(out["done"]), np.flatnonzero(~out["done"])
                    if len(done):
                        yield _write({k: [v[i] for i in done] if isinstance(v, list) else v[done] for k, v in out.items()}, _ROUND_SCHEMA)
                    live, s = live[left], {k: out[k][left] for k in STATE_NAMES}

    return run


def _pass(model: Model, keys: Sequence[str] = OBJ):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _pixel_slices(big, model):
                sums = _blocks_of(model, b).normals(_stack(b, "cand"))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], _lists(sums)], [*keys, "_s"])

    return run


def _step(model: Model, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _slices(big, _solve_rows(model)):
                yield _write(_advance(model, plan, _read_state(b), _stack(b, "_s")), _ROUND_SCHEMA)

    return run


def add_arrays(df: DataFrame, keys: Sequence[str], name: str = "_s") -> DataFrame:
    """Sum arrays of equal length entry by entry."""
    parts = df.select(*keys, F.posexplode(name).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p")).select(*keys, F.transform("_p", lambda e: e["_v"]).alias(name))


def with_blocks(blocks: DataFrame, objects: DataFrame, model: Model) -> DataFrame:
    """Blocks with the facts of their objects; the blocks of one long series stay in different tasks.

    While few objects are live their facts travel to the blocks, so late rounds do not shuffle the blocks of finished ones.
    """
    each = objects.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / model.size))))
    if is_small(each):
        return blocks.join(F.broadcast(each), KEYS)
    return spread(blocks, *KEYS).join(spread(each, *KEYS), KEYS)


def start_state(ends: DataFrame, model: Model, sigma0: float = 100.0, centre: float = 0.0, tuning: DataFrame | None = None, warm: DataFrame | None = None) -> DataFrame:
    """First states. ``tuning(object_id[, sigma0][, centre][, v_center][, lam])`` limits the fit to its objects; ``warm(object_id, z)``
    continues a fit. A given ``lam`` is kept where the plan's ``freeze`` is 0."""
    s = ends if tuning is None else ends.join(tuning, OBJ)
    have = [] if tuning is None else tuning.columns
    for c, default in (("sigma0", float(sigma0)), ("centre", float(centre)), ("v_center", 0.0), ("lam", None)):
        s = s.withColumn(c, (F.col(c) if c in have else F.lit(default)).cast("double"))
    fresh = F.concat(start_shape(model.n, model.vmin, model.vmax, "sigma0", "centre"), F.array_repeat("level", model.nc), F.array_repeat(F.lit(1.0 / model.templates), model.nw))
    if warm is None:
        s = s.withColumn("z", fresh)
    else:
        s = s.join(warm.select(*OBJ, F.col("z").alias("_z")), OBJ, "left").withColumn("z", F.coalesce("_z", fresh))
    none = F.lit(None).cast("double")
    return s.select(
        *OBJ, "x0", "x1", "last", "scale", "sigma0", "centre", "v_center", "lam", "z", none.alias("f"), F.col("z").alias("cand"), F.lit(0).alias("round"),
        F.lit(0).alias("short"), F.lit(False).alias("reached"), F.lit(0).alias("expansions"), F.lit(True).alias("sane"), F.lit(0).alias("trials"),
    )


def solve_rounds(blocks: DataFrame, state: DataFrame, model: Model, plan: Plan) -> DataFrame:
    """Rounds over the live objects until none is left; one packed row per (object, strength).

    ``object_id, lam, b, coef, weights, z, chi2, smooth, ngood, sum_b, converged, residual, rounds, reached, expansions, sane, trials``.
    """
    finished, live = None, cut(state)
    if model.single:
        finished = cut(with_blocks(blocks, live, model).select("_blk", "px", *STATE_NAMES).mapInArrow(_all_rounds(model, plan), ROUND))
    for _ in range(0 if model.single else plan.rounds + 1):
        parts = with_blocks(blocks, live, model).select(*OBJ, "_blk", "px", "cand", "x0", "x1", "last").mapInArrow(_pass(model), "object_id long, _s array<double>")
        summed = spread(add_arrays(parts, OBJ), *OBJ).join(spread(live, *OBJ), OBJ)
        out = cut(summed.select(*STATE_NAMES, "_s").mapInArrow(_step(model, plan), ROUND))
        done = out.filter("done")
        finished = done if finished is None else finished.unionByName(done)
        live = out.filter("NOT done").select(*STATE_NAMES)
        if live.isEmpty():
            break
    rows = finished.select("*", F.explode("fits").alias("_f")).drop("lam", "z")
    z, n, nc = F.col("_f.z"), model.n, model.nc
    return rows.select(
        *OBJ, F.col("_f.lam").alias("lam"), F.slice(z, 1, n).alias("b"), F.slice(z, n + 1, nc).alias("coef"),
        (F.slice(z, n + nc + 1, model.nw) if model.nw else F.array(F.lit(1.0))).alias("weights"), z.alias("z"), F.col("_f.chi2").alias("chi2"), F.col("_f.smooth").alias("smooth"),
        "ngood", F.aggregate(F.slice(z, 1, n), F.lit(0.0), lambda a, e: a + e).alias("sum_b"), (F.col("converged") & F.col("_f.solved")).alias("converged"), "residual",
        F.col("round").alias("rounds"), "sigma0", "centre", *([] if plan.grid or plan.own else ["reached", "expansions", "sane", "trials"]),
    )


def solve_each(blocks: DataFrame, ends: DataFrame, model: Model, lambdas: Sequence[float]) -> DataFrame:
    """A fit of its own for every (object, strength): none stands on the linear model of another strength."""
    if model.single:
        tuning = ends.select(*OBJ, F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam"))
        return solve_rounds(blocks, start_state(ends, model, tuning=tuning), model, Plan(own=True))
    fits = [solve_rounds(blocks, start_state(ends, model), model, Plan(grid=(float(x),))) for x in lambdas]
    return reduce(DataFrame.unionByName, fits)


def recover_losvd(pix: DataFrame, lambdas: Sequence[float], n: int = 29, vmin: float = -300.0, vmax: float = 300.0, step: float = 1.25, sigma0: float = 100.0,
                  centre: float = 0.0, tuning: DataFrame | None = None, cont: str | None = None, joint: bool = False, **sizes) -> DataFrame:
    """Histograms for all objects and all strengths at once, one packed row per (object, strength).

    Minimises chi2 + lam * tapered roughness over b >= 1e-6 (``joint``: with sum(b) = 1 and a penalised spline continuum).
    The model is linearised until it stands still at the middle strength; the others are solved on the same normal equations.
    """
    blocks, ends, model = pack_blocks(pix, n, vmin, vmax, step, joint, cont=cont, **sizes)
    return solve_rounds(blocks, start_state(ends, model, sigma0, centre, tuning), model, Plan(grid=tuple(float(x) for x in lambdas)))


# --- replicates --------------------------------------------------------------------------------------

REPLICATE_VALUES, REPLICATES = 1_000_000, 64


def _replicate_sums(model: Model, big: pa.RecordBatch) -> Iterator[tuple]:
    """(row, batch, first replicate, right-hand sides and y'Wy, normal matrix) of every block at its object's fit, for its run of replicates."""
    for b in _pixel_slices(big, model):
        z, blocks, draws = _stack(b, "z"), _blocks_of(model, b), b.column("draws")
        flat, at = draws.flatten(), np.asarray(draws.offsets) - draws.offsets[0].as_py()
        first = np.asarray(b.column("_blk")) * model.size
        rep, sizes = np.asarray(flat.field("rep")), np.diff(np.asarray(flat.field("pix").offsets))
        pix, g = np.asarray(flat.field("pix").flatten()), np.asarray(flat.field("g").flatten())
        edge = np.append(0, np.cumsum(sizes))
        for which, pixels in blocks.groups(np.arange(b.num_rows)):
            flux, j, w = blocks.seen(z[which], pixels)
            ahead, jw = (j @ z[which][..., None])[..., 0] - flux, j * w[..., None]
            grams = np.swapaxes(jw, 1, 2) @ j
            for k, i in enumerate(which):
                lo, hi = at[i], at[i + 1]
                reps, row = np.unique(rep[lo:hi], return_inverse=True)
                y, s = np.zeros((len(reps), pixels.shape[1])), slice(edge[lo], edge[hi])
                y[np.repeat(row, sizes[lo:hi]), pix[s] - first[i]] = g[s]
                y = np.where(w[k] > 0, y, 0.0) + ahead[k]
                yield i, b, int(reps[0]), y @ jw[k], (y * y) @ w[k], grams[k]


def _replicate_pass(model: Model):
    """Normal matrix of a block at the object's fit and the right-hand sides of a run of replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i, b, first, rhs, yy, gram in _replicate_sums(model, big):
                out = np.concatenate([gram.ravel(), rhs.ravel(), yy])
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (b.column("object_id")[int(i)].as_py(), first, len(rhs))] + [_lists(out[None])], ["object_id", "first", "count", "_s"])

    return run


def _replicate_fits(model: Model, ids, first, mats: list, rhs: list, facts: np.ndarray, start: np.ndarray | None) -> pa.RecordBatch:
    """Fits of runs of replicates, all runs together. ``facts``: lam, sigma0, centre and scale of each run's object."""
    n, t, count = model.n, model.total, np.array([len(x) for x in rhs])
    low = np.full(t, -np.inf)
    low[:n], low[n + model.nc :] = FLOOR, 0.0
    lam, s0, vc, scale = facts.T
    mat = np.array(mats)
    mat[:, :n, :n] += lam[:, None, None] * penalty_batch(np.linspace(model.vmin, model.vmax, n), s0, vc, model.step)
    if model.nc:
        d = difference_matrix(model.nc, 2)
        mat[:, n : n + model.nc, n : n + model.nc] += (model.lam_cont / scale**2)[:, None, None] * (d.T @ d)
    z, ok = constrained_batch(np.repeat(mat, count, axis=0), np.concatenate(rhs), low, model.sums, start=None if start is None else np.repeat(start, count, axis=0))
    rep = np.repeat(np.asarray(first) - np.cumsum(count) + count, count) + np.arange(count.sum())
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(ids), count)), pa.array(rep), _lists(np.ascontiguousarray(z[:, :n])), pa.array(ok)], ["object_id", "rep", "b", "converged"])


def _replicate_solve(model: Model):
    """Fits of runs of replicates, from the pixels where a series is one block, else from the sums over its blocks."""
    t, most = model.total, max(16, PASS_MATRICES // model.total**2)

    def sums(big: pa.RecordBatch) -> Iterator[tuple]:
        if model.single:
            for i, b, first, rhs, _, gram in _replicate_sums(model, big):
                yield b, i, first, gram, rhs
            return
        for i in range(big.num_rows):
            count, packed = big.column("count")[i].as_py(), np.asarray(big.column("_s")[i].values, float)
            yield big, i, big.column("first")[i].as_py(), packed[: t * t].reshape(t, t), packed[t * t : t * t + count * t].reshape(count, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            held, rows = [], 0
            for b, i, first, gram, rhs in sums(big):
                at = lambda c: b.column(c)[int(i)].as_py()
                held.append((at("object_id"), first, gram, rhs, [at(c) for c in ("lam", "sigma0", "centre", "scale")], np.asarray(b.column("z")[int(i)].values)))
                rows += len(rhs)
                if rows >= most:
                    ids, firsts, mats, right, facts, start = zip(*held)
                    yield _replicate_fits(model, ids, firsts, mats, right, np.array(facts, float), np.array(start))
                    held, rows = [], 0
            if held:
                ids, firsts, mats, right, facts, start = zip(*held)
                yield _replicate_fits(model, ids, firsts, mats, right, np.array(facts, float), np.array(start))

    return run


def refit_replicates(blocks: DataFrame, ends: DataFrame, fits: DataFrame, draws: DataFrame, model: Model) -> DataFrame:
    """(object_id, rep, b, converged): every replicate of every object refitted at the strength of its object's fit.

    ``draws(object_id, rep, pix, g)`` has the valid pixels of every replicate, replicates numbered from 0; ``pix`` and ``g``
    are numbers, or arrays of all pixels of a series of one block. Replicates change the
    right-hand side only, so a normal matrix is held once for a run of replicates; runs are short where blocks are long, so
    any number of replicates takes bounded memory. The model is linear around the fit (continuum and weights move with it).
    """
    longest = ends.agg(F.max("last")).first()[0] or 0
    run = max(1, min(REPLICATES, REPLICATE_VALUES // (min(longest + 1, model.size))))
    whole = dict(draws.dtypes)["pix"].startswith("array")
    if whole and not model.single:
        draws = draws.select(*OBJ, "rep", F.explode(F.arrays_zip("pix", "g")).alias("_e")).select(*OBJ, "rep", "_e.pix", "_e.g")
        whole = False
    numbers = [F.col("pix"), F.col("g")] if whole else [F.array(F.col("pix").cast("long")), F.array(F.coalesce("g", F.lit(0.0)))]
    blk = F.lit(0).cast("long") if whole else F.floor(F.col("pix") / model.size)
    parts = draws.select(*OBJ, blk.alias("_blk"), F.floor(F.col("rep") / run).alias("_run"), F.struct(
        F.col("rep").cast("long").alias("rep"), numbers[0].alias("pix"), numbers[1].alias("g")).alias("_d"))
    parts = spread(parts, *KEYS).groupBy(*KEYS, "_run").agg(F.collect_list("_d").alias("draws"))
    fit = fits.select(*OBJ, "lam", "sigma0", "centre", "z").join(ends.select(*OBJ, "scale"), OBJ)
    facts = ends.select(*OBJ, "x0", "x1", "last").join(fit, OBJ)
    rows = with_blocks(blocks, facts, model).join(parts, KEYS)
    if not model.single:
        rows = rows.select(*OBJ, "_blk", "px", "z", "x0", "x1", "last", "draws").mapInArrow(_replicate_pass(model), "object_id long, first long, count long, _s array<double>")
        rows = add_arrays(rows, [*OBJ, "first", "count"]).join(fit, OBJ)
    return rows.mapInArrow(_replicate_solve(model), "object_id long, rep long, b array<double>, converged boolean")


# --- what a fit says about its pixels ------------------------------------------------------------------


def _model_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for big in batches for part in _pixel_slices(big, model)):
            z, ids, blocks = _stack(b, "z"), np.asarray(b.column("object_id")), _blocks_of(model, b)
            flux, cont = np.empty(len(blocks.pix)), np.empty(len(blocks.pix))
            for which, pixels in blocks.groups(np.arange(len(ids))):
                flux[pixels], cont[pixels], _ = blocks.at(z[which], pixels, slopes=False)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[blocks.row], blocks.pix, flux, cont)], ["object_id", "pix", "model", "cont"])

    return run


def model_pixels(blocks: DataFrame, ends: DataFrame, fits: DataFrame, model: Model) -> DataFrame:
    """(object_id, pix, model, cont) of one fit per object."""
    facts = ends.select(*OBJ, "x0", "x1", "last").join(fits.select(*OBJ, "z"), OBJ)
    rows = with_blocks(blocks, facts, model).select(*OBJ, "_blk", "px", "z", "x0", "x1", "last")
    return rows.mapInArrow(_model_rows(model), "object_id long, pix long, model double, cont double")


def normal_equations(blocks: DataFrame, ends: DataFrame, fits: DataFrame, model: Model) -> DataFrame:
    """(object_id, _gram, _rhs, _yy, chi2, ngood) at one fit per object, for what is solved beside the fit."""
    facts = ends.select(*OBJ, "x0", "x1", "last").join(fits.select(*OBJ, F.col("z").alias("cand")), OBJ)
    parts = with_blocks(blocks, facts, model).select(*OBJ, "_blk", "px", "cand", "x0", "x1", "last").mapInArrow(_pass(model), "object_id long, _s array<double>")
    parts = parts if model.single else add_arrays(parts, OBJ)
    t = model.total
    return parts.select(
        *OBJ, F.slice("_s", 1, t * t).alias("_gram"), F.slice("_s", t * t + 1, t).alias("_rhs"), F.slice("_s", t * t + t + 1, 1).alias("_yy"),
        F.element_at("_s", t * t + t + 2).alias("chi2"), F.element_at("_s", t * t + t + 3).cast("long").alias("ngood"),
    )


def _distance(model: Model, b: pa.RecordBatch, h: np.ndarray, q: np.ndarray, yy: np.ndarray) -> pa.RecordBatch:
    """How far the fits of ``b`` are from stationary points, given the normal equations at them."""
    n, t, z = model.n, model.total, _stack(b, "z")
    lam, s0, vc, scale = (np.asarray(b.column(c), float) for c in ("lam", "sigma0", "centre", "scale"))
    slope = (h @ z[..., None])[..., 0] - q
    slope[:, :n] += lam[:, None] * np.einsum("bij,bj->bi", penalty_batch(np.linspace(model.vmin, model.vmax, n), s0, vc, model.step), z[:, :n])
    if model.nc:
        d = difference_matrix(model.nc, 2)
        slope[:, n : n + model.nc] += (model.lam_cont / scale**2)[:, None] * (z[:, n : n + model.nc] @ (d.T @ d))
    low = np.full(t, -np.inf)
    low[:n], low[n + model.nc :] = FLOOR, 0.0
    free = z > np.where(np.isfinite(low), low + 1e-9, low)
    gap = np.zeros(len(z))
    for s in model.sums:
        price = np.where(free[:, s], slope[:, s], 0.0).sum(1) / np.maximum(free[:, s].sum(1), 1)
        slope[:, s] -= price[:, None]
        gap = np.maximum(gap, np.abs(z[:, s].sum(1) - 1))
    # In units of what a change of the unknown by its own size does to the objective.
    size = np.sqrt(np.maximum(np.einsum("bii->bi", h), 1e-300)) * np.sqrt(np.maximum(yy, 1e-300))[:, None]
    off = np.where(free, np.abs(slope), np.maximum(-slope, 0.0)) / size
    return pa.RecordBatch.from_arrays([b.column("object_id"), b.column("lam"), pa.array(off.max(1)), pa.array(gap)], ["object_id", "lam", "stationarity", "sum_gap"])


def _optimality(model: Model):
    """From the pixels where a series is one block, else from the sums ``_s`` over its blocks."""
    t = model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _pixel_slices(big, model) if model.single else _slices(big, _solve_rows(model)):
                sums = _blocks_of(model, b).normals(_stack(b, "z")) if model.single else _stack(b, "_s")
                yield _distance(model, b, sums[:, : t * t].reshape(-1, t, t), sums[:, t * t : -3], sums[:, -3])

    return run


def optimality(blocks: DataFrame, ends: DataFrame, fits: DataFrame, model: Model) -> DataFrame:
    """(object_id, lam, stationarity, sum_gap): how far a fit is from a point where no allowed change helps.

    A pass over the pixels of its own at the fit, so it does not rest on what the rounds report.
    """
    keys, about = [*OBJ, "lam"], ["sigma0", "centre", "scale", "z"]
    facts = ends.select(*OBJ, "x0", "x1", "last", "scale").join(fits.select(*keys, "sigma0", "centre", "z"), OBJ)
    rows = with_blocks(blocks, facts, model)
    if not model.single:
        parts = rows.select(*keys, "_blk", "px", F.col("z").alias("cand"), "x0", "x1", "last").mapInArrow(_pass(model, keys), "object_id long, lam double, _s array<double>")
        rows = add_arrays(parts, keys).join(facts, keys)
    rows = rows.select(*keys, *about, *(["_blk", "px", "x0", "x1", "last"] if model.single else ["_s"]))
    return rows.mapInArrow(_optimality(model), "object_id long, lam double, stationarity double, sum_gap double")
