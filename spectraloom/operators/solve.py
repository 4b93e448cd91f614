"""Regularised recovery: normal equations built by Spark, small dense solves batch-wise.

Pixels meet their design (spline basis, templates) through joins and grouped sums. Only the packed normal equations of an
object, at most a few dozen unknowns, reach numpy, a whole Arrow batch of objects at a time. The recovery of velocity
histograms, whose design is too wide to be kept per pixel, is in ``recovery``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import array_sum, col, dot, lcg_normal, let, valid_pixel
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.stats import pack_bins
from spectraloom.plans.scale import BLOCK_ROWS, attach, cut, quantiles, setting, spread

FLOOR = 1e-6


# --- packed normal equations -------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), float).reshape(-1, n)


def _partial_sums(keys: list[str], n: int, m: int):
    """Running sums over the consecutive rows of one (keys, block); one output row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, acc = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            j, y, w = _matrix(b, "_d", n), _matrix(b, "_y", m), np.asarray(b.column("_w"), float)
            ids = list(zip(*[b.column(k).to_pylist() for k in [*keys, "_blk"]]))
            edges = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            done = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                jw = j[lo:hi] * w[lo:hi, None]
                part = np.concatenate([
                    (jw.T @ j[lo:hi]).ravel(), (y[lo:hi].T @ jw).ravel(),
                    (w[lo:hi, None] * y[lo:hi] ** 2).sum(0), [np.count_nonzero(w[lo:hi] > 0)],
                ])
                if ids[lo] == key:
                    acc = acc + part
                else:
                    if key is not None:
                        done.append((key, acc))
                    key, acc = ids[lo], part
            if done:
                yield _rows(done)
        if key is not None:
            yield _rows([(key, acc)])

    def _rows(done):
        cols = [pa.array([k[i] for k, _ in done]) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([a.tolist() for _, a in done], pa.list_(pa.float64()))], [*keys, "_s"])

    return run


def packed_gram(df: DataFrame, n: int, m: int = 1, keys: list[str] = OBJ, longest: int | None = None) -> DataFrame:
    """Normal equations per key from rows ``(keys, pix, _d array n, _y array m, _w)``.

    Returns ``_gram`` (n*n), ``_rhs`` (m*n), ``_yy`` (m) and ``ngood``. Rows are summed inside their
    block of positions first; blocks of a long series are then added up entry by entry.
    """
    size = setting(df.sparkSession, BLOCK_ROWS)
    types = dict(df.dtypes)
    if longest is None:
        longest = df.agg(F.max("pix")).first()[0] or 0
    rows = df.select(*keys, F.floor(F.col("pix") / size).alias("_blk"), "_d", "_y", "_w")
    rows = spread(rows, *keys, "_blk").sortWithinPartitions(*keys, "_blk")
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _s array<double>"
    parts = rows.mapInArrow(_partial_sums(keys, n, m), schema)
    if longest >= size:
        parts = (
            parts.select(*keys, F.posexplode("_s").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_p"))
            .select(*keys, F.transform("_p", lambda e: e["_v"]).alias("_s"))
        )
    a, b = n * n, n * n + m * n
    return parts.select(
        *keys, F.slice("_s", 1, a).alias("_gram"), F.slice("_s", a + 1, m * n).alias("_rhs"),
        F.slice("_s", b + 1, m).alias("_yy"), F.element_at("_s", b + m + 1).cast("long").alias("ngood"),
    )


def nonneg_batch(mat: np.ndarray, rhs: np.ndarray, rounds: int = 200) -> np.ndarray:
    """min z'Mz/2 - q'z, z >= 0 for a stack of problems, by block pivoting on the active sets."""
    count, n = rhs.shape
    scale = np.sqrt(np.maximum(np.einsum("ijj->ij", mat), 1e-300))
    mat, q = mat / scale[:, :, None] / scale[:, None, :], rhs / scale
    mat = mat + 1e-12 * np.eye(n)
    free, out = np.ones((count, n), bool), np.zeros((count, n))
    best, patience, live = np.full(count, n + 1), np.full(count, 3), np.arange(count)
    for _ in range(rounds):
        if not len(live):
            break
        f, m, c = free[live], mat[live], q[live]
        a = np.where(f[:, :, None] & f[:, None, :], m, 0.0)
        i = np.arange(n)
        a[:, i, i] += ~f
        z = np.linalg.solve(a, np.where(f, c, 0.0)[..., None])[..., 0]
        slope = np.einsum("bij,bj->bi", m, z) - c
        tol = 1e-10 * np.maximum(np.abs(c).max(1, keepdims=True), 1e-300)
        bad = (f & (z < -tol)) | (~f & (slope < -tol))
        nbad = bad.sum(1)
        out[live] = z
        better = nbad < best[live]
        best[live] = np.where(better, nbad, best[live])
        patience[live] = np.where(better, 3, patience[live] - 1)
        last = np.zeros_like(bad)
        last[np.arange(len(live)), n - 1 - np.argmax(bad[:, ::-1], axis=1)] = True
        free[live] ^= np.where((patience[live] < 0)[:, None], bad & last, bad)
        live = live[nbad > 0]
    return np.maximum(out, 0.0) / scale


def penalty_batch(v: np.ndarray, sigma0: np.ndarray, centre: np.ndarray, step: float, core: float = 1.8) -> np.ndarray:
    """Wing-tapered second-difference penalty matrices (zero outside the grid), over step cubed."""
    n = len(v)
    d2 = np.diag(np.full(n, -2.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    d = np.abs(v[None, :] - centre[:, None]) / sigma0[:, None]
    taper = np.where(d > core, (d / core) ** 4, 1.0)
    return ((d2.T[None] * taper[:, None, :]) @ d2) / step**3


# --- histograms ---------------------------------------------------------------------------------


def start_shape(n: int, vmin: float, vmax: float, sigma0, centre) -> Column:
    """Unit-sum Gaussian over the velocity bins, the shape the first linearisation starts from."""
    v = F.array(*[F.lit(vmin + (vmax - vmin) * k / (n - 1)) for k in range(n)])
    s, c = col(sigma0), col(centre)
    raw = F.transform(v, lambda x: F.exp(-0.5 * F.pow((x - c) / s, F.lit(2.0))) + 1e-4)
    return let(raw, lambda r: let(array_sum(r), lambda t: F.transform(r, lambda e: e / t)))


def bins_from_packed(df: DataFrame, vmin: float, vmax: float, n: int, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, F.posexplode("b").alias("bin", "b")).withColumn(
        "v", F.lit(float(vmin)) + (vmax - vmin) * F.col("bin") / (n - 1)
    )


# --- mixtures, splines, baselines -------------------------------------------------------------------


def _nonneg_batches(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            w = nonneg_batch(_matrix(b, "_gram", n * n).reshape(-1, n, n), _matrix(b, "_rhs", n))
            w = np.where(w.sum(1, keepdims=True) > 0, w, 1.0 / n)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(w.tolist(), pa.list_(pa.float64()))], [*keys, "w"])

    return run


def fit_mixture(pix: DataFrame, tpl_on_pix: DataFrame, tpl_ids: Sequence[int], keys: list[str] = OBJ) -> DataFrame:
    """Non-negative template weights per object; equal weights where the fit collapses.

    ``tpl_on_pix(tpl_id, pix[, object_id], t)`` holds the templates on the pixel grid; the library a
    fit uses is short (``tpl_ids`` names it), so a pixel carries its template values as one array.
    """
    n = len(tpl_ids)
    on = [*[k for k in keys if k in tpl_on_pix.columns], "pix"]
    packed = tpl_on_pix.filter(F.col("tpl_id").isin(list(tpl_ids))).groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("tpl_id", "t"))).alias("_m")
    )
    order = F.array(*[F.lit(i) for i in tpl_ids])
    rows = pix.join(packed, on).withColumn("_d", F.transform(order, lambda i: F.coalesce(F.try_element_at("_m", i.cast(dict(tpl_on_pix.dtypes)["tpl_id"])), F.lit(0.0))))
    w = F.when(valid_pixel(), 1 / (F.col("gerr") * F.col("gerr"))).otherwise(0.0)
    gram = packed_gram(rows.withColumn("_w", w).withColumn("_y", F.array(F.coalesce("g", F.lit(0.0)))), n, keys=keys)
    types = dict(gram.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", w array<double>"
    out = gram.mapInArrow(_nonneg_batches(keys, n), schema)
    return out.select(*keys, F.posexplode("w").alias("_i", "w")).select(*keys, F.element_at(order, F.col("_i") + 1).alias("tpl_id"), "w")


def mixture_weights(gram: DataFrame, n: int, keys: list[str] = OBJ) -> DataFrame:
    """(keys, w): non-negative weights from packed normal equations, scaled to add up to one."""
    types = dict(gram.dtypes)
    out = gram.mapInArrow(_nonneg_batches(keys, n), ", ".join(f"{k} {types[k]}" for k in keys) + ", w array<double>")
    return out.select(*keys, let(array_sum("w"), lambda t: F.transform("w", lambda e: e / t)).alias("w"))


def spline_rows(pix: DataFrame, interior: int = 10, degree: int = 3, keys: list[str] = OBJ) -> DataFrame:
    """Clamped uniform B-spline basis of every pixel as array ``_d`` (interior + degree + 1 long)."""
    ends = pix.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    k = interior + 1
    d = attach(pix, ends, keys).withColumn("_h", (F.col("_hi") - F.col("_lo")) / k)
    at = F.when(F.col("_h") > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_h")), F.lit(k - 1).cast("long"))).otherwise(0)
    d = d.withColumn("_at", at.cast("int"))

    def knot(offset: int) -> Column:
        # Knot number at + offset counted from the left end of the pixel's interval.
        return F.col("_lo") + F.col("_h") * F.least(F.greatest(F.col("_at") + offset, F.lit(0)), F.lit(k))

    basis = [F.lit(1.0)]
    for p in range(1, degree + 1):
        prev, basis = basis, []
        for i in range(p + 1):
            term = F.lit(0.0)
            if i > 0:
                left, right = knot(i - p), knot(i)
                term = term + (F.col("x") - left) * F.coalesce(F.try_divide(prev[i - 1], right - left), F.lit(0.0))
            if i < p:
                left, right = knot(i - p + 1), knot(i + 1)
                term = term + (right - F.col("x")) * F.coalesce(F.try_divide(prev[i], right - left), F.lit(0.0))
            basis.append(term)
        d = d.withColumns({f"_n{p}_{i}": c for i, c in enumerate(basis)})
        basis = [F.col(f"_n{p}_{i}") for i in range(p + 1)]
    local = F.array(*basis)
    n = interior + degree + 1
    full = F.concat(F.array_repeat(F.lit(0.0), F.col("_at")), local, F.array_repeat(F.lit(0.0), F.lit(n - degree - 1) - F.col("_at")))
    return d.withColumn("_d", full).drop("_lo", "_hi", "_h", "_at", *[f"_n{p}_{i}" for p in range(1, degree + 1) for i in range(p + 1)])


def spline_basis(x: np.ndarray, lo, hi, interior: int, degree: int = 3) -> np.ndarray:
    """Clamped uniform B-splines on [lo, hi] at ``x`` (any shape, the ends broadcast to it), along a last axis of interior + degree + 1."""
    k = interior + 1
    x, lo, hi = np.broadcast_arrays(x, lo, hi)
    wide = hi > lo
    width = np.where(wide, hi - lo, 1.0)
    at = np.clip(np.floor((x - lo) / width * k), 0, k - 1).astype(np.int64)
    knot = lambda j: lo + width / k * np.clip(at + j, 0, k)
    near = {j: knot(j) for j in range(-degree, degree + 1)}
    local = [np.ones(x.shape)]
    for p in range(1, degree + 1):
        old, local = local, []
        for i in range(p + 1):
            term = np.zeros(x.shape)
            for first, sign in ((i - p, 1) if i > 0 else (None, 0), (i - p + 1, -1) if i < p else (None, 0)):
                if first is None:
                    continue
                a, b = near[first], near[first + p]
                gap = np.where(b > a, b - a, 1.0)
                term = term + np.where(b > a, ((x - a) if sign > 0 else (b - x)) / gap, 0.0) * old[i - 1 if sign > 0 else i]
            local.append(term)
    out = np.zeros((*x.shape, k + degree))
    for i, term in enumerate(local):
        np.put_along_axis(out, (at + i)[..., None], term[..., None], axis=-1)
    out[~wide] = np.eye(k + degree)[0]
    return out


def difference_matrix(n: int, order: int) -> np.ndarray:
    return np.diff(np.eye(n), order, axis=0)


def _ridge_batches(keys: list[str], n: int, order: int, strength: float):
    pen = difference_matrix(n, order).T @ difference_matrix(n, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            g, r = _matrix(b, "_gram", n * n).reshape(-1, n, n), _matrix(b, "_rhs", n)
            s = np.asarray(b.column("scale"), float)
            a = g + (strength / s**2)[:, None, None] * pen + 1e-12 * np.einsum("bii->b", g)[:, None, None] / n * np.eye(n)
            c = np.linalg.solve(a + 1e-300 * np.eye(n), r[..., None])[..., 0]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(c.tolist(), pa.list_(pa.float64()))], [*keys, "coef"])

    return run


def fit_spline(rows: DataFrame, n: int, strength: float, order: int = 2, keys: list[str] = OBJ, scale: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Penalised spline coefficients from rows with ``_d, _y, _w``; the roughness of coefficients
    divided by ``scale`` is penalised."""
    gram = packed_gram(rows, n, keys=keys, longest=longest)
    gram = attach(gram, scale, keys) if scale is not None else gram.withColumn("scale", F.lit(1.0))
    gram = gram.withColumn("scale", F.when(F.abs("scale") > 0, F.abs("scale")).otherwise(1.0))
    types = dict(gram.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", coef array<double>"
    return gram.mapInArrow(_ridge_batches(keys, n, order, strength), schema)


def fit_pspline(pix: DataFrame, interior: int = 10, degree: int = 3, strength: float = 3.0, order: int = 2, keys: list[str] = OBJ, name: str = "cont") -> DataFrame:
    """Smooth continuum of every series: penalised B-splines weighted by the errors."""
    rows = spline_rows(pix, interior, degree, keys)
    w = F.when(valid_pixel(), 1 / (F.col("gerr") * F.col("gerr"))).otherwise(0.0)
    weighted = rows.withColumn("_w", w).withColumn("_y", F.array(F.when(valid_pixel(), F.col("g")).otherwise(0.0)))
    level = pix.filter(valid_pixel()).groupBy(*keys).agg(F.avg(F.abs("g")).alias("scale"))
    coef = cut(fit_spline(weighted, interior + degree + 1, strength, order, keys, level))
    return attach(rows, coef, keys).withColumn(name, dot("_d", "coef")).drop("_d", "coef")


def asymmetric_baseline(
    pix: DataFrame, strength: float = 1e4, p: float = 0.05, rounds: int = 10, interior: int = 20, masked_weight: float = 1e-6,
    keys: list[str] = OBJ, name: str = "baseline",
) -> DataFrame:
    """Baseline with weight ``p`` above and 1 - p below it, reweighted ``rounds`` times.

    On a spline basis instead of one unknown per pixel, so a round is one small solve per object. Series of one block play
    all rounds in one pass; for longer ones a round is a pass over the pixels, and only the coefficients are carried (and
    checkpointed) between rounds.
    """
    n = interior + 4
    base = spline_rows(pix, interior, 3, keys)
    longest = pix.agg(F.max("pix")).first()[0] or 0
    if longest < setting(pix.sparkSession, BLOCK_ROWS):
        coef = cut(_baseline_packed(pix, strength, p, rounds, interior, masked_weight, keys))
        return attach(base, coef, keys).withColumn(name, dot("_d", "coef")).drop("_d", "coef")
    base, coef = base.withColumn("_y", F.array(F.coalesce("g", F.lit(0.0)))), None
    for _ in range(rounds):
        if coef is None:
            rows = base.withColumn("_w", F.when(F.col("good"), 1.0).otherwise(masked_weight))
        else:
            rows = attach(base, coef, keys).withColumn("_f", dot("_d", "coef"))
            side = F.when(F.col("g") > F.col("_f"), p).otherwise(1 - p)
            rows = rows.withColumn("_w", F.when(F.col("good"), side).otherwise(masked_weight)).drop("coef")
        coef = cut(fit_spline(rows, n, strength, 2, keys, longest=longest))
    return attach(base, coef, keys).withColumn(name, dot("_d", "coef")).drop("_d", "_y", "coef")


#: Numbers in the spline rows that are held together.
BASELINE_VALUES = 250_000


def _baseline_packed(pix: DataFrame, strength: float, p: float, rounds: int, interior: int, masked_weight: float, keys: list[str]) -> DataFrame:
    """(keys, coef): every round of series that are one row each, so pixels are shuffled once."""
    g = F.col("g").cast("double")
    level = F.when(g.isNull(), float("-inf")).otherwise(g)  # an unknown value is not above the baseline
    numbers = F.array(F.col("x").cast("double"), F.coalesce(g, F.lit(0.0)), level, F.coalesce(F.col("good"), F.lit(False)).cast("double"))
    rows = spread(pix, *keys).groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list(numbers))).alias("_px"))
    types = dict(pix.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", coef array<double>"
    return rows.mapInArrow(_baseline_batches(keys, interior + 4, strength, p, rounds, interior, masked_weight), schema)


def _baseline_batches(keys: list[str], n: int, strength: float, p: float, rounds: int, interior: int, masked_weight: float):
    pen = strength * difference_matrix(n, 2).T @ difference_matrix(n, 2)

    def fit(px: np.ndarray) -> np.ndarray:
        x, y, level, good = np.moveaxis(px, 2, 0)
        lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
        d = spline_basis(x, lo, hi, interior) * (hi > lo)[..., None]
        w, coef = np.where(good > 0, 1.0, masked_weight), None
        for _ in range(rounds):
            if coef is not None:
                w = np.where(good > 0, np.where(level > (d @ coef[..., None])[..., 0], p, 1 - p), masked_weight)
            dw = d * w[..., None]
            gram = np.swapaxes(dw, 1, 2) @ d
            a = gram + pen + (1e-12 * np.einsum("bii->b", gram)[:, None, None] / n + 1e-300) * np.eye(n)
            coef = np.linalg.solve(a, (y[:, None] @ dw)[:, 0, :, None])[..., 0]
        return coef

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px, at = _matrix(b, "_px", 4), np.asarray(b.column("_px").offsets) // 4
            start, count, out = at[:-1] - at[0], np.diff(at), np.empty((b.num_rows, n))
            for m in np.unique(count):
                which = np.flatnonzero(count == m)
                some = max(1, BASELINE_VALUES // (m * n))
                for part in (which[i : i + some] for i in range(0, len(which), some)):
                    out[part] = fit(px[start[part][:, None] + np.arange(m)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], lists], [*keys, "coef"])

    return run


# --- influence and library reduction ------------------------------------------------------------------


INFLUENCE_ROWS = 256


def _influence_batches(n: int, step: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(start, INFLUENCE_ROWS) for big in batches for start in range(0, big.num_rows, INFLUENCE_ROWS)):
            g = _matrix(b, "_gram", n * n).reshape(-1, n, n)
            lam, s0 = np.asarray(b.column("lam"), float), np.asarray(b.column("sigma0"), float)
            v = np.linspace(float(b.column("v_lo")[0].as_py()), float(b.column("v_hi")[0].as_py()), n)
            # The taper of this diagnostic is centred on 0, unlike that of the fit.
            mat = g + lam[:, None, None] * penalty_batch(v, s0, np.zeros(len(lam)), step)
            h = np.linalg.solve(mat + 1e-10 * np.einsum("bii->b", mat)[:, None, None] / n * np.eye(n), g)
            fit = _matrix(b, "b", n)
            better = np.maximum(np.einsum("bij,bj->bi", np.linalg.pinv(h, rcond=1e-6), fit), 0.0)
            bias = fit - np.einsum("bij,bj->bi", h, better)
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column("object_id"), b.column("lam"), pa.array(np.einsum("bii->b", h)), pa.array(better.tolist(), lists), pa.array(bias.tolist(), lists)],
                ["object_id", "lam", "eff_dof", "b_corrected", "bias"],
            )

    return run


def influence(gram: DataFrame, fits: DataFrame, n: int, vmin: float, vmax: float, step: float, sigma0: float = 100.0, lsf_kms: float | None = None) -> DataFrame:
    """Effective degrees of freedom, bias-corrected histogram and bias of each (object, lam) fit.

    ``unreliable`` marks fits narrower than twice the instrument width, where the correction harms.
    """
    rows = gram.select(*OBJ, "_gram").join(fits.select(*OBJ, "lam", "b"), OBJ).withColumn("sigma0", F.lit(float(sigma0)))
    rows = rows.withColumn("v_lo", F.lit(float(vmin))).withColumn("v_hi", F.lit(float(vmax)))
    schema = "object_id long, lam double, eff_dof double, b_corrected array<double>, bias array<double>"
    out = rows.mapInArrow(_influence_batches(n, step), schema)
    if lsf_kms is None:
        return out.withColumn("unreliable", F.lit(None).cast("boolean"))
    from spectraloom.operators.stats import losvd_moments

    width = losvd_moments(bins_from_packed(fits, vmin, vmax, n, [*OBJ, "lam"]), [*OBJ, "lam"])
    return out.join(width.select(*OBJ, "lam", (F.col("sigma") < 2 * lsf_kms).alias("unreliable")), [*OBJ, "lam"], "left")


def _cross(rows: DataFrame, p: int) -> np.ndarray:
    """Sums of products of the columns of ``y``: p x p numbers, whatever the rows."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.agg(*[F.sum(F.col("y")[i] * F.col("y")[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(pairs, got):
        out[i, j] = out[j, i] = v or 0.0
    return out


def _times(rows: DataFrame, key: str, w: np.ndarray) -> DataFrame:
    """Each row's ``y`` times a small matrix."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in w[:, j]]) for j in range(w.shape[1])])
    dot = lambda c: F.aggregate(F.zip_with("y", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.select(key, F.transform(columns, dot).alias("y"))


def _orthonormal(rows: DataFrame, key: str, p: int) -> tuple[DataFrame, int]:
    """Rows of an orthonormal basis of the columns of ``y``; twice, against rounding."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_cross(rows, p))
        keep = values > max(values.max(), 1e-300) * 1e-13
        rows = cut(_times(rows, key, vectors[:, keep] / np.sqrt(values[keep])))
        p = int(keep.sum())
    return rows, p


def eigen_templates(tpl: DataFrame, k: int, extra: int = 10, passes: int = 5) -> DataFrame:
    """Leading ``k`` left singular vectors of the (pixel x template) matrix with scaled columns.

    ``tpl(tpl_id, pix, t)``. A randomised range finder: Spark multiplies the matrix by k + ``extra`` columns, back and
    forth ``passes`` times; only (k + extra) x (k + extra) sums reach the driver, so neither side is limited.
    The start is a hash of tpl_id, the same on every run. Vectors are signed so their loadings sum to a
    positive number and scaled to unit median absolute value.
    """
    scale = quantiles(tpl, ["tpl_id"], F.abs("t"), {"_m": 0.5})
    unit = attach(tpl, scale, ["tpl_id"]).select("pix", "tpl_id", (F.col("t") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).alias("t"))
    unit = cut(unit)
    total = unit.agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0

    def product(left: DataFrame, key: str, p: int) -> DataFrame:
        return cut(left.groupBy(key).agg(F.array(*[F.sum(F.col("t") * F.col("y")[j]) for j in range(p)]).alias("y")))

    p = k + extra
    start = F.array(*[lcg_normal("tpl_id", F.lit(0), F.lit(j)) for j in range(p)])
    base, p = _orthonormal(product(unit.withColumn("y", start), "pix", p), "pix", p)
    for _ in range(passes):
        back, p = _orthonormal(product(unit.join(base, "pix"), "tpl_id", p), "tpl_id", p)
        base, p = _orthonormal(product(unit.join(back, "tpl_id"), "pix", p), "pix", p)
    load = product(unit.join(base, "pix"), "tpl_id", p)
    values, vectors = np.linalg.eigh(_cross(load, p))
    pick = np.argsort(values)[::-1][:k]
    s2, vec = np.maximum(values[pick], 0.0), vectors[:, pick]
    # The sign makes the loadings' sum over templates positive.
    sums = np.array(load.agg(*[F.sum(F.col("y")[j]) for j in range(p)]).first(), float)
    sign = np.sign(sums @ vec)
    vec = vec * np.where(sign == 0, 1.0, sign)
    share = F.array(*[F.lit(float(x) / max(total, 1e-300)) for x in s2])
    out = _times(base, "pix", vec).select(F.col("pix").cast("long").alias("pix"), F.posexplode("y").alias("component", "t"))
    out = cut(out.withColumn("explained", F.element_at(share, F.col("component") + 1)))
    med = quantiles(out, ["component"], F.abs("t"), {"_m": 0.5})
    return attach(out, med, ["component"]).withColumn("t", F.col("t") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).drop("_m")
