"""Interpolation, regridding, smoothing, forward model and correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import C_KMS, array_sum, col, let, nint
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.stats import pack_bins
from spectraloom.plans.scale import BLOCK_ROWS, attach, halo, number_rows, quantiles, setting, spread

PACKED_SERIES = ("spectraloom.packedSeries", 65_536)


def _segments(df: DataFrame, keys: list[str], x: str, values: Sequence[str]) -> DataFrame:
    """Each sample with its right neighbour: ``_x0, _x1`` and ``v, v_next`` per value."""
    base = df if "pix" in df.columns else number_rows(df, keys, [x], "pix")
    return halo(base, keys, 1, lambda w: {"_x1": F.lead(x).over(w), **{f"{v}_next": F.lead(v).over(w) for v in values}}).withColumn("_x0", F.col(x))


def _bucketed(segs: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    return segs.withColumn("_bkt", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def interp_templates(grid: DataFrame, tpl: DataFrame) -> DataFrame:
    """Every template on every grid point: ``t`` and ``outside``.

    ``grid(x, ...)``, ``tpl(tpl_id, wave, flux)``. Outside means x < first or x >= last. The value is 1
    there and wherever a bracketing flux is not positive. The two stretches outside a template's
    coverage are segments too, so all pairs come out of one equi-join on coordinate buckets.
    """
    x_lo, x_hi = grid.agg(F.min("x"), F.max("x")).first()
    first, last, n, nt = tpl.agg(F.min("wave"), F.max("wave"), F.count(F.lit(1)), F.count_distinct("tpl_id")).first()
    width = max((last - first) / max(n / max(nt, 1), 1) * 2, 1e-9)
    segs = _segments(tpl.select("tpl_id", "wave", "flux", *(["pix"] if "pix" in tpl.columns else [])), ["tpl_id"], "wave", ["flux"])
    inner = segs.filter("_x1 IS NOT NULL").select("tpl_id", "_x0", "_x1", F.col("flux").alias("_f0"), F.col("flux_next").alias("_f1"), F.lit(False).alias("outside"))
    ends = tpl.groupBy("tpl_id").agg(F.min("wave").alias("a"), F.max("wave").alias("b"))
    none = F.lit(None).cast("double")
    beyond = F.lit(x_hi + 1.0)
    gaps = ends.select("tpl_id", F.explode(F.array(
        F.struct(F.least(F.lit(x_lo), F.col("a")).alias("_x0"), F.col("a").alias("_x1")),
        F.struct(F.col("b").alias("_x0"), F.greatest(beyond, F.col("b")).alias("_x1")),
    )).alias("_s")).select("tpl_id", "_s._x0", "_s._x1", none.alias("_f0"), none.alias("_f1"), F.lit(True).alias("outside")).filter("_x1 > _x0")
    clip_hi = F.least(F.col("_x1"), beyond)
    near = inner.unionByName(gaps).filter((F.col("_x1") > x_lo) & (F.col("_x0") <= x_hi))
    both = _bucketed(near, F.greatest(F.col("_x0"), F.lit(x_lo)), clip_hi, width)
    hit = grid.withColumn("_bkt", F.floor(F.col("x") / width)).join(both, "_bkt").filter("x >= _x0 AND x < _x1")
    value = F.col("_f0") + (F.col("_f1") - F.col("_f0")) * ((F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")))
    fine = ~F.col("outside") & (F.col("_f0") > 0) & (F.col("_f1") > 0)
    return hit.withColumn("t", F.when(fine, value).otherwise(1.0)).drop("_bkt", "_x0", "_x1", "_f0", "_f1")


def rebin(df: DataFrame, step: float, values: Sequence[str] = ("g",), keys: list[str] = OBJ) -> DataFrame:
    """Linear interpolation onto x_first + step * pix, the last value held beyond the end."""
    ends = df.groupBy(*keys).agg(F.min("x").alias("_first"), F.max("x").alias("_last"), F.max("pix").alias("_n"))
    width = 4 * step
    segs = attach(_segments(df, keys, "x", values), ends, keys)
    top = F.greatest(F.col("_last"), F.col("_first") + step * F.col("_n")) + step
    segs = segs.withColumn("_x1", F.coalesce("_x1", top))
    both = _bucketed(segs, F.col("_x0"), F.col("_x1"), width).select(*keys, "_bkt", "_x0", "_x1", *values, *[f"{v}_next" for v in values])
    new = attach(df.select(*keys, "pix"), ends, keys).select(*keys, "pix", (F.col("_first") + step * F.col("pix")).alias("x"))
    hit = new.withColumn("_bkt", F.floor(F.col("x") / width)).join(both, [*keys, "_bkt"]).filter("x >= _x0 AND x < _x1")
    at = (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    return hit.select(*keys, "pix", "x", *[
        (F.col(v) + F.coalesce(F.col(f"{v}_next") - F.col(v), F.lit(0.0)) * at).alias(v) for v in values
    ])


def coverage_mask(tpl_on_grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A pixel is uncovered only when every template lacks it."""
    return tpl_on_grid.groupBy(*keys).agg(F.every("outside").alias("outside_all"))


def normalise_templates(tpl: DataFrame, flux: str = "flux", positive_only: bool = True, key: str = "tpl_id") -> DataFrame:
    """Divide by the median of the positive flux (or the plain median); 1 where there is none."""
    x = F.when(F.col(flux) > 0, F.col(flux)) if positive_only else F.col(flux)
    med = quantiles(tpl, [key], x, {"_med": 0.5})
    scale = F.when(F.col("_med") > 0, F.col("_med")) if positive_only else F.when(F.col("_med") != 0, F.col("_med"))
    return attach(tpl, med, [key]).withColumn(flux, F.col(flux) / F.coalesce(scale, F.lit(1.0))).drop("_med")


def mix_templates(tpl_on_grid: DataFrame, weights: DataFrame, by: Sequence[str], on: Sequence[str] = ("tpl_id",), use_coverage: bool = True) -> DataFrame:
    """Weighted template mixture per pixel; uncovered templates leave the sum and the weight."""
    d = tpl_on_grid.join(weights, list(on))
    keep = ~F.col("outside") if use_coverage else F.lit(True)
    sums = d.groupBy(*by).agg(
        F.sum(F.when(keep, F.col("w") * F.col("t")).otherwise(0.0)).alias("_a"), F.sum(F.when(keep, F.col("w")).otherwise(0.0)).alias("_b"),
        F.sum("w").alias("_w"),
    )
    den = F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_b"))
    return sums.select(*by, F.when(F.col("_w") <= 0, 1.0).otherwise(F.col("_a") / den).alias("tmix"))


def fine_losvd(df: DataFrame, keys: Sequence[str], n_fine: int | str) -> DataFrame:
    """Histogram resampled to ``n_fine`` points keeping its total: one packed row per key
    (``v0``, ``v1``, ``y`` array), all bounded by the velocity grids."""
    ends = df.groupBy(*keys).agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    nf = (F.lit(n_fine) if isinstance(n_fine, int) else F.col(n_fine)).cast("int")
    d = pack_bins(df, keys).join(ends, list(keys)).withColumn("_nf", nf)

    def sample(b):
        def one(j):
            at = j * (F.size(b) - 1) / (F.col("_nf") - 1).cast("double")
            lo = F.floor(at).cast("int")
            left, right = F.get(b, lo), F.get(b, F.least(lo + 1, F.size(b) - 1))
            return left + (right - left) * (at - F.floor(at))

        return F.transform(F.sequence(F.lit(0), F.col("_nf") - 1), one)

    def rescale(b, y):
        return let(F.struct(array_sum(b).alias("b"), array_sum(y).alias("y")), lambda s: F.transform(
            y, lambda e: F.when(s["y"] != 0, e * (s["b"] / s["y"])).otherwise(e)
        ))

    y = let(F.col("b"), lambda b: let(sample(b), lambda y: rescale(b, y)))
    return d.select(*keys, "v0", "v1", y.alias("y"))


def refine_losvd(df: DataFrame, keys: Sequence[str], n_fine: int) -> DataFrame:
    return fine_losvd(df, keys, n_fine).select(*keys, F.posexplode("y").alias("j", "y"))


def convolve_losvd(pix: DataFrame, fine: DataFrame, step: float, value: str = "t", keys: list[str] = OBJ) -> DataFrame:
    """Scatter every pixel through the fine velocity profile to the nearest target pixel.

    ``pix(keys, pix, x, value)``; ``fine`` from ``fine_losvd``. Each pixel also sends an empty share to
    itself, so unhit pixels stay in the result as 0 without another join.
    """
    ends = pix.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("pix").alias("_last"))
    d = attach(attach(pix, ends, keys), fine, keys)
    d = d.withColumn("_sum", array_sum("y")).withColumn("_e", F.explode(F.expr(
        "concat(array(named_struct('j', -1, 'y', cast(0 as double))), transform(y, (e, j) -> named_struct('j', j, 'y', e)))"
    ))).withColumn("_nf", F.size("y")).drop("y")
    v = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("_e.j") / (F.col("_nf") - 1)
    target = nint((1 - F.col("_x0") / step) + F.col("x") * ((1 + v / C_KMS) / step)) - 1
    d = d.withColumn("_to", F.when(F.col("_e.j") < 0, F.col("pix")).otherwise(target)).filter("_to >= 0 AND _to <= _last")
    out = d.groupBy(*keys, F.col("_to").alias("pix")).agg(
        F.sum(F.col(value) * F.col("_e.y")).alias("_g"), F.sum("_e.y").alias("weight"), F.max("_sum").alias("_sum")
    )
    model = F.when(F.col("weight") != 0, F.col("_g") * F.col("_sum") / F.col("weight")).otherwise(F.col("_g"))
    return out.select(*keys, "pix", model.alias("model"), "weight")


def gauss_weights(sigma: float) -> list[float]:
    """Normalised Gaussian taps cut at 4 sigma."""
    r = int(4.0 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    s = sum(w)
    return [x / s for x in w]


def gauss_smooth(df: DataFrame, sigma: float, value: str = "g", name: str = "smooth", keys: list[str] = OBJ) -> DataFrame:
    """Gaussian smoothing along ``pix``, the end values held outside the series.

    Short kernels are a sum of offset columns; long ones a numpy convolution of one block of rows with
    its halo, so no task ever holds a whole series.
    """
    if sigma <= 0:
        return df.withColumn(name, F.col(value))
    taps = gauss_weights(sigma)
    r = len(taps) // 2
    if r <= 40:
        def frames(w):
            first, last = F.first(value).over(w.rowsBetween(-r, r)), F.last(value).over(w.rowsBetween(-r, r))
            total = taps[r] * F.col(value)
            for k in range(1, r + 1):
                total = total + taps[r + k] * (
                    F.coalesce(F.lag(value, k).over(w), first) + F.coalesce(F.lead(value, k).over(w), last)
                )
            return {name: total}

        return halo(df, keys, r, frames)
    size = setting(df.sparkSession, BLOCK_ROWS)
    first = F.greatest(F.floor((F.col("pix") - r) / size), F.lit(0).cast("long"))
    spread = df.withColumn("_blk", F.explode(F.sequence(first, F.floor((F.col("pix") + r) / size))))
    schema = df.schema.simpleString()[len("struct<"):-1]

    def block(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pix")
        y = rows[value].to_numpy(float)
        padded = np.concatenate([np.full(r, y[0]), y, np.full(r, y[-1])])
        rows[name] = np.convolve(padded, taps, mode="valid")
        return rows[rows["pix"] // size == key[-1]].drop(columns="_blk")

    return spread.groupBy(*keys, "_blk").applyInPandas(block, f"{schema},{name}:double")


def gauss_kernel(losvd: DataFrame, keys: Sequence[str], lam: float, step: float) -> DataFrame:
    """Velocity profile on a uniform grid resampled at integer pixels, unit sum: ``lo`` and ``k`` array."""
    ends = losvd.groupBy(*keys).agg(F.min("v").alias("v0"), F.max("v").alias("v1"))
    d = pack_bins(losvd, keys).join(ends, list(keys))
    f = lam / (C_KMS * step)
    d = d.withColumn("_p0", F.col("v0") * f).withColumn("_dp", (F.col("v1") - F.col("v0")) * f / (F.size("b") - 1))
    d = d.withColumn("lo", F.floor("_p0").cast("int")).withColumn("_hi", F.ceil(F.col("v1") * f).cast("int"))

    def sample(b):
        def one(p):
            at = (p - F.col("_p0")) / F.col("_dp")
            lo = F.least(F.floor(at), (F.size(b) - 1).cast("long")).cast("int")
            left, right = F.get(b, lo), F.get(b, F.least(lo + 1, F.size(b) - 1))
            out = (p < F.col("_p0")) | (p > F.col("_p0") + F.col("_dp") * (F.size(b) - 1))
            return F.when(out, 0.0).otherwise(left + (right - left) * (at - F.floor(at)))

        return F.transform(F.sequence("lo", "_hi"), one)

    unit = let(F.col("b"), lambda b: let(sample(b), lambda r: let(array_sum(r), lambda s: F.transform(
        r, lambda e: F.when(s > 0, e / s).otherwise(e)
    ))))
    return d.select(*keys, "lo", unit.alias("k"))


def convolve_kernel(pix: DataFrame, kernel: DataFrame, value: str = "t", keys: list[str] = OBJ, same: bool = True) -> DataFrame:
    """Zero-padded convolution of each series with its packed kernel (kernel not longer than the series).

    ``same`` centres the middle tap on the pixel, as the usual 'same' mode does; otherwise taps keep
    their own offsets ``lo + j``, so a kernel about a non-zero velocity moves the series.
    """
    ends = pix.groupBy(*keys).agg(F.max("pix").alias("_last"))
    d = attach(attach(pix.select(*keys, "pix", value), ends, keys), kernel, keys)
    centre = F.floor((F.size("k") - 1) / 2) if same else -F.col("lo").cast("long")
    d = d.withColumn("_c", centre).select(*keys, "pix", value, "_last", "_c", F.posexplode("k").alias("_j", "_w"))
    to = F.col("pix") + F.col("_j") - F.col("_c")
    return d.withColumn("_to", to).filter("_to >= 0 AND _to <= _last").groupBy(*keys, F.col("_to").alias("pix")).agg(
        F.sum(F.col(value) * F.col("_w")).alias("conv")
    )


def _solve_batches(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            a = np.stack(b.column("_gram").to_numpy(zero_copy_only=False)).reshape(-1, n, n)
            y = np.stack(b.column("_rhs").to_numpy(zero_copy_only=False))
            scale = np.sqrt(np.maximum(np.einsum("ijj->ij", a), 1e-300))
            scaled = a / scale[:, :, None] / scale[:, None, :]
            x = np.stack([np.linalg.lstsq(m, v, rcond=1e-13)[0] for m, v in zip(scaled, y / scale)]) / scale
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keys] + [pa.array(list(x), pa.list_(pa.float64()))], [*keys, "coef"]
            )

    return run


def solve_normal(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Least-squares coefficients from packed normal equations (``_gram`` n*n, ``_rhs`` n), batch-wise."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", coef array<double>"
    return df.select(*keys, "_gram", "_rhs").mapInArrow(_solve_batches(keys, n), schema)


def detrend(df: DataFrame, degree: int = 3, values: Sequence[str] = ("g",), keys: list[str] = OBJ) -> DataFrame:
    """Subtract a polynomial in the pixel index fitted over good pixels; masked pixels become 0."""
    ends = df.groupBy(*keys).agg(F.max("pix").alias("_n"))
    u = 2 * F.col("pix") / F.greatest(F.col("_n"), F.lit(1)) - 1
    d = attach(df, ends, keys).withColumn("_u", u)
    n = degree + 1
    powers = [F.pow("_u", F.lit(float(k))) if k else F.lit(1.0) for k in range(2 * degree + 1)]
    good = d.filter("good")
    sums = good.groupBy(*keys).agg(
        *[F.sum(p).alias(f"_s{k}") for k, p in enumerate(powers)],
        *[F.sum(powers[k] * F.col(v)).alias(f"_y{i}_{k}") for i, v in enumerate(values) for k in range(n)],
    )
    out = d
    for i, v in enumerate(values):
        packed = sums.select(
            *keys, F.array(*[F.col(f"_s{a + b}") for a in range(n) for b in range(n)]).alias("_gram"),
            F.array(*[F.col(f"_y{i}_{k}") for k in range(n)]).alias("_rhs"),
        )
        coef = solve_normal(packed, keys, n).withColumnRenamed("coef", f"_c{i}")
        trend = F.lit(0.0)
        for k in reversed(range(n)):
            trend = trend * F.col("_u") + F.col(f"_c{i}")[k]
        out = attach(out, coef, keys).withColumn(v, F.when(F.col("good"), F.col(v) - trend).otherwise(0.0)).drop(f"_c{i}")
    return out.drop("_u", "_n")


def _correlate_batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(k) for k in keys]
            for i in range(b.num_rows):
                a = np.asarray(b.column("_a")[i].values, float)
                t = np.asarray(b.column("_b")[i].values, float)
                n = len(a)
                if n <= 2048:
                    c = np.correlate(a, t, mode="full")
                else:
                    m = 1 << (2 * n - 1).bit_length()
                    c = np.roll(np.fft.irfft(np.fft.rfft(a, m) * np.conj(np.fft.rfft(t, m)), m), n - 1)[: 2 * n - 1]
                lag = pa.array(np.arange(-(n - 1), n), pa.int64())
                take = pa.array(np.full(2 * n - 1, i), pa.int64())
                yield pa.RecordBatch.from_arrays([k.take(take) for k in ids] + [lag, pa.array(c)], [*keys, "lag", "xcorr"])

    return run


def cross_correlate(df: DataFrame, a: str = "g", b: str = "t", keys: list[str] = OBJ) -> DataFrame:
    """Full correlation of two equally long series at every lag (``sum a[i + lag] * b[i]``).

    Series up to the packing limit are correlated as one row; longer ones by a Fourier transform
    spread over the cluster (``_long_correlation``). No pixel pairs are ever produced.
    """
    limit = setting(df.sparkSession, PACKED_SERIES)
    size = df.groupBy(*keys).agg((F.max("pix") + 1).alias("_n"))
    longest = size.agg(F.max("_n")).first()[0] or 0
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", lag long, xcorr double"
    short = df if longest <= limit else df.join(size.filter(F.col("_n") <= limit), keys, "left_semi")
    rows = spread(short, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pix", F.col(a).alias("_a"), F.col(b).alias("_b")))).alias("_p")).select(
        *keys, F.transform("_p", lambda e: e["_a"]).alias("_a"), F.transform("_p", lambda e: e["_b"]).alias("_b")
    )
    out = rows.mapInArrow(_correlate_batches(keys), schema)
    if longest > limit:
        long = df.join(size.filter(F.col("_n") > limit), keys)
        out = out.unionByName(_long_correlation(long, a, b, keys, longest))
    return out


def _fft_pass(df: DataFrame, keys: list[str], line: str, slot: str, m: int, twist: int, pairs: int) -> DataFrame:
    """One pass of the four-step transform: length-``m`` transforms along ``slot`` for every ``line``.

    Every group has at most ``m`` rows, the square root of the series length. ``twist`` > 0 applies
    the twiddle factors of a transform of that total length.
    """
    names = [f"{p}{i}" for i in range(pairs) for p in ("re", "im")]
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {line} long, {slot} long, " + ", ".join(f"{c} double" for c in names)

    def group(key, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[slot].to_numpy()
        k = np.arange(m)
        out = {name: key[i] for i, name in enumerate([*keys, line])}
        frame = {slot: k}
        for i in range(pairs):
            z = np.zeros(m, complex)
            z[at] = rows[f"re{i}"].to_numpy() + 1j * rows[f"im{i}"].to_numpy()
            z = np.fft.fft(z)
            if twist:
                z = z * np.exp(-2j * np.pi * ((k * int(key[-1])) % twist) / twist)
            frame[f"re{i}"], frame[f"im{i}"] = z.real, z.imag
        return pd.DataFrame({**{n: np.full(m, v) for n, v in out.items()}, **frame})[[*keys, line, slot, *names]]

    return df.groupBy(*keys, line).applyInPandas(group, schema)


def _long_correlation(df: DataFrame, a: str, b: str, keys: list[str], longest: int) -> DataFrame:
    m = 1 << ((int(2 * longest - 1).bit_length() + 1) // 2)
    total = m * m

    def transform(d: DataFrame, pairs: int) -> DataFrame:
        # n = m * n1 + n2  ->  k = k1 + m * k2
        one = _fft_pass(d.withColumn("n1", F.floor(F.col("n") / m)).withColumn("n2", F.col("n") % m), keys, "n2", "n1", m, total, pairs)
        two = _fft_pass(one.withColumnRenamed("n1", "k1"), keys, "k1", "n2", m, 0, pairs)
        return two.withColumn("k", F.col("k1") + m * F.col("n2"))

    zero = F.lit(0.0)
    src = df.select(*keys, F.col("pix").cast("long").alias("n"), F.col(a).alias("re0"), zero.alias("im0"), F.col(b).alias("re1"), zero.alias("im1"))
    f = transform(src, 2)
    # conj(A * conj(B)): a forward transform of it, conjugated and scaled, is the inverse of A * conj(B).
    re = F.col("re0") * F.col("re1") + F.col("im0") * F.col("im1")
    im = F.col("im0") * F.col("re1") - F.col("re0") * F.col("im1")
    back = transform(f.select(*keys, F.col("k").alias("n"), re.alias("re0"), (-im).alias("im0")), 1)
    lag = F.when(F.col("k") < total // 2, F.col("k")).otherwise(F.col("k") - total)
    size = df.groupBy(*keys).agg(F.max("_n").alias("_n"))
    return attach(back.select(*keys, lag.alias("lag"), (F.col("re0") / total).alias("xcorr")), size, keys).filter(
        F.abs("lag") < F.col("_n")
    ).select(*keys, "lag", "xcorr")


def refine_peak(xcorr: DataFrame, keys: list[str] = OBJ) -> DataFrame:
    """Lag of the first maximum, moved by a three-point parabola when that is concave and small."""
    peak = xcorr.groupBy(*keys).agg(F.max(F.struct("xcorr", (-F.col("lag")).alias("_l"))).alias("_p")).select(
        *keys, (-F.col("_p._l")).alias("lag0"), F.col("_p.xcorr").alias("y0")
    )
    d = attach(xcorr, peak, keys).groupBy(*keys, "lag0", "y0").agg(
        F.max(F.when(F.col("lag") == F.col("lag0") - 1, F.col("xcorr"))).alias("ym"),
        F.max(F.when(F.col("lag") == F.col("lag0") + 1, F.col("xcorr"))).alias("yp"),
    )
    den = F.col("ym") - 2 * F.col("y0") + F.col("yp")
    delta = 0.5 * (F.col("ym") - F.col("yp")) / F.when(den < 0, den)
    return d.select(*keys, "lag0", (F.col("lag0") + F.when(F.abs(delta) <= 1, delta).otherwise(0.0)).alias("lag"))


def _detrended(values: np.ndarray, good: np.ndarray, sizes: np.ndarray, degree: int) -> np.ndarray:
    """Rows of ``values`` less their polynomial in the position, fitted over good places; 0 at the others. All rows at once."""
    n = degree + 1
    u = 2 * np.arange(values.shape[1])[None, :] / np.maximum(sizes - 1, 1)[:, None] - 1
    power = [good.astype(float)]
    for _ in range(2 * degree):
        power.append(power[-1] * u)
    sums = np.stack([p.sum(1) for p in power], axis=1)
    gram = sums[:, np.arange(n)[:, None] + np.arange(n)[None, :]]
    rhs = np.stack([(power[k] * values).sum(1) for k in range(n)], axis=1)
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", gram), 1e-300))
    gram = gram / scale[:, :, None] / scale[:, None, :] + 1e-14 * np.eye(n)
    coef = np.linalg.solve(gram, (rhs / scale)[..., None])[..., 0] / scale
    trend = np.zeros_like(values)
    for k in reversed(range(n)):
        trend = trend * u + coef[:, k : k + 1]
    return np.where(good, values - trend, 0.0)


def _peaks(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lag of the largest correlation of each row pair, refined by its two neighbours; equal heights: the smallest lag."""
    m = a.shape[1]
    c = np.roll(np.fft.irfft(np.fft.rfft(a, 2 * m) * np.conj(np.fft.rfft(b, 2 * m)), 2 * m), m - 1, axis=1)[:, : 2 * m - 1]
    lag = np.arange(-(m - 1), m)
    c = np.where(np.abs(lag)[None, :] < sizes[:, None], c, -np.inf)
    at, row = np.argmax(c, axis=1), np.arange(len(a))
    top = c[row, at]
    low, high = (np.where((at + d >= 0) & (at + d < 2 * m - 1), c[row, np.clip(at + d, 0, 2 * m - 2)], -np.inf) for d in (-1, 1))
    inside = np.isfinite(low) & np.isfinite(high)
    low, high = np.where(inside, low, 0.0), np.where(inside, high, 0.0)
    bend = low - 2 * top + high
    shift = np.where(inside & (bend < 0), 0.5 * (low - high) / np.where(bend < 0, bend, 1.0), 0.0)
    return lag[at] + np.where(np.abs(shift) <= 1, shift, 0.0)


CLASS_VALUES = 1 << 20


def _lag_batches(keys: list[str], degree: int, least: int):
    """Series in classes of padded length, a class at a time; one lag (null with too few good samples) and middle per series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_p")
            flat, at = column.flatten(), np.asarray(column.offsets) - column.offsets[0].as_py()
            pix = np.asarray(flat.field("pix"))
            g, t, x = (np.nan_to_num(np.asarray(flat.field(c), float)) for c in ("g", "t", "x"))
            good = np.asarray(flat.field("good").to_numpy(zero_copy_only=False)).astype(bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            sizes = np.maximum.reduceat(pix, at[:-1]) + 1 if len(pix) else np.zeros(0, np.int64)
            lag, mid = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            centre = pix == sizes[row] // 2
            mid[row[centre]] = x[centre]
            width = np.array([1 << max(int(n - 1).bit_length(), 4) for n in sizes])
            usable = np.bincount(row[good], minlength=batch.num_rows) >= least
            for m in np.unique(width[usable]):
                members = np.flatnonzero(usable & (width == m))
                for start in range(0, len(members), max(1, CLASS_VALUES // int(m))):
                    some = members[start : start + max(1, CLASS_VALUES // int(m))]
                    place = np.full(batch.num_rows, -1)
                    place[some] = np.arange(len(some))
                    take = np.flatnonzero(place[row] >= 0)
                    where = (place[row[take]], pix[take])
                    one, two, ok = np.zeros((len(some), m)), np.zeros((len(some), m)), np.zeros((len(some), m), bool)
                    one[where], two[where], ok[where] = g[take], t[take], good[take]
                    lag[some] = _peaks(_detrended(one, ok, sizes[some], degree), _detrended(two, ok, sizes[some], degree), sizes[some])
            cols = [pa.array(v, pa.float64(), from_pandas=True) for v in (lag, mid)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *cols], [*keys, "lag", "_mid"])

    return run


def xcorr_velocity(df: DataFrame, step: float, v_lo, v_hi, degree: int = 3, g: str = "g", t: str = "t", keys: list[str] = OBJ) -> DataFrame:
    """Velocity of ``g`` against ``t``: detrend, correlate, refine, convert at the middle coordinate, clip.

    0 where fewer than max(10, 2 * degree + 3) pixels are good. Series up to the packing limit travel once and give one lag
    each; longer ones are correlated over the cluster.
    """
    least, limit = max(10, 2 * degree + 3), setting(df.sparkSession, PACKED_SERIES)
    types = dict(df.dtypes)
    longest = (df.agg(F.max("pix")).first()[0] or 0) + 1
    sizes = df.groupBy(*keys).agg((F.max("pix") + 1).alias("_n"), F.count_if("good").alias("_ok")) if longest > limit else None
    short = df if sizes is None else df.join(sizes.filter(F.col("_n") <= limit).select(*keys), keys, "left_semi")
    sample = F.struct(F.col("pix").cast("long").alias("pix"), F.col(g).cast("double").alias("g"), F.col(t).cast("double").alias("t"), F.col("x").cast("double").alias("x"), "good")
    packed = spread(short, *keys).groupBy(*keys).agg(F.collect_list(sample).alias("_p"))
    lags = packed.mapInArrow(_lag_batches(keys, degree, least), ", ".join(f"{k} {types[k]}" for k in keys) + ", lag double, _mid double")
    if sizes is not None:
        long = df.join(sizes.filter(F.col("_n") > limit), keys)
        flat = detrend(long.filter(F.col("_ok") >= least).drop("_n", "_ok"), degree, [g, t], keys)
        mid = long.filter(F.col("pix") == F.floor(F.col("_n") / 2)).select(*keys, F.col("x").alias("_mid"))
        far = mid.join(refine_peak(cross_correlate(flat, g, t, keys), keys).select(*keys, "lag"), keys, "left")
        lags = lags.unionByName(far.select(*keys, "lag", "_mid"))
    v = F.least(F.greatest(F.col("lag") * step * C_KMS / F.col("_mid"), col(v_lo)), col(v_hi))
    return lags.filter("_mid IS NOT NULL").select(*keys, F.when(F.col("lag").isNotNull(), v).otherwise(0.0).alias("v"))
