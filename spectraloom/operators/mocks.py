"""Planted-truth tables: truth histograms, broadened templates, contamination, noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import col, gh_profile, lcg_normal, lcg_uniform
from spectraloom.functions.lines import MOCK_EMISSION_CENTRES
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.resample import gauss_smooth
from spectraloom.plans.scale import attach, halo, quantiles


def double_peak(v, centre, sigma, separation: float = 0.6, width: float = 0.5, ratio: float = 1.0) -> Column:
    """Two Gaussians at +-0.6 sigma, half as wide, in the given amplitude ratio."""
    w2 = ratio / (1.0 + ratio)
    s = width * col(sigma)

    def peak(sign):
        d = (col(v) - (col(centre) + sign * separation * col(sigma))) / s
        return F.exp(-0.5 * d * d)

    return (1 - w2) * peak(-1) + w2 * peak(1)


def truth_losvd(truth: DataFrame, n: int, reach: float | None = 8.0, vmin=None, vmax=None, keys: Sequence[str] = OBJ) -> DataFrame:
    """Unit-sum truth histograms. ``truth(keys, v_true, sigma_true, h3, h4, shape)`` -> ``(keys, bin, v, b)``.

    The grid spans ``reach`` sigmas around the true velocity, or [vmin, vmax].
    """
    lo = F.col("v_true") - reach * F.col("sigma_true") if vmin is None else F.lit(float(vmin))
    hi = F.col("v_true") + reach * F.col("sigma_true") if vmax is None else F.lit(float(vmax))
    d = truth.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("v", lo + (hi - lo) * F.col("bin") / (n - 1))
    smooth = F.greatest(F.coalesce(gh_profile("v", 1.0, "v_true", "sigma_true", "h3", "h4"), F.lit(0.0)), F.lit(0.0))
    d = d.withColumn("b", F.when(F.col("shape") == "double_peak", double_peak("v", "v_true", "sigma_true")).otherwise(smooth))
    total = d.groupBy(*keys).agg(F.sum("b").alias("_t"))
    return attach(d.select(*keys, "bin", "v", "b"), total, keys).withColumn(
        "b", F.when(F.col("_t") > 0, F.col("b") / F.col("_t")).otherwise(F.col("b"))
    ).drop("_t")


def inject_lines(
    df: DataFrame, lo: Column | float, hi: Column | float, cont: str, seed: str | Column, value: str = "g", fwhm: float = 3.0,
    centres: Sequence[float] = MOCK_EMISSION_CENTRES, keys: list[str] = OBJ,
) -> DataFrame:
    """Add Gaussian lines inside each series' range, amplitude uniform in (lo, hi) times the local continuum.

    The lines of a series (at most one per entry of the short list) are packed into an array, so the
    profile sum is one expression per pixel.
    """
    sigma = fwhm / 2.3548
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(centres)])
    pairs = halo(df.withColumn("_c", F.col(cont)), keys, 1, lambda w: {"_x1": F.lead("x").over(w), "_c1": F.lead("_c").over(w)})
    pairs = pairs.withColumn("_x1", F.coalesce("_x1", F.col("x"))).withColumn("_c1", F.coalesce("_c1", F.col("_c")))
    inside = F.filter(lines, lambda e: (e["c"] >= F.col("x")) & ((e["c"] < F.col("_x1")) | ((F.col("x") == F.col("_x1")) & (e["c"] == F.col("x")))))
    at = pairs.withColumn("_s", col(seed)).select(*keys, "x", "_x1", "_c", "_c1", "_s", col(lo).alias("_lo"), col(hi).alias("_hi"), F.explode(inside).alias("_e"))
    local = F.col("_c") + F.coalesce(F.try_divide(F.col("_c1") - F.col("_c"), F.col("_x1") - F.col("x")), F.lit(0.0)) * (F.col("_e.c") - F.col("x"))
    u = lcg_uniform(keys[0], "_s", F.col("_e.i"))
    amp = at.select(*keys, F.col("_e.c").alias("c"), ((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * u) * local).alias("amp"))
    packed = amp.groupBy(*keys).agg(F.collect_list(F.struct("c", "amp")).alias("_l"))
    add = F.aggregate(
        F.coalesce("_l", F.array().cast("array<struct<c:double,amp:double>>")), F.lit(0.0),
        lambda s, e: s + e["amp"] * F.exp(-0.5 * F.pow((F.col("x") - e["c"]) / sigma, F.lit(2.0))),
    )
    return attach(df, packed, keys).withColumn(value, F.col(value) + add).drop("_l")


def add_noise(df: DataFrame, snr, seed, value: str = "g", floor: float = 1e-8, keys: list[str] = OBJ) -> DataFrame:
    """Gaussian noise at median |flux| / snr (floored), the same level in the error column."""
    level = quantiles(df, keys, F.abs(value), {"_level": 0.5})
    d = attach(df, level, keys).withColumn("gerr", F.greatest(F.col("_level") / col(snr), F.lit(floor)))
    return d.withColumn(value, F.col(value) + F.col("gerr") * lcg_normal(keys[0], seed, "pix")).drop("_level")


def flatten_templates(tpl: DataFrame, sigma: float = 200.0) -> DataFrame:
    """Divide each template by a wide Gaussian smooth of itself; 1 where the smooth is not positive."""
    d = gauss_smooth(tpl, sigma, "flux", "_s", ["tpl_id"])
    return d.withColumn("flux", F.when(F.col("_s") > 0, F.col("flux") / F.col("_s")).otherwise(1.0)).drop("_s")
