"""Column expressions for sampled series. Everything stays inside code generation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: speed of light, km/s.
C_KMS = 299792.458


def col(c: str | float | Column) -> Column:
    """Column names, plain numbers and columns alike."""
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(float(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``. Columns used inside a lambda are otherwise inlined by the
    optimizer and computed again for every element."""
    return F.transform(F.array(value), body)[0]


def array_sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, e: s + e)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def array_median(a: Column) -> Column:
    """Median of an array of numbers, null when it is empty."""
    return let(F.array_sort(a), lambda w: F.when(
        F.size(w) > 0,
        (F.element_at(w, F.floor((F.size(w) + 1) / 2).cast("int")) + F.element_at(w, (F.floor(F.size(w) / 2) + 1).cast("int"))) / 2,
    ))


def to_rest(x, z, frame: str = "observed") -> Column:
    """Observed coordinates are divided by 1+z; rest ones pass through."""
    return col(x) / (1 + col(z)) if frame == "observed" else col(x)


def window_to_rest(lo, hi, z, frame: str = "observed") -> tuple[Column, Column]:
    a, b = to_rest(lo, z, frame), to_rest(hi, z, frame)
    return F.least(a, b), F.greatest(a, b)


def sigma_from_variance(v) -> Column:
    return F.sqrt(F.greatest(col(v), F.lit(0.0)))


def flux_in_range(f, lo: float = 0.0, hi: float = 1.3) -> Column:
    return (col(f) > lo) & (col(f) <= hi)


#: Fixed value: an error of this size or more marks a masked sample in files.
MASKED_ERROR = 1e9


def nint(z) -> Column:
    """Nearest integer, halves away from zero."""
    z = col(z)
    return F.when(z >= 0, F.floor(z + 0.5)).otherwise(F.ceil(z - 0.5)).cast("long")


def line_half_width(centre, half_width: float, pad_kms: float) -> Column:
    return F.greatest(F.lit(float(half_width)), col(centre) * pad_kms / C_KMS)


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_pixel(edge: int = 0, n: str | Column | None = None, model: str | None = None) -> Column:
    """Pixels every statistic counts: unmasked, finite, positive error below the masked mark, inside the edge trim."""
    ok = F.col("good") & finite("g") & finite("gerr") & (F.col("gerr") > 0) & (F.col("gerr") < MASKED_ERROR)
    if model:
        ok = ok & finite(model)
    if edge:
        ok = ok & (F.col("pix") >= edge) & (F.col("pix") < col(n) - edge)
    return ok


def kms_to_pix(v, lam, step) -> Column:
    return col(v) * col(lam) / (C_KMS * col(step))


def pix_to_kms(p, lam, step) -> Column:
    return col(p) * col(step) * C_KMS / col(lam)


def lsf_sigma_kms(resolving_power) -> Column:
    return F.lit(C_KMS) / col(resolving_power) * FWHM_TO_SIGMA


def gh_h3(w) -> Column:
    w = col(w)
    return (2 * w * w * w - 3 * w) / math.sqrt(3.0)


def gh_h4(w) -> Column:
    w = col(w)
    return (4 * w * w * w * w - 12 * w * w + 3) / math.sqrt(24.0)


def gh_basis(w, n: int) -> Column:
    """Probabilists' Hermite polynomial over sqrt(n!). Never mix with ``gh_h3``/``gh_h4``."""
    w = col(w)
    before, now = F.lit(1.0), w
    for k in range(1, n):
        before, now = now, w * now - k * before
    return now / math.sqrt(math.factorial(n))


def gh_profile(v, amp, vel, sig, h3=0.0, h4=0.0) -> Column:
    """Four-moment profile; null where sigma is not positive."""
    s = F.when(col(sig) > 0, col(sig))
    w = (col(v) - col(vel)) / s
    gauss = col(amp) * F.exp(-0.5 * w * w) / (math.sqrt(2 * math.pi) * s)
    return gauss * (1 + col(h3) * gh_h3(w) + col(h4) * gh_h4(w))


def gh_profile_higher(v, amp, vel, sig, *h) -> Column:
    s = F.when(col(sig) > 0, col(sig))
    w = (col(v) - col(vel)) / s
    series = F.lit(1.0)
    for n, hn in enumerate(h, start=3):
        series = series + col(hn) * gh_basis(w, n)
    return col(amp) * F.exp(-0.5 * w * w) / (math.sqrt(2 * math.pi) * s) * series


def wing_weight(v, lam, sigma0, centre=0.0, core: float = 1.8) -> Column:
    d = F.abs(col(v) - col(centre)) / col(sigma0)
    return F.when(d > core, col(lam) * F.pow(d / core, F.lit(4.0))).otherwise(col(lam))


def wing_excess(v, sigma0, centre=0.0, core: float = 1.8) -> Column:
    """(d / core)^4 - 1 beyond the core, 0 inside: the optional wing-shrinkage weight."""
    d = F.abs(col(v) - col(centre)) / col(sigma0)
    return F.when(d > core, F.pow(d / core, F.lit(4.0)) - 1).otherwise(0.0)


def apply_corrections(model, xs, mode: str, amp=1.0, poly=0.0, cont=None) -> Column:
    """Amplitude, then an additive or multiplicative linear term, then the continuum."""
    out = col(model) * col(amp)
    if mode == "additive":
        out = out + col(poly) * col(xs)
    elif mode == "multiplicative":
        out = out * (1 + col(poly) * col(xs))
    return out if cont is None else out * col(cont)


def at_bound(a, bound, rtol: float = 1e-6, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(bound)) <= atol + rtol * F.abs(col(bound))


def bound_flags(a, grad, lo, hi) -> dict[str, Column]:
    """At-bound flags and the gradient with components pointing out of bounds zeroed."""
    low, high = at_bound(a, lo), at_bound(a, hi)
    g = col(grad)
    out = F.when((low & (g > 0)) | (high & (g < 0)), F.lit(0.0)).otherwise(g)
    return {"at_lower": low, "at_upper": high, "proj_grad": out}


# Fixed value: sigma of a Gaussian over its full width at half maximum.
FWHM_TO_SIGMA = 1.0 / (2.0 * math.sqrt(2.0 * math.log(2.0)))


def resolution_mismatch(data_fwhm, tpl_fwhm, atol: float = 1e-6) -> dict[str, Column]:
    """Kernel sigma and which side to convolve; rows with a non-positive width are 'invalid'."""
    d, t = col(data_fwhm) * FWHM_TO_SIGMA, col(tpl_fwhm) * FWHM_TO_SIGMA
    valid = finite(data_fwhm) & finite(tpl_fwhm) & (d > 0) & (t > 0)
    same = F.abs(d - t) <= atol
    return {
        "kernel_sigma": F.when(valid, F.when(same, 0.0).otherwise(F.sqrt(F.abs(d * d - t * t)))),
        "direction": F.when(~valid, "invalid").when(same, "none")
        .when(t < d, "convolve_templates").otherwise("convolve_data"),
    }


def object_id(path) -> Column:
    """File key: the last path part without .norm/.spec/.txt/.dat, else without its extension."""
    name = F.regexp_extract(col(path), r"([^/]+)$", 1)
    known = name.rlike(r"\.(norm|spec|txt|dat)$")
    return F.when(known, F.regexp_replace(name, r"\.(norm|spec|txt|dat)$", "")).otherwise(
        F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    )


# Fixed pattern: library file naming (IMF type and slope, signed metallicity, age).
LIBRARY_NAME = r"^E([a-z]{2})([0-9.]+)Z([mp])([0-9.]+)T([0-9.]+)"


def template_meta(name) -> dict[str, Column]:
    base = F.regexp_extract(col(name), r"([^/]+)$", 1)
    ok = base.rlike(LIBRARY_NAME)

    def part(i: int) -> Column:
        return F.when(ok, F.regexp_extract(base, LIBRARY_NAME, i))

    def number(i: int) -> Column:
        return part(i).try_cast("double")

    return {
        "imf_type": part(1),
        "imf_slope": number(2),
        "metallicity": F.when(part(3) == "m", -number(4)).otherwise(number(4)),
        "age": number(5),
    }


def lcg_uniform(obj, rep, k) -> Column:
    """Counter-based uniform in [0, 1): 52 bits of the digest of (object, replicate, counter), the same draw whatever
    the partitioning."""
    key = F.concat_ws(":", *[col(c).cast("long").cast("string") for c in (obj, rep, k)])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def lcg_normal(obj, rep, k) -> Column:
    """Standard normal from two counter draws (Box-Muller)."""
    u = F.greatest(lcg_uniform(obj, rep, col(k) * 2), F.lit(1e-12))
    v = lcg_uniform(obj, rep, col(k) * 2 + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
