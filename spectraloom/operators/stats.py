"""Fit statistics, histogram moments and shape measures, replicate spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.columns import col, valid_pixel, wing_excess, wing_weight
from spectraloom.plans.scale import attach, checked_once, cut, quantiles


def chi2(df: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """Sum of squared standardised residuals and their count; (inf, 0) without valid pixels."""
    ok = valid_pixel(model=model)
    r = (F.col("g") - F.col(model)) / F.col("gerr")
    return df.groupBy(*by).agg(F.sum(F.when(ok, r * r)).alias("chi2"), F.count_if(ok).alias("ngood")).withColumn(
        "chi2", F.coalesce("chi2", F.lit(float("inf")))
    )


def chi2_reduced(kind: str, params: int = 0) -> Column:
    """Three denominators are in use: 'good' = n, 'dof' = max(n-1, 1), 'params' = max(n-p, 1)."""
    n = F.col("ngood")
    den = {"good": n, "dof": F.greatest(n - 1, F.lit(1)), "params": F.greatest(n - params, F.lit(1))}[kind]
    return F.col("chi2") / F.nullif(den.cast("double"), F.lit(0.0))


def rms(df: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    r = F.col("g") - F.col(model)
    return df.filter(valid_pixel(model=model)).groupBy(*by).agg(F.sqrt(F.avg(r * r)).alias("rms"))


def fractions(df: DataFrame, by: Sequence[str], weight: str = "w") -> DataFrame:
    total = df.groupBy(*by).agg(F.sum(weight).alias("_t"))
    return attach(df, total, by).withColumn("fraction", F.try_divide(weight, "_t")).drop("_t")


def pooled_frac_error(df: DataFrame, flux: str, err: str) -> DataFrame:
    """Median of err/flux over all rows where both are positive, 0 when there are none."""
    ok = df.filter((F.col(flux) > 0) & (F.col(err) > 0))
    med = quantiles(ok, [], F.col(err) / F.col(flux), {"frac_error": 0.5})
    return med.agg(F.coalesce(F.max("frac_error"), F.lit(0.0)).alias("frac_error"))


# --- Histograms: one row per (object, bin). A histogram has a few dozen bins by construction, ---
# --- so a window or an array over the bins of one histogram is bounded by the grid size.      ---


def bins_of(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("bin")


def roughness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest |second difference| of b clipped at 0 over its peak; 0 below 3 bins, inf for peak < 1e-4."""
    w = bins_of(keys)
    b = F.greatest("b", F.lit(0.0))
    d = df.withColumn("_b", b).withColumn("_d", F.abs(F.lead("_b").over(w) - 2 * F.col("_b") + F.lag("_b").over(w)))
    facts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_b").alias("_p"), F.max("_d").alias("_m"))
    return facts.select(*keys, F.when(F.col("_n") < 3, 0.0).when(F.col("_p") < 1e-4, float("inf"))
                        .otherwise(F.try_divide("_m", "_p")).alias("roughness"))


def losvd_moments(df: DataFrame, keys: Sequence[str], clip: bool = True) -> DataFrame:
    """Centroid and dispersion of a histogram; null where the total is not positive."""
    b = F.greatest("b", F.lit(0.0)) if clip else F.col("b")
    first = df.groupBy(*keys).agg(F.sum(b).alias("_s"), F.sum(b * F.col("v")).alias("_sv"))
    first = first.select(*keys, F.when(F.col("_s") > 0, F.col("_s")).alias("_s"), F.when(F.col("_s") > 0, F.col("_sv") / F.col("_s")).alias("vel"))
    second = attach(df, first, keys).groupBy(*keys, "vel", "_s").agg(F.sum(b * F.pow(F.col("v") - F.col("vel"), F.lit(2.0))).alias("_m2"))
    return second.select(*keys, "vel", F.sqrt(F.greatest(F.col("_m2") / F.col("_s"), F.lit(0.0))).alias("sigma"))


def arg_first_max(df: DataFrame, keys: Sequence[str], value: str = "b", pos: str = "bin") -> DataFrame:
    """Position and value of the maximum; the lowest position wins ties."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("m"), (-F.col(pos)).alias("i"))).alias("_m")).select(
        *keys, (-F.col("_m.i")).alias("at"), F.col("_m.m").alias("peak")
    )


def fwhm(df: DataFrame, keys: Sequence[str], level: float = 0.5) -> DataFrame:
    """Width at a fraction of the maximum. Left crossing nearest the peak, right one farthest from it."""
    w = bins_of(keys)
    peak = arg_first_max(df, keys)
    d = attach(df, peak, keys).withColumn("_nb", F.lead("b").over(w)).withColumn("_nv", F.lead("v").over(w))
    half = level * F.col("peak")
    i, b, nb, v, nv = F.col("bin"), F.col("b"), F.col("_nb"), F.col("v"), F.col("_nv")
    up = (i < F.col("at")) & (half >= b) & (half < nb)
    down = (i >= F.col("at")) & (half >= nb) & (half < b)
    facts = d.groupBy(*keys, "peak").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(i == F.col("at"), v)).alias("v_peak"),
        F.max(F.when(up, F.struct(i, (v + (half - b) / (nb - b) * (nv - v)).alias("x")))).alias("_l"),
        F.max(F.when(down, F.struct(i, (nv + (half - nb) / (b - nb) * (v - nv)).alias("x")))).alias("_r"),
        F.min(F.struct("bin", "v")).alias("_first"), F.max(F.struct("bin", "v")).alias("_last"),
    )
    enough = F.col("_n") >= 3
    left = F.coalesce("_l.x", "_first.v")
    right = F.coalesce("_r.x", "_last.v")
    return facts.select(
        *keys, *[F.when(enough, c).alias(n) for n, c in {
            "fwhm": right - left, "v_peak": F.col("v_peak"), "peak": F.col("peak"), "v_left": left, "v_right": right,
        }.items()]
    )


def smoothness(df: DataFrame, keys: Sequence[str], lam, sigma0, centre=0.0, step: float = 1.0) -> DataFrame:
    """Wing-tapered second-difference penalty, bins outside the grid count as 0, over step cubed."""
    w = bins_of(keys)
    d = F.coalesce(F.lead("b").over(w), F.lit(0.0)) - 2 * F.col("b") + F.coalesce(F.lag("b").over(w), F.lit(0.0))
    return df.withColumn("_t", wing_weight("v", lam, sigma0, centre) * d * d).groupBy(*keys).agg(
        (F.sum("_t") / step**3).alias("smooth")
    )


def wing_shrinkage(df: DataFrame, keys: Sequence[str], k: float, sigma0, centre=0.0, step: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(k * wing_excess("v", sigma0, centre) * F.col("b") * F.col("b")) / step**3).alias("shrink"))


def objective_terms(
    chi2s: DataFrame, hist: DataFrame, keys: Sequence[str], lam, sigma0, centre=0.0, step: float = 1.0, shrink: float = 0.0
) -> DataFrame:
    """chi2, smoothness, shrinkage, 0.1 * |sum b - 1| and their total."""
    total = hist.groupBy(*keys).agg((0.1 * F.abs(F.sum("b") - 1)).alias("norm"))
    out = chi2s.join(smoothness(hist, keys, lam, sigma0, centre, step), keys)
    out = out.join(wing_shrinkage(hist, keys, shrink, sigma0, centre, step), keys).join(total, keys)
    return out.withColumn("objective", F.col("chi2") + F.col("smooth") + F.col("shrink") + F.col("norm")).withColumn(
        "smooth_ratio", F.try_divide("smooth", "chi2")
    )


def diff_penalty(df: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """Sum of squared ``order``-th differences along the bins."""
    w = bins_of(keys)
    d = df.withColumn("_d", F.col("b"))
    for _ in range(order):
        d = d.withColumn("_d", F.lead("_d").over(w) - F.col("_d"))
    return d.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("penalty"))


def normalise_losvd(df: DataFrame, keys: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """b floored and scaled to unit sum."""
    b = F.greatest("b", F.lit(float(floor)))
    total = df.groupBy(*keys).agg(F.sum(b).alias("_t"))
    return attach(df, total, keys).withColumn("b", b / F.nullif("_t", F.lit(0.0))).drop("_t")


# Lowest point between bin i and the nearest taller bin on one side, 0 when no bin there is taller.
_KEY_COL = """aggregate({side}, named_struct('low', CAST('Infinity' AS DOUBLE), 'key', CAST(-1 AS DOUBLE)),
      (s, j) -> CASE WHEN s.key >= 0 THEN s
                     WHEN p.b[j] > p.b[i] THEN named_struct('low', s.low, 'key', CASE WHEN s.low = CAST('Infinity' AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE s.low END)
                     ELSE named_struct('low', least(s.low, p.b[j]), 'key', s.key) END,
      s -> CASE WHEN s.key >= 0 THEN s.key ELSE CAST(0 AS DOUBLE) END)"""
PEAKS = f"""CASE WHEN p.n < 3 OR p.top <= 0 THEN 1 ELSE greatest(1, size(filter(sequence(1, p.n - 2), i ->
  p.b[i] > p.b[i - 1] AND p.b[i] > p.b[i + 1] AND p.b[i] - greatest(
    {_KEY_COL.format(side="sequence(i - 1, 0, -1)")},
    {_KEY_COL.format(side="sequence(i + 1, p.n - 1)")}
  ) >= {{prominence}} * p.top))) END"""


def pack_bins(df: DataFrame, keys: Sequence[str], value: str = "b", name: str = "b") -> DataFrame:
    """One array per histogram, ordered by bin (bounded by the grid size)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", F.col(value).alias("_y")))).alias("_p")).select(
        *keys, F.transform("_p", lambda e: e["_y"]).alias(name)
    )


def count_peaks(df: DataFrame, keys: Sequence[str], prominence: float = 0.1) -> DataFrame:
    """Strict local maxima whose height over the higher key col reaches a share of the peak; >= 1."""
    packed = pack_bins(df.withColumn("b", F.greatest("b", F.lit(0.0))), keys)
    # The array is bound once as a lambda variable; its maximum and length likewise.
    found = F.expr(f"transform(array(struct(b, size(b) AS n, array_max(b) AS top)), p -> {PEAKS.format(prominence=float(prominence))})[0]")
    return packed.select(*keys, found.cast("long").alias("n_peaks"))


# --- Replicates: (object, bin, rep) rows; the replicate axis is unbounded. ---


def replicate_spread(df: DataFrame, by: Sequence[str], value: str = "b") -> DataFrame:
    """Sample standard deviation, NaN replicates left out."""
    x = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.stddev_samp(x).alias("spread"), F.count(x).alias("n_rep"))


def replicate_interval(df: DataFrame, by: Sequence[str], confidence: float = 0.68, value: str = "b") -> DataFrame:
    a = (1 - confidence) / 2
    return quantiles(df, by, F.when(~F.isnan(value), F.col(value)), {"p_lo": a, "p_mid": 0.5, "p_hi": 1 - a})


def biweight_location(df: DataFrame, by: Sequence[str], value: str = "b", c: float = 6.0) -> DataFrame:
    """Tukey's biweight location; the median where the MAD is 0."""
    src = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x)")
    with checked_once(src, by):
        med = cut(quantiles(src, by, "_x", {"_m": 0.5}))  # one row per key, read by two plans
        dev = attach(src, med, by)
        mad = quantiles(dev, by, F.abs(F.col("_x") - F.col("_m")), {"_mad": 0.5})
    u = (F.col("_x") - F.col("_m")) / F.nullif(c * F.col("_mad"), F.lit(0.0))
    wt = F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0)))
    sums = attach(dev, mad, by).groupBy(*by).agg(
        F.max("_m").alias("_m"), F.sum((F.col("_x") - F.col("_m")) * wt).alias("_a"), F.sum(wt).alias("_b")
    )
    return sums.select(*by, (F.col("_m") + F.coalesce(F.try_divide("_a", "_b"), F.lit(0.0))).alias("location"))


def anchored_bounds(
    point: DataFrame, reps: DataFrame, by: Sequence[str], confidence: float = 0.68, value: str = "b", floor: float | None = 0.0
) -> DataFrame:
    """Interval widths measured from the biweight location, moved onto the point estimate."""
    loc = biweight_location(reps, by, value)
    iv = replicate_interval(reps, by, confidence, value)
    out = point.join(loc, list(by), "left").join(iv, list(by), "left")
    lo = F.col(value) - (F.col("location") - F.col("p_lo"))
    if floor is not None:
        lo = F.greatest(lo, F.lit(float(floor)))
    return out.withColumn("lo", lo).withColumn("hi", F.col(value) + (F.col("p_hi") - F.col("location")))


def coverage(df: DataFrame, by: Sequence[str], truth, lo, hi) -> DataFrame:
    """Share of rows whose interval contains the truth."""
    hit = (col(truth) >= col(lo)) & (col(truth) <= col(hi))
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("coverage"), F.count_if(hit).alias("n_covered"), F.count(F.lit(1)).alias("n"))


def draw_summary(df: DataFrame, by: Sequence[str], confidence: float = 0.68, value: str = "b") -> DataFrame:
    """Mean and equal-tail quantiles of posterior-like draws."""
    a = (1 - confidence) / 2
    q = quantiles(df, by, value, {"q_lo": a, "q_hi": 1 - a})
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(q, list(by))


def thin_draws(df: DataFrame, keys: Sequence[str], n_keep: int, draw: str = "draw") -> DataFrame:
    """Keep ``n_keep`` evenly spaced draws per object (draws numbered from 0), all if there are fewer."""
    size = df.groupBy(*keys).agg((F.max(draw) + 1).alias("_n"))
    idx = F.floor(F.col("_i") * (F.col("_n") - 1) / (F.col("_k") - 1))
    keep = (
        size.withColumn("_k", F.least(F.col("_n"), F.lit(n_keep)))
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        .select(*keys, F.when(F.col("_k") > 1, idx).otherwise(0).cast("long").alias(draw))
        .distinct()
    )
    return df.join(keep, [*keys, draw], "left_semi")
