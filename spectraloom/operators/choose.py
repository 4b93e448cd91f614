"""Choosing a regularisation strength from a table of trials.

A trials table is ``(object_id, lam, chi2, ngood, n_peaks, v, sigma, rough)`` with one row per
(object, lambda): its rows per object are bounded by the lambda grid (``distinct_trials`` makes it so).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import array_median, let
from spectraloom.operators.pixels import OBJ
from spectraloom.plans.scale import attach


def distinct_trials(trials: DataFrame) -> DataFrame:
    """One trial per (object, lambda): the first evaluated (``ord``)."""
    rest = [c for c in trials.columns if c not in ("object_id", "lam", "ord")]
    return trials.groupBy(*OBJ, "lam").agg(F.min_by(F.struct(*rest), "ord").alias("_r")).select(*OBJ, "lam", "_r.*")


def pick_lambda_chi2(trials: DataFrame, tol: float = 0.02, max_peaks: int = 1) -> DataFrame:
    """Largest unimodal lambda with reduced chi2 within ``tol`` of the unimodal minimum; else the largest."""
    red = F.col("chi2") / F.col("ngood")
    single = F.col("n_peaks") <= max_peaks
    best = trials.groupBy(*OBJ).agg(F.min(F.when(single, red)).alias("_min"), F.max("lam").alias("_top"))
    ok = single & (red <= F.col("_min") * (1 + tol))
    return attach(trials, best, OBJ).groupBy(*OBJ).agg(F.coalesce(F.max(F.when(ok, F.col("lam"))), F.max("_top")).alias("lam"))


def pick_lambda_roughness(trials: DataFrame, limit: float = 0.25, max_peaks: int = 1) -> DataFrame:
    """Smallest lambda smooth enough and unimodal; else the largest."""
    ok = (F.col("rough") <= limit) & (F.col("n_peaks") <= max_peaks)
    return trials.groupBy(*OBJ).agg(F.coalesce(F.min(F.when(ok, F.col("lam"))), F.max("lam")).alias("lam"))


def sane_trials(trials: DataFrame, max_peaks: int = 1) -> DataFrame:
    """Adds ``sane``: V within 5 sigma of ``v_center`` and, with two or more other unimodal trials,
    within 5 * max(MAD, 3) of their median. Trials of an object form one short array."""
    packed = trials.groupBy(*OBJ).agg(
        F.collect_list(F.when(F.col("n_peaks") <= max_peaks, F.struct("lam", "v"))).alias("_single")
    )
    others = F.transform(F.filter("_single", lambda t: t["lam"] != F.col("lam")), lambda t: t["v"])
    near = F.abs(F.col("v") - F.col("v_center")) <= 5 * F.greatest("sigma", F.lit(1.0))

    def agrees(o):
        return let(array_median(o), lambda m: F.abs(F.col("v") - m) <= 5 * F.greatest(
            array_median(F.transform(o, lambda x: F.abs(x - m))), F.lit(3.0)
        ))

    agree = let(others, lambda o: F.when(F.size(o) >= 2, agrees(o)).otherwise(True))
    return attach(trials, packed, OBJ).withColumn("sane", near & agree).drop("_single")


def discrepancy_target(trials: DataFrame, nsigma: float = 0.3) -> DataFrame:
    """chi2 at the smallest lambda scaled by 1 + nsigma * sqrt(2 / ngood)."""
    first = trials.groupBy(*OBJ).agg(F.min_by(F.struct("chi2", "ngood"), "lam").alias("_f"))
    n = F.greatest(F.col("_f.ngood"), F.lit(1).cast("long"))
    return first.select(*OBJ, (F.col("_f.chi2") * (1 + nsigma * F.sqrt(2.0 / n))).alias("target"))


def pick_lambda_discrepancy(trials: DataFrame, nsigma: float = 0.3, max_peaks: int = 1, expansions_warn: int = 3, lam_hi: float | None = None) -> DataFrame:
    """Smallest lambda reaching the target, then the unimodality and sanity fallbacks.

    The curve is sampled on a lambda grid in one job instead of a search per object; a second finer
    grid between the two brackets (``bracket``) brings the resolution down. ``v_center`` is needed.
    """
    d = sane_trials(attach(trials, discrepancy_target(trials, nsigma), OBJ), max_peaks)
    single = F.col("n_peaks") <= max_peaks
    reach = F.col("chi2") >= F.col("target")
    lam = F.col("lam")
    first = d.groupBy(*OBJ).agg(
        F.coalesce(F.min(F.when(reach, lam)), F.max(lam)).alias("_hit"), F.min(F.when(single & reach, lam)).alias("_uni"),
        F.count_if(reach).alias("_nreach"), F.max("target").alias("target"),
    )
    d2 = attach(d.drop("target"), first, OBJ)
    at_hit = F.max(F.when(lam == F.col("_hit"), F.col("n_peaks")))
    beyond = F.min(F.when(single & (lam > F.col("_hit")), lam))
    second = d2.groupBy(*OBJ, "target", "_hit", "_uni", "_nreach").agg(at_hit.alias("_np"), beyond.alias("_beyond"))
    second = second.withColumn(
        "_best", F.when(F.col("_np") <= max_peaks, F.col("_hit")).otherwise(F.coalesce("_uni", "_beyond", "_hit"))
    )
    d3 = attach(d, second.drop("target"), OBJ)
    picked = d3.groupBy(*OBJ, "target", "_best", "_nreach").agg(
        F.bool_or(F.col("sane") & (lam == F.col("_best"))).alias("_ok"),
        F.max(F.when(F.col("sane") & single & (lam != F.col("_best")), lam)).alias("_fallback"),
    )
    out = picked.select(
        *OBJ, "target", F.when(F.col("_ok"), F.col("_best")).otherwise(F.coalesce("_fallback", "_best")).alias("lam"),
        (F.col("_nreach") > 0).alias("reached"), F.col("_ok").alias("sane"),
    )
    if lam_hi is not None:
        out = out.withColumn("suspicious", F.col("lam") >= lam_hi * 10.0**expansions_warn)
    return out


def bracket(trials: DataFrame, nsigma: float = 0.3) -> DataFrame:
    """Last lambda below and first lambda at or above the target, for a finer second grid."""
    d = attach(trials, discrepancy_target(trials, nsigma), OBJ)
    hi = d.groupBy(*OBJ).agg(F.min(F.when(F.col("chi2") >= F.col("target"), F.col("lam"))).alias("hi"))
    e = attach(d, hi, OBJ)
    return e.groupBy(*OBJ, "hi").agg(F.max(F.when(F.col("lam") < F.col("hi"), F.col("lam"))).alias("lo")).filter("hi IS NOT NULL AND lo IS NOT NULL")


def refined_grid(brackets: DataFrame, dex: float = 0.05) -> DataFrame:
    """Log-spaced lambdas strictly inside each bracket, at most ``dex`` apart."""
    span = F.log10(F.col("hi")) - F.log10(F.col("lo"))
    n = F.ceil(span / dex).cast("int")
    return brackets.withColumn("_n", n).filter("_n > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n") - 1))).select(
        *OBJ, F.pow(F.lit(10.0), F.log10(F.col("lo")) + span * F.col("_i") / F.col("_n")).alias("lam")
    )


def best_round(rounds: DataFrame, tol: float = 2.0) -> DataFrame:
    """Fixed-point rounds ``(object_id, round, gap, ...)``: the last round played (the first within
    ``tol`` ends the game), unless an earlier one had a smaller gap."""
    stop = rounds.groupBy(*OBJ).agg(F.coalesce(F.min(F.when(F.col("gap") <= tol, F.col("round"))), F.max("round")).alias("_stop"))
    rest = [c for c in rounds.columns if c not in OBJ]
    played = attach(rounds, stop, OBJ).filter(F.col("round") <= F.col("_stop"))
    d = played.groupBy(*OBJ).agg(
        F.max_by(F.struct(*rest), "round").alias("_last"),
        F.min(F.struct(F.col("gap").alias("_g"), F.col("round").alias("_i"), F.struct(*rest).alias("row"))).alias("_best"),
    )
    worse = F.col("_best._g") < F.col("_last.gap")
    return d.select(*OBJ, F.when(worse, F.col("_best.row")).otherwise(F.col("_last")).alias("_p"), worse.alias("reverted")).select(
        *OBJ, "_p.*", "reverted"
    )


def log_grid(lo: float = 1e2, hi: float = 1e7, per_decade: int = 1) -> list[float]:
    """Log-spaced lambda grid; the default is the decade grid."""
    a, b = math.log10(lo), math.log10(hi)
    n = max(round((b - a) * per_decade), 1)
    return [10 ** (a + (b - a) * i / n) for i in range(n + 1)]
