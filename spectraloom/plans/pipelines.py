"""End-to-end plans: prepare, quality, fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import valid_pixel
from spectraloom.functions.lines import emission_candidates
from spectraloom.operators import choose, describe, masks, products, recovery, resample, solve
from spectraloom.operators import pixels as P
from spectraloom.operators import stats as S
from spectraloom.operators.pixels import OBJ
from spectraloom.plans.scale import attach, checked_once, cut, flag_in_windows


def prepare(
    pix: DataFrame, lo: float, hi: float, z: float = 0.0, regions: DataFrame | None = None, min_pixels: int = 10,
    emission_threshold: float = 3.0, grow: float = 0.0, n_sigma: float = 3.0,
) -> DataFrame:
    """Raw pixels to fit-ready pixels of all series at once.

    Region filter first (it reaches the scan), then sanitising, excluded regions, line and segment
    masks, growth; series with fewer than ``min_pixels`` are left out. Positions are renumbered.
    """
    from spectraloom.plans.scale import number_rows

    spark = pix.sparkSession
    d = pix.withColumn("x", F.col("x") / (1 + z)) if z else pix
    d = P.require_pixels(P.sanitise(P.select_region(d, lo, hi)), min_pixels)
    d = number_rows(d.drop("pix"), OBJ, ["x"], "pix")
    d = cut(d)  # every detector below reads this table on its own
    names = []
    with checked_once(d, OBJ):
        out = d
        if regions is not None:
            out = masks.mask_regions(out, regions, z, "m_region")
            names.append("m_region")
        lines = masks.emission_line_windows(d, emission_candidates(spark), emission_threshold, lo=lo, hi=hi)
        out = flag_in_windows(out, lines, "m_line", keys=OBJ)
        segment = masks.rolling_flags(d, n_sigma).withColumn("m_segment", F.lit(True))
        out = out.join(segment, [*OBJ, "pix"], "left").withColumn("m_segment", F.coalesce("m_segment", F.lit(False)))
        names += ["m_line", "m_segment"]
        if grow > 0:
            out = masks.union_masks(out, ["m_line", "m_segment"], "_seed")
            out = masks.grow_mask_by(cut(out), "_seed", grow, "m_grown").drop("_seed")
            names.append("m_grown")
    out = masks.union_masks(out, names, "masked")
    return out.withColumn("good", F.col("good") & ~F.col("masked"))


def series_quality(pix: DataFrame, lo: float, hi: float, grow: int = 1) -> DataFrame:
    """One row per series: size, masked pixels, robust scatter and fit to its mean level."""
    pix = P.select_region(pix, lo, hi)
    with checked_once(pix, OBJ):
        d = masks.rolling_outliers(pix, name="outlier")
        d = masks.grow_mask(d, "outlier", grow, "masked")
        d = cut(d.withColumn("good", F.col("good") & ~F.col("masked")))
        good = d.filter("good")
        sigma = masks.robust_sigma(good, OBJ, "g")
    level = good.groupBy(*OBJ).agg(F.avg("g").alias("model"))
    stats = S.chi2(attach(d, level, OBJ), OBJ, "model")
    counts = d.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if("masked").alias("n_masked"))
    return counts.join(sigma, OBJ, "left").join(stats, OBJ, "left").withColumn("chi2_red", S.chi2_reduced("dof"))


def trials_of(fits: DataFrame, n: int, vmin: float, vmax: float, v_center: DataFrame | None = None, prominence: float = 0.1) -> DataFrame:
    """Selection table of packed fits: roughness, peak count, centroid and dispersion per strength."""
    keys = [*OBJ, "lam"]
    fits = fits.select(*keys, "b", "chi2", "ngood")
    bins = solve.bins_from_packed(fits, vmin, vmax, n, keys)
    t = fits.select(*keys, "chi2", "ngood").join(S.roughness(bins, keys).withColumnRenamed("roughness", "rough"), keys)
    t = t.join(S.count_peaks(bins, keys, prominence), keys).join(S.losvd_moments(bins, keys).withColumnRenamed("vel", "v"), keys)
    t = t.withColumn("v_center", F.lit(0.0)) if v_center is None else attach(t, v_center, OBJ)
    return cut(t)  # one short row per (object, strength), read many times by the selection


def auto_lambda(
    pix: DataFrame | None, lambdas: Sequence[float] | None = None, n: int = 29, vmin: float = -300.0, vmax: float = 300.0, step: float = 1.25,
    criterion: str = "discrepancy", sigma0: float = 100.0, tuning: DataFrame | None = None, v_center: DataFrame | None = None,
    packed: tuple | None = None, warm: DataFrame | None = None, cont: str | None = None, joint: bool = False, nsigma: float = 0.3,
) -> DataFrame:
    """Fit every object at the strength chosen for it: packed fit rows.

    'discrepancy' searches the strength of each object between the ends of ``lambdas`` and beyond (``reached``,
    ``expansions``, ``sane`` and ``trials`` tell how); 'chi2' and 'roughness' choose from the grid, fitted in one job.
    """
    packed = packed or recovery.pack_blocks(pix, n, vmin, vmax, step, joint, cont=cont)
    blocks, ends, model = packed
    if criterion not in ("discrepancy", "chi2", "roughness"):
        raise ValueError(f"unknown criterion {criterion!r}")
    if criterion == "discrepancy":
        if v_center is None:
            v_center = resample.xcorr_velocity(pix, step, vmin, vmax).withColumnRenamed("v", "v_center")
        tuning = v_center if tuning is None else tuning.join(v_center, OBJ, "left")
        ends_of = (min(lambdas), max(lambdas)) if lambdas else (1e2, 1e6)
        plan = recovery.Plan(lo=float(ends_of[0]), hi=float(ends_of[1]), nsigma=nsigma)
        return recovery.solve_rounds(blocks, recovery.start_state(ends, model, sigma0, tuning=tuning, warm=warm), model, plan)
    plan = recovery.Plan(grid=tuple(float(x) for x in lambdas or choose.log_grid(per_decade=2)))
    fits = cut(recovery.solve_rounds(blocks, recovery.start_state(ends, model, sigma0, tuning=tuning, warm=warm), model, plan))
    pick = choose.pick_lambda_chi2 if criterion == "chi2" else choose.pick_lambda_roughness
    return fits.join(pick(trials_of(fits, n, vmin, vmax)).select(*OBJ, "lam"), [*OBJ, "lam"])


def recover_self_consistent(
    pix: DataFrame, rounds: int = 3, tol: float = 2.0, sigma0: float = 100.0, n: int = 29, vmin: float = -300.0, vmax: float = 300.0,
    step: float = 1.25, lambdas: Sequence[float] | None = None, criterion: str = "discrepancy", recentre: bool = True, cont: str | None = None,
    joint: bool = False, packed: tuple | None = None, warm: DataFrame | None = None, v_center: DataFrame | None = None,
) -> DataFrame:
    """Fit, read the dispersion, feed it back into the wing taper; per object the best round is kept.

    Objects within ``tol`` leave the loop, a later round starts where the earlier one ended. The pivot of the taper is the
    correlation velocity.
    """
    packed = packed or recovery.pack_blocks(pix, n, vmin, vmax, step, joint, cont=cont)
    if v_center is None:
        v_center = cut(resample.xcorr_velocity(pix, step, vmin, vmax).withColumnRenamed("v", "v_center"))
    tuning = v_center.select(*OBJ, F.lit(float(sigma0)).alias("sigma0"), (F.col("v_center") if recentre else F.lit(0.0)).alias("centre"))
    played = None
    for i in range(rounds):
        fit = auto_lambda(None, lambdas, n, vmin, vmax, step, criterion, tuning=tuning, v_center=v_center, packed=packed, warm=warm)
        gh = describe.gh_fit_packed(fit, vmin, vmax, n).select(*OBJ, F.col("sigma").alias("sigma_rec"))
        row = fit.join(gh, OBJ).withColumn("round", F.lit(i))
        row = cut(row.withColumn("gap", F.coalesce(F.abs(F.col("sigma0") - F.col("sigma_rec")), F.lit(float("inf")))))
        played = row if played is None else played.unionByName(row)
        going = row.filter((F.col("gap") > tol) & (F.col("sigma_rec") > 0))
        if i + 1 == rounds or going.isEmpty():
            break
        tuning, warm = going.select(*OBJ, F.col("sigma_rec").alias("sigma0"), "centre"), going.select(*OBJ, "z")
    return choose.best_round(played, tol)


def mixture_start(pix: DataFrame) -> DataFrame:
    """(object_id, w): non-negative weights, adding up to one, of the template values ``t`` of the pixels themselves."""
    n = pix.agg(F.max(F.size("t"))).first()[0] or 1
    w = F.when(valid_pixel(), 1 / (F.col("gerr") * F.col("gerr"))).otherwise(0.0)
    rows = pix.withColumn("_w", w).withColumn("_d", F.col("t").cast("array<double>")).withColumn("_y", F.array(F.when(valid_pixel(), F.col("g")).otherwise(0.0)))
    return solve.mixture_weights(solve.packed_gram(rows, n), n)


def fit_spectra(
    pix: DataFrame, mode: str = "plain", n: int = 29, vmin: float = -300.0, vmax: float = 300.0, step: float = 1.25,
    lambdas: Sequence[float] | None = None, criterion: str = "discrepancy", rounds: int = 3, clip: float | None = None, protect: str | None = None,
    clip_rounds: int = 3, interior: int = 10,
) -> dict[str, DataFrame]:
    """Prepared pixels to result tables.

    ``t`` is a template mixture or an array with a value per template; then the weights are fitted as well, starting from
    the non-negative mixture of the data. 'plain' fits the spectrum as it is; 'joint' fits a smooth continuum together with
    histogram and weights under sum(b) = 1. With ``clip`` pixels that many robust deviations above the model are
    masked and the object is refitted at its strength until its mask stands still; the whole fit then runs on what is left.
    """
    if mode not in ("plain", "joint"):
        raise ValueError(f"unknown mode {mode!r}")
    many = dict(pix.dtypes)["t"].startswith("array")
    mixed, weights = pix, None
    if many:
        weights = cut(mixture_start(pix))
        mixed = attach(pix, weights, OBJ).withColumn("t", F.aggregate(F.zip_with("t", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).drop("w")
    v_center = cut(resample.xcorr_velocity(mixed, step, vmin, vmax).withColumnRenamed("v", "v_center"))

    def fitted(pixels, warm=None):
        packed = recovery.pack_blocks(pixels, n, vmin, vmax, step, mode == "joint", interior)
        model = packed[2]
        if warm is None and model.nw:  # the mixture is where the weights start
            first = recovery.start_state(packed[1], model).join(weights, OBJ)
            warm = first.select(*OBJ, F.concat(F.slice("z", 1, model.n + model.nc), "w").alias("z"))
        best = recover_self_consistent(pixels, rounds, n=n, vmin=vmin, vmax=vmax, step=step, lambdas=lambdas, criterion=criterion, packed=packed, warm=warm, v_center=v_center)
        return packed, cut(best)

    packed, best = fitted(pix)
    if clip is not None:
        def refit(live):
            again = recovery.pack_blocks(live, n, vmin, vmax, step, mode == "joint", interior)
            state = recovery.start_state(again[1], again[2], tuning=best.select(*OBJ, "lam", "sigma0", "centre"), warm=best)
            fits = recovery.solve_rounds(again[0], state, again[2], recovery.Plan(freeze=0))
            return live.join(recovery.model_pixels(again[0], again[1], fits, again[2]).drop("cont"), [*OBJ, "pix"])

        pix = cut(masks.sigma_clip(pix, "model", clip, clip_rounds, protect=protect, refit=refit).drop("clip_rounds"))
        packed, best = fitted(pix, best)
    bins = solve.bins_from_packed(best, vmin, vmax, n, OBJ)
    rows = pix.join(recovery.model_pixels(packed[0], packed[1], best, packed[2]), [*OBJ, "pix"])
    share = best.select(*OBJ, F.posexplode("weights").alias("tpl_id", "w")).withColumn("tpl_id", F.col("tpl_id").cast("long"))
    out = products.fit_products(rows, bins, share, n)
    out["moments"] = describe.gh_fit_packed(best, vmin, vmax, n)
    out["fits"] = best
    return out
