"""Series made from formulas, for tests of what the library recovers from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import FWHM_TO_SIGMA
from spectraloom.functions.lines import MOCK_EMISSION_RANGE
from spectraloom.operators import shapes
from spectraloom.operators.mocks import add_noise, inject_lines, truth_losvd
from spectraloom.operators.pixels import OBJ, generated_axis
from spectraloom.operators.resample import convolve_kernel, gauss_kernel, gauss_smooth
from spectraloom.plans.scale import attach, checked_once, cut, quantiles


def build_mocks(jobs: DataFrame, start: float, step: float, n_pix: int, lam_center: float, resolving_power: float | None = None, fine: int = 401) -> DataFrame:
    """Pixels of every job: ``(object_id, pix, x, g, gerr, good, t)``.

    ``jobs(object_id, v_true, sigma_true, snr, h3, h4, shape, mode, emission, role, seed)``. The
    template is the weak-line forest (the plain triplet generates 'mismatched' jobs), optionally
    smoothed by the instrument; the broadening kernel, continuum, lines and noise all come from the
    job's columns, so any number of jobs is one plan.
    """
    axis = generated_axis(jobs, n_pix, start, step)
    forest, triplet = shapes.forest_template("x"), shapes.triplet_template("x")
    base = axis.withColumn("t", forest).withColumn("_t", F.when(F.col("role") == "mismatched", triplet).otherwise(forest))
    if resolving_power:
        sig = lam_center / resolving_power * FWHM_TO_SIGMA / step
        base = gauss_smooth(base, sig, "_t", "_t2").withColumn("_t", F.col("_t2")).drop("_t2")
    kernel = gauss_kernel(truth_losvd(jobs.select(*OBJ, "v_true", "sigma_true", "h3", "h4", "shape"), fine, 8.0), OBJ, lam_center, step)
    # Padding with 1 (the continuum) instead of 0: convolve the deviation from the continuum.
    conv = convolve_kernel(base.withColumn("_dip", 1 - F.col("_t")), kernel, "_dip", same=False)
    d = base.join(conv, [*OBJ, "pix"]).withColumn("_broad", 1 - F.col("conv")).drop("conv", "_t")
    d = cut(d)  # the steps below each read the table for a per-job fact
    with checked_once(d, OBJ):
        return _dress(d)


def _dress(d: DataFrame) -> DataFrame:
    """Continuum, lines and noise of the jobs' columns on top of the broadened template."""
    d = shapes.normalised_axis(d, OBJ)
    level = quantiles(d, OBJ, F.abs("_broad"), {"_med": 0.5})
    d = attach(d, level, OBJ)
    cont = (
        F.when(F.col("mode") == "joint", shapes.galaxy_continuum("x", "xn", "x_first"))
        .when(F.col("mode") == "poly_amp", shapes.linear_tilt("xn") * F.col("_med") * 1000.0).otherwise(1.0)
    )
    d = d.withColumn("cont", cont).withColumn("g", F.col("_broad") * F.col("cont")).drop("_med", "xn", "x_first")
    lo, hi = F.lit(0.0), F.lit(0.0)
    for name, (a, b) in MOCK_EMISSION_RANGE.items():
        lo, hi = F.when(F.col("emission") == name, a).otherwise(lo), F.when(F.col("emission") == name, b).otherwise(hi)
    d = inject_lines(d, lo, hi, "cont", "seed")
    d = add_noise(d, F.col("snr"), F.col("seed"))
    return d.select(*OBJ, "pix", "x", "g", "gerr", F.lit(True).alias("good"), "t", "cont")
