"""Error estimates: residual bootstrap, propagated moment errors, combined summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import lcg_uniform, valid_pixel
from spectraloom.operators import stats as S
from spectraloom.operators.describe import gh_fit
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.recovery import Model, refit_replicates
from spectraloom.operators.solve import bins_from_packed
from spectraloom.plans.scale import attach, cut, number_rows, setting

REP = ["object_id", "rep"]
#: Valid pixels of a series whose draws are made inside one row.
PACKED = ("spectraloom.packedDraws", 4_096)


def _flagged(pix: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Pixels with their model and whether they are valid, and the valid ones."""
    flagged = pix.select(*OBJ, "pix", "g", "gerr", F.col(model).alias("_m"), valid_pixel(model=model).alias("_ok"))
    return flagged, flagged.filter("_ok")


def bootstrap_draws(pix: DataFrame, n: int, block: int = 1, model: str = "model") -> DataFrame:
    """``n`` replicates per object: ``(object_id, rep, pix, g)``.

    Standardised residuals of the valid pixels are redrawn singly or in contiguous blocks of the
    *list of valid pixels* (a block may straddle a masked gap); masked pixels keep their data. The
    draw is a counter hash of (object, replicate, block), so it does not depend on partitioning. A short series is packed
    into one row that draws from itself; residuals of a long one are fetched by an equi-join on (object, position).
    """
    flagged, valid = _flagged(pix, model)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    kept = flagged.filter("NOT _ok").withColumn("rep", each).select(*REP, "pix", "g")
    limit = setting(pix.sparkSession, PACKED)
    total = valid.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("_n"))
    long = cut(total.filter(F.col("_n") > limit))
    if long.isEmpty():
        return _packed_draws(valid, n, block).unionByName(kept)
    short = _packed_draws(valid.join(long, OBJ, "left_anti"), n, block)
    return short.unionByName(_joined_draws(valid.join(long, OBJ, "left_semi"), long, n, block)).unionByName(kept)


def _source(k, total, block: int):
    """Position of the residual that the ``k``-th valid pixel of an object's replicate takes."""
    u = lcg_uniform("object_id", "rep", k if block <= 1 else F.floor(k / block))
    if block <= 1:
        return F.floor(u * total).cast("long")
    return (F.floor(u * F.greatest(total - block + 1, F.lit(1))) + k % block).cast("long")


def _packed_draws(good: DataFrame, n: int, block: int) -> DataFrame:
    """Draws of series that fit one row each: every pixel is shuffled once, whatever the number of replicates."""
    slots = _drawn_slots(good, n)
    slots = slots.select(*REP, "_p", F.posexplode("_p").alias("_k", "_e"))
    at = _source(F.col("_k").cast("long"), F.size("_p"), block).cast("int")
    return slots.select(*REP, F.col("_e.pix").alias("pix"), (F.col("_e.m") + F.col("_e.e") * F.get(F.col("_p.r"), at)).alias("g"))


def _whole_draws(pix: DataFrame, n: int, block: int) -> DataFrame:
    """The same with the positions and values of a replicate as arrays."""
    at = lambda k: _source(k.cast("long"), F.size("_p"), block).cast("int")
    drawn = F.transform("_p", lambda e, k: e["m"] + e["e"] * F.get(F.col("_p.r"), at(k)))
    return _drawn_slots(pix, n).select(*REP, F.col("_p.pix").cast("array<long>").alias("pix"), drawn.alias("g"))


def _drawn_slots(pix: DataFrame, n: int) -> DataFrame:
    """A row per (object, replicate) with the valid pixels, none where an object has none."""
    row = F.struct(F.col("pix").alias("pix"), F.col("_m").alias("m"), F.col("gerr").alias("e"), ((F.col("g") - F.col("_m")) / F.col("gerr")).alias("r"))
    packed = pix.groupBy(*OBJ).agg(F.sort_array(F.collect_list(F.when(F.col("_ok"), row))).alias("_p"))
    return packed.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def _joined_draws(valid: DataFrame, total: DataFrame, n: int, block: int) -> DataFrame:
    """The same for series of any length."""
    good = number_rows(valid, OBJ, ["pix"], "_k")
    res = good.select(*OBJ, F.col("_k").alias("_at"), ((F.col("g") - F.col("_m")) / F.col("gerr")).alias("_r"))
    slots = attach(good, total, OBJ).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return slots.withColumn("_at", _source(F.col("_k"), F.col("_n"), block)).join(res, [*OBJ, "_at"]).select(
        *REP, "pix", (F.col("_m") + F.col("gerr") * F.col("_r")).alias("g")
    )


def bootstrap_fits(packed: tuple[DataFrame, DataFrame, Model], pix: DataFrame, fits: DataFrame, n: int, block: int = 1) -> DataFrame:
    """Refit ``n`` residual replicates of every object, plain or joint: ``(object_id, rep, b)``, the converged ones.

    ``packed`` is what ``pack_blocks`` made of the fitted pixels; ``pix`` has the model, ``fits`` one fit per object. Where
    every series draws inside one row, a replicate stays one row from draw to fit.
    """
    blocks, ends, model = packed
    short = model.single and (ends.agg(F.max("last")).first()[0] or 0) < setting(pix.sparkSession, PACKED)
    draws = _whole_draws(_flagged(pix, "model")[0], n, block) if short else bootstrap_draws(pix, n, block)
    return refit_replicates(blocks, ends, fits, draws, model).filter("converged").select(*REP, "b")


def bootstrap_losvd(packed: tuple[DataFrame, DataFrame, Model], pix: DataFrame, fits: DataFrame, n: int, block: int = 1) -> DataFrame:
    """``bootstrap_fits`` with a row for each bin: ``(object_id, rep, bin, v, b)``."""
    model = packed[2]
    return bins_from_packed(bootstrap_fits(packed, pix, fits, n, block), model.vmin, model.vmax, model.n, REP)


def ensemble_errors(point: DataFrame, reps: DataFrame, confidence: float = 0.68, described: DataFrame | None = None, best: DataFrame | None = None) -> dict[str, DataFrame]:
    """Histogram and moment errors of a bootstrap ensemble, plus its diagnostics.

    Replicates without a finite description count as failed. ``point(object_id, bin, v, b)``. ``described`` and ``best`` are the
    descriptions of the replicates and of the point, where they are known already.
    """
    by = ["object_id", "bin"]
    spread = S.replicate_spread(reps, by).select(*by, F.col("spread").alias("err"))
    losvd = S.anchored_bounds(point, reps, by, confidence).join(spread, by, "left")
    described = cut(gh_fit(reps, REP) if described is None else described)
    best = gh_fit(point, OBJ) if best is None else best
    names = ["vel", "sigma", "h3", "h4"]

    def long(df, keys):
        rows = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value")) for n in names])
        return df.select(*keys, F.explode(rows).alias("_e")).select(*keys, "_e.*")

    m_by = ["object_id", "parameter"]
    m_reps = long(described, REP)
    moments = S.anchored_bounds(long(best, OBJ), m_reps, m_by, confidence, "value", floor=None).join(
        S.replicate_spread(m_reps, m_by, "value").select(*m_by, F.col("spread").alias("err")), m_by, "left"
    )
    from spectraloom.operators.products import bootstrap_diagnostics

    status = bootstrap_diagnostics(described)
    status = status.withColumn("few", F.col("n_converged") < 10)
    return {"losvd": losvd, "moments": moments, "diagnostics": status}


def moment_jacobian(point: DataFrame, keys: Sequence[str] = OBJ, step: float = 1e-6) -> DataFrame:
    """Central differences of centroid and dispersion for a change of each bin.

    The moments depend on three sums only, so a perturbed copy is a change of those sums and nothing
    is duplicated per bin.
    """
    b = F.greatest("b", F.lit(0.0))
    sums = point.groupBy(*keys).agg(
        F.sum(b).alias("_s0"), F.sum(b * F.col("v")).alias("_s1"), F.sum(b * F.col("v") * F.col("v")).alias("_s2")
    )
    d = attach(point, sums, keys)

    def moved(sign):
        delta = F.greatest(F.col("b") + sign * step, F.lit(0.0)) - b
        s0 = F.nullif(F.col("_s0") + delta, F.lit(0.0))
        vel = (F.col("_s1") + delta * F.col("v")) / s0
        var = (F.col("_s2") + delta * F.col("v") * F.col("v")) / s0 - vel * vel
        return vel, F.sqrt(F.greatest(var, F.lit(0.0)))

    (v_up, s_up), (v_dn, s_dn) = moved(1), moved(-1)
    return d.select(*keys, "bin", ((v_up - v_dn) / (2 * step)).alias("dv"), ((s_up - s_dn) / (2 * step)).alias("ds"))


def propagate_errors(point: DataFrame, reps: DataFrame) -> DataFrame:
    """sqrt(J C J') of centroid and dispersion, C being the covariance of the replicates.

    J C J' is the sample variance of the replicates projected on J, so no bin pairs are formed.
    """
    jac = moment_jacobian(point)
    proj = reps.join(jac, ["object_id", "bin"]).groupBy(*REP).agg(
        F.sum(F.col("dv") * F.col("b")).alias("pv"), F.sum(F.col("ds") * F.col("b")).alias("ps")
    )
    return proj.groupBy(*OBJ).agg(F.stddev_samp("pv").alias("vel_err"), F.stddev_samp("ps").alias("sigma_err"))


def propagate_gh_errors(point: DataFrame, reps: DataFrame, share: float = 1e-3) -> DataFrame:
    """The same for the four-moment description; every bin is moved by a share of the peak."""
    top = point.groupBy(*OBJ).agg((share * F.max("b")).alias("_h"), (F.max("bin") + 1).alias("_n"))
    tagged = attach(point, top, OBJ).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(
        "up", F.explode(F.array(F.lit(1), F.lit(-1)))
    )
    moved = tagged.withColumn("b", F.col("b") + F.when(F.col("bin") == F.col("k"), F.col("up") * F.col("_h")).otherwise(0.0))
    names = ["vel", "sigma", "h3", "h4"]
    fits = attach(gh_fit(moved, ["object_id", "k", "up"]), top, OBJ)
    jac = fits.groupBy("object_id", F.col("k").alias("bin")).agg(
        *[(F.sum(F.col("up") * F.col(n)) / (2 * F.max("_h"))).alias(f"d_{n}") for n in names]
    )
    proj = reps.join(jac, ["object_id", "bin"]).groupBy(*REP).agg(*[F.sum(F.col(f"d_{n}") * F.col("b")).alias(n) for n in names])
    return proj.groupBy(*OBJ).agg(*[F.stddev_samp(n).alias(f"{n}_err") for n in names])


def summarise_errors(
    point: DataFrame, bootstrap: DataFrame | None = None, covariance: DataFrame | None = None, bias: DataFrame | None = None,
    keys: Sequence[str] = ("object_id", "bin"),
) -> DataFrame:
    """One recommended error per row: bootstrap first, then the covariance-based one; the value is always
    the point estimate. ``bootstrap(keys, err, lo, hi)``, ``covariance(keys, err)``, ``bias(keys, bias)``."""
    keys = list(keys)
    out = point
    empty = F.lit(None).cast("double")
    if bootstrap is not None:
        out = out.join(bootstrap.select(*keys, F.col("err").alias("_be"), F.col("lo").alias("_bl"), F.col("hi").alias("_bh")), keys, "left")
    else:
        out = out.withColumns({"_be": empty, "_bl": empty, "_bh": empty})
    out = out.join(covariance.select(*keys, F.col("err").alias("_ce")), keys, "left") if covariance is not None else out.withColumn("_ce", empty)
    out = out.join(bias.select(*keys, "bias"), keys, "left") if bias is not None else out.withColumn("bias", empty)
    method = F.when(F.col("_be").isNotNull(), "bootstrap").when(F.col("_ce").isNotNull(), "covariance").otherwise("none")
    return out.select(
        *point.columns, "bias", method.alias("method"), F.coalesce("_be", "_ce").alias("err"),
        F.coalesce("_bl", F.col("b") - F.col("_ce")).alias("lo"), F.coalesce("_bh", F.col("b") + F.col("_ce")).alias("hi"),
    )
