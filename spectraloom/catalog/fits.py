"""Solvers, error estimates and library reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import HIST, PIXELS, REPS, big, hist, lcg_sql, pixels, query, r6, reps, table
from spectraloom.catalog.histograms import BOUNDS, MOM, _point
from spectraloom.operators import errors as E
from spectraloom.operators import products, recovery, shapes, solve
from spectraloom.operators import stats as S
from spectraloom.operators.describe import gh_fit, gh_fit_higher, gh_fit_packed
from spectraloom.operators.mocks import truth_losvd
from spectraloom.operators.resample import convolve_losvd, fine_losvd
from spectraloom.plans import pipelines
from spectraloom.plans.scale import attach, cut, shared_folder

OBJ = ["object_id"]
STEP, VLO, VHI, NB = 1.5, -300.0, 300.0, 29
LAMBDAS = [1e2, 1e3, 1e4, 1e5, 1e6]


def planted_truth(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("object_id"), (300 * F.col("embedding")[0].cast("double")).alias("v_true"),
        (70 + 200 * F.abs(F.col("embedding")[1].cast("double"))).alias("sigma_true"),
        F.lit(0.0).alias("h3"), F.lit(0.0).alias("h4"), F.lit("gaussian").alias("shape"),
    )


def planted(spark, sf):
    """Spectra with a known velocity distribution; the embedding values are their noise."""
    h = hist(spark, sf)
    px = h.select("object_id", F.col("bin").cast("long").alias("pix"), (8470 + STEP * F.col("bin")).alias("x"), "raw").withColumn("t", shapes.forest_template("x"))
    truth = truth_losvd(planted_truth(spark, sf), NB, vmin=VLO, vmax=VHI)
    model = convolve_losvd(px, fine_losvd(truth, OBJ, 22), STEP).select(*OBJ, "pix", "model")
    return cut(px.join(model, [*OBJ, "pix"]).select(
        *OBJ, "pix", "x", (F.col("model") + 0.04 * F.col("raw")).alias("g"), F.lit(0.005).alias("gerr"), F.lit(True).alias("good"), "t"
    ))


@query("asymmetric_baseline")
def asymmetric_baseline(spark, sf):
    return solve.asymmetric_baseline(pixels(spark, sf), rounds=5, interior=10).select("object_id", "pix", "g", "baseline")


@query("fit_pspline")
def fit_pspline(spark, sf):
    return solve.fit_pspline(pixels(spark, sf)).select("object_id", "pix", "g", "cont")


@query("fit_mixture")
def fit_mixture(spark, sf):
    h = hist(spark, sf)
    lib = h.groupBy(F.col("label").cast("long").alias("tpl_id"), F.col("bin").cast("long").alias("pix")).agg((1 + F.avg("raw")).alias("t"))
    ids = sorted(r[0] for r in lib.select("tpl_id").distinct().collect())
    px = h.select("object_id", F.col("bin").cast("long").alias("pix"), (1 + F.col("raw")).alias("g"), F.lit(0.1).alias("gerr"), F.lit(True).alias("good"))
    return solve.fit_mixture(px, lib, ids)


@query("recover_losvd")
def recover_losvd(spark, sf):
    out = recovery.recover_losvd(planted(spark, sf), LAMBDAS, NB, VLO, VHI, STEP)
    return solve.bins_from_packed(out, VLO, VHI, NB, [*OBJ, "lam", "chi2", "ngood"])


OPTIMAL = "SELECT vec_id AS object_id, 1e0 AS sum_b, true AS stationary, true AS converged FROM embeddings"


def sloping(px):
    """The same spectra under a sloping continuum."""
    level = 2 + 0.01 * F.col("pix")
    return px.withColumn("g", F.col("g") * level).withColumn("gerr", F.col("gerr") * level)


@query("recover_joint", OPTIMAL)
def recover_joint(spark, sf):
    """Histogram and continuum together; the twin states that every row adds up to one and is a stationary point."""
    blocks, ends, model = recovery.pack_blocks(sloping(planted(spark, sf)), NB, VLO, VHI, STEP, joint=True, interior=6)
    fits = cut(recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(lo=1e2, hi=1e6)))
    ok = recovery.optimality(blocks, ends, fits, model)
    return fits.join(ok, [*OBJ, "lam"]).select("object_id", F.round("sum_b", 9).alias("sum_b"), (F.col("stationarity") < 1e-6).alias("stationary"), "converged")


@query("recover_optimality", OPTIMAL.replace("1e0 AS sum_b, ", "lam, ").replace("FROM embeddings", "FROM embeddings CROSS JOIN (VALUES (1e2), (1e4), (1e6)) l(lam)"))
def recover_optimality(spark, sf):
    """Every strength of a grid; fits away from the middle strength stand on its linear model, so each is a fit of its own here."""
    blocks, ends, model = recovery.pack_blocks(planted(spark, sf), NB, VLO, VHI, STEP)
    fits = cut(recovery.solve_each(blocks, ends, model, (1e2, 1e4, 1e6)))
    rows = fits.select(*OBJ, "lam", "converged").join(recovery.optimality(blocks, ends, fits, model), [*OBJ, "lam"])
    return rows.select("object_id", "lam", (F.col("stationarity") < 1e-6).alias("stationary"), "converged")


@query("auto_lambda")
def auto_lambda(spark, sf):
    best = pipelines.auto_lambda(planted(spark, sf), LAMBDAS, NB, VLO, VHI, STEP)
    return best.select("object_id", "lam", "chi2", "ngood", "reached", "expansions", "sane", "trials", "converged")


@query("recover_self_consistent")
def recover_self_consistent(spark, sf):
    best = pipelines.recover_self_consistent(planted(spark, sf), lambdas=LAMBDAS, n=NB, vmin=VLO, vmax=VHI, step=STEP)
    return best.select("object_id", "round", "lam", "sigma0", "sigma_rec", "gap", "reverted")


@query("gh_fit")
def gauss_hermite(spark, sf):
    return gh_fit(hist(spark, sf), OBJ)


@query("gh_fit_higher")
def gauss_hermite_higher(spark, sf):
    return gh_fit_higher(hist(spark, sf), OBJ)


@query("influence")
def influence(spark, sf):
    blocks, ends, model = recovery.pack_blocks(planted(spark, sf), NB, VLO, VHI, STEP)
    fits = cut(recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(grid=(1e4,))))
    gram = recovery.normal_equations(blocks, ends, fits, model)
    return solve.influence(gram, fits, NB, VLO, VHI, STEP, lsf_kms=40.0).select("object_id", "lam", "eff_dof", "b_corrected", "bias", "unreliable")


def _eigen(spark, sf):
    t = hist(spark, sf).select(F.col("object_id").alias("tpl_id"), F.col("bin").cast("long").alias("pix"), (1 + F.col("raw")).alias("t"))
    return solve.eigen_templates(t, 4)


@query("eigen_templates")
def eigen_templates(spark, sf):
    return _eigen(spark, sf)


@query("write_eigen_library")
def write_eigen(spark, sf):
    path = shared_folder(spark, "eigen")
    products.write_eigen_library(_eigen(spark, sf), path)
    return spark.read.parquet(f"{path}/templates").join(spark.read.parquet(f"{path}/manifest"), "component")


DRAWS = f"""{PIXELS}, md AS (SELECT p.*, m AS model FROM pixels p JOIN (SELECT object_id, avg(g) FILTER (WHERE good) AS m FROM pixels GROUP BY 1) USING (object_id)),
gd AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY pix) - 1 AS k, count(*) OVER (PARTITION BY object_id) AS n FROM md WHERE good),
sl AS (SELECT *, unnest(range(0, 20)) AS rep FROM gd),
pick AS (SELECT *, CAST(floor({lcg_sql('object_id', 'rep', 'k // 5')} * greatest(n - 5 + 1, 1)) AS BIGINT) + k % 5 AS src FROM sl),
dr AS (SELECT a.object_id, a.rep, a.pix, a.model + a.gerr * (b.g - b.model) / b.gerr AS g FROM pick a JOIN gd b ON b.object_id = a.object_id AND b.k = a.src
  UNION ALL SELECT object_id, unnest(range(0, 20)), pix, g FROM md WHERE NOT good)"""


@query("bootstrap_draws", f"""
WITH {DRAWS} SELECT object_id, pix, count(*) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS spread FROM dr GROUP BY 1, 2""")
def bootstrap_draws(spark, sf):
    px = pixels(spark, sf)
    m = px.filter("good").groupBy(*OBJ).agg(F.avg("g").alias("model"))
    draws = E.bootstrap_draws(attach(px, m, OBJ), 20, block=5)
    return draws.groupBy("object_id", "pix").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("g"), "mean"), r6(F.stddev_samp("g"), "spread"))


@query("residual_bootstrap")
def residual_bootstrap(spark, sf):
    px = planted(spark, sf)
    packed = blocks, ends, model = recovery.pack_blocks(px, NB, VLO, VHI, STEP)
    fits = cut(recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(grid=(1e4,))))
    fitted = cut(px.join(recovery.model_pixels(blocks, ends, fits, model).drop("cont"), [*OBJ, "pix"]))
    rep = cut(E.bootstrap_fits(packed, fitted, fits, 10))
    point, bins = solve.bins_from_packed(fits, VLO, VHI, NB, OBJ), solve.bins_from_packed(rep, VLO, VHI, NB, E.REP)
    described, best = gh_fit_packed(rep, VLO, VHI, NB, E.REP), gh_fit_packed(fits, VLO, VHI, NB)
    return E.ensemble_errors(point, bins, described=described, best=best)["moments"].select("object_id", "parameter", "value", "err", "lo", "hi")


JAC = """s AS (SELECT object_id, sum(b) AS s0, sum(b * v) AS s1, sum(b * v * v) AS s2 FROM pt GROUP BY 1),
mv AS (SELECT pt.object_id, bin, sg, (s1 + d * v) / (s0 + d) AS vel, (s2 + d * v * v) / (s0 + d) AS m2 FROM (
   SELECT *, greatest(b + sg * 1e-6, 0) - b AS d FROM (SELECT *, unnest([1, -1]) AS sg FROM pt)) pt JOIN s USING (object_id)),
jac AS (SELECT object_id, bin, sum(sg * vel) / 2e-6 AS dv, sum(sg * sqrt(m2 - vel * vel)) / 2e-6 AS ds FROM mv GROUP BY 1, 2),
cv AS (SELECT a.object_id, a.bin AS i, b.bin AS j, covar_samp(a.b, b.b) AS c FROM reps a JOIN reps b ON a.object_id = b.object_id AND a.rep = b.rep GROUP BY 1, 2, 3)"""


@query("propagate_errors", f"""
WITH {BOUNDS}, {JAC} SELECT cv.object_id, round(sqrt(sum(p.dv * c * q.dv)), 3) AS vel_err, round(sqrt(sum(p.ds * c * q.ds)), 3) AS sigma_err
FROM cv JOIN jac p ON p.object_id = cv.object_id AND p.bin = i JOIN jac q ON q.object_id = cv.object_id AND q.bin = j GROUP BY 1""")
def propagate_errors(spark, sf):
    out = E.propagate_errors(_point(spark, sf), reps(spark, sf))
    return out.select("object_id", F.round("vel_err", 3).alias("vel_err"), F.round("sigma_err", 3).alias("sigma_err"))


@query("propagate_gh_errors")
def propagate_gh_errors(spark, sf):
    return E.propagate_gh_errors(_point(spark, sf), reps(spark, sf))


@query("summarise_errors", f"""
WITH {BOUNDS}, sp AS (SELECT object_id, bin, stddev_samp(b) AS e FROM reps GROUP BY 1, 2),
o AS (SELECT bd.object_id, bd.bin, b, hi - lo < 0.15e0 AS boot, bd.bin < 60 AS cov, lo, hi, e, avg(b) OVER (PARTITION BY bd.object_id) - b AS bias FROM bd JOIN sp ON sp.object_id = bd.object_id AND sp.bin = bd.bin)
SELECT object_id, bin, round(b, 6) AS b, round(bias, 6) AS bias, CASE WHEN boot THEN 'bootstrap' WHEN cov THEN 'covariance' ELSE 'none' END AS method,
  round(CASE WHEN boot THEN e WHEN cov THEN 2 * e END, 6) AS err, round(CASE WHEN boot THEN lo WHEN cov THEN b - 2 * e END, 6) AS lo, round(CASE WHEN boot THEN hi WHEN cov THEN b + 2 * e END, 6) AS hi FROM o""")
def summarise_errors(spark, sf):
    by = ["object_id", "bin"]
    point, r = _point(spark, sf), reps(spark, sf)
    sp = S.replicate_spread(r, by)
    boot = S.anchored_bounds(point, r, by).join(sp, by).filter("hi - lo < 0.15").select(*by, F.col("spread").alias("err"), "lo", "hi")
    cov = sp.select(*by, F.when(F.col("bin") < 60, 2 * F.col("spread")).alias("err"))
    level = point.groupBy("object_id").agg(F.avg("b").alias("_a"))
    bias = attach(point, level, OBJ).select(*by, (F.col("_a") - F.col("b")).alias("bias"))
    out = E.summarise_errors(point, boot, cov, bias)
    return out.select(*by, r6("b"), r6("bias"), "method", r6("err"), r6("lo"), r6("hi"))
