"""The recovery of histograms: solves, strength search, joint fit, split plans, replicates, clipping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import describe, recovery as R, strength
from spectraloom.operators import stats as S
from spectraloom.operators.pixels import OBJ
from spectraloom.operators.solve import bins_from_packed
from spectraloom.plans import pipelines

N, LO, HI, STEP, PIX = 25, -400.0, 400.0, 1.25, 240
SCHEMA = "object_id long, pix long, x double, g double, gerr double, good boolean, t array<double>"


def template(x, k=0):
    lines = [(8498.0, 0.35), (8542.1, 0.6), (8662.1, 0.5)] if k == 0 else [(8468.4, 0.4), (8515.1, 0.5), (8598.4, 0.4), (8688.6, 0.5)]
    return 1 - sum(d * np.exp(-0.5 * ((x - c) / 1.8) ** 2) for c, d in lines)


def spectra(truth, noise=0.004, cont=None, mix=(1.0,), seed=1):
    """Rows of objects with a Gaussian histogram each, by the model itself, and the histograms."""
    rng, x = np.random.default_rng(seed), 8450 + STEP * np.arange(PIX)
    model = R.Model(N, LO, HI, STEP, True, 6, n_fine=3 * N, templates=len(mix))
    reach = 2 * round((HI - LO) / STEP * x[-1] / 299792.458)
    model = R.Model(N, LO, HI, STEP, True, 6, n_fine=max(3, reach), templates=len(mix))
    v = np.linspace(LO, HI, N)
    t = np.stack([template(x, k) for k in range(len(mix))], axis=1)
    px = {"pix": np.arange(PIX), "x": x, "g": np.zeros(PIX), "w": np.ones(PIX), "c": np.ones(PIX), "t": t}
    rows, hists = [], []
    for i, (vel, sig) in enumerate(truth):
        b = np.exp(-0.5 * ((v - vel) / sig) ** 2) + 1e-6
        b /= b.sum()
        block = R.Block(R.Model(N, LO, HI, STEP, False, 6, n_fine=model.n_fine, templates=len(mix)), 0, px, x[0], x[-1], PIX - 1)
        flux = block.at(np.concatenate([b, mix]) if len(mix) > 1 else b, slopes=False)[0]
        level = np.ones(PIX) if cont is None else cont(x, i)
        g = flux * level + noise * level * rng.normal(size=PIX)
        rows += [(i, k, float(x[k]), float(g[k]), float(noise * level[k]), True, [float(e) for e in t[k]]) for k in range(PIX)]
        hists.append(b)
    return rows, hists


TRUTH = [(60.0, 110.0), (-90.0, 140.0), (0.0, 90.0)]


def curve(x, i):
    u = (x - x.mean()) / np.ptp(x) * 2
    return (3 + i) * (1 + 0.15 * u + 0.1 * u**2 - 0.05 * u**3)


def described(fits):
    return {r.object_id: r for r in describe.gh_fit_packed(fits, LO, HI, N).collect()}


# --- solves -----------------------------------------------------------------------------------------


def test_constrained_batch_meets_all_conditions():
    rng = np.random.default_rng(0)
    count, n = 150, 20
    a = rng.normal(size=(count, 30, n))
    m, q = np.einsum("bki,bkj->bij", a, a), 3 * np.einsum("bki,bk->bi", a, rng.normal(size=(count, 30)))
    low = np.r_[np.full(12, 1e-6), np.full(4, -np.inf), np.zeros(4)]
    sums = [slice(0, 12), slice(16, 20)]
    z, ok = R.constrained_batch(m, q, low, sums)
    assert ok.all()
    slope = np.einsum("bij,bj->bi", m, z) - q
    assert np.abs(slope[:, 12:16]).max() < 1e-7
    for s in sums:
        assert np.abs(z[:, s].sum(1) - 1).max() < 1e-12 and (z[:, s] >= low[s] - 1e-12).all()
        free = z[:, s] > low[s] + 1e-9
        price = np.where(free, slope[:, s], 0).sum(1) / free.sum(1)
        rest = slope[:, s] - price[:, None]
        assert np.abs(np.where(free, rest, 0)).max() < 1e-7 and rest.min() > -1e-7


def test_peaks_equal_the_column_expression(spark):
    rng = np.random.default_rng(4)
    rows = [np.round(rng.random(15), 1) for _ in range(80)] + [np.zeros(15), np.ones(15), np.r_[0, 1, 0, 0.95, 1.0, np.zeros(10)]]
    df = spark.createDataFrame([(i, k, float(x)) for i, r in enumerate(rows) for k, x in enumerate(r)], "object_id long, bin int, b double")
    want = {r.object_id: r.n_peaks for r in S.count_peaks(df, OBJ).collect()}
    assert [want[i] for i in range(len(rows))] == strength.count_peaks(np.array(rows)).tolist()


# --- strength search ----------------------------------------------------------------------------------


def monotone(chi2=100.0, slope=5.0, at=1.0, peaks=lambda lam: 1, v=lambda lam: 0.0):
    calls = []

    def evaluate(rows, lam):
        calls.extend(zip(rows.tolist(), lam.tolist()))
        return {"chi2": chi2 + slope * np.maximum(0, np.log10(lam / at)), "peaks": np.vectorize(peaks)(lam), "v": np.vectorize(v, otypes=[float])(lam), "sigma": np.full(len(lam), 100.0)}

    return evaluate, calls


def run(evaluate, lo, hi, ngood=100, count=3, **more):
    return strength.search(evaluate, count, np.full(count, ngood), lo, hi, np.zeros(count), nsigma=1.0, **more)


def test_search_lands_on_the_analytic_strength():
    evaluate, calls = monotone()
    out = run(evaluate, 1e-3, 1e2)
    want = 10 ** (np.sqrt(2 * 100) / 5)
    assert np.allclose(out["lam"], want, rtol=0.2) and out["reached"].all()
    assert (100 + 5 * np.log10(out["lam"]) >= out["target"] - 1e-6).all()
    assert len(calls) == len(set(calls)) == out["trials"].sum()


def test_search_grows_its_bracket():
    out = run(monotone(1000.0, 10.0)[0], 1.0, 10.0, ngood=1000)
    assert (out["lam"] > 10).all() and out["reached"].all() and (out["expansions"] == 4).all() and out["suspicious"].all()


def test_search_ends_on_a_flat_curve():
    out = run(monotone(slope=0.0)[0], 1.0, 10.0, expansions=3)
    assert (out["trials"] == 5).all() and (out["lam"] == 1e4).all() and not out["reached"].any()


def test_search_leaves_many_peaks():
    out = run(monotone(peaks=lambda lam: 2 if lam < 3e3 else 1)[0], 1e-3, 1e2)
    assert (out["lam"] >= 3e3).all()
    never = run(monotone(peaks=lambda lam: 2)[0], 1e-3, 1e2)
    assert never["reached"].all() and np.allclose(never["lam"], 10 ** (np.sqrt(200) / 5), rtol=0.2)


def test_search_leaves_a_centroid_far_off():
    far = monotone(v=lambda lam: 900.0 if 690 < lam < 700 else 0.0)[0]
    out = run(far, 1e-3, 1e2)
    assert not ((out["lam"] > 690) & (out["lam"] < 700)).any() and out["sane"].all()


def test_search_treats_objects_apart():
    def evaluate(rows, lam):
        return {"chi2": np.where(rows == 0, 100 + 5 * np.maximum(0, np.log10(lam)), 100.0), "peaks": np.ones(len(lam)), "v": np.zeros(len(lam)), "sigma": np.full(len(lam), 50.0)}

    out = strength.search(evaluate, 2, np.full(2, 100), 1e-3, 1e2, np.zeros(2), nsigma=1.0, expansions=2)
    assert out["reached"].tolist() == [True, False] and out["expansions"].tolist() == [1, 2]


# --- fits -----------------------------------------------------------------------------------------------


def test_joint_fit_recovers_histogram_and_continuum(spark):
    rows, hists = spectra(TRUTH, cont=curve)
    pix = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks, ends, model = R.pack_blocks(pix, N, LO, HI, STEP, joint=True, interior=6)
    fits = R.cut(R.solve_rounds(blocks, R.start_state(ends, model), model, R.Plan(lo=1e2, hi=1e6)))
    got = {r.object_id: r for r in fits.collect()}
    moments = described(fits)
    for i, (v, s) in enumerate(TRUTH):
        assert got[i].converged and abs(sum(got[i].b) - 1) < 1e-9 and got[i].reached
        assert moments[i].vel == pytest.approx(v, abs=10) and moments[i].sigma == pytest.approx(s, abs=12)
    x = 8450 + STEP * np.arange(PIX)
    rows = R.model_pixels(blocks, ends, fits, model).collect()
    off = [abs(r.cont / curve(x, r.object_id)[r.pix] - 1) for r in rows]
    assert len(rows) == 3 * PIX and np.median(off) < 0.02
    assert all(r.stationarity < 1e-6 and r.sum_gap < 1e-9 for r in R.optimality(blocks, ends, fits, model).collect())


def test_template_weights_are_fitted_with_the_histogram(spark):
    rows, _ = spectra(TRUTH[:2], noise=0.002, mix=(0.3, 0.7), cont=curve)
    out = pipelines.fit_spectra(spark.createDataFrame(rows, SCHEMA), "joint", N, LO, HI, STEP, interior=6, rounds=2)
    for r in out["fits"].collect():
        assert r.converged and r.weights[0] == pytest.approx(0.3, abs=0.05) and sum(r.weights) == pytest.approx(1, abs=1e-9)
    m = {r.object_id: r for r in out["moments"].collect()}
    assert all(m[i].vel == pytest.approx(v, abs=10) and m[i].sigma == pytest.approx(s, abs=15) for i, (v, s) in enumerate(TRUTH[:2]))


@pytest.mark.parametrize("joint", [False, True])
def test_blocks_of_a_long_series_give_the_same_fit(spark, joint):
    rows, _ = spectra(TRUTH[:2], cont=curve if joint else None)
    pix = spark.createDataFrame(rows, SCHEMA)

    def fit():
        blocks, ends, model = R.pack_blocks(pix, N, LO, HI, STEP, joint=joint, interior=6)
        return model.single, {r.object_id: r for r in R.solve_rounds(blocks, R.start_state(ends, model), model, R.Plan(grid=(1e4,))).collect()}

    whole, one = fit()
    spark.conf.set("spectraloom.blockRows", "37")
    try:
        split, many = fit()
    finally:
        spark.conf.unset("spectraloom.blockRows")
    assert whole and not split
    for i in one:
        assert np.allclose(one[i].b, many[i].b, atol=1e-7) and one[i].chi2 == pytest.approx(many[i].chi2, rel=1e-6)


def test_clipped_pixels_leave_the_fit(spark):
    rows, _ = spectra(TRUTH[:2])
    hit = {(0, 50), (0, 51), (1, 120)}
    rows = [(i, k, x, g + (0.5 if (i, k) in hit else 0.0), e, ok, t) for i, k, x, g, e, ok, t in rows]
    out = pipelines.fit_spectra(spark.createDataFrame(rows, SCHEMA), "plain", N, LO, HI, STEP, rounds=1, clip=5.0, clip_rounds=2)
    gone = {(r.object_id, r.pix) for r in out["pixels"].filter("rejected").collect()}
    assert hit <= gone and len(gone) < 12
    m = {r.object_id: r for r in out["moments"].collect()}
    assert all(m[i].vel == pytest.approx(v, abs=12) for i, (v, _) in enumerate(TRUTH[:2]))


@pytest.mark.parametrize("joint, block_rows", [(False, None), (True, None), (True, "37")])
def test_replicates_of_noise_free_data_repeat_the_fit(spark, joint, block_rows, monkeypatch):
    """Draws equal to the data must give the fit itself; shifted data must move with the shift."""
    rows, _ = spectra(TRUTH[:2], cont=curve if joint else None)
    pix = spark.createDataFrame(rows, SCHEMA)
    if block_rows:
        spark.conf.set("spectraloom.blockRows", block_rows)
    try:
        monkeypatch.setattr(R, "REPLICATE_VALUES", 1000)
        blocks, ends, model = R.pack_blocks(pix, N, LO, HI, STEP, joint=joint, interior=6)
        fits = R.cut(R.solve_rounds(blocks, R.start_state(ends, model), model, R.Plan(grid=(1e4,))))
        draws = pix.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<long>"))).select(*OBJ, "rep", "pix", "g")
        got = R.refit_replicates(blocks, ends, fits, draws, model).collect()
    finally:
        spark.conf.unset("spectraloom.blockRows")
    want = {r.object_id: r.b for r in fits.collect()}
    assert sorted((r.object_id, r.rep) for r in got) == [(i, k) for i in range(2) for k in range(30)]
    assert all(r.converged and np.allclose(r.b, want[r.object_id], atol=1e-5) for r in got)


def test_self_consistent_rounds_warm_start(spark):
    rows, _ = spectra(TRUTH)
    best = pipelines.recover_self_consistent(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.col("t")[0]), n=N, vmin=LO, vmax=HI, step=STEP)
    got = {r.object_id: r for r in best.collect()}
    m = described(best)
    for i, (v, s) in enumerate(TRUTH):
        assert got[i].converged and m[i].vel == pytest.approx(v, abs=10) and m[i].sigma == pytest.approx(s, abs=12)
    assert bins_from_packed(best, LO, HI, N, OBJ).count() == 3 * N


def test_objects_without_a_valid_pixel(spark):
    rows, _ = spectra(TRUTH[:1])
    rows += [(9, k, x, float("nan"), e, False, t) for _, k, x, _, e, _, t in rows]
    out = {r.object_id: r for r in R.recover_losvd(spark.createDataFrame(rows, SCHEMA), [1e4], N, LO, HI, STEP).collect()}
    assert out[0].converged and out[9].ngood == 0 and not out[9].converged
