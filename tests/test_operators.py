"""Pinned values, planted truth and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mock_series import build_mocks
from spectraloom.functions import columns as C
from spectraloom.operators import choose, describe, masks, mocks, resample, shapes, solve
from spectraloom.operators import pixels as P
from spectraloom.operators import stats as S
from spectraloom.plans import pipelines
from spectraloom.plans.scale import number_rows, quantiles

OBJ = ["object_id"]


def hist(spark, rows):
    return spark.createDataFrame([(i, j, float(v), float(b)) for i, (vs, bs) in enumerate(rows) for j, (v, b) in enumerate(zip(vs, bs))],
                                 "object_id long, bin int, v double, b double")


def series(spark, values, step=1.25, start=8400.0, err=1.0):
    return spark.createDataFrame([(i, k, start + step * k, float(y), err, True) for i, ys in enumerate(values) for k, y in enumerate(ys)],
                                 "object_id long, pix long, x double, g double, gerr double, good boolean")


def gaussian(v, mean, sigma):
    b = np.exp(-0.5 * ((v - mean) / sigma) ** 2)
    return b / b.sum()


V = np.linspace(-500, 500, 101)


def test_pinned_shape_numbers(spark):
    h = hist(spark, [(V, gaussian(V, 0, 100))])
    assert S.roughness(h, OBJ).first().roughness == pytest.approx(0.009975, rel=0.05)
    assert S.losvd_moments(h, OBJ).first().sigma == pytest.approx(100, rel=0.03)
    assert S.fwhm(h, OBJ).first().fwhm == pytest.approx(235.48, rel=0.01)


def test_degenerate_histograms(spark):
    flat, spike, faint = np.ones(21), np.eye(21)[10], np.full(21, 1e-6)
    v = np.arange(21.0)
    r = {x.object_id: x.roughness for x in S.roughness(hist(spark, [(v, flat), (v, spike), (v, faint), (v[:2], flat[:2])]), OBJ).collect()}
    assert r[0] == 0 and r[1] == 2 and math.isinf(r[2]) and r[3] == 0


def test_peak_counts(spark):
    two = gaussian(V, -200, 50) + gaussian(V, 200, 50)
    shoulder = gaussian(V, 0, 80) + 0.2 * gaussian(V, 150, 80)
    n = {x.object_id: x.n_peaks for x in S.count_peaks(hist(spark, [(V, gaussian(V, 0, 80)), (V, two), (V, shoulder), (V, 0 * V)]), OBJ).collect()}
    assert n == {0: 1, 1: 2, 2: 1, 3: 1}


def test_description_recovers_planted_moments(spark):
    v = np.linspace(-600, 600, 101)
    truth = [(50, 120, 0.0, 0.0), (-80, 90, 0.06, 0.03), (20, 200, -0.05, 0.08)]
    rows = []
    for m, s, h3, h4 in truth:
        w = (v - m) / s
        rows.append((v, np.exp(-0.5 * w * w) * (1 + h3 * (2 * w**3 - 3 * w) / math.sqrt(3) + h4 * (4 * w**4 - 12 * w * w + 3) / math.sqrt(24))))
    out = {r.object_id: r for r in describe.gh_fit(hist(spark, rows), OBJ).collect()}
    for i, (m, s, h3, h4) in enumerate(truth):
        assert out[i].vel == pytest.approx(m, abs=1) and out[i].sigma == pytest.approx(s, abs=1)
        assert out[i].h3 == pytest.approx(h3, abs=0.01) and out[i].h4 == pytest.approx(h4, abs=0.01)
    # A narrow spike on a broad profile: the fit has to leave the spike's width.
    v = np.linspace(-300, 300, 64)
    b = gaussian(v, -10, 120)
    b[20] = 2 * b.max()
    r = describe.gh_fit(hist(spark, [(v, b)]), OBJ).first()
    planted = (describe._linear(v, b, np.array(-10.0), np.array(120.0), [3, 4], "classic", 1.0)[2] ** 2).sum()
    assert r.converged and r.sigma > 60 and r.sse <= planted
    few = describe.gh_fit(hist(spark, [(v[:4], v[:4])]), OBJ).first()
    assert few.vel is None


def test_higher_description_on_a_gaussian(spark):
    v = np.linspace(-600, 600, 101)
    r = describe.gh_fit_higher(hist(spark, [(v, gaussian(v, 30, 110))]), OBJ).first()
    assert r.vel == pytest.approx(30, abs=1) and r.sigma == pytest.approx(110, abs=1) and abs(r.h5) < 0.01 and abs(r.h6) < 0.01


def test_grown_mask_indices(spark):
    d = series(spark, [np.zeros(21)]).withColumn("flag", F.col("pix") == 10)
    got = [r.pix for r in masks.grow_mask(d, "flag", 2).filter("grown").collect()]
    assert sorted(got) == [8, 9, 10, 11, 12]


def test_clipping_is_one_sided_and_respects_protection(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(0, 0.1, 50)
    high, low = y.copy(), y.copy()
    high[25], low[25] = 20, -20
    d = series(spark, [high, low, high]).withColumn("model", F.lit(0.0)).withColumn("protect", F.col("object_id") == 2)
    bad = {(r.object_id, r.pix) for r in masks.sigma_clip(d, "model", protect="protect").filter("NOT good").collect()}
    assert (0, 25) in bad and not any(o == 2 for o, _ in bad) and (1, 25) not in bad


def test_robust_sigma_of_a_normal_sample(spark):
    y = np.random.default_rng(1).normal(0, 5, 4000)
    d = series(spark, [y, np.full(5, 3.0), [1.0]])
    s = {r.object_id: r.sigma for r in masks.robust_sigma(d, OBJ, "g").collect()}
    assert s[0] == pytest.approx(5, abs=0.3) and s[1] == 0 and s[2] == 0


def test_smoothing_and_convolution_keep_a_constant(spark):
    d = series(spark, [np.full(80, 7.0)])
    for sigma in (2.0, 30.0):
        assert all(r.smooth == pytest.approx(7) for r in resample.gauss_smooth(d, sigma).collect())
    v = np.linspace(-300, 300, 29)
    fine = resample.fine_losvd(hist(spark, [(v, gaussian(v, 0, 90))]), OBJ, 28)
    inner = resample.convolve_losvd(d.withColumn("t", F.col("g")), fine, 1.25).filter("pix BETWEEN 12 AND 67").collect()
    assert len(inner) == 56 and all(r.model == pytest.approx(7) for r in inner)


def test_equal_templates_mix_to_themselves(spark):
    t = spark.createDataFrame([(i, k, 2.0, False) for i in range(3) for k in range(5)], "tpl_id long, pix long, t double, outside boolean")
    w = spark.createDataFrame([(9, i, float(i)) for i in range(3)], "object_id long, tpl_id long, w double")
    assert {r.tmix for r in resample.mix_templates(t, w, ["object_id", "pix"]).collect()} == {2.0}


def test_correlation_of_long_series_equals_the_short_plan(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=97), rng.normal(size=97)
    d = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "object_id long, pix long, g double, t double")
    want = np.correlate(a, b, "full")
    spark.conf.set("spectraloom.packedSeries", "10")
    try:
        got = {r.lag: r.xcorr for r in resample.cross_correlate(d).collect()}
    finally:
        spark.conf.unset("spectraloom.packedSeries")
    assert len(got) == len(want)
    assert np.allclose([got[k] for k in range(-96, 97)], want, atol=1e-9)


def test_quantiles_of_a_hot_key_are_exact(spark, split_plans):
    rng = np.random.default_rng(3)
    y = np.round(rng.exponential(size=3000), 2)
    d = spark.createDataFrame([(i % 50 if i % 3 else 7, float(x)) for i, x in enumerate(y)], "k long, x double")
    got = {r.k: (r.a, r.b) for r in quantiles(d, ["k"], "x", {"a": 0.16, "b": 0.5}).collect()}
    groups = {}
    for r in d.collect():
        groups.setdefault(r.k, []).append(r.x)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert np.allclose(got[k], np.quantile(xs, [0.16, 0.5]))


def test_numbering_of_a_hot_key_is_dense_and_ordered(spark, split_plans):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(0, float(x), i) for i, x in enumerate(rng.integers(0, 500, 2000))], "k long, x double, i long")
    rows = sorted(number_rows(d, ["k"], ["x", "i"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(2000))
    assert [(r.x, r.i) for r in rows] == sorted((r.x, r.i) for r in rows)


def test_nonnegative_solver_against_brute_force():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 12, 6))
    mat, q = np.einsum("bij,bik->bjk", a, a), rng.normal(size=(40, 6))
    got = solve.nonneg_batch(mat, q)
    for m, c, z in zip(mat, q, got):
        best = np.inf
        for mask in range(64):
            s = [i for i in range(6) if mask >> i & 1]
            x = np.zeros(6)
            if s:
                x[s] = np.linalg.solve(m[np.ix_(s, s)], c[s])
            if (x >= 0).all():
                best = min(best, 0.5 * x @ m @ x - c @ x)
        assert (z >= 0).all() and 0.5 * z @ m @ z - c @ z == pytest.approx(best, abs=1e-8)


def test_spline_follows_a_smooth_curve(spark):
    x = np.arange(200)
    d = series(spark, [10 + np.sin(x / 40), 5 + 0.01 * x], err=0.05)
    worst = solve.fit_pspline(d, strength=1e-6).agg(F.max(F.abs(F.col("cont") - F.col("g")))).first()[0]
    assert worst < 0.01


def test_baseline_stays_below_peaks(spark):
    x = np.arange(200)
    y = 10 + 0.01 * x
    peaks = y + 5 * np.exp(-0.5 * ((x - 100) / 3) ** 2)
    out = solve.asymmetric_baseline(series(spark, [peaks]), strength=1.0, p=0.01, rounds=6, interior=10).orderBy("pix").collect()
    assert abs(out[100].baseline - y[100]) < 1.0 and abs(out[30].baseline - y[30]) < 0.3


def test_mixture_finds_planted_weights(spark):
    x = np.arange(60)
    t = [1 + 0.5 * np.sin(x / 5), 1 + 0.5 * np.cos(x / 7), 1 + 0.3 * np.sin(x / 3)]
    tpl = spark.createDataFrame([(i, int(k), float(t[i][k])) for i in range(3) for k in x], "tpl_id long, pix long, t double")
    d = series(spark, [0.2 * t[0] + 0.8 * t[2]], err=0.01)
    w = {r.tpl_id: r.w for r in solve.fit_mixture(d, tpl, [0, 1, 2]).collect()}
    assert w[0] == pytest.approx(0.2, abs=1e-6) and w[1] == pytest.approx(0, abs=1e-6) and w[2] == pytest.approx(0.8, abs=1e-6)


def test_eigen_templates_match_a_dense_decomposition(spark):
    rng = np.random.default_rng(6)
    for shape in ((30, 6), (6, 30)):
        m = 1 + 0.3 * rng.random(shape)
        tpl = spark.createDataFrame([(j, i, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])], "tpl_id long, pix long, t double")
        out = solve.eigen_templates(tpl, 3).collect()
        u, s, vt = np.linalg.svd(m / np.median(np.abs(m), axis=0), full_matrices=False)
        u = u * np.where(np.sign(vt.sum(1)) == 0, 1, np.sign(vt.sum(1)))
        got = np.zeros((shape[0], 3))
        for r in out:
            got[r.pix, r.component] = r.t
        want = u[:, :3] / np.median(np.abs(u[:, :3]), axis=0)
        assert np.allclose(got, want, atol=1e-6)
        share = {r.component: r.explained for r in out}
        assert np.allclose([share[k] for k in range(3)], (s**2 / (s**2).sum())[:3])


def planted(spark, truth, n_pix=320, noise=0.01):
    rows = [(i, float(v), float(s), 0.0, 0.0, "gaussian") for i, (v, s) in enumerate(truth)]
    t = spark.createDataFrame(rows, "object_id long, v_true double, sigma_true double, h3 double, h4 double, shape string")
    jobs = t.withColumns({"snr": F.lit(1 / noise), "mode": F.lit("none"), "emission": F.lit("none"), "role": F.lit("matched"), "seed": F.col("object_id")})
    return build_mocks(jobs, 8350.0, 1.25, n_pix, 8550.0).drop("cont")


def test_recovery_of_planted_velocities(spark):
    truth = [(50.0, 100.0), (-60.0, 130.0), (0.0, 90.0)]
    pix = planted(spark, truth)
    best = pipelines.recover_self_consistent(pix, 2, n=29, vmin=-500.0, vmax=500.0, lambdas=[1e1, 1e2, 1e3, 1e4])
    gh = {r.object_id: r for r in describe.gh_fit(solve.bins_from_packed(best, -500.0, 500.0, 29, OBJ), OBJ).collect()}
    for i, (v, s) in enumerate(truth):
        assert gh[i].vel == pytest.approx(v, abs=15) and gh[i].sigma == pytest.approx(s, abs=20)


def test_correlation_velocity_has_the_right_sign(spark):
    out = {r.object_id: r.v for r in resample.xcorr_velocity(planted(spark, [(120.0, 60.0), (-120.0, 60.0)]), 1.25, -500.0, 500.0).collect()}
    assert out[0] == pytest.approx(120, abs=25) and out[1] == pytest.approx(-120, abs=25)


def test_injected_lines_are_masked(spark):
    d = planted(spark, [(0.0, 100.0)]).withColumn("cont", F.lit(1.0))
    lit = mocks.inject_lines(d, 1.0, 3.0, "cont", F.lit(1))
    from spectraloom.functions.lines import emission_candidates

    out = masks.emission_line_mask(lit, emission_candidates(spark), lo=8360.0, hi=8720.0)
    near = out.filter("abs(x - 8446.36) < 3").collect()
    assert near and all(r.emission for r in near)


def test_lambda_selection_fallbacks(spark):
    rows = [(0, 10.0**k, 100.0 + 3 * k * k, 100, 1, 10.0, 50.0, 0.5 - 0.1 * k) for k in range(6)]
    rows += [(1, 10.0**k, 50.0, 100, 2, 0.0, 50.0, 0.9) for k in range(6)]
    t = spark.createDataFrame(rows, "object_id long, lam double, chi2 double, ngood long, n_peaks int, v double, sigma double, rough double")
    t = t.withColumn("v_center", F.lit(0.0))
    chi = {r.object_id: r.lam for r in choose.pick_lambda_chi2(t).collect()}
    rough = {r.object_id: r.lam for r in choose.pick_lambda_roughness(t).collect()}
    disc = {r.object_id: (r.lam, r.reached) for r in choose.pick_lambda_discrepancy(t, nsigma=0.3).collect()}
    assert chi == {0: 1.0, 1: 1e5}
    assert rough == {0: 1e3, 1: 1e5}
    assert disc[0] == (1e2, True) and disc[1] == (1e5, False)


def test_mock_level_and_axis(spark):
    d = planted(spark, [(0.0, 80.0)], n_pix=100)
    assert d.count() == 100 and d.agg(F.min("x")).first()[0] == 8350.0
    assert d.agg(F.countDistinct("gerr")).first()[0] == 1


def test_synthetic_template_shape(spark):
    r = spark.range(1).select(shapes.triplet_template(F.lit(8542.09)).alias("deep"), shapes.triplet_template(F.lit(8200.0)).alias("flat")).first()
    assert r.deep == pytest.approx(0.3, abs=1e-6) and r.flat == pytest.approx(1.0)


def test_frame_and_axis_detection(spark):
    d = series(spark, [np.ones(40)])
    assert not P.resolve_frame(d, 0.0, 8405.0, 8440.0).first().shifted
    idx = d.withColumn("c1", F.col("pix") + 1.0)
    assert P.detect_index_axis(idx, 4750.0, 1.25).first().is_index
    assert C.C_KMS == 299792.458


def test_hot_plan_does_not_read_its_input_again_and_again(spark, split_plans):
    """Scans in the plan of a robust sigma: the plan for hot keys has at most three times those of the cheap one."""
    from spectraloom.operators.masks import robust_sigma

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "value")
    scans = lambda: robust_sigma(events, ["user_id"], "value")._jdf.queryExecution().executedPlan().toString().count("FileScan")
    hot = scans()
    spark.conf.set("spectraloom.hotRows", "1000000")
    assert hot <= 3 * scans()
