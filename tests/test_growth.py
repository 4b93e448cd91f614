"""Plans whose cost must not grow faster than their input."""

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectraloom.catalog import load_all
from spectraloom.catalog.base import QUERIES
from spectraloom.operators import errors, recovery, solve
from spectraloom.plans.scale import cut
from spectraloom.sources import library, runlog


load_all()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _library_on_disk(spark, path):
    spark.range(500).select(
        F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("ord"), (F.col("id") % 50).cast("double").alias("age"), ((F.col("id") % 7) / 10.0).alias("metal")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_a_library_is_not_broadcast_to_its_requests(spark, tmp_path):
    lib = _library_on_disk(spark, str(tmp_path / "lib"))
    req = spark.createDataFrame([(i, float(i), (i % 7) / 10.0) for i in range(40)], "req long, req_age double, req_metal double")
    got = library.select_templates(lib, req)
    assert "BuildRight" in plan_of(got) and "BuildLeft" not in plan_of(got)
    want = {i: next(k for k in range(500) if k % 50 == i and k % 7 == i % 7) for i in range(40)}
    assert {r.req: r.name for r in got.collect()} == {i: f"n{k}" for i, k in want.items()}


def test_neither_side_of_a_large_epsilon_join_is_broadcast(spark, split_plans, tmp_path):
    lib = _library_on_disk(spark, str(tmp_path / "lib"))
    got = library.epsilon_join(lib, lib.toDF("n2", "o2", "a2", "m2"), [("age", "a2"), ("metal", "m2")])
    assert "BroadcastHashJoin" not in plan_of(got)
    assert got.count() == sum(1 for i in range(500) for j in range(500) if i % 50 == j % 50 and i % 7 == j % 7)


def _spectra(spark, objects=3, pixels=64):
    x = (8470 + 1.5 * F.col("pix")).alias("x")
    dip = 1 - 0.5 * F.exp(-0.5 * F.pow((x - 8500 - F.col("object_id")) / 3, F.lit(2.0)))
    px = spark.range(objects * pixels).select(F.floor(F.col("id") / pixels).alias("object_id"), (F.col("id") % pixels).alias("pix"))
    return px.select("object_id", "pix", x, dip.alias("g"), F.lit(0.005).alias("gerr"), F.lit(True).alias("good"), dip.alias("t"))


def test_rounds_of_short_series_are_one_pass(spark, monkeypatch):
    written = []
    monkeypatch.setattr(recovery, "cut", lambda df: written.append(1) or cut(df))
    blocks, ends, model = recovery.pack_blocks(_spectra(spark), 9, -300.0, 300.0, 1.5)
    written.clear()
    fits = recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(grid=(1e4,))).collect()
    assert model.single and len(written) == 2  # the state and the fits, however many rounds there were
    assert len(fits) == 3 and max(r.rounds for r in fits) > 1 and all(r.converged for r in fits)


def test_influence_holds_few_objects_at_a_time():
    n, count = 5, 1000
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
    one = np.ones(count)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(count)), pa.array(one), pa.array(100 * one), lists(np.tile(np.eye(n).ravel(), (count, 1))), lists(np.ones((count, n))), pa.array(-one), pa.array(one)],
        ["object_id", "lam", "sigma0", "_gram", "b", "v_lo", "v_hi"],
    )
    out = list(solve._influence_batches(n, 1.0)(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum(b.num_rows for b in out) == count


def test_active_sets_started_anywhere_give_the_same_minimum():
    rng = np.random.default_rng(1)
    root = rng.normal(size=(20, 12, 12))
    mat, rhs, low = root @ root.transpose(0, 2, 1) + 0.1 * np.eye(12), rng.normal(size=(20, 12)), np.full(12, 1e-6)
    for sums in ([], [slice(0, 8)]):
        want, ok = recovery.constrained_batch(mat, rhs, low, sums)
        start = np.where(rng.random((20, 12)) < 0.5, 1e-6, 1.0)
        start[:, 0] = 1.0
        got, fine = recovery.constrained_batch(mat, rhs, low, sums, start=start)
        assert ok.all() and fine.all() and np.allclose(got, want, atol=1e-9)


def test_pixels_are_not_shuffled_to_the_buckets_of_few_windows(spark):
    got = QUERIES["ingest_regions"](spark, "/root/testdata/sf0.001")
    plan = plan_of(got)
    assert "_bkt" in plan and not re.search(r"hashpartitioning\(_bkt", plan)
    assert not re.search(r"hashpartitioning\(_b#", plan_of(QUERIES["line_table"](spark, "/root/testdata/sf0.001")))


def test_draws_of_short_series_do_not_shuffle_their_replicates(spark):
    px = _spectra(spark, 4, 40).withColumn("g", F.col("g") + 0.01 * (F.col("pix") % 7)).withColumn("model", F.lit(0.9))
    px = px.withColumn("good", F.col("pix") % 9 != 3)
    for block in (1, 5):
        draws = errors.bootstrap_draws(px, 6, block)
        assert not re.search(r"hashpartitioning\([^)]*_at#", plan_of(draws))
        got = {(r.object_id, r.rep, r.pix): r.g for r in draws.collect()}
        spark.conf.set("spectraloom.packedDraws", "3")
        try:
            want = {(r.object_id, r.rep, r.pix): r.g for r in errors.bootstrap_draws(px, 6, block).collect()}
        finally:
            spark.conf.unset("spectraloom.packedDraws")
        assert len(got) == 4 * 6 * 40 and got == want


def test_run_log_files_are_small_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runlog, "FILE_ROWS", 300)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("scenario_id"), F.lit("m").alias("mode"), F.col("id").alias("seed"), F.lit(False).alias("crashed")).coalesce(1)
    path = tmp_path / "log"
    runlog.append_run_log(rows, str(path))
    runlog.append_run_log(rows, str(path))
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    plain = sum(len(json.dumps({"scenario_id": str(i), "mode": "m", "seed": i, "crashed": False})) for i in range(1000))
    assert len(files) == 8 and sum(f.stat().st_size for f in files) < plain
    back = runlog.read_run_log(spark, str(path))
    assert back.count() == 2000 and back.agg(F.sum("seed")).first()[0] == 999000


def test_blocks_of_a_batch_share_their_passes():
    """Blocks of several lengths stacked together give what each gives alone."""
    model = recovery.Model(9, -300.0, 300.0, 1.5, True, 4, n_fine=22, templates=2)
    rng, sizes = np.random.default_rng(0), [40, 17, 40, 0, 25]
    px = [np.column_stack([np.arange(m), 8470 + 1.5 * np.arange(m), rng.random(m) + 1, rng.integers(0, 2, m), np.ones(m), 1 + rng.random((m, 2))]) for m in sizes]
    ends = [(p[0, 1], p[-1, 1], m - 1) if m else (0.0, 0.0, 0) for p, m in zip(px, sizes)]
    x0, x1, last = (np.array(c) for c in zip(*ends))
    z, at = rng.random((len(sizes), model.total)), np.cumsum([0, *sizes])
    many = recovery.Stack(model, np.zeros(len(sizes), np.int64), np.concatenate(px), at, x0, x1, last).normals(z[[0, 1, 3, 4]], np.array([0, 1, 3, 4]))
    for row, i in enumerate([0, 1, 3, 4]):
        one = recovery.Stack(model, np.zeros(1, np.int64), px[i], np.array([0, sizes[i]]), x0[i : i + 1], x1[i : i + 1], last[i : i + 1]).normals(z[i : i + 1])
        assert np.allclose(many[row], one[0], rtol=1e-12, atol=1e-12)
        assert many[row][-1] == px[i][:, 3].sum()


def test_all_strengths_of_short_series_are_one_pass(spark, monkeypatch):
    blocks, ends, model = recovery.pack_blocks(_spectra(spark), 9, -300.0, 300.0, 1.5)
    alone = {(r.object_id, r.lam): r for x in (1e2, 1e6) for r in recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(grid=(x,))).collect()}
    written = []
    monkeypatch.setattr(recovery, "cut", lambda df: written.append(1) or cut(df))
    fits = cut(recovery.solve_each(blocks, ends, model, (1e2, 1e6)))
    assert len(written) == 2
    got = {(r.object_id, r.lam): r for r in fits.collect()}
    assert got.keys() == alone.keys() and all(np.allclose(got[k].b, alone[k].b, atol=1e-9) and got[k].converged == alone[k].converged for k in got)
    plan = recovery.optimality(blocks, ends, fits, model)
    assert {(r.object_id, r.lam) for r in plan.collect() if r.stationarity < 1e-6} == set(got)
    assert plan_of(plan).count("MapInArrow") == 1  # no table of normal matrices between the pixels and the answer


def test_replicates_of_short_series_stay_one_row_each(spark):
    px = _spectra(spark).withColumn("good", ~((F.col("pix") == 5) & (F.col("object_id") == 1)) & (F.col("object_id") < 2))
    px = px.withColumn("g", F.col("g") + 0.01 * (F.col("pix") % 7))
    packed = blocks, ends, model = recovery.pack_blocks(px, 9, -300.0, 300.0, 1.5)
    fits = cut(recovery.solve_rounds(blocks, recovery.start_state(ends, model), model, recovery.Plan(grid=(1e4,))))
    fitted = cut(px.join(recovery.model_pixels(blocks, ends, fits, model).drop("cont"), ["object_id", "pix"]))
    got = errors.bootstrap_fits(packed, fitted, fits, 4)
    assert "posexplode" not in plan_of(got)
    by_pixel = recovery.refit_replicates(blocks, ends, fits, errors.bootstrap_draws(fitted, 4), model).filter("converged")
    rows = lambda df: {(r.object_id, r.rep): r.b for r in df.collect()}
    one, many = rows(got), rows(by_pixel)
    assert one.keys() == many.keys() and len(one) >= 8 and all(np.allclose(one[k], many[k], atol=1e-9) for k in one)


def test_baseline_rounds_of_short_series_are_one_pass(spark, monkeypatch):
    px = _spectra(spark).withColumn("good", F.col("pix") != 9).withColumn("g", F.when(F.col("pix") != 30, F.col("g") - 1 + 0.1 * (F.col("pix") % 3)))
    px = px.unionByName(px.filter("object_id = 0 AND pix = 0").withColumn("object_id", F.lit(7).cast("long")))
    written = []
    monkeypatch.setattr(solve, "cut", lambda df: written.append(1) or cut(df))

    def fit():
        written.clear()
        rows = solve.asymmetric_baseline(px, rounds=5, interior=10).collect()
        return len(written), {(r.object_id, r.pix): r.baseline for r in rows}

    passes, one = fit()
    spark.conf.set("spectraloom.blockRows", "20")
    try:
        rounds, many = fit()
    finally:
        spark.conf.unset("spectraloom.blockRows")
    assert passes == 1 and rounds == 5
    assert one.keys() == many.keys() and len(one) == 3 * 64 + 1 and all(abs(one[k] - many[k]) < 1e-8 for k in one)


def test_a_bucket_of_the_stream_is_one_file_and_its_state_checked_once(spark, tmp_path, monkeypatch):
    from spectraloom.plans import scale
    from spectraloom.streaming import arrivals

    rows = spark.range(4000).select((F.col("id") % 2).alias("object_id"), F.col("id").alias("pix"), F.lit(8410.0).alias("x"), (F.col("id") * 0.5).alias("g"),
                                    F.lit(1.0).alias("gerr"), F.lit(True).alias("good"), F.lit(2.0).alias("model"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state = arrivals.update_state(spark, str(tmp_path), 0, cut(arrivals.partial_state(rows, 8400.0, 8500.0)), buckets=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folders = list(tmp_path.glob("state/batch=0/bucket=*"))
    assert folders and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    checks = []
    monkeypatch.setattr(scale, "cut", lambda df: checks.append(1) or cut(df))
    got = {r.object_id: r for r in arrivals.score_state(state).collect()}
    assert len(checks) == 1
    want = {r.object_id: r for r in arrivals.score_batch(rows, 8400.0, 8500.0).collect()}
    assert set(got) == set(want) and all(abs(got[o].sigma - want[o].sigma) < 1e-9 and abs(got[o].chi2 / want[o].chi2 - 1) < 1e-12 for o in want)
