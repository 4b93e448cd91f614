"""Ingest from files, result folders and restarts."""

import json

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import suite
from spectraloom.operators.products import simulation_matrix, write_products
from spectraloom.sources import library, runlog, text
from spectraloom.streaming.arrivals import latest_scores, score_stream


def test_spectra_folder(spark, tmp_path):
    (tmp_path / "a.spec").write_text("# header\n1 10.0 0.1\n2 11.0 0.2\n\n3 12.0\n")
    (tmp_path / "b.norm").write_text("  8400.0   1.0 0.1 # note\n")
    rows = sorted(text.ingest_spectra(spark, str(tmp_path / "*")).collect(), key=lambda r: (r.file, r.line_no))
    assert [(r.file, r.flux, r.ok) for r in rows] == [("a", 10.0, True), ("a", 11.0, True), ("a", 12.0, False), ("b", 1.0, True)]


def test_regions_and_parameters(spark, tmp_path):
    (tmp_path / "bad").write_text("8400 8410\n8500 8510\n")
    assert text.ingest_regions(spark, str(tmp_path / "bad")).count() == 2
    assert text.ingest_regions(spark, str(tmp_path / "none")).count() == 0
    assert text.ingest_regions(spark, None).count() == 0
    (tmp_path / "g.params").write_text("# c\nngc1 extra\nvel 3.0\nz 0.5 x\nname abc\n")
    p = {r.key: (r.name, r.raw, r.kind) for r in text.ingest_params(spark, str(tmp_path / "g.params")).collect()}
    assert p == {"vel": ("ngc1", "3.0", "int"), "z": ("ngc1", "0.5", "float"), "name": ("ngc1", "abc", "text")}


def test_run_log_is_tolerant(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join([json.dumps({"_header": True, "started": "x"}), json.dumps({"scenario_id": "s", "mode": "m", "seed": 1}), "", "# c", '{"scenario_id": ']) + "\n")
    rows = runlog.read_run_log(spark, str(log)).collect()
    assert [(r.scenario_id, r.mode, r.seed) for r in rows] == [("s", "m", 1)]
    assert runlog.read_headers(spark.read.text(str(log))).first().started == "x"


def test_missing_template_is_an_error(spark):
    lib = spark.createDataFrame([("a", 0, 1.0, 0.1)], "name string, ord long, age double, metal double")
    req = spark.createDataFrame([(0, 9.0, 0.1)], "req long, req_age double, req_metal double")
    with pytest.raises(ValueError):
        library.require_templates(lib, req)


def test_mixed_grids_need_the_union_grid(spark):
    t = spark.createDataFrame([(i, 1.0 * k + 0.1 * i, 1.0) for i in range(2) for k in range(5)], "tpl_id long, wave double, flux double")
    with pytest.raises(ValueError):
        library.pack_library(t)
    packed = library.pack_library(t, 1.0, 3.0, shared=False)
    assert packed.agg(F.min("wave") >= 1, F.max("wave") < 3).first() == (True, True)


def test_empty_bias_table_is_an_error(spark):
    d = spark.createDataFrame([(1.0, 2.0)], "v_rec double, sigma_rec double")
    empty = spark.createDataFrame([], "v_true double, sigma_true double, bias_v double, bias_v_std double, bias_sigma double, bias_sigma_std double")
    with pytest.raises(ValueError):
        suite.correct_bias(d, empty)


def test_truth_grid_size(spark):
    g = suite.truth_grid(spark, [0.0, 50.0], [60.0, 90.0, 120.0], 4)
    assert g.count() == 24 and g.select("v_true", "sigma_true").distinct().count() == 6


def test_simulation_matrix_has_one_column_per_replicate(spark):
    sim = spark.createDataFrame([(0, "losvd", 0, -1, 1.0), (0, "losvd", 0, 5, 2.0)], "object_id long, kind string, row long, rep long, value double")
    assert simulation_matrix(sim, [-1, 5]).first()["5"] == 2.0


def test_products_folder(spark, tmp_path):
    t = spark.range(10).withColumnRenamed("id", "object_id")
    write_products({"t": t}, str(tmp_path / "p"), 4)
    assert spark.read.parquet(str(tmp_path / "p" / "t")).count() == 10


def test_stream_processes_files_once(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(0, k, 8410.0 + k, 1.0 + k % 3, 1.0, True, 2.0) for k in range(20)]
    cols = "object_id long, pix long, x double, g double, gerr double, good boolean, model double"
    d = spark.createDataFrame(rows, cols)
    d.write.parquet(str(src))
    args = (spark, str(src), d.schema, str(tmp_path / "out"), str(tmp_path / "state"), 8400.0, 8500.0)
    for _ in range(2):
        score_stream(*args).awaitTermination()
    assert latest_scores(spark, str(tmp_path / "out")).count() == 1
    # Another object, and later samples of the first one: a restart scores it over all its samples.
    d.withColumn("object_id", F.lit(1).cast("long")).write.mode("append").parquet(str(src))
    d.limit(5).withColumn("pix", F.col("pix") + 20).withColumn("x", F.col("x") + 20).write.mode("append").parquet(str(src))
    score_stream(*args, files_per_batch=1).awaitTermination()
    out = latest_scores(spark, str(tmp_path / "out")).collect()
    assert sorted((r.object_id, r.ngood) for r in out) == [(0, 25), (1, 20)]


def test_stream_reads_and_writes_touched_buckets_only(spark, tmp_path):
    """Twelve batches, each with samples of two of six objects: state of the others is neither read nor rewritten."""
    import random

    from spectraloom.streaming import arrivals

    rng = random.Random(2)
    cols = "object_id long, pix long, x double, g double, gerr double, good boolean, model double"
    out, every = str(tmp_path / "out"), []
    for b in range(12):
        rows = [(o, 100 * b + k, 8410.0 + k / 9, round(rng.gauss(2, 1), 1), 1.0, rng.random() > 0.1, 2.0) for o in (b % 6, (b + 1) % 6) for k in range(15)]
        every += rows
        part = arrivals.partial_state(spark.createDataFrame(rows, cols), 8400.0, 8500.0)
        for _ in range(1 + (b == 5)):  # a replay changes nothing
            before = {r.bucket: r.version for r in spark.read.parquet(f"{out}/manifest/batch={b - 1}").collect()} if b else {}
            state = arrivals.update_state(spark, out, b, part, buckets=64)
            arrivals.score_state(state.join(part.select("object_id").distinct(), "object_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/scores/batch={b}")
        after = {r.bucket: r.version for r in spark.read.parquet(f"{out}/manifest/batch={b}").collect()}
        changed = {k for k, v in after.items() if before.get(k) != v}
        assert len(changed) <= 2 and all(after[k] == b for k in changed)
    folders = list((tmp_path / "out" / "state").glob("batch=*/bucket=*"))
    assert len(folders) <= 6 + 2
    want = {r.object_id: r for r in arrivals.score_batch(spark.createDataFrame(every, cols), 8400.0, 8500.0).collect()}
    got = {r.object_id: r for r in latest_scores(spark, out).collect()}
    assert set(got) == set(want)
    for o, r in want.items():
        assert got[o].ngood == r.ngood and abs(got[o].chi2 - r.chi2) < 1e-9 and abs(got[o].sigma - r.sigma) < 1e-9


def test_stream_computes_deviations_only_where_half_of_the_values_are_equal(spark):
    """Scores of flat, spread and empty objects equal those of whole series; without a flat object no mean is taken."""
    from spectraloom.streaming import arrivals

    cols = "object_id long, pix long, x double, g double, gerr double, good boolean, model double"
    spread = [(0, k, 8410.0 + k / 9, float(k * k), 1.0, True, 2.0) for k in range(30)]
    flat = [(1, k, 8410.0 + k / 9, 3.0 if k < 25 else float(k), 1.0, True, 2.0) for k in range(30)]
    none = [(2, k, 8410.0 + k / 9, 3.0, 1.0, False, 2.0) for k in range(30)]
    for rows in (spread + flat + none, spread + none):
        pix = spark.createDataFrame(rows, cols)
        scored = arrivals.score_state(arrivals.partial_state(pix, 8400.0, 8500.0))
        got = {r.object_id: r.sigma for r in scored.collect()}
        want = {r.object_id: r.sigma for r in arrivals.score_batch(pix, 8400.0, 8500.0).collect()}
        assert set(got) == set(want) and got[2] is None and want[2] is None
        assert all(abs(got[o] - want[o]) < 1e-9 for o in got if o != 2)
    assert "_m#" not in scored._jdf.queryExecution().optimizedPlan().toString()
