"""End-to-end flows, result sinks and incremental arrival."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import PIXELS, RUNS, big, pixels, query, r6, runs, table
from spectraloom.catalog.fits import LAMBDAS, NB, STEP, VHI, VLO, planted, sloping
from spectraloom.catalog.ingest import REGION_ROWS
from spectraloom.catalog.masks import EXCESS, ROLL
from spectraloom.operators import products
from spectraloom.plans import pipelines
from spectraloom.plans.scale import attach, number_rows, shared_folder
from spectraloom.sources import runlog
from spectraloom.streaming.arrivals import latest_scores, score_stream

OBJ = ["object_id"]


def window_of(lo, hi):
    """The canonical pixel table cut to an open window and renumbered, under the usual name."""
    return PIXELS.replace("pixels AS (", "px0 AS (", 1) + f""",
pixels AS (SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY x) - 1 AS pix, x, g, gerr, good FROM px0 WHERE x > {lo} AND x < {hi})"""


@query("series_quality", f"""
WITH {window_of(8401, 8500)}, {ROLL},
m AS (SELECT p.*, bool_or(r.pix IS NOT NULL) OVER (PARTITION BY p.object_id ORDER BY p.pix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS masked FROM pixels p LEFT JOIN roll r ON r.object_id = p.object_id AND r.pix = p.pix),
l AS (SELECT object_id, avg(g) AS model, quantile_cont(g, 0.5) AS med, stddev_pop(g) AS sd FROM m WHERE good AND NOT masked GROUP BY 1),
s AS (SELECT m.object_id, count(*) AS n_pixels, count(*) FILTER (WHERE masked) AS n_masked, quantile_cont(abs(g - med), 0.5) FILTER (WHERE good AND NOT masked) AS mad, any_value(sd) AS sd,
   sum(((g - model) / gerr) ** 2) FILTER (WHERE good AND NOT masked) AS chi2, count(*) FILTER (WHERE good AND NOT masked) AS ngood FROM m LEFT JOIN l USING (object_id) GROUP BY 1)
SELECT object_id, n_pixels, n_masked, round(CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE sd END, 6) AS sigma, round(chi2, 6) AS chi2, ngood, round(chi2 / greatest(ngood - 1, 1), 6) AS chi2_red FROM s""")
def series_quality(spark, sf):
    px = pixels(spark, sf)
    px = number_rows(px.filter("x > 8401 AND x < 8500").drop("pix"), OBJ, ["x"])
    out = pipelines.series_quality(px, 8401.0, 8500.0)
    return out.select("object_id", "n_pixels", "n_masked", r6("sigma"), r6("chi2"), "ngood", r6("chi2_red"))


@query("prepare", f"""
WITH {window_of(8405, 8500)}, {EXCESS[EXCESS.index('lines('):].replace("IN ('em', 'paschen')", "= 'em' AND centre BETWEEN 8380 AND 8525")}, {ROLL},
reg(lo, hi) AS (VALUES {', '.join(f'({a}e0, {b}e0)' for a, b in REGION_ROWS)}),
f AS (SELECT p.*, EXISTS (SELECT 1 FROM reg WHERE (x >= lo AND x <= hi) OR (x >= -lo AND x <= -hi)) AS m_region,
  EXISTS (SELECT 1 FROM excess e WHERE e.object_id = p.object_id AND e.excess >= 3 AND x >= centre - hw AND x <= centre + hw) AS m_line,
  EXISTS (SELECT 1 FROM roll r WHERE r.object_id = p.object_id AND r.pix = p.pix) AS m_segment FROM pixels p)
SELECT object_id, pix, x, g, m_region, m_line, m_segment, good AND NOT (m_region OR m_line OR m_segment) AS good FROM f
WHERE object_id IN (SELECT object_id FROM pixels GROUP BY 1 HAVING count(*) >= 10)""")
def prepare(spark, sf):
    reg = spark.createDataFrame(REGION_ROWS, "lo double, hi double")
    return pipelines.prepare(pixels(spark, sf), 8405.0, 8500.0, regions=reg).select("object_id", "pix", "x", "g", "m_region", "m_line", "m_segment", "good")


@query("fit_products", f"""
WITH {PIXELS}, m AS (SELECT p.*, mu AS model FROM pixels p JOIN (SELECT object_id, avg(g) FILTER (WHERE good) AS mu FROM pixels GROUP BY 1) USING (object_id))
SELECT object_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT good) AS n_rejected, round(sum(((g - model) / gerr) ** 2) FILTER (WHERE good), 6) AS chi2, count(*) FILTER (WHERE good) AS ngood,
  round(sqrt(avg((g - model) ** 2) FILTER (WHERE good)), 6) AS rms FROM m GROUP BY 1""")
def fit_products(spark, sf):
    px = pixels(spark, sf)
    px = attach(px, px.filter("good").groupBy(*OBJ).agg(F.avg("g").alias("model")), OBJ)
    hist = px.select(*OBJ, F.col("pix").alias("bin"), F.col("x").alias("v"), F.col("g").alias("b"))
    weights = px.select(*OBJ).distinct().select(*OBJ, F.lit(0).cast("long").alias("tpl_id"), F.lit(1.0).alias("w"))
    path = shared_folder(spark, "products")
    products.write_products(products.fit_products(px, hist, weights), path, 8)
    per_pixel = spark.read.parquet(f"{path}/pixels").groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("rejected").alias("n_rejected"))
    q = spark.read.parquet(f"{path}/quality")
    return per_pixel.join(q, OBJ).select("object_id", "n_rows", "n_rejected", r6("chi2"), "ngood", r6("rms"))


@query("append_run_log", f"""
WITH {RUNS} SELECT scenario_id, mode, count(*) AS n, count(*) FILTER (WHERE crashed) AS n_crashed, round(sum(bias_v), 6) AS sum_bias_v, round(sum(wall_time_s), 5) AS sum_wall FROM runs GROUP BY 1, 2""")
def append_run_log(spark, sf):
    path = shared_folder(spark, "runlog")
    r = runs(spark, sf).withColumn("scenario_id", F.col("scenario_id").cast("string"))
    runlog.append_run_log(r.filter("crashed"), path)
    runlog.append_run_log(r.filter("NOT crashed"), path)
    back = runlog.read_run_log(spark, path)
    return back.groupBy(F.col("scenario_id").cast("long").alias("scenario_id"), "mode").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("crashed").alias("n_crashed"), r6(F.sum("bias_v"), "sum_bias_v"), F.round(F.sum("wall_time_s"), 5).alias("sum_wall")
    )


@query("fit_spectra")
def fit_spectra(spark, sf):
    out = pipelines.fit_spectra(planted(spark, sf), n=NB, vmin=VLO, vmax=VHI, step=STEP, lambdas=LAMBDAS)
    return out["quality"].join(out["moments"].select("object_id", "vel", "sigma", "h3", "h4"), "object_id", "left")


@query("fit_spectra_joint")
def fit_spectra_joint(spark, sf):
    # The same spectra under a sloping continuum, which the joint mode has to recover as well.
    out = pipelines.fit_spectra(sloping(planted(spark, sf)), "joint", n=NB, vmin=VLO, vmax=VHI, step=STEP, lambdas=LAMBDAS)
    return out["quality"].join(out["moments"].select("object_id", "vel", "sigma", "h3", "h4"), "object_id", "left")


@query("score_stream", f"""
WITH {PIXELS}, p AS (SELECT * FROM (SELECT user_id AS object_id, value AS g, 0.05e0 * value + 0.5e0 AS gerr, event_type <> 'error' AS good, 40e0 AS model FROM events)),
d AS (SELECT *, quantile_cont(CASE WHEN good THEN g END, 0.5) OVER (PARTITION BY object_id) AS med FROM p),
s AS (SELECT object_id, sum(((g - model) / gerr) ** 2) FILTER (WHERE good) AS chi2, count(*) FILTER (WHERE good) AS ngood, quantile_cont(abs(g - med), 0.5) FILTER (WHERE good) AS mad, stddev_pop(g) FILTER (WHERE good) AS sd FROM d GROUP BY 1)
SELECT object_id, round(chi2, 6) AS chi2, ngood, round(CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE sd END, 6) AS sigma FROM s""")
def stream(spark, sf):
    work = shared_folder(spark, "stream")

    def to_pixels(batch):
        return batch.select(
            F.col("user_id").alias("object_id"), F.col("event_id").alias("pix"), F.lit(8450.0).alias("x"), F.col("value").alias("g"),
            (0.05 * F.col("value") + 0.5).alias("gerr"), (F.col("event_type") != "error").alias("good"), F.lit(40.0).alias("model"),
        )

    # The table is dealt into several files and read one file a batch, so every user's rows span batches.
    events = table(spark, sf, "events")
    events.repartition(3, "event_id").write.parquet(f"{work}/in")
    q = score_stream(spark, f"{work}/in", events.schema, f"{work}/out", f"{work}/state", 8400.0, 8500.0, to_pixels, files_per_batch=1)
    q.awaitTermination()
    return latest_scores(spark, f"{work}/out").select("object_id", r6("chi2"), "ngood", r6("sigma"))
