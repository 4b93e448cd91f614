"""Job grid, resume and scoring on lineitem, supplier and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import RUNS, big, query, r6, runs, table
from spectraloom.operators import choose
from spectraloom.operators import suite as U

AGG = f"""{RUNS}, ok AS (SELECT * FROM runs WHERE NOT crashed),
agg AS (SELECT a.*, n_crashed, sigma_true, v_true FROM (
    SELECT scenario_id, axis, mode, count(*) AS n_replicates,
      {', '.join(f"avg(bias_{m}) AS mean_bias_{m}, coalesce(stddev_samp(bias_{m}), 0) AS std_bias_{m}" for m in U.MOMENTS)},
      avg(chi2_red) AS mean_chi2_red, avg(wall_time_s) AS mean_wall_time_s, max(wall_time_s) AS max_wall_time_s FROM ok GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT scenario_id, mode, count(*) FILTER (WHERE crashed) AS n_crashed FROM runs GROUP BY 1, 2) c USING (scenario_id, mode)
  LEFT JOIN (SELECT scenario_id, arg_min(sigma_true, seed) AS sigma_true, arg_min(v_true, seed) AS v_true FROM runs GROUP BY 1) t USING (scenario_id))"""
NUM = [f"{k}_bias_{m}" for m in U.MOMENTS for k in ("mean", "std")] + ["mean_chi2_red", "mean_wall_time_s", "max_wall_time_s", "sigma_true", "v_true"]


@query("aggregate_replicates", f"WITH {AGG} SELECT scenario_id, axis, mode, n_replicates, n_crashed, {', '.join(f'round({c}, 6) AS {c}' for c in NUM)} FROM agg")
def aggregate_replicates(spark, sf):
    return U.aggregate_replicates(runs(spark, sf)).select("scenario_id", "axis", "mode", "n_replicates", "n_crashed", *[r6(c) for c in NUM])


@query("replicate_truth", f"""
WITH {RUNS}, c AS (SELECT scenario_id, mode, count(*) FILTER (WHERE crashed) AS n_crashed FROM runs GROUP BY 1, 2),
t AS (SELECT scenario_id, arg_min(sigma_true, seed) AS sigma_true, arg_min(v_true, seed) AS v_true FROM runs GROUP BY 1)
SELECT scenario_id, mode, n_crashed, sigma_true, v_true FROM c LEFT JOIN t USING (scenario_id)""")
def replicate_truth(spark, sf):
    r = runs(spark, sf)
    crashed = r.groupBy("scenario_id", "mode").agg(F.count_if("crashed").alias("n_crashed"))
    return crashed.join(U.first_rows(r, ["scenario_id"], ["seed"], ["sigma_true", "v_true"]), "scenario_id", "left")


@query("flag_scenarios", f"""
WITH {AGG}, s AS (SELECT *, greatest(sigma_true, 1e-6) AS sc, {', '.join(f"CASE WHEN n_replicates > 1 AND std_bias_{m} > 0 THEN abs(mean_bias_{m}) / (std_bias_{m} / sqrt(n_replicates)) ELSE 0 END AS z_{m}" for m in U.MOMENTS)} FROM agg),
r AS (SELECT scenario_id, mode, concat_ws('; ',
  CASE WHEN abs(mean_bias_v) / sc > 0.05e0 AND z_v > 2 THEN 'bias_v' END, CASE WHEN abs(mean_bias_sigma) / sc > 0.1e0 AND z_sigma > 2 THEN 'bias_sigma' END,
  CASE WHEN abs(mean_bias_h3) > 0.03e0 AND z_h3 > 2 THEN 'bias_h3' END, CASE WHEN abs(mean_bias_h4) > 0.03e0 AND z_h4 > 2 THEN 'bias_h4' END,
  CASE WHEN mean_chi2_red < 0.85e0 OR mean_chi2_red > 1.2e0 THEN 'chi2_red' END, CASE WHEN n_crashed > 0 THEN n_crashed || ' crashed' END) AS reasons FROM s)
SELECT scenario_id, mode, reasons <> '' AS flagged, reasons FROM r""")
def flag_scenarios(spark, sf):
    return U.flag_scenarios(U.aggregate_replicates(runs(spark, sf))).select("scenario_id", "mode", "flagged", "reasons")


@query("head_to_head", f"""
WITH {AGG}, s AS (SELECT scenario_id, mode, sigma_true, abs(mean_bias_v) / greatest(sigma_true, 1e-6) AS bv, abs(mean_bias_sigma) / greatest(sigma_true, 1e-6) AS bs, mean_chi2_red AS c2 FROM agg),
j AS (SELECT a.scenario_id, a.sigma_true, a.bv AS bv_a, a.bs AS bs_a, a.c2 AS c2_a, b.bv AS bv_b, b.bs AS bs_b, b.c2 AS c2_b FROM s a JOIN s b ON a.scenario_id = b.scenario_id AND a.mode = 'A' AND b.mode = 'R')
SELECT scenario_id, sigma_true, {', '.join(f'round({c}_{k}, 6) AS {c}_{k}' for c in ('bv', 'bs', 'c2') for k in 'ab')},
  CASE WHEN abs(bv_a + bs_a - bv_b - bs_b) < 1e-6 THEN 'tie' WHEN bv_a + bs_a < bv_b + bs_b THEN 'A' ELSE 'R' END AS winner FROM j""")
def head_to_head(spark, sf):
    out = U.head_to_head(U.aggregate_replicates(runs(spark, sf)), "A", "R")
    return out.select("scenario_id", "sigma_true", *[r6(f"{c}_{k}") for c in ("bv", "bs", "c2") for k in "ab"], "winner")


@query("bias_table", f"""
WITH {RUNS} SELECT v_true, sigma_true, count(*) AS n_ok, {', '.join(f"round(avg(bias_{m}), 6) AS bias_{m}, round(stddev_pop(bias_{m}), 6) AS bias_{m}_std" for m in U.MOMENTS)} FROM runs WHERE NOT crashed GROUP BY 1, 2""")
def bias_table(spark, sf):
    return U.bias_table(runs(spark, sf)).select("v_true", "sigma_true", "n_ok", *[r6(f"bias_{m}{t}") for m in U.MOMENTS for t in ("", "_std")])


@query("sweep_verdict", f"""
WITH {RUNS}, d AS (SELECT sigma_true, avg(bias_v) AS v_bias, stddev_pop(bias_v) AS v_std, avg(bias_sigma) AS s_bias, stddev_pop(bias_sigma) AS s_std, count(*) AS n FROM runs WHERE NOT crashed GROUP BY 1)
SELECT sigma_true, n, round(v_bias, 6) AS v_bias, round(v_std, 6) AS v_std, round(s_bias, 6) AS s_bias, round(s_std, 6) AS s_std,
  CASE WHEN abs(v_bias) < greatest(3 * v_std, 5) AND v_std < 0.3e0 * sigma_true + 10 AND abs(s_bias) < 0.25e0 * sigma_true THEN 'OK' ELSE 'FAIL' END AS verdict FROM d""")
def sweep_verdict(spark, sf):
    return U.sweep_verdict(runs(spark, sf).filter("NOT crashed")).select("sigma_true", "n", r6("v_bias"), r6("v_std"), r6("s_bias"), r6("s_std"), "verdict")


@query("runtime_summary", f"""
WITH {RUNS}, d AS (SELECT scenario_id, mode, avg(wall_time_s) AS mean_s, max(wall_time_s) AS max_s FROM runs GROUP BY 1, 2)
SELECT d.scenario_id, d.mode, round(d.mean_s, 6) AS mean_s, round(d.max_s, 6) AS max_s, round(d.mean_s / b.mean_s, 6) AS ratio FROM d LEFT JOIN d b ON b.scenario_id = d.scenario_id AND b.mode = 'N'""")
def runtime_summary(spark, sf):
    out = U.runtime_summary(runs(spark, sf), ["scenario_id", "mode"], ["scenario_id"], "N")
    return out.select("scenario_id", "mode", r6("mean_s"), r6("max_s"), r6("ratio"))


@query("top_slowest", f"WITH {AGG} SELECT scenario_id, mode, round(mean_wall_time_s, 6) AS mean_s, round(max_wall_time_s, 6) AS max_s FROM agg ORDER BY mean_wall_time_s DESC, scenario_id, mode LIMIT 15")
def top_slowest(spark, sf):
    return U.top_slowest(U.aggregate_replicates(runs(spark, sf))).select("scenario_id", "mode", r6("mean_wall_time_s", "mean_s"), r6("max_wall_time_s", "max_s"))


JOBS = """sc AS (SELECT s_suppkey AS scenario_id, CASE s_suppkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'sigma' WHEN 2 THEN 'snr' ELSE 'bug' END AS axis FROM supplier),
jobs AS (SELECT scenario_id, axis, mode, CAST(seed AS BIGINT) AS seed FROM (
  SELECT *, unnest(range(1000, 1008)) AS seed FROM (SELECT *, unnest(CASE WHEN axis = 'base' THEN ['joint', 'poly_amp', 'none'] ELSE ['joint', 'poly_amp'] END) AS mode FROM sc)))"""


def _scenarios(spark, sf):
    k = F.col("s_suppkey")
    axis = F.when(k % 4 == 0, "base").when(k % 4 == 1, "sigma").when(k % 4 == 2, "snr").otherwise("bug")
    return table(spark, sf, "supplier").select(k.alias("scenario_id"), axis.alias("axis"))


@query("job_grid", f"WITH {JOBS} SELECT scenario_id, axis, mode, seed FROM jobs")
def job_grid(spark, sf):
    return U.plan_jobs(_scenarios(spark, sf), ["joint", "poly_amp"], 8).select("scenario_id", "axis", "mode", "seed")


@query("plan_jobs", f"WITH {JOBS} SELECT axis, mode, count(*) AS n, count(DISTINCT scenario_id) AS n_scenarios FROM jobs WHERE axis IN ('base', 'snr', 'sigma') GROUP BY 1, 2")
def plan_jobs(spark, sf):
    return U.plan_jobs(_scenarios(spark, sf), ["joint", "poly_amp"], 8, axes=["base", "snr", "sigma"]).groupBy("axis", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_id").alias("n_scenarios")
    )


@query("pending_jobs", """
WITH j AS (SELECT o_orderkey AS scenario_id, m AS mode, s AS seed FROM (SELECT *, unnest([1, 2, 3]) AS s FROM (SELECT o_orderkey, unnest(['A', 'N', 'R']) AS m FROM orders)))
SELECT scenario_id, mode, CAST(seed AS BIGINT) AS seed FROM j WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = scenario_id AND l_returnflag = mode AND l_linenumber = seed)""")
def pending_jobs(spark, sf):
    sc = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.lit("base").alias("axis"))
    jobs = U.plan_jobs(sc, ["A", "N", "R"], 3, extra_mode=None, first_seed=1).drop("axis")
    log = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_returnflag").alias("mode"), F.col("l_linenumber").cast("long").alias("seed"))
    return U.pending_jobs(jobs, log)


@query("distinct_trials", """
WITH t AS (SELECT l_orderkey AS object_id, l_quantity AS lam, l_extendedprice AS chi2, row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT object_id, lam, chi2 FROM t WHERE rn = 1""")
def distinct_trials(spark, sf):
    trials = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("object_id"), F.col("l_quantity").alias("lam"), F.col("l_extendedprice").alias("chi2"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )
    return choose.distinct_trials(trials)


@query("correct_bias", """
WITH cell AS (SELECT s_nationkey % 5 * 50e0 - 100 AS v_true, 50 + s_suppkey % 4 * 60e0 AS sigma_true,
    avg((l_quantity - 25) / 2) AS bias_v, stddev_pop((l_quantity - 25) / 2) AS bias_v_std, avg(l_extendedprice / 10000 - 4) AS bias_sigma, stddev_pop(l_extendedprice / 10000 - 4) AS bias_sigma_std
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity <> 1 GROUP BY 1, 2),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_partkey % 260 - 130 AS DOUBLE) AS v, 20 + l_quantity * 5 AS s FROM lineitem),
b AS (SELECT *, CASE WHEN v <= 100 THEN floor((v + 100) / 50) * 50 - 100 END AS v0, CASE WHEN s <= 230 THEN floor((s - 50) / 60) * 60 + 50 END AS s0 FROM q),
p AS (SELECT b.*, CASE WHEN v0 >= 100 THEN v0 ELSE v0 + 50 END AS v1, CASE WHEN s0 >= 230 THEN s0 ELSE s0 + 60 END AS s1 FROM b),
f AS (SELECT p.*, CASE WHEN v1 > v0 THEN (v - v0) / (v1 - v0) ELSE 0 END AS fv, CASE WHEN s1 > s0 THEN (s - s0) / (s1 - s0) ELSE 0 END AS fs FROM p),
nn AS (SELECT v, s, min(struct_pack(d := (v_true - v) ** 2 + (sigma_true - s) ** 2, v := v_true, s := sigma_true)) AS k FROM (SELECT DISTINCT v, s FROM q) JOIN cell ON true GROUP BY 1, 2),
o AS (SELECT f.*, """ + ", ".join(
    f"coalesce((1 - fv) * ((1 - fs) * a.{c} + fs * b.{c}) + fv * ((1 - fs) * c.{c} + fs * d.{c}), n.{c}) AS x_{c}" for c in ("bias_v", "bias_v_std", "bias_sigma", "bias_sigma_std")
) + """ FROM f JOIN nn ON nn.v = f.v AND nn.s = f.s JOIN cell n ON n.v_true = k.v AND n.sigma_true = k.s
  LEFT JOIN cell a ON a.v_true = v0 AND a.sigma_true = s0 LEFT JOIN cell b ON b.v_true = v0 AND b.sigma_true = s1
  LEFT JOIN cell c ON c.v_true = v1 AND c.sigma_true = s0 LEFT JOIN cell d ON d.v_true = v1 AND d.sigma_true = s1)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, round(v - x_bias_v, 6) AS v_corrected, round(x_bias_v_std, 6) AS v_inflation, round(s - x_bias_sigma, 6) AS sigma_corrected, round(x_bias_sigma_std, 6) AS sigma_inflation FROM o""")
def correct_bias(spark, sf):
    li = table(spark, sf, "lineitem")
    r = runs(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scenario_id"), "s_nationkey"), "scenario_id")
    r = r.withColumn("v_true", F.col("s_nationkey") % 5 * 50.0 - 100).withColumn("sigma_true", 50 + F.col("scenario_id") % 4 * 60.0)
    q = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 260 - 130).cast("double").alias("v_rec"), (20 + F.col("l_quantity") * 5).alias("sigma_rec"))
    out = U.correct_bias(q, U.bias_table(r))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", *[r6(c) for c in ("v_corrected", "v_inflation", "sigma_corrected", "sigma_inflation")])
