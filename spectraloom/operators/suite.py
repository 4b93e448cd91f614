"""Validation suite: job grid, resume, scoring, flags, comparison, bias correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.plans.scale import attach, cut

JOB = ["scenario_id", "mode", "seed"]
# Fixed thresholds of the flag rules.
BIAS_V_SHARE, BIAS_SIGMA_SHARE, BIAS_H, SIGNIFICANCE, CHI2_LOW, CHI2_HIGH = 0.05, 0.10, 0.03, 2.0, 0.85, 1.20


def plan_jobs(
    scenarios: DataFrame, modes: Sequence[str], seeds: int, axes: Sequence[str] | None = None,
    only_axis: str | None = None, extra_mode: str | None = "none", extra_axis: str = "base", first_seed: int = 1000,
) -> DataFrame:
    """Scenario x mode x seed; the base case gets one extra mode. The short axes are literals,
    so the grid is an explode of the scenario rows, not a join."""
    picked = scenarios
    if only_axis is not None:
        picked = picked.filter(F.col("axis") == only_axis)
    elif axes is not None:
        picked = picked.filter(F.col("axis").isin(list(axes)))
    usual = F.array(*[F.lit(m) for m in modes])
    if extra_mode is not None:
        usual = F.when(F.col("axis") == extra_axis, F.array_append(usual, F.lit(extra_mode))).otherwise(usual)
    return picked.withColumn("mode", F.explode(usual)).withColumn(
        "seed", F.explode(F.sequence(F.lit(first_seed).cast("long"), F.lit(first_seed + seeds - 1).cast("long")))
    )


def truth_grid(spark, v_values: Sequence[float], sigma_values: Sequence[float], seeds: int) -> DataFrame:
    """Truth grid of a bias assessment (v x sigma x seed), built as a sequence of ids."""
    nv, ns = len(v_values), len(sigma_values)
    ids = spark.range(nv * ns * seeds)
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (i + 1).cast("int"))
    return ids.select(
        F.col("id").alias("job_id"), pick(v_values, F.floor(F.col("id") / (ns * seeds))).alias("v_true"),
        pick(sigma_values, F.floor(F.col("id") / seeds) % ns).alias("sigma_true"), (F.col("id") % seeds).alias("seed"),
    )


def pending_jobs(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs without a row in the log; log keys are deduplicated map-side before the join."""
    return jobs.join(log.select(*JOB).distinct(), JOB, "left_anti")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``: one aggregate, partial on the map side."""
    row = F.min(F.struct(*order, *[c for c in keep if c not in order]))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in keep])


MOMENTS = ("v", "sigma", "h3", "h4")


def aggregate_replicates(runs: DataFrame) -> DataFrame:
    """Per (scenario, axis, mode): replicate means and spreads without crashed rows, crash counts, truth."""
    ok = runs.filter(~F.col("crashed"))
    stats = []
    for m in MOMENTS:
        stats += [F.avg(f"bias_{m}").alias(f"mean_bias_{m}"),
                  F.coalesce(F.stddev_samp(f"bias_{m}"), F.lit(0.0)).alias(f"std_bias_{m}")]
    agg = ok.groupBy("scenario_id", "axis", "mode").agg(
        F.count(F.lit(1)).alias("n_replicates"), *stats, F.avg("chi2_red").alias("mean_chi2_red"),
        F.avg("wall_time_s").alias("mean_wall_time_s"), F.max("wall_time_s").alias("max_wall_time_s"),
    )
    crashed = runs.groupBy("scenario_id", "mode").agg(F.count_if("crashed").alias("n_crashed"))
    truth = first_rows(runs, ["scenario_id"], ["seed"], ["sigma_true", "v_true"])
    return agg.join(crashed, ["scenario_id", "mode"], "left").join(truth, ["scenario_id"], "left")


def flag_scenarios(agg: DataFrame) -> DataFrame:
    """Threshold rules with reasons. A bias counts only beyond two standard errors; one replicate
    or zero scatter is never significant."""
    n = F.col("n_replicates")
    reasons = []

    def significance(m):
        sem = F.col(f"std_bias_{m}") / F.sqrt(n)
        return F.when((n > 1) & (sem > 0), F.abs(f"mean_bias_{m}") / sem).otherwise(0.0)

    scale = F.greatest("sigma_true", F.lit(1e-6))
    for m, share in (("v", BIAS_V_SHARE), ("sigma", BIAS_SIGMA_SHARE)):
        bad = (F.abs(f"mean_bias_{m}") / scale > share) & (significance(m) > SIGNIFICANCE)
        reasons.append(F.when(bad, f"bias_{m}"))
    for m in ("h3", "h4"):
        bad = (F.abs(f"mean_bias_{m}") > BIAS_H) & (significance(m) > SIGNIFICANCE)
        reasons.append(F.when(bad, f"bias_{m}"))
    chi = F.col("mean_chi2_red")
    reasons.append(F.when((chi < CHI2_LOW) | (chi > CHI2_HIGH), "chi2_red"))
    reasons.append(F.when(F.col("n_crashed") > 0, F.concat(F.col("n_crashed").cast("string"), F.lit(" crashed"))))
    found = F.array_compact(F.array(*reasons))
    return agg.withColumn("flagged", F.size(found) > 0).withColumn("reasons", F.concat_ws("; ", found))


def head_to_head(agg: DataFrame, a: str, b: str) -> DataFrame:
    """Two modes of one scenario side by side; the smaller summed |bias| / sigma wins, ties below 1e-6."""
    s = F.greatest("sigma_true", F.lit(1e-6))
    scored = agg.filter(F.col("mode").isin(a, b)).select(
        "scenario_id", "mode", "sigma_true", (F.abs("mean_bias_v") / s).alias("bv"),
        (F.abs("mean_bias_sigma") / s).alias("bs"), F.col("mean_chi2_red").alias("c2"),
    )

    def arm(mode, c):
        return F.max(F.when(F.col("mode") == mode, F.col(c)))

    wide = scored.groupBy("scenario_id").agg(
        F.max("sigma_true").alias("sigma_true"),
        *[arm(m, c).alias(f"{c}_{k}") for k, m in (("a", a), ("b", b)) for c in ("bv", "bs", "c2")],
        F.count_distinct("mode").alias("_arms"),
    ).filter("_arms = 2").drop("_arms")
    gap = (F.col("bv_a") + F.col("bs_a")) - (F.col("bv_b") + F.col("bs_b"))
    return wide.withColumn("winner", F.when(F.abs(gap) < 1e-6, "tie").when(gap < 0, a).otherwise(b))


def bias_table(runs: DataFrame, keys: Sequence[str] = ("v_true", "sigma_true")) -> DataFrame:
    """Mean and population spread of the biases of successful runs per truth cell."""
    stats = []
    for m in MOMENTS:
        stats += [F.avg(f"bias_{m}").alias(f"bias_{m}"), F.stddev_pop(f"bias_{m}").alias(f"bias_{m}_std")]
    return runs.filter(~F.col("crashed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ok"), *stats)


def sweep_verdict(df: DataFrame) -> DataFrame:
    """Per true sigma: is the scatter of the recovered values tight enough?"""
    d = df.groupBy("sigma_true").agg(
        F.avg("bias_v").alias("v_bias"), F.stddev_pop("bias_v").alias("v_std"),
        F.avg("bias_sigma").alias("s_bias"), F.stddev_pop("bias_sigma").alias("s_std"), F.count(F.lit(1)).alias("n"),
    )
    ok = (
        (F.abs("v_bias") < F.greatest(3 * F.col("v_std"), F.lit(5.0)))
        & (F.col("v_std") < 0.3 * F.col("sigma_true") + 10) & (F.abs("s_bias") < 0.25 * F.col("sigma_true"))
    )
    return d.withColumn("verdict", F.when(ok, "OK").otherwise("FAIL"))


def runtime_summary(runs: DataFrame, by: Sequence[str], within: Sequence[str], baseline: str) -> DataFrame:
    """Mean and longest seconds per group and the ratio to the baseline group (``mode`` = baseline)."""
    d = runs.groupBy(*by).agg(F.avg("wall_time_s").alias("mean_s"), F.max("wall_time_s").alias("max_s"))
    base = d.filter(F.col("mode") == baseline).select(*within, F.col("mean_s").alias("_base"))
    return d.join(base, list(within), "left").withColumn("ratio", F.try_divide("mean_s", "_base")).drop("_base")


def top_slowest(agg: DataFrame, n: int = 15) -> DataFrame:
    return agg.orderBy(F.desc("mean_wall_time_s"), "scenario_id", "mode").limit(n)


def correct_bias(df: DataFrame, table: DataFrame, v: str = "v_rec", sigma: str = "sigma_rec") -> DataFrame:
    """Subtract the bias interpolated at (v, sigma); the spread of the table passes through.

    Bilinear inside the rectangular truth grid, the nearest cell outside it, on holes, or with fewer
    than four cells. The truth grid is a short table written by hand (its size is checked), so its
    axes travel as literals and every query row finds its bracket without a join on ranges.
    """
    cells = cut(table).select("v_true", "sigma_true", *[f"bias_{m}{t}" for m in ("v", "sigma") for t in ("", "_std")])
    n = cells.limit(4_097).count()
    if n == 0:
        raise ValueError("the bias table is empty")
    if n > 4_096:
        raise ValueError("a truth grid has at most 4096 cells")
    vs, ss = cells.agg(F.array_sort(F.collect_set("v_true")), F.array_sort(F.collect_set("sigma_true"))).first()
    names = ["bias_v", "bias_v_std", "bias_sigma", "bias_sigma_std"]
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    d = df.withColumn("_v", F.col(v)).withColumn("_s", F.col(sigma))
    for a, axis in (("v", vs), ("s", ss)):
        q, inside = F.col(f"_{a}"), F.col(f"_{a}") <= float(axis[-1])
        d = d.withColumn(f"_{a}0", F.when(inside, F.array_max(F.filter(arr(axis), lambda e: e <= q))))
        d = d.withColumn(f"_{a}1", F.when(inside, F.coalesce(F.array_min(F.filter(arr(axis), lambda e: e > q)), F.col(f"_{a}0"))))

    def cell(tag, v_at, s_at):
        packed = cells.select(F.col("v_true").alias(v_at), F.col("sigma_true").alias(s_at), F.struct(*names).alias(tag))
        return F.broadcast(packed)  # its size was checked above

    for i in "01":
        for j in "01":
            d = d.join(cell(f"_c{i}{j}", f"_v{i}", f"_s{j}"), [f"_v{i}", f"_s{j}"], "left")
    full = F.lit(n >= 4)
    for i in "01":
        for j in "01":
            full = full & F.col(f"_c{i}{j}").isNotNull()
    keys = arr_cells(cells)
    near = F.array_min(F.transform(keys, lambda k: F.struct(
        (F.pow(k["v"] - F.col("_v"), F.lit(2.0)) + F.pow(k["s"] - F.col("_s"), F.lit(2.0))).alias("d"), k["v"].alias("v"), k["s"].alias("s")
    )))
    d = d.withColumn("_full", full).withColumn("_near", F.when(~F.col("_full"), near))
    d = d.withColumn("_nv", F.col("_near.v")).withColumn("_ns", F.col("_near.s")).join(cell("_cn", "_nv", "_ns"), ["_nv", "_ns"], "left")
    fv = F.coalesce(F.try_divide(F.col("_v") - F.col("_v0"), F.col("_v1") - F.col("_v0")), F.lit(0.0))
    fs = F.coalesce(F.try_divide(F.col("_s") - F.col("_s0"), F.col("_s1") - F.col("_s0")), F.lit(0.0))

    def at(name):
        c = {(i, j): F.col(f"_c{i}{j}.{name}") for i in "01" for j in "01"}
        low = (1 - fs) * c["0", "0"] + fs * c["0", "1"]
        high = (1 - fs) * c["1", "0"] + fs * c["1", "1"]
        return F.when(F.col("_full"), (1 - fv) * low + fv * high).otherwise(F.col(f"_cn.{name}"))

    return d.select(
        *df.columns, (F.col(v) - at("bias_v")).alias("v_corrected"), at("bias_v_std").alias("v_inflation"),
        (F.col(sigma) - at("bias_sigma")).alias("sigma_corrected"), at("bias_sigma_std").alias("sigma_inflation"),
    )


def arr_cells(cells: DataFrame):
    """Coordinates of a (checked) truth grid as one array literal."""
    rows = cells.select("v_true", "sigma_true").distinct().orderBy("v_true", "sigma_true").collect()
    return F.array(*[F.struct(F.lit(float(r[0])).alias("v"), F.lit(float(r[1])).alias("s")) for r in rows])
