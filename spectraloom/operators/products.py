"""Result tables: error tables, simulation export, diagnostics, fit products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators import stats as S
from spectraloom.operators.pixels import OBJ
from spectraloom.plans.scale import quantiles

BY = ["object_id", "bin"]


def losvd_error_table(point: DataFrame, err: DataFrame | None = None, interval: DataFrame | None = None) -> DataFrame:
    """(bin, v, b, err, lo, hi); a missing error is 0, a missing bound is b -+ err."""
    out = point
    out = out.join(err, BY, "left") if err is not None else out.withColumn("err", F.lit(None).cast("double"))
    if interval is None:
        out = out.withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double"))
    else:
        out = out.join(interval, BY, "left")
    out = out.withColumn("err", F.coalesce("err", F.lit(0.0)))
    return out.withColumn("lo", F.coalesce("lo", F.col("b") - F.col("err"))).withColumn(
        "hi", F.coalesce("hi", F.col("b") + F.col("err"))
    )


def moment_error_table(wide: DataFrame, params: list[str]) -> DataFrame:
    """Long form of ``p, p_err, p_lo, p_hi`` columns; what is missing stays null."""
    have = set(wide.columns)

    def pick(c):
        return (F.col(c) if c in have else F.lit(None)).cast("double")

    rows = F.array(*[
        F.struct(F.lit(p).alias("parameter"), pick(p).alias("value"), pick(f"{p}_err").alias("err"),
                 pick(f"{p}_lo").alias("lo"), pick(f"{p}_hi").alias("hi"))
        for p in params
    ])
    return wide.select("object_id", F.explode(rows).alias("_r")).select("object_id", "_r.*")


def simulation_table(point: DataFrame, reps: DataFrame, w_point: DataFrame | None = None, w_reps: DataFrame | None = None) -> DataFrame:
    """Histogram rows, template-weight rows and flux-weighted centres, per replicate (-1 = point estimate).

    Kept long: the number of replicates is open, so they are rows, not columns.
    """
    none = F.lit(-1).cast("long")
    all_b = point.select(*BY, "v", none.alias("rep"), "b").unionByName(reps.select(*BY, "v", F.col("rep").cast("long").alias("rep"), "b"))
    total = F.sum("b")
    out = all_b.select("object_id", F.lit("losvd").alias("kind"), F.col("bin").cast("long").alias("row"), "rep", F.col("b").alias("value"))
    if w_point is not None:
        w = w_point.select("object_id", "tpl", none.alias("rep"), "w").unionByName(
            w_reps.select("object_id", "tpl", F.col("rep").cast("long").alias("rep"), "w")
        )
        out = out.unionByName(w.select("object_id", F.lit("weight").alias("kind"), F.col("tpl").cast("long").alias("row"), "rep", F.col("w").alias("value")))
    centre = all_b.groupBy("object_id", "rep").agg(
        (F.sum(F.col("v") * F.col("b")) / F.when(total > 0, total).otherwise(1.0)).alias("value")
    )
    return out.unionByName(centre.select("object_id", F.lit("centre").alias("kind"), F.lit(0).cast("long").alias("row"), "rep", "value"))


def simulation_matrix(sim: DataFrame, replicates: list[int]) -> DataFrame:
    """Export layout of a chosen set of replicates: one column each."""
    return sim.groupBy("object_id", "kind", "row").pivot("rep", replicates).agg(F.first("value"))


def percentile_table(reps: DataFrame) -> DataFrame:
    return quantiles(reps, BY, "b", {"p50": 0.5, "p5": 0.05, "p16": 0.16, "p84": 0.84, "p95": 0.95})


def bootstrap_diagnostics(df: DataFrame) -> DataFrame:
    """Totals, convergence rate in percent and a flag below 95."""
    d = df.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("converged").alias("n_converged"))
    rate = F.when(F.col("n_total") > 0, 100.0 * F.col("n_converged") / F.col("n_total")).otherwise(0.0)
    return d.select(*OBJ, "n_total", "n_converged", (F.col("n_total") - F.col("n_converged")).alias("n_failed"),
                    rate.alias("rate"), (rate < 95).alias("low_rate"))


def fit_quality(pix: DataFrame, model: str = "model", params: int = 0) -> DataFrame:
    """One row per object: chi2, valid pixels, reduced chi2, rms."""
    c = S.chi2(pix, OBJ, model)
    return c.withColumn("chi2_red", S.chi2_reduced("params", params)).join(S.rms(pix, OBJ, model), OBJ, "left")


def fit_products(pix: DataFrame, losvd: DataFrame, weights: DataFrame, params: int = 0) -> dict[str, DataFrame]:
    """The four result tables of a fit: histogram, template fractions, per-pixel model, quality."""
    per_pixel = pix.select(
        *OBJ, "pix", "x", F.col("g").alias("data"), "model",
        *[c for c in ("cont", "tmix") if c in pix.columns], (~F.col("good")).alias("rejected"),
    )
    return {
        "losvd": losvd, "fractions": S.fractions(weights, OBJ), "pixels": per_pixel,
        "quality": fit_quality(pix, "model", params),
    }


def write_products(tables: dict[str, DataFrame], path: str, buckets: int = 64) -> None:
    """Parquet per table, clustered by a hash bucket of the object so one object reads one folder."""
    for name, t in tables.items():
        bucket = F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")
        t.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def write_eigen_library(eigen: DataFrame, path: str) -> None:
    """Reduced templates with a constant error of 0.001, and their manifest."""
    eigen.withColumn("err", F.lit(0.001)).write.mode("overwrite").parquet(f"{path}/templates")
    eigen.select("component").distinct().withColumn(
        "entry", F.format_string("eigen_%03d", F.col("component"))
    ).write.mode("overwrite").parquet(f"{path}/manifest")
