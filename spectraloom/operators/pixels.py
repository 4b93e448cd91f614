"""Pixel-table preparation: axes, frames, error policy, region selection.

A pixel table is ``(object_id, pix, x, g, gerr, good)`` with ``pix`` dense from 0 in each object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import MASKED_ERROR, col, finite
from spectraloom.plans.scale import attach, quantiles

OBJ = ["object_id"]


def affine_axis(df: DataFrame, start, step, name: str = "x") -> DataFrame:
    return df.withColumn(name, F.lit(start) + F.lit(step) * F.col("pix"))


def generated_axis(objects: DataFrame, n, start, step) -> DataFrame:
    """``n`` samples per object on an affine axis."""
    n = F.lit(n) if isinstance(n, int) else n
    return objects.withColumn("pix", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).withColumn(
        "x", F.lit(start) + F.lit(step) * F.col("pix")
    )


def detect_index_axis(df: DataFrame, start: float, step: float, raw: str = "c1") -> DataFrame:
    """First column read as an index (all integral, first below 100) or as the coordinate itself."""
    facts = df.groupBy(*OBJ).agg(
        F.every(F.col(raw) == F.floor(raw)).alias("_int"), F.min_by(raw, "pix").alias("_first")
    ).select(*OBJ, (F.col("_int") & (F.col("_first") < 100)).alias("is_index"))
    return attach(df, facts, OBJ).withColumn(
        "x", F.when(F.col("is_index"), start + step * F.col("pix")).otherwise(F.col(raw))
    )


def resolve_frame(df: DataFrame, z, lo: float, hi: float, frame: str = "auto") -> DataFrame:
    """Coordinate in the chosen frame; ``auto`` divides by 1+z only if that puts more samples in (lo, hi)."""
    rest = F.col("x") / (1 + col(z))
    if frame == "rest":
        return df.withColumn("x_fit", F.col("x")).withColumn("shifted", F.lit(False))
    if frame == "observed":
        return df.withColumn("x_fit", rest).withColumn("shifted", F.lit(True))

    def inside(c: Column) -> Column:
        return F.count_if((c > lo) & (c < hi))

    votes = df.groupBy(*OBJ).agg((inside(rest) > inside(F.col("x"))).alias("shifted"))
    return attach(df, votes, OBJ).withColumn(
        "x_fit", F.when(F.col("shifted"), rest).otherwise(F.col("x"))
    )


def apply_error_policy(df: DataFrame, policy: str, value=None) -> DataFrame:
    """Errors: 'unit', 'file', 'scalar' (value), 'column' (value), or 'median' of positive errors."""
    if policy == "unit":
        return df.withColumn("gerr", F.lit(1.0))
    if policy == "file":
        return df
    if policy == "scalar":
        return df.withColumn("gerr", F.lit(float(value)))
    if policy == "column":
        return df.withColumn("gerr", col(value))
    if policy != "median":
        raise ValueError(f"unknown error policy {policy!r}")
    positive = F.when((F.col("gerr") > 0) & finite("gerr"), F.col("gerr"))
    med = quantiles(df, OBJ, positive, {"_med": 0.5})
    return attach(df.drop("gerr"), med, OBJ).withColumn("gerr", F.coalesce("_med", F.lit(1.0))).drop("_med")


def sanitise(df: DataFrame) -> DataFrame:
    """Non-finite samples, non-positive errors and errors marked as masked are masked; non-finite flux becomes 0."""
    ok = finite("x") & finite("g") & finite("gerr") & F.coalesce((F.col("gerr") > 0) & (F.col("gerr") < MASKED_ERROR), F.lit(False))
    return df.withColumn("good", F.coalesce(F.col("good"), F.lit(True)) & ok).withColumn(
        "g", F.when(finite("g"), F.col("g")).otherwise(0.0)
    )


def select_region(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Open interval on ``x``; a plain filter, so it reaches the scan."""
    return df.filter((F.col("x") > lo) & (F.col("x") < hi))


def count_in_window(df: DataFrame, lo: float, hi: float) -> DataFrame:
    return df.groupBy(*OBJ).agg(F.count_if((F.col("x") > lo) & (F.col("x") < hi)).alias("n_in"))


def require_pixels(df: DataFrame, n: int) -> DataFrame:
    """Keep the series that have at least ``n`` samples."""
    enough = df.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(*OBJ)
    return df.join(enough, OBJ, "left_semi")


def scaled_coordinate(df: DataFrame) -> DataFrame:
    """(x - mean) / (max - min), scale 1 where degenerate."""
    facts = df.groupBy(*OBJ).agg(F.avg("x").alias("_m"), (F.max("x") - F.min("x")).alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return attach(df, facts, OBJ).withColumn("xs", (F.col("x") - F.col("_m")) / scale).drop("_m", "_s")


def velocity_grid(objects: DataFrame, n: int, vmin=None, vmax=None, sigma=None) -> DataFrame:
    """``n`` evenly spaced velocities between bounds, or over +-4.5 sigma."""
    lo = F.lit(vmin) if vmin is not None else -4.5 * col(sigma)
    hi = F.lit(vmax) if vmax is not None else 4.5 * col(sigma)
    return objects.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max(n, 3) - 1)))).withColumn(
        "v", lo + (hi - lo) * F.col("bin") / (max(n, 3) - 1)
    )


def fine_grid_size(span, step, x_ref) -> Column:
    """Number of fine velocity samples; the rounding here is half-even."""
    from spectraloom.functions.columns import C_KMS

    return F.greatest(F.lit(3), (F.rint(col(span) / col(step) * col(x_ref) / C_KMS) * 2).cast("int"))


def median_step(df: DataFrame) -> DataFrame:
    """Median sampling step per object; ``step`` is null where it is not positive or undefined."""
    from spectraloom.plans.scale import halo

    steps = halo(df, OBJ, 1, lambda w: {"_d": F.lead("x").over(w) - F.col("x")})
    med = quantiles(steps, OBJ, "_d", {"step": 0.5})
    return med.withColumn("step", F.when(F.col("step") > 0, F.col("step")))
