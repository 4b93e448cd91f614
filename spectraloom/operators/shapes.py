"""Synthetic spectrum shapes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import col
from spectraloom.functions.lines import TRIPLET_CENTRES, TRIPLET_DEPTHS, TRIPLET_WIDTH, WEAK_LINES
from spectraloom.plans.scale import attach


def dips(x, features: list[tuple[float, float, float]]) -> Column:
    """1 - sum of Gaussian dips (centre, depth, width)."""
    out = F.lit(1.0)
    for centre, depth, width in features:
        out = out - depth * F.exp(-0.5 * F.pow((col(x) - centre) / width, F.lit(2.0)))
    return out


def triplet_template(x) -> Column:
    return dips(x, [(c, d, TRIPLET_WIDTH) for c, d in zip(TRIPLET_CENTRES, TRIPLET_DEPTHS)])


def forest_template(x) -> Column:
    return dips(x, [(c, d, TRIPLET_WIDTH) for c, d in zip(TRIPLET_CENTRES, TRIPLET_DEPTHS)] + WEAK_LINES)


def normalised_axis(df: DataFrame, keys: list[str]) -> DataFrame:
    """``xn`` = (x - mean) over half the range, and the first coordinate, per key."""
    facts = df.groupBy(*keys).agg(
        F.avg("x").alias("_m"), F.min("x").alias("x_first"), (0.5 * (F.max("x") - F.min("x"))).alias("_h")
    )
    return attach(df, facts, keys).withColumn("xn", (F.col("x") - F.col("_m")) / F.nullif("_h", F.lit(0.0))).drop("_m", "_h")


def galaxy_continuum(x, xn, first, level: float = 12_000.0, fringe: float = 0.01) -> Column:
    """Cubic slope plus a broad hump plus interference fringes of period 50. All coefficients."""
    q = col(xn)
    slope = 1 + 0.8 * q + 0.5 * q * q - 0.1 * q * q * q
    hump = 0.5 * F.exp(-0.5 * F.pow((q - 0.2) / 0.45, F.lit(2.0)))
    wave = fringe * F.sin(2 * math.pi * (col(x) - col(first)) / 50.0)
    return level * (slope + hump + wave)


def linear_tilt(xn, slope: float = 0.05) -> Column:
    return 1 + slope * col(xn)
