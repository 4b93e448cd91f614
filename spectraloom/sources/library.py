"""Template libraries: metadata selection, packing onto one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.operators.resample import interp_templates
from spectraloom.plans.scale import is_small


def epsilon_join(
    left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], tol: float = 1e-3, rtol: float = 1e-5
) -> DataFrame:
    """Inner join on |a - b| <= tol + rtol * |b| for every (a, b).

    The right side falls into classes by the size of its tolerance, each with buckets at least twice as wide, so a row
    is copied into two buckets at most; the left side looks into the bucket of every class (a few, their number
    grows with the logarithm of the values). The rest is an equi-join, in which only a right side counted as small is
    broadcast: the size of a file says little of the size of its rows.
    """
    for i, (a, b) in enumerate(pairs):
        reach = tol + rtol * F.abs(b)
        size = F.greatest(F.lit(0), F.ceil(F.log2(reach / tol))).cast("int")
        width = 2 * tol * F.pow(F.lit(2.0), F.col(f"_c{i}"))
        right = right.withColumn(f"_c{i}", size).withColumn(f"_b{i}", F.explode(F.sequence(F.floor((F.col(b) - reach) / width), F.floor((F.col(b) + reach) / width))))
        top = right.agg(F.max(f"_c{i}")).first()[0] or 0
        left = left.withColumn(f"_c{i}", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn(f"_b{i}", F.floor(F.col(a) / width))
    cols = [f"_{x}{i}" for i in range(len(pairs)) for x in "cb"]
    out = left.join(F.broadcast(right) if is_small(right) else right.hint("merge"), cols)
    for a, b in pairs:
        out = out.filter(F.abs(F.col(a) - F.col(b)) <= tol + rtol * F.abs(b))
    return out.drop(*cols)


def select_templates(library: DataFrame, requests: DataFrame, tol: float = 1e-3) -> DataFrame:
    """First library entry (by ``ord``) for every requested (age, metal), in request order.

    ``library(name, ord, age, metal)``, ``requests(req, req_age, req_metal)``.
    """
    hits = epsilon_join(library, requests, [("age", "req_age"), ("metal", "req_metal")], tol)
    return hits.groupBy("req", "req_age", "req_metal").agg(F.min_by(F.struct("name", "age", "metal"), "ord").alias("_h")).select(
        "req", "req_age", "req_metal", "_h.*"
    )


def unmatched_requests(library: DataFrame, requests: DataFrame, tol: float = 1e-3) -> DataFrame:
    return requests.join(select_templates(library, requests, tol).select("req"), "req", "left_anti")


def require_templates(library: DataFrame, requests: DataFrame, tol: float = 1e-3) -> DataFrame:
    """``select_templates`` that raises when a request has no match (a request list is short)."""
    missing = unmatched_requests(library, requests, tol).limit(5).collect()
    if missing:
        raise ValueError(f"no template for {[(r.req_age, r.req_metal) for r in missing]}")
    return select_templates(library, requests, tol)


def grids_of(tpl: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free signature of each template's grid."""
    return tpl.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_wave"), F.min("wave").alias("first"), F.max("wave").alias("last"),
        F.bit_xor(F.xxhash64("wave")).alias("grid"),
    )


def pack_library(tpl: DataFrame, lo: float | None = None, hi: float | None = None, shared: bool = True) -> DataFrame:
    """One table ``(tpl_id, wave, flux)`` on one grid, trimmed to the half-open [lo, hi).

    ``shared`` libraries must already be on one grid (checked); otherwise all templates go onto a
    union grid at a sixteenth of the finest step.
    """
    if shared:
        if grids_of(tpl, ["tpl_id"]).select("n_wave", "grid").distinct().limit(2).count() > 1:
            raise ValueError("templates do not share one wavelength grid")
        out = tpl.select("tpl_id", "wave", "flux")
    else:
        w = Window.partitionBy("tpl_id").orderBy("wave")
        steps = tpl.select("tpl_id", "wave", (F.lead("wave").over(w) - F.col("wave")).alias("d"))
        row = steps.agg(F.min("d"), F.min("wave"), F.max("wave")).first()
        step, first, last = row[0] / 16, row[1], row[2]
        n = max(int(-(-(last - first) // step)), 1)
        grid = tpl.sparkSession.range(n).select((F.lit(first) + F.col("id") * step).alias("x"))
        out = interp_templates(grid, tpl).select("tpl_id", F.col("x").alias("wave"), F.col("t").alias("flux"))
    if lo is not None:
        out = out.filter((F.col("wave") >= lo) & (F.col("wave") < hi))
    return out


def write_library(packed: DataFrame, meta: DataFrame, path: str) -> None:
    packed.write.mode("overwrite").parquet(f"{path}/flux")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
