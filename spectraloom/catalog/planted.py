"""Solvers on noise-free inputs built from the given tables, where SQL can state the exact answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import PIXELS, hist, pixels, query, table
from spectraloom.functions.columns import gh_profile
from spectraloom.operators import solve
from spectraloom.operators.describe import gh_fit, gh_fit_higher
from spectraloom.operators.pixels import OBJ

PROFILE_SQL = "SELECT vec_id AS object_id, (vec_id % 21 - 10) * 10 AS vel, 60 + vec_id % 40 AS sigma, {zeros}, true AS converged FROM embeddings"


def _profiles(spark, sf):
    """A Gaussian per vector, its centre and width given by the vector's id, on the histogram grid."""
    w = (F.col("v") - (F.col("object_id") % 21 - 10) * 10) / (60 + F.col("object_id") % 40)
    return hist(spark, sf).select("object_id", "bin", "v", F.exp(-0.5 * w * w).alias("b"))


def _rounded(fits, orders):
    whole = lambda c, k=1: F.round(F.col(c) * k).cast("long").alias(c)
    return fits.select("object_id", whole("vel"), whole("sigma"), *[whole(f"h{n}", 10) for n in orders], "converged")


@query("gh_fit_planted", PROFILE_SQL.format(zeros="CAST(0 AS BIGINT) AS h3, CAST(0 AS BIGINT) AS h4"))
def gh_planted(spark, sf):
    return _rounded(gh_fit(_profiles(spark, sf), OBJ), [3, 4])


@query("gh_fit_higher_planted", PROFILE_SQL.format(zeros=", ".join(f"CAST(0 AS BIGINT) AS h{n}" for n in (3, 4, 5, 6))))
def gh_higher_planted(spark, sf):
    return _rounded(gh_fit_higher(_profiles(spark, sf), OBJ), [3, 4, 5, 6])


@query("fit_mixture_planted", """
SELECT vec_id AS object_id, l.label AS tpl_id, (vec_id + 7 * l.label) % 4 AS parts
FROM embeddings CROSS JOIN (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings) l""")
def mixture_planted(spark, sf):
    lib = hist(spark, sf).groupBy(F.col("label").cast("long").alias("tpl_id"), F.col("bin").cast("long").alias("pix")).agg((1 + F.avg("raw")).alias("t"))
    ids = sorted(r[0] for r in lib.select("tpl_id").distinct().collect())  # the labels of the table, ten
    parts = lambda i: (F.col("object_id") + 7 * i) % 4
    total = sum((parts(i) for i in ids), F.lit(0))
    # Each vector mixes the label means in whole parts.
    objects = table(spark, sf, "embeddings").select(F.col("vec_id").alias("object_id"), F.explode(F.array(*[F.lit(i) for i in ids])).alias("tpl_id"))
    mixed = objects.withColumn("part", parts(F.col("tpl_id"))).filter("part > 0").join(lib, "tpl_id")
    px = mixed.groupBy("object_id", "pix").agg(F.sum(F.col("part") * F.col("t")).alias("g")).withColumn("g", F.col("g") / total)
    px = px.withColumn("gerr", F.lit(0.1)).withColumn("good", F.lit(True))
    fit = solve.fit_mixture(px, lib, ids)
    return fit.select("object_id", "tpl_id", F.round(F.col("w") * total).cast("long").alias("parts"))


LEVEL_SQL = f"WITH {PIXELS} SELECT object_id, pix, round(2 + 0.01e0 * object_id, 4) AS level FROM pixels"


def _levels(spark, sf):
    """Level series: a penalty on differences leaves them as they are."""
    return pixels(spark, sf).withColumn("g", 2 + 0.01 * F.col("object_id"))


@query("fit_pspline_planted", LEVEL_SQL)
def pspline_planted(spark, sf):
    return solve.fit_pspline(_levels(spark, sf)).select("object_id", "pix", F.round("cont", 4).alias("level"))


@query("asymmetric_baseline_planted", LEVEL_SQL)
def baseline_planted(spark, sf):
    return solve.asymmetric_baseline(_levels(spark, sf), rounds=5, interior=10).select("object_id", "pix", F.round("baseline", 4).alias("level"))


SHAPE = {"vel": "300e0 * e[1]", "sigma": "70 + 100 * abs(e[2])", "h3": "least(greatest(0.5e0 * e[3], -0.12e0), 0.12e0)", "h4": "least(greatest(0.4e0 * e[4], -0.1e0), 0.1e0)"}


@query("gh_fit_shapes", f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id AS object_id, round({SHAPE['vel']}, 3) AS vel, round({SHAPE['sigma']}, 3) AS sigma, round({SHAPE['h3']}, 4) AS h3, round({SHAPE['h4']}, 4) AS h4, true AS converged FROM x""")
def gh_shapes(spark, sf):
    """Skewed and peaked profiles whose four numbers are values of the table."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("object_id"), F.transform("embedding", lambda a: a.cast("double")).alias("e"))
    at = lambda i: F.col("e")[i]
    bound = lambda c, limit: F.least(F.greatest(c, F.lit(-limit)), F.lit(limit))
    e = e.select("object_id", (300.0 * at(0)).alias("vel"), (70 + 100 * F.abs(at(1))).alias("sigma"), bound(0.5 * at(2), 0.12).alias("h3"), bound(0.4 * at(3), 0.1).alias("h4"))
    rows = hist(spark, sf).select("object_id", "bin", "v").join(e, "object_id")
    fits = gh_fit(rows.select("object_id", "bin", "v", gh_profile("v", F.lit(1.0), "vel", "sigma", "h3", "h4").alias("b")), OBJ)
    return fits.select("object_id", F.round("vel", 3).alias("vel"), F.round("sigma", 3).alias("sigma"), F.round("h3", 4).alias("h3"), F.round("h4", 4).alias("h4"), "converged")
