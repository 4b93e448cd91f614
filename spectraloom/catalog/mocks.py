"""Planted-truth tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import HIST, PIXELS, hist, lcg_sql, pixels, query, r6, table
from spectraloom.functions.lines import MOCK_EMISSION_CENTRES
from spectraloom.operators import mocks as K
from spectraloom.operators.resample import convolve_kernel, gauss_kernel

OBJ = ["object_id"]

TRUTH = """tr AS (SELECT s_suppkey AS object_id, s_acctbal / 100 AS v_true, 40e0 + s_suppkey % 150 AS sigma_true, (s_nationkey % 5 - 2) / 20e0 AS h3, (s_nationkey % 3 - 1) / 20e0 AS h4, s_nationkey % 4 = 0 AS dbl FROM supplier),
tg AS (SELECT *, v_true - 8 * sigma_true + 16 * sigma_true * bin / 60 AS v FROM (SELECT *, unnest(range(0, 61)) AS bin FROM tr)),
tw AS (SELECT *, (v - v_true) / sigma_true AS w FROM tg),
tb AS (SELECT object_id, bin, v, CASE WHEN dbl THEN 0.5e0 * exp(-0.5e0 * ((w + 0.6e0) / 0.5e0) ** 2) + 0.5e0 * exp(-0.5e0 * ((w - 0.6e0) / 0.5e0) ** 2)
   ELSE greatest(exp(-0.5e0 * w * w) / (sqrt(2 * pi()) * sigma_true) * (1 + h3 * (2 * w * w * w - 3 * w) / sqrt(3e0) + h4 * (4 * w ** 4 - 12 * w * w + 3) / sqrt(24e0)), 0) END AS y FROM tw),
truth AS (SELECT object_id, bin, v, y / sum(y) OVER (PARTITION BY object_id) AS b FROM tb)"""


def truth(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("object_id"), (F.col("s_acctbal") / 100).alias("v_true"), (40.0 + F.col("s_suppkey") % 150).alias("sigma_true"),
        ((F.col("s_nationkey") % 5 - 2) / 20.0).alias("h3"), ((F.col("s_nationkey") % 3 - 1) / 20.0).alias("h4"),
        F.when(F.col("s_nationkey") % 4 == 0, "double_peak").otherwise("gh").alias("shape"),
    )
    return K.truth_losvd(s, 61, 8.0)


@query("truth_losvd", f"WITH {TRUTH} SELECT object_id, CAST(bin AS BIGINT) AS bin, round(v, 6) AS v, round(b, 6) AS b FROM truth")
def truth_losvd(spark, sf):
    return truth(spark, sf).select("object_id", F.col("bin").cast("long").alias("bin"), r6("v"), r6("b"))


@query("convolve_kernel", f"""
WITH {HIST}, {TRUTH}, e AS (SELECT object_id, min(v) * 8580 / (299792.458e0 * 1.25e0) AS p0, max(v) * 8580 / (299792.458e0 * 1.25e0) AS p1 FROM truth GROUP BY 1),
ps AS (SELECT *, unnest(range(CAST(floor(p0) AS BIGINT), CAST(ceil(p1) AS BIGINT) + 1)) AS p FROM e),
kr AS (SELECT ps.object_id, p, p0, p1, CASE WHEN p < p0 OR p > p1 THEN 0 ELSE a.b + coalesce((n.b - a.b) * ((p - p0) / ((p1 - p0) / 60) - a.bin), 0) END AS y FROM ps
  LEFT JOIN truth a ON a.object_id = ps.object_id AND a.bin = CAST(floor((p - p0) / ((p1 - p0) / 60)) AS BIGINT) LEFT JOIN truth n ON n.object_id = ps.object_id AND n.bin = a.bin + 1),
k AS (SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY p) - 1 AS j, count(*) OVER (PARTITION BY object_id) AS m, coalesce(y, 0) / sum(coalesce(y, 0)) OVER (PARTITION BY object_id) AS w FROM kr),
sp AS (SELECT object_id, 1 + object_id % (SELECT count(*) FROM supplier) AS of, bin AS pix, 1 + raw AS t FROM hist)
SELECT sp.object_id, pix + j - (m - 1) // 2 AS pix, round(sum(t * w), 6) AS conv FROM sp JOIN k ON k.object_id = sp.of WHERE pix + j - (m - 1) // 2 BETWEEN 0 AND 63 GROUP BY 1, 2""")
def kernel(spark, sf):
    # Every vector gets the kernel of one supplier.
    k = gauss_kernel(truth(spark, sf), OBJ, 8580.0, 1.25).withColumnRenamed("object_id", "_of")
    n = table(spark, sf, "supplier").count()
    px = hist(spark, sf).select("object_id", F.col("bin").cast("long").alias("pix"), (1 + F.col("raw")).alias("t"))
    own = px.select("object_id").distinct().withColumn("_of", 1 + F.col("object_id") % n)
    return convolve_kernel(px, k.join(own, "_of").drop("_of")).select("object_id", "pix", r6("conv"))


@query("inject_lines", f"""
WITH {PIXELS}, cl AS (SELECT i, c FROM (VALUES {', '.join(f'({i}, {c}e0)' for i, c in enumerate(MOCK_EMISSION_CENTRES))}) t(i, c)),
nx AS (SELECT *, lead(x) OVER w AS nx, lead(gerr) OVER w AS ne FROM pixels WINDOW w AS (PARTITION BY object_id ORDER BY pix)),
am AS (SELECT object_id, c, (0.3e0 + 0.7e0 * {lcg_sql('object_id', '3', 'i')}) * (gerr + coalesce((ne - gerr) / (nx - x) * (c - x), 0)) AS a
  FROM nx JOIN cl ON c >= x AND (c < nx OR (nx IS NULL AND c = x)))
SELECT p.object_id, p.pix, round(g + coalesce(sum(a * exp(-0.5e0 * ((x - c) / (3 / 2.3548e0)) ** 2)), 0), 6) AS g FROM pixels p LEFT JOIN am ON am.object_id = p.object_id GROUP BY p.object_id, p.pix, p.g""")
def inject(spark, sf):
    return K.inject_lines(pixels(spark, sf), 0.3, 1.0, "gerr", F.lit(3)).select("object_id", "pix", r6("g"))


@query("add_noise", f"""
WITH {PIXELS}, n AS (SELECT *, greatest(quantile_cont(abs(g), 0.5) OVER (PARTITION BY object_id) / 50, 1e-8) AS e,
  greatest({lcg_sql('object_id', '7', '2 * pix')}, 1e-12) AS u1, {lcg_sql('object_id', '7', '2 * pix + 1')} AS u2 FROM pixels)
SELECT object_id, pix, round(e, 6) AS gerr, round(g + e * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 6) AS g FROM n""")
def add_noise(spark, sf):
    return K.add_noise(pixels(spark, sf), 50.0, F.lit(7)).select("object_id", "pix", r6("gerr"), r6("g"))
