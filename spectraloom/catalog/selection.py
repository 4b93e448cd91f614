"""Choosing lambda and rounds on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import TRIALS, big, query, r6, table, trials
from spectraloom.operators import choose as X


@query("pick_lambda_chi2", f"""
WITH {TRIALS}, m AS (SELECT object_id, min(chi2 / ngood) FILTER (WHERE n_peaks <= 1) AS mn, max(lam) AS top FROM trials GROUP BY 1)
SELECT object_id, coalesce(max(lam) FILTER (WHERE n_peaks <= 1 AND chi2 / ngood <= mn * (1 + 0.5e0)), max(top)) AS lam FROM trials JOIN m USING (object_id) GROUP BY 1""")
def pick_chi2(spark, sf):
    return X.pick_lambda_chi2(trials(spark, sf), tol=0.5)


@query("pick_lambda_roughness", f"""
WITH {TRIALS} SELECT object_id, coalesce(min(lam) FILTER (WHERE rough <= 0.25e0 AND n_peaks <= 1), max(lam)) AS lam FROM trials GROUP BY 1""")
def pick_roughness(spark, sf):
    return X.pick_lambda_roughness(trials(spark, sf))


SANE = """tv AS (SELECT *, CAST(object_id % 41 - 20 AS DOUBLE) AS v_center FROM trials),
oth AS (SELECT a.object_id, a.lam, count(*) AS n, quantile_cont(b.v, 0.5) AS med FROM tv a JOIN tv b ON a.object_id = b.object_id AND a.lam <> b.lam AND b.n_peaks <= 1 GROUP BY 1, 2),
dev AS (SELECT o.object_id, o.lam, o.n, o.med, quantile_cont(abs(b.v - o.med), 0.5) AS mad FROM oth o JOIN tv b ON o.object_id = b.object_id AND o.lam <> b.lam AND b.n_peaks <= 1 GROUP BY ALL),
sane AS (SELECT t.*, abs(v - v_center) <= 5 * greatest(sigma, 1) AND (coalesce(n, 0) < 2 OR abs(v - med) <= 5 * greatest(mad, 3)) AS sane FROM tv t LEFT JOIN dev d ON d.object_id = t.object_id AND d.lam = t.lam)"""


def _centred(spark, sf):
    return trials(spark, sf).withColumn("v_center", (F.col("object_id") % 41 - 20).cast("double"))


@query("sane_trials", f"""WITH {TRIALS}, {SANE}, f AS (SELECT object_id, max(lam) FILTER (WHERE sane AND n_peaks <= 1) AS fallback FROM sane GROUP BY 1)
SELECT object_id, lam, sane, fallback FROM sane JOIN f USING (object_id)""")
def sane(spark, sf):
    d = X.sane_trials(_centred(spark, sf))
    f = d.groupBy("object_id").agg(F.max(F.when(F.col("sane") & (F.col("n_peaks") <= 1), F.col("lam"))).alias("fallback"))
    return d.join(f, "object_id").select("object_id", "lam", "sane", "fallback")


@query("pick_lambda_discrepancy", f"""
WITH {TRIALS}, {SANE}, tg AS (SELECT object_id, arg_min(chi2, lam) * (1 + 2 * sqrt(2e0 / greatest(arg_min(ngood, lam), 1))) AS target FROM trials GROUP BY 1),
a AS (SELECT object_id, target, coalesce(min(lam) FILTER (WHERE chi2 >= target), max(lam)) AS hit, min(lam) FILTER (WHERE n_peaks <= 1 AND chi2 >= target) AS uni, count(*) FILTER (WHERE chi2 >= target) AS nr FROM sane JOIN tg USING (object_id) GROUP BY 1, 2),
b AS (SELECT object_id, target, hit, uni, nr, max(n_peaks) FILTER (WHERE lam = hit) AS np, min(lam) FILTER (WHERE n_peaks <= 1 AND lam > hit) AS bey FROM sane JOIN a USING (object_id) GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT *, CASE WHEN np <= 1 THEN hit ELSE coalesce(uni, bey, hit) END AS best FROM b),
d AS (SELECT object_id, target, nr, best, bool_or(sane AND lam = best) AS ok, max(lam) FILTER (WHERE sane AND n_peaks <= 1 AND lam <> best) AS fb FROM sane JOIN c USING (object_id) GROUP BY 1, 2, 3, 4)
SELECT object_id, round(target, 4) AS target, CASE WHEN ok THEN best ELSE coalesce(fb, best) END AS lam, nr > 0 AS reached, ok AS sane FROM d""")
def pick_discrepancy(spark, sf):
    return X.pick_lambda_discrepancy(_centred(spark, sf), nsigma=2.0).withColumn("target", F.round("target", 4))


@query("best_round", """
WITH r AS (SELECT l_orderkey AS object_id, l_linenumber AS round, min(abs(l_quantity - l_extendedprice / 2000)) AS gap, min(l_quantity) AS lam FROM lineitem GROUP BY 1, 2),
s AS (SELECT object_id, coalesce(min(round) FILTER (WHERE gap <= 2), max(round)) AS stop FROM r GROUP BY 1),
p AS (SELECT r.* FROM r JOIN s USING (object_id) WHERE round <= stop),
b AS (SELECT object_id, arg_max(round, round) AS lr, arg_max(gap, round) AS lg, arg_max(lam, round) AS ll, min(struct_pack(g := gap, i := round, l := lam)) AS m FROM p GROUP BY 1)
SELECT object_id, CAST(CASE WHEN m.g < lg THEN m.i ELSE lr END AS BIGINT) AS round, round(CASE WHEN m.g < lg THEN m.g ELSE lg END, 6) AS gap, CASE WHEN m.g < lg THEN m.l ELSE ll END AS lam, m.g < lg AS reverted FROM b""")
def best_round(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("round")).agg(
        F.min(F.abs(F.col("l_quantity") - F.col("l_extendedprice") / 2000)).alias("gap"), F.min("l_quantity").alias("lam")
    )
    return X.best_round(r).select("object_id", big("round"), r6("gap"), "lam", "reverted")


@query("refined_lambda_grid", f"""
WITH {TRIALS}, tg AS (SELECT object_id, arg_min(chi2, lam) * (1 + 2 * sqrt(2e0 / 200)) AS target FROM trials GROUP BY 1),
h AS (SELECT object_id, min(lam) FILTER (WHERE chi2 >= target) AS hi FROM trials JOIN tg USING (object_id) GROUP BY 1),
b AS (SELECT object_id, hi, max(lam) AS lo FROM trials JOIN h USING (object_id) WHERE lam < hi GROUP BY 1, 2),
n AS (SELECT *, CAST(ceil((log10(hi) - log10(lo)) / 0.05e0) AS INT) AS n FROM b)
SELECT object_id, round(10e0 ** (log10(lo) + (log10(hi) - log10(lo)) * i / n), 6) AS lam FROM (SELECT *, unnest(range(1, n)) AS i FROM n WHERE n > 1)""")
def refined(spark, sf):
    return X.refined_grid(X.bracket(trials(spark, sf), 2.0)).select("object_id", r6("lam"))
