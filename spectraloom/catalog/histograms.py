"""Histogram shapes, moments and replicate statistics on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import HIST, PIXELS, REPS, big, hist, pixels, query, r6, reps, table
from spectraloom.operators import products
from spectraloom.operators import stats as S

KEY = ["object_id"]


@query("roughness", f"""
WITH {HIST}, d AS (SELECT object_id, b, abs(lead(b) OVER w - 2 * b + lag(b) OVER w) AS d FROM hist WINDOW w AS (PARTITION BY object_id ORDER BY bin))
SELECT object_id, round(CASE WHEN max(b) < 1e-4 THEN 'inf'::DOUBLE ELSE max(d) / max(b) END, 6) AS roughness FROM d GROUP BY 1""")
def roughness(spark, sf):
    return S.roughness(hist(spark, sf), KEY).select("object_id", r6("roughness"))


MOM = """mom AS (SELECT object_id, vel, sqrt(sum(b * (v - vel) ** 2) / sum(b)) AS sigma FROM hist
  JOIN (SELECT object_id, sum(b * v) / sum(b) AS vel FROM hist GROUP BY 1) USING (object_id) GROUP BY 1, 2)"""


@query("losvd_moments", f"WITH {HIST}, {MOM} SELECT object_id, round(vel, 6) AS vel, round(sigma, 6) AS sigma FROM mom")
def losvd_moments(spark, sf):
    return S.losvd_moments(hist(spark, sf), KEY).select("object_id", r6("vel"), r6("sigma"))


@query("fwhm", f"""
WITH {HIST}, pk AS (SELECT object_id, max(b) AS peak FROM hist GROUP BY 1),
top AS (SELECT h.object_id, peak, min(bin) AS ib FROM hist h JOIN pk USING (object_id) WHERE b = peak GROUP BY 1, 2),
s AS (SELECT h.object_id, bin, v, b, peak, ib, lead(b) OVER w AS nb, lead(v) OVER w AS nv FROM hist h JOIN top USING (object_id) WINDOW w AS (PARTITION BY h.object_id ORDER BY bin)),
c AS (SELECT *, CASE WHEN bin < ib AND peak / 2 >= b AND peak / 2 < nb THEN v + (peak / 2 - b) / (nb - b) * (nv - v) END AS l,
   CASE WHEN bin >= ib AND peak / 2 >= nb AND peak / 2 < b THEN nv + (peak / 2 - nb) / (b - nb) * (v - nv) END AS r FROM s),
f AS (SELECT object_id, peak, max(v) FILTER (WHERE bin = ib) AS v_peak, coalesce(arg_max(l, bin) FILTER (WHERE l IS NOT NULL), min(v)) AS v_left,
   coalesce(arg_max(r, bin) FILTER (WHERE r IS NOT NULL), max(v)) AS v_right FROM c GROUP BY 1, 2)
SELECT object_id, round(v_right - v_left, 6) AS fwhm, round(v_peak, 6) AS v_peak, round(peak, 6) AS peak, round(v_left, 6) AS v_left, round(v_right, 6) AS v_right FROM f""")
def fwhm(spark, sf):
    return S.fwhm(hist(spark, sf), KEY).select("object_id", *[r6(c) for c in ("fwhm", "v_peak", "peak", "v_left", "v_right")])


@query("arg_first_max", f"""
WITH {HIST}, q AS (SELECT object_id, bin, round(b * 20) AS b FROM hist), m AS (SELECT object_id, max(b) AS peak FROM q GROUP BY 1)
SELECT q.object_id, CAST(min(bin) AS BIGINT) AS at, peak FROM q JOIN m ON m.object_id = q.object_id AND b = peak GROUP BY 1, 3""")
def arg_first_max(spark, sf):
    q = hist(spark, sf).withColumn("b", F.round(F.col("b") * 20))
    return S.arg_first_max(q, KEY).select("object_id", big("at"), "peak")


SMOOTH = """sm AS (SELECT object_id, sum(CASE WHEN abs(v - 10) / 80 > 1.8e0 THEN 1000 * (abs(v - 10) / 80 / 1.8e0) ** 4 ELSE 1000 END * d * d) / 1.25e0 ** 3 AS smooth,
   sum(CASE WHEN abs(v - 10) / 80 > 1.8e0 THEN 0.5e0 * ((abs(v - 10) / 80 / 1.8e0) ** 4 - 1) * b * b ELSE 0 END) / 1.25e0 ** 3 AS shrink, 0.1e0 * abs(sum(b) - 1) AS norm
  FROM (SELECT *, coalesce(lead(b) OVER w, 0) - 2 * b + coalesce(lag(b) OVER w, 0) AS d FROM hist WINDOW w AS (PARTITION BY object_id ORDER BY bin)) GROUP BY 1)"""


@query("smoothness", f"WITH {HIST}, {SMOOTH} SELECT object_id, round(smooth, 6) AS smooth FROM sm")
def smoothness(spark, sf):
    return S.smoothness(hist(spark, sf), KEY, 1000.0, 80.0, 10.0, 1.25).select("object_id", r6("smooth"))


@query("objective_terms", f"""
WITH {HIST}, {SMOOTH}, c AS (SELECT object_id, sum(((raw - b) / 0.05e0) ** 2) AS chi2 FROM hist GROUP BY 1)
SELECT object_id, round(chi2, 6) AS chi2, round(smooth, 6) AS smooth, round(shrink, 6) AS shrink, round(norm, 6) AS norm,
  round(chi2 + smooth + shrink + norm, 6) AS objective, round(smooth / chi2, 6) AS smooth_ratio FROM c JOIN sm USING (object_id)""")
def objective_terms(spark, sf):
    h = hist(spark, sf)
    px = h.select("object_id", F.col("raw").alias("g"), F.lit(0.05).alias("gerr"), F.lit(True).alias("good"), F.col("b").alias("model"))
    c = S.chi2(px, KEY).drop("ngood")
    out = S.objective_terms(c, h, KEY, 1000.0, 80.0, 10.0, 1.25, shrink=0.5)
    return out.select("object_id", *[r6(n) for n in ("chi2", "smooth", "shrink", "norm", "objective", "smooth_ratio")])


@query("diff_penalty", f"""
WITH {HIST}, d1 AS (SELECT object_id, bin, lead(b) OVER w - b AS d FROM hist WINDOW w AS (PARTITION BY object_id ORDER BY bin)),
d2 AS (SELECT object_id, bin, lead(d) OVER w - d AS d FROM d1 WINDOW w AS (PARTITION BY object_id ORDER BY bin)),
d3 AS (SELECT object_id, bin, lead(d) OVER w - d AS d FROM d2 WINDOW w AS (PARTITION BY object_id ORDER BY bin))
SELECT a.object_id, p2, p3 FROM (SELECT object_id, round(sum(d * d), 6) AS p2 FROM d2 GROUP BY 1) a JOIN (SELECT object_id, round(sum(d * d), 6) AS p3 FROM d3 GROUP BY 1) b USING (object_id)""")
def diff_penalty(spark, sf):
    h = hist(spark, sf)
    two = S.diff_penalty(h, KEY, 2).select("object_id", r6("penalty", "p2"))
    return two.join(S.diff_penalty(h, KEY, 3).select("object_id", r6("penalty", "p3")), "object_id")


@query("normalise_losvd", f"""
WITH {HIST} SELECT object_id, bin, round(greatest(b, 1e-6) / sum(greatest(b, 1e-6)) OVER (PARTITION BY object_id), 6) AS b FROM hist""")
def normalise_losvd(spark, sf):
    return S.normalise_losvd(hist(spark, sf), KEY).select("object_id", "bin", r6("b"))


@query("count_peaks", f"""
WITH {HIST}, c AS (SELECT *, max(b) OVER (PARTITION BY object_id) AS peak,
    b > lag(b) OVER w AND b > lead(b) OVER w AS is_max FROM hist WINDOW w AS (PARTITION BY object_id ORDER BY bin)),
m AS (SELECT object_id, bin, b, peak FROM c WHERE is_max),
t AS (SELECT m.object_id, m.bin, m.b, m.peak, max(h.bin) FILTER (WHERE h.bin < m.bin AND h.b > m.b) AS lt, min(h.bin) FILTER (WHERE h.bin > m.bin AND h.b > m.b) AS rt
  FROM m JOIN hist h USING (object_id) GROUP BY ALL),
k AS (SELECT t.object_id, t.bin, t.b, t.peak, t.lt, t.rt, min(h.b) FILTER (WHERE h.bin > t.lt AND h.bin < t.bin) AS lk, min(h.b) FILTER (WHERE h.bin < t.rt AND h.bin > t.bin) AS rk
  FROM t JOIN hist h USING (object_id) GROUP BY ALL),
n AS (SELECT object_id, count(*) FILTER (WHERE b - greatest(coalesce(lk, 0), coalesce(rk, 0)) >= 0.1e0 * peak) AS n FROM k GROUP BY 1)
SELECT h.object_id, greatest(coalesce(max(n), 0), 1) AS n_peaks FROM hist h LEFT JOIN n USING (object_id) GROUP BY 1""")
def count_peaks(spark, sf):
    return S.count_peaks(hist(spark, sf), KEY)


@query("fractions", f"""
WITH {HIST} SELECT object_id, CAST(bin AS BIGINT) AS tpl, round((1 + raw) / sum(1 + raw) OVER (PARTITION BY object_id), 6) AS fraction FROM hist""")
def fractions(spark, sf):
    w = hist(spark, sf).select("object_id", F.col("bin").cast("long").alias("tpl"), (1 + F.col("raw")).alias("w"))
    return S.fractions(w, KEY).select("object_id", "tpl", r6("fraction"))


@query("replicate_spread", f"WITH {REPS} SELECT object_id, bin, round(stddev_samp(b), 6) AS spread, count(*) AS n_rep FROM reps GROUP BY 1, 2")
def replicate_spread(spark, sf):
    return S.replicate_spread(reps(spark, sf), ["object_id", "bin"]).select("object_id", "bin", r6("spread"), "n_rep")


@query("replicate_interval", f"""
WITH {REPS} SELECT object_id, bin, round(quantile_cont(b, 0.16), 6) AS p_lo, round(quantile_cont(b, 0.5), 6) AS p_mid, round(quantile_cont(b, 0.84), 6) AS p_hi FROM reps GROUP BY 1, 2""")
def replicate_interval(spark, sf):
    return S.replicate_interval(reps(spark, sf), ["object_id", "bin"]).select("object_id", "bin", r6("p_lo"), r6("p_mid"), r6("p_hi"))


BIWEIGHT = """bw AS (
  SELECT object_id, bin, m + coalesce(sum((b - m) * (1 - u * u) ** 2) FILTER (WHERE abs(u) < 1) / nullif(sum((1 - u * u) ** 2) FILTER (WHERE abs(u) < 1), 0), 0) AS location FROM (
    SELECT object_id, bin, b, m, (b - m) / nullif(6 * quantile_cont(abs(b - m), 0.5) OVER (PARTITION BY object_id, bin), 0) AS u FROM (
      SELECT object_id, bin, b, quantile_cont(b, 0.5) OVER (PARTITION BY object_id, bin) AS m FROM reps)) GROUP BY object_id, bin, m)"""


@query("biweight_location", f"WITH {REPS}, {BIWEIGHT} SELECT object_id, bin, round(location, 6) AS location FROM bw")
def biweight_location(spark, sf):
    return S.biweight_location(reps(spark, sf), ["object_id", "bin"]).select("object_id", "bin", r6("location"))


POINT = "pt AS (SELECT object_id, bin, v, avg(b) AS b FROM reps GROUP BY 1, 2, 3)"
BOUNDS = f"""{REPS}, {BIWEIGHT}, {POINT},
bd AS (SELECT pt.*, greatest(b - (location - lo0), 0) AS lo, b + (hi0 - location) AS hi FROM pt JOIN bw USING (object_id, bin)
  JOIN (SELECT object_id, bin, quantile_cont(b, 0.16) AS lo0, quantile_cont(b, 0.84) AS hi0 FROM reps GROUP BY 1, 2) USING (object_id, bin))"""


def _point(spark, sf):
    return reps(spark, sf).groupBy("object_id", "bin", "v").agg(F.avg("b").alias("b"))


@query("anchored_bounds", f"WITH {BOUNDS} SELECT object_id, bin, round(b, 6) AS b, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bd")
def anchored_bounds(spark, sf):
    return S.anchored_bounds(_point(spark, sf), reps(spark, sf), ["object_id", "bin"]).select("object_id", "bin", r6("b"), r6("lo"), r6("hi"))


@query("interval_coverage", """
SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice BETWEEN 20 * c_acctbal AND 80 * c_acctbal THEN 1e0 ELSE 0e0 END), 6) AS coverage,
  count(*) FILTER (WHERE o_totalprice BETWEEN 20 * c_acctbal AND 80 * c_acctbal) AS n_covered, count(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def interval_coverage(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return S.coverage(d, ["o_orderstatus"], "o_totalprice", 20 * F.col("c_acctbal"), 80 * F.col("c_acctbal")).select("o_orderstatus", r6("coverage"), "n_covered", "n")


@query("draw_summary", f"""
WITH {REPS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY object_id ORDER BY rep) - 1 AS draw FROM reps),
n AS (SELECT object_id, max(draw) + 1 AS n FROM r GROUP BY 1),
keep AS (SELECT DISTINCT object_id, CAST(floor(i * (n - 1) / (k - 1)) AS BIGINT) AS draw FROM (SELECT object_id, n, k, unnest(range(0, k)) AS i FROM (SELECT *, least(n, 20) AS k FROM n)))
SELECT object_id, bin, round(avg(b), 6) AS mean, round(quantile_cont(b, 0.16), 6) AS q_lo, round(quantile_cont(b, 0.84), 6) AS q_hi
FROM r SEMI JOIN keep USING (object_id, draw) GROUP BY 1, 2""")
def draw_summary(spark, sf):
    from spectraloom.plans.scale import number_rows

    r = reps(spark, sf)
    draws = number_rows(r.select("object_id", "rep").distinct(), KEY, ["rep"], "draw")
    kept = S.thin_draws(r.join(draws, ["object_id", "rep"]), KEY, 20)
    return S.draw_summary(kept, ["object_id", "bin"]).select("object_id", "bin", r6("mean"), r6("q_lo"), r6("q_hi"))


@query("losvd_error_table", f"""
WITH {BOUNDS}, sp AS (SELECT object_id, bin, CASE WHEN stddev_samp(b) > 0.07e0 THEN stddev_samp(b) END AS e FROM reps GROUP BY 1, 2)
SELECT object_id, bin, round(v, 6) AS v, round(b, 6) AS b, round(coalesce(e, 0), 6) AS err,
  round(CASE WHEN hi - b > 0.06e0 THEN lo ELSE b - coalesce(e, 0) END, 6) AS lo, round(CASE WHEN hi - b > 0.06e0 THEN hi ELSE b + coalesce(e, 0) END, 6) AS hi
FROM bd JOIN sp USING (object_id, bin)""")
def losvd_error_table(spark, sf):
    # Errors and bounds are missing where they are small, to exercise the defaults.
    by = ["object_id", "bin"]
    r = reps(spark, sf)
    point = _point(spark, sf)
    err = S.replicate_spread(r, by).select(*by, F.when(F.col("spread") > 0.07, F.col("spread")).alias("err"))
    wide = F.col("hi") - F.col("b") > 0.06
    iv = S.anchored_bounds(point, r, by).select(*by, F.when(wide, F.col("lo")).alias("lo"), F.when(wide, F.col("hi")).alias("hi"))
    return products.losvd_error_table(point, err, iv).select(*by, r6("v"), r6("b"), r6("err"), r6("lo"), r6("hi"))


@query("moment_error_table", """
WITH m AS (SELECT l_suppkey AS object_id, avg(l_quantity) AS v, avg(l_extendedprice) AS s, avg(l_discount) AS h3, CASE WHEN l_suppkey % 2 = 0 THEN avg(l_tax) END AS h4,
   stddev_samp(l_quantity) AS ev, stddev_samp(l_extendedprice) AS es, stddev_samp(l_discount) AS e3, CASE WHEN l_suppkey % 2 = 0 THEN stddev_samp(l_tax) END AS e4 FROM lineitem GROUP BY 1)
SELECT object_id, p.parameter AS parameter, round(p.value, 6) AS value, round(p.err, 6) AS err, round(p.value - p.err, 6) AS lo, round(p.value + p.err, 6) AS hi FROM (
  SELECT object_id, unnest([struct_pack(parameter := 'V', value := v, err := ev), struct_pack(parameter := 'sigma', value := s, err := es),
     struct_pack(parameter := 'h3', value := h3, err := e3), struct_pack(parameter := 'h4', value := h4, err := e4)]) AS p FROM m)""")
def moment_error_table(spark, sf):
    cols = {"V": "l_quantity", "sigma": "l_extendedprice", "h3": "l_discount", "h4": "l_tax"}
    m = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("object_id")).agg(
        *[F.avg(c).alias(p) for p, c in cols.items()], *[F.stddev_samp(c).alias(f"{p}_err") for p, c in cols.items()]
    )
    for c in ("h4", "h4_err"):
        m = m.withColumn(c, F.when(F.col("object_id") % 2 == 0, F.col(c)))
    for p in cols:
        m = m.withColumn(f"{p}_lo", F.col(p) - F.col(f"{p}_err")).withColumn(f"{p}_hi", F.col(p) + F.col(f"{p}_err"))
    return products.moment_error_table(m, list(cols)).select("object_id", "parameter", r6("value"), r6("err"), r6("lo"), r6("hi"))


@query("simulation_table", f"""
WITH {REPS}, {POINT}, s AS (SELECT object_id, bin, v, -1 AS rep, b FROM pt UNION ALL SELECT object_id, bin, v, rep, b FROM reps)
SELECT object_id, 'losvd' AS kind, CAST(bin AS BIGINT) AS row, rep, round(b, 6) AS value FROM s
UNION ALL SELECT object_id, 'weight', bin, rep, round(b + 1, 6) FROM s
UNION ALL SELECT object_id, 'centre', 0, rep, round(sum(v * b) / CASE WHEN sum(b) > 0 THEN sum(b) ELSE 1 END, 6) FROM s GROUP BY object_id, rep""")
def simulation_table(spark, sf):
    r, p = reps(spark, sf), _point(spark, sf)

    def weights(d):
        return d.withColumn("tpl", F.col("bin")).withColumn("w", F.col("b") + 1)

    out = products.simulation_table(p, r, weights(p), weights(r))
    return out.select("object_id", "kind", "row", "rep", r6("value"))


@query("percentile_table", f"""
WITH {REPS} SELECT object_id, bin, {', '.join(f'round(quantile_cont(b, {p / 100}), 6) AS p{p}' for p in (50, 5, 16, 84, 95))} FROM reps GROUP BY 1, 2""")
def percentile_table(spark, sf):
    return products.percentile_table(reps(spark, sf)).select("object_id", "bin", *[r6(f"p{p}") for p in (50, 5, 16, 84, 95)])


@query("bootstrap_diagnostics", """
WITH s AS (SELECT l_suppkey AS object_id, count(*) AS n_total, count(*) FILTER (WHERE l_linestatus = 'O' OR l_linenumber < 6) AS n_converged FROM lineitem GROUP BY 1)
SELECT object_id, n_total, n_converged, n_total - n_converged AS n_failed, round(100e0 * n_converged / n_total, 6) AS rate, 100e0 * n_converged / n_total < 95 AS low_rate FROM s""")
def bootstrap_diagnostics(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("object_id"), ((F.col("l_linestatus") == "O") | (F.col("l_linenumber") < 6)).alias("converged"))
    return products.bootstrap_diagnostics(d).withColumn("rate", F.round("rate", 6))
