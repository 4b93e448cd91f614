"""Masks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import PIXELS, pixels, query, r6, table
from spectraloom.catalog.ingest import LINES
from spectraloom.functions.lines import TRIPLET_CENTRES, emission_candidates, line_table
from spectraloom.operators import masks as M
from spectraloom.operators import stats as S
from spectraloom.plans.scale import attach

CK = "299792.458e0"
TRIP = "(x BETWEEN 8490.02e0 AND 8506.02e0 OR x BETWEEN 8534.09e0 AND 8550.09e0 OR x BETWEEN 8654.14e0 AND 8670.14e0)"

EXCESS = f"""{PIXELS}, {LINES},
em AS (SELECT line_id, centre, greatest(5e0, centre * 300 / {CK}) AS hw FROM lines WHERE tag IN ('em', 'paschen')),
pair AS (SELECT object_id, line_id, centre, hw, x, g, gerr,
   x >= centre - hw AND x <= centre + hw AS inl,
   NOT (x >= centre - hw AND x <= centre + hw) AND NOT {TRIP} AND x >= centre - 20 AND x <= centre + 20 AS flank
  FROM pixels JOIN em ON x >= centre - greatest(hw, 20) AND x <= centre + greatest(hw, 20) WHERE good),
ex AS (SELECT object_id, line_id, centre, hw, count(*) FILTER (WHERE flank) AS n_flank, max(g) FILTER (WHERE inl) AS peak,
   quantile_cont(g, 0.5) FILTER (WHERE flank) AS level, quantile_cont(gerr, 0.5) FILTER (WHERE flank) AS noise
  FROM pair GROUP BY 1, 2, 3, 4),
excess AS (SELECT *, (peak - level) / noise AS excess FROM ex WHERE n_flank >= 5 AND peak IS NOT NULL AND noise > 0)"""


def _snr(spark, sf, px):
    return M.line_excess_snr(px, emission_candidates(spark, paschen=True))


@query("line_excess_snr", f"""
WITH {EXCESS} SELECT object_id, line_id, n_flank, peak, round(level, 6) AS level, round(noise, 6) AS noise, round(excess, 6) AS excess FROM excess""")
def line_excess(spark, sf):
    return _snr(spark, sf, pixels(spark, sf)).select("object_id", "line_id", "n_flank", "peak", r6("level"), r6("noise"), r6("excess"))


@query("emission_line_mask", f"""
WITH {EXCESS} SELECT object_id, pix, x, EXISTS (SELECT 1 FROM excess e WHERE e.object_id = p.object_id AND e.excess >= 12
  AND x >= centre - hw AND x <= centre + hw) AS emission FROM pixels p""")
def emission_line_mask(spark, sf):
    return M.emission_line_mask(pixels(spark, sf), emission_candidates(spark, paschen=True), threshold=12.0).select("object_id", "pix", "x", "emission")


@query("protect_mask", f"""
WITH {PIXELS}, w(lo, hi) AS (
  SELECT c - greatest(6e0, c * 400 / {CK}), c + greatest(6e0, c * 400 / {CK}) FROM (VALUES (8498.02e0), (8542.09e0), (8662.14e0)) t(c)
  UNION ALL VALUES (8405e0, 8407.5e0), (8430e0 - 3, 8430e0 + 3))
SELECT object_id, pix, x, EXISTS (SELECT 1 FROM w WHERE x >= lo AND x <= hi) AS protect FROM pixels""")
def protect(spark, sf):
    lines = line_table(spark).filter(F.col("name") == "Ca II")
    wins = M.protect_windows(spark, lines, custom=[(8405.0, 8407.5)], extra=[(8430.0, 3.0)])
    return M.protect_mask(pixels(spark, sf), wins).select("object_id", "pix", "x", "protect")


@query("grow_mask", f"""
WITH {PIXELS} SELECT object_id, pix, g > 60 AS flag, bool_or(g > 60) OVER (PARTITION BY object_id ORDER BY pix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS grown FROM pixels""")
def grow_mask(spark, sf):
    return M.grow_mask(pixels(spark, sf).withColumn("flag", F.col("g") > 60), "flag", 2).select("object_id", "pix", "flag", "grown")


@query("grow_mask_by", f"""
WITH {PIXELS}, sx AS (SELECT object_id, pix, g, x * (1 + object_id % 3) AS x FROM pixels),
d AS (SELECT object_id, abs(lead(x) OVER (PARTITION BY object_id ORDER BY pix) - x) AS d FROM sx),
n AS (SELECT object_id, CAST(ceil(5 / quantile_cont(d, 0.5)) AS BIGINT) AS n FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT p.object_id, p.pix, EXISTS (SELECT 1 FROM sx q WHERE q.object_id = p.object_id AND q.g > 60 AND abs(q.pix - p.pix) <= n.n) AS grown
FROM sx p JOIN n ON n.object_id = p.object_id""")
def grow_mask_by(spark, sf):
    px = pixels(spark, sf).withColumn("flag", F.col("g") > 60).withColumn("x", F.col("x") * (1 + F.col("object_id") % 3))
    return M.grow_mask_by(px, "flag", 5.0).select("object_id", "pix", "grown")


@query("bloom", f"""
WITH {PIXELS}, f AS (SELECT *, g > 60 AS rej, x BETWEEN 8420 AND 8440 AS prot FROM pixels)
SELECT object_id, pix, rej OR (bool_or(rej) OVER (PARTITION BY object_id ORDER BY pix ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AND NOT prot) AS bloomed FROM f""")
def bloom(spark, sf):
    px = pixels(spark, sf).withColumn("rej", F.col("g") > 60).withColumn("protect", F.col("x").between(8420, 8440))
    return M.bloom(px, "rej", 3).select("object_id", "pix", "bloomed")


@query("mask_spans", f"""
WITH {PIXELS}, f AS (SELECT *, pix - row_number() OVER (PARTITION BY object_id ORDER BY pix) AS grp FROM pixels WHERE g > 20)
SELECT object_id, min(x) AS x_start, max(x) AS x_end, count(*) AS n FROM f GROUP BY object_id, grp""")
def mask_spans(spark, sf):
    return M.mask_spans(pixels(spark, sf).withColumn("flag", F.col("g") > 20), "flag").drop("span")


ROLL = """seg AS (SELECT *, CASE WHEN x <= 8498.02e0 - 12 THEN 0 WHEN x >= 8498.02e0 + 12 AND x <= 8542.09e0 - 12 THEN 1
    WHEN x >= 8542.09e0 + 12 AND x <= 8662.14e0 - 12 THEN 2 WHEN x >= 8662.14e0 + 12 THEN 3 END AS seg FROM pixels WHERE good),
rk AS (SELECT *, row_number() OVER (PARTITION BY object_id, seg ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY object_id, seg) AS n,
    lead(x) OVER (PARTITION BY object_id, seg ORDER BY x) - x AS d FROM seg WHERE seg IS NOT NULL),
hw AS (SELECT object_id, seg, CAST(greatest(5, ceil(50 / (2 * quantile_cont(d, 0.5)))) AS BIGINT) AS h FROM rk WHERE n >= 10 AND d IS NOT NULL GROUP BY 1, 2),
md AS (SELECT a.object_id, a.seg, a.k, a.pix, a.g, h, quantile_cont(b.g, 0.5) AS med FROM rk a JOIN hw USING (object_id, seg)
    JOIN rk b ON b.object_id = a.object_id AND b.seg = a.seg AND abs(b.k - a.k) <= h GROUP BY ALL),
mm AS (SELECT a.object_id, a.pix, a.g, a.med, 1.4826e0 * quantile_cont(abs(b.g - a.med), 0.5) AS mad FROM md a
    JOIN rk b ON b.object_id = a.object_id AND b.seg = a.seg AND abs(b.k - a.k) <= h GROUP BY ALL),
roll AS (SELECT object_id, pix FROM mm WHERE mad > 0 AND g > med + 3 * mad)"""


@query("rolling_outliers", f"""
WITH {PIXELS}, {ROLL} SELECT p.object_id, p.pix, p.g, r.pix IS NOT NULL AS segment_emission FROM pixels p LEFT JOIN roll r ON r.object_id = p.object_id AND r.pix = p.pix""")
def rolling(spark, sf):
    return M.rolling_outliers(pixels(spark, sf)).select("object_id", "pix", "g", "segment_emission")


@query("union_masks", f"""
WITH {PIXELS}, f AS (SELECT *, g > 60 AS a, NOT good AS b,
   bool_or(g > 60) OVER (PARTITION BY object_id ORDER BY pix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM pixels)
SELECT object_id, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b AND NOT a) AS n_b, count(*) FILTER (WHERE c AND NOT a AND NOT b) AS n_c,
  count(*) FILTER (WHERE a OR b OR c) AS n_masked FROM f GROUP BY 1""")
def union_masks(spark, sf):
    px = pixels(spark, sf).withColumn("a", F.col("g") > 60).withColumn("b", ~F.col("good"))
    return M.mask_gains(M.grow_mask(px, "a", 1, "c"), ["a", "b", "c"])


@query("robust_sigma", f"""
WITH u AS (SELECT 'e' AS src, user_id AS k, value AS x FROM events UNION ALL SELECT 's', l_suppkey, l_extendedprice FROM lineitem UNION ALL SELECT 'z', l_orderkey, 5e0 + l_linenumber // 6 FROM lineitem),
m AS (SELECT src, k, x, quantile_cont(x, 0.5) OVER (PARTITION BY src, k) AS med FROM u),
d AS (SELECT src, k, quantile_cont(abs(x - med), 0.5) AS mad, stddev_pop(x) AS sd FROM m GROUP BY 1, 2)
SELECT src, k, round(CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE sd END, 6) AS sigma FROM d""")
def robust(spark, sf):
    e = table(spark, sf, "events").select(F.lit("e").alias("src"), F.col("user_id").alias("k"), F.col("value").alias("x"))
    li = table(spark, sf, "lineitem")
    s = li.select(F.lit("s").alias("src"), F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))
    z = li.select(F.lit("z").alias("src"), F.col("l_orderkey").alias("k"), (5.0 + F.floor(F.col("l_linenumber") / 6)).alias("x"))
    return M.robust_sigma(e.unionByName(s).unionByName(z), ["src", "k"], "x").select("src", "k", r6("sigma"))


def _clip_round_sql(prev: str, cur: str) -> str:
    return f"""
{cur}s AS (SELECT object_id, CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE sd END AS sig FROM (
  SELECT object_id, quantile_cont(abs(r - med), 0.5) AS mad, stddev_pop(r) AS sd FROM (
    SELECT object_id, r, quantile_cont(r, 0.5) OVER (PARTITION BY object_id) AS med FROM {prev} WHERE good) GROUP BY 1)),
{cur}n AS (SELECT p.*, good AND (CASE WHEN sig > 0 THEN r <= 3 * sig OR prot ELSE true END) AS nxt FROM {prev} p JOIN {cur}s USING (object_id)),
{cur}v AS (SELECT object_id, stop OR bool_and(good = nxt) OR count(*) FILTER (WHERE nxt) < 10 AS stop FROM {cur}n GROUP BY object_id, stop),
{cur} AS (SELECT n.object_id, pix, g, r, prot, CASE WHEN v.stop THEN good ELSE nxt END AS good, v.stop,
  rounds + CASE WHEN n.stop THEN 0 ELSE 1 END AS rounds FROM {cur}n n JOIN {cur}v v USING (object_id))"""


@query("sigma_clip", f"""
WITH {PIXELS}, base AS (SELECT object_id, quantile_cont(g, 0.5) AS model FROM pixels GROUP BY 1),
r0 AS (SELECT object_id, pix, g, (g - model) / gerr AS r, x BETWEEN 8420 AND 8430 AS prot, good, false AS stop, 0 AS rounds FROM pixels JOIN base USING (object_id)),
{','.join(_clip_round_sql(f'r{i}', f'r{i + 1}') for i in range(5))}
SELECT object_id, pix, g, good, CAST(rounds AS BIGINT) AS clip_rounds FROM r5""")
def sigma_clip(spark, sf):
    from spectraloom.plans.scale import quantiles

    px = pixels(spark, sf)
    px = attach(px, quantiles(px, ["object_id"], "g", {"model": 0.5}), ["object_id"]).withColumn("protect", F.col("x").between(8420, 8430))
    out = M.sigma_clip(px, "model", protect="protect")
    return out.select("object_id", "pix", "g", "good", F.col("clip_rounds").cast("long").alias("clip_rounds"))


@query("chi2", f"""
WITH {PIXELS}, m AS (SELECT object_id, avg(g) FILTER (WHERE good) AS model FROM pixels GROUP BY 1),
s AS (SELECT p.object_id, CASE WHEN object_id % 25 = 0 THEN false ELSE good END AS ok, g, gerr, model FROM pixels p JOIN m USING (object_id))
SELECT object_id, coalesce(round(sum(((g - model) / gerr) ** 2) FILTER (WHERE ok), 6), 'inf'::DOUBLE) AS chi2, count(*) FILTER (WHERE ok) AS ngood FROM s GROUP BY 1""")
def chi2(spark, sf):
    # Every 25th series is masked as a whole, which must give (inf, 0).
    px = _with_mean(spark, sf).withColumn("good", F.col("good") & (F.col("object_id") % 25 != 0))
    return S.chi2(px, ["object_id"], "model").select("object_id", r6("chi2"), "ngood")


def _with_mean(spark, sf):
    px = pixels(spark, sf)
    m = px.filter("good").groupBy("object_id").agg(F.avg("g").alias("model"))
    return attach(px, m, ["object_id"])


@query("chi2_reduced", f"""
WITH {PIXELS}, m AS (SELECT object_id, avg(g) FILTER (WHERE good) AS model FROM pixels GROUP BY 1),
s AS (SELECT object_id, sum(((g - model) / gerr) ** 2) FILTER (WHERE good) AS c, count(*) FILTER (WHERE good) AS n FROM pixels JOIN m USING (object_id) GROUP BY 1)
SELECT object_id, round(c / n, 6) AS per_good, round(c / greatest(n - 1, 1), 6) AS per_dof, round(c / greatest(n - 33, 1), 6) AS per_param FROM s""")
def chi2_reduced(spark, sf):
    d = S.chi2(_with_mean(spark, sf), ["object_id"], "model")
    return d.select("object_id", r6(S.chi2_reduced("good"), "per_good"), r6(S.chi2_reduced("dof"), "per_dof"), r6(S.chi2_reduced("params", 33), "per_param"))


@query("rms_residual", f"""
WITH {PIXELS}, m AS (SELECT object_id, avg(g) FILTER (WHERE good) AS model FROM pixels GROUP BY 1)
SELECT object_id, round(sqrt(avg((g - model) ** 2) FILTER (WHERE good)), 6) AS rms FROM pixels JOIN m USING (object_id) GROUP BY 1""")
def rms(spark, sf):
    return S.rms(_with_mean(spark, sf), ["object_id"], "model").select("object_id", r6("rms"))


@query("pooled_frac_error", """
SELECT round(coalesce(quantile_cont(l_tax / l_discount, 0.5), 0), 6) AS frac_error FROM lineitem WHERE l_tax > 0 AND l_discount > 0""")
def pooled(spark, sf):
    return S.pooled_frac_error(table(spark, sf, "lineitem"), "l_discount", "l_tax").select(r6("frac_error"))
