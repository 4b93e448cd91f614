"""Interpolation, forward model, smoothing and correlation on embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import HIST, PIXELS, hist, pixels, query, r6, table
from spectraloom.operators import resample as R
from spectraloom.plans.scale import halo
from spectraloom.sources.library import pack_library

C = "299792.458e0"
TPL = "tpl AS (SELECT object_id AS tpl_id, bin AS pix, 8390 + 2e0 * bin + 0.1e0 * (object_id % 5) AS wave, raw + 0.1e0 AS flux FROM hist)"


def templates(spark, sf):
    return hist(spark, sf).select(
        F.col("object_id").alias("tpl_id"), F.col("bin").alias("pix"), (8390 + 2.0 * F.col("bin") + 0.1 * (F.col("object_id") % 5)).alias("wave"),
        (F.col("raw") + 0.1).alias("flux"),
    )


def axis(spark, sf):
    """The distinct coordinates of the pixel table."""
    return pixels(spark, sf).select("pix", "x").distinct()


INTERP = f"""{HIST}, {PIXELS}, {TPL}, ax AS (SELECT DISTINCT pix, x FROM pixels),
seg AS (SELECT tpl_id, wave, flux, lead(wave) OVER w AS nw, lead(flux) OVER w AS nf FROM tpl WINDOW w AS (PARTITION BY tpl_id ORDER BY wave)),
ti AS (SELECT t.tpl_id, ax.pix, ax.x, s.nw IS NULL AS outside,
   CASE WHEN s.flux > 0 AND s.nf > 0 THEN s.flux + (s.nf - s.flux) * ((x - s.wave) / (s.nw - s.wave)) ELSE 1 END AS t
  FROM ax JOIN (SELECT DISTINCT tpl_id FROM tpl) t ON true LEFT JOIN seg s ON s.tpl_id = t.tpl_id AND x >= s.wave AND x < s.nw)"""


@query("interp_templates", f"WITH {INTERP} SELECT tpl_id, pix, outside, round(t, 6) AS t FROM ti")
def interp_templates(spark, sf):
    return R.interp_templates(axis(spark, sf), templates(spark, sf)).select("tpl_id", "pix", "outside", r6("t"))


@query("coverage_mask", f"WITH {INTERP} SELECT pix, x, bool_and(outside) AS outside_all FROM ti GROUP BY 1, 2")
def coverage_mask(spark, sf):
    return R.coverage_mask(R.interp_templates(axis(spark, sf), templates(spark, sf)), ["pix", "x"])


@query("normalise_templates", f"""
WITH {HIST}, n AS (SELECT object_id AS tpl_id, bin AS pix, raw, quantile_cont(CASE WHEN raw > 0 THEN raw END, 0.5) OVER (PARTITION BY object_id) AS mp, quantile_cont(raw, 0.5) OVER (PARTITION BY object_id) AS m FROM hist)
SELECT tpl_id, pix, round(raw / coalesce(CASE WHEN mp > 0 THEN mp END, 1), 6) AS by_positive, round(raw / CASE WHEN m <> 0 THEN m ELSE 1 END, 3) AS by_median FROM n""")
def normalise_templates(spark, sf):
    h = hist(spark, sf).select(F.col("object_id").alias("tpl_id"), F.col("bin").alias("pix"), F.col("raw").alias("by_positive"), F.col("raw").alias("by_median"))
    out = R.normalise_templates(R.normalise_templates(h, "by_positive"), "by_median", positive_only=False)
    return out.select("tpl_id", "pix", r6("by_positive"), F.round("by_median", 3).alias("by_median"))


@query("mix_templates", f"""
WITH {INTERP}, wt AS (SELECT DISTINCT label AS object_id, object_id AS tpl_id, 1 + max(CASE WHEN bin = 0 THEN raw END) OVER (PARTITION BY object_id) AS w FROM hist)
SELECT object_id, pix, round(CASE WHEN sum(w) <= 0 THEN 1 ELSE sum(CASE WHEN outside THEN 0 ELSE w * t END) / CASE WHEN sum(CASE WHEN outside THEN 0 ELSE w END) = 0 THEN 1 ELSE sum(CASE WHEN outside THEN 0 ELSE w END) END END, 6) AS tmix,
  round(sum(w * t) / sum(w), 6) AS plain FROM ti JOIN wt USING (tpl_id) GROUP BY 1, 2""")
def mix_templates(spark, sf):
    w = table(spark, sf, "embeddings").select(
        F.col("label").alias("object_id"), F.col("vec_id").alias("tpl_id"), (1 + F.col("embedding")[0].cast("double")).alias("w")
    )
    t = R.interp_templates(axis(spark, sf), templates(spark, sf))
    by = ["object_id", "pix"]
    plain = R.mix_templates(t, w, by, use_coverage=False).select(*by, r6("tmix", "plain"))
    return R.mix_templates(t, w, by).select(*by, r6("tmix")).join(plain, by)


@query("rebin", f"""
WITH {PIXELS}, s AS (SELECT object_id, pix, x, g, gerr, lead(x) OVER w AS nx, lead(g) OVER w AS ng, lead(gerr) OVER w AS ne, min(x) OVER (PARTITION BY object_id) AS x0 FROM (SELECT object_id, pix, g, gerr, x + 0.3e0 * (pix % 3) AS x FROM pixels) WINDOW w AS (PARTITION BY object_id ORDER BY pix)),
q AS (SELECT object_id, pix, x0 + 1.4e0 * pix AS x FROM s)
SELECT q.object_id, q.pix, round(q.x, 6) AS x, round(s.g + coalesce((s.ng - s.g) * (q.x - s.x) / (s.nx - s.x), 0), 6) AS g, round(s.gerr + coalesce((s.ne - s.gerr) * (q.x - s.x) / (s.nx - s.x), 0), 6) AS gerr
FROM q JOIN s ON q.object_id = s.object_id AND q.x >= s.x AND (s.nx IS NULL OR q.x < s.nx)""")
def rebin(spark, sf):
    px = pixels(spark, sf).withColumn("x", F.col("x") + 0.3 * (F.col("pix") % 3))
    return R.rebin(px, 1.4, ["g", "gerr"]).select("object_id", "pix", r6("x"), r6("g"), r6("gerr"))


FINE = """fine0 AS (SELECT h.object_id, j, h.b + (coalesce(n.b, h.b) - h.b) * (j * 63 / 26e0 - floor(j * 63 / 26e0)) AS y FROM (SELECT object_id, unnest(range(0, 27)) AS j FROM (SELECT DISTINCT object_id FROM hist)) f
  JOIN hist h ON h.object_id = f.object_id AND h.bin = CAST(floor(j * 63 / 26e0) AS INT) LEFT JOIN hist n ON n.object_id = f.object_id AND n.bin = h.bin + 1),
fine AS (SELECT f.object_id, j, y * (CASE WHEN sy <> 0 THEN sb / sy ELSE 1 END) AS y FROM fine0 f JOIN (SELECT object_id, sum(y) AS sy FROM fine0 GROUP BY 1) a USING (object_id) JOIN (SELECT object_id, sum(b) AS sb FROM hist GROUP BY 1) b USING (object_id))"""


@query("refine_losvd", f"WITH {HIST}, {FINE} SELECT object_id, CAST(j AS BIGINT) AS j, round(y, 6) AS y FROM fine")
def refine_losvd(spark, sf):
    return R.refine_losvd(hist(spark, sf), ["object_id"], 27).select("object_id", F.col("j").cast("long").alias("j"), r6("y"))


@query("convolve_losvd", f"""
WITH {HIST}, {FINE}, px AS (SELECT object_id, CAST(bin AS BIGINT) AS pix, 8400 + 1.25e0 * bin AS x, 1 + raw AS t FROM hist),
s AS (SELECT object_id, t, y, z - CAST(1 AS BIGINT) AS target FROM (
  SELECT p.object_id, t, y, CAST(CASE WHEN q >= 0 THEN floor(q + 0.5e0) ELSE ceil(q - 0.5e0) END AS BIGINT) AS z FROM (
    SELECT px.object_id, t, y, (1 - 8400 / 1.25e0) + x * ((1 + (-300e0 + 600e0 * j / 26) / {C}) / 1.25e0) AS q FROM px JOIN fine USING (object_id)) p)),
a AS (SELECT object_id, target, sum(t * y) AS g, sum(y) AS w FROM s WHERE target BETWEEN 0 AND 63 GROUP BY 1, 2),
tot AS (SELECT object_id, sum(y) AS sy FROM fine GROUP BY 1)
SELECT px.object_id, px.pix, round(CASE WHEN coalesce(w, 0) <> 0 THEN g * sy / w ELSE coalesce(g, 0) END, 5) AS model, round(coalesce(w, 0), 5) AS weight
FROM px JOIN tot USING (object_id) LEFT JOIN a ON a.object_id = px.object_id AND a.target = px.pix""")
def convolve_losvd(spark, sf):
    h = hist(spark, sf)
    px = h.select("object_id", F.col("bin").cast("long").alias("pix"), (8400 + 1.25 * F.col("bin")).alias("x"), (1 + F.col("raw")).alias("t"))
    out = R.convolve_losvd(px, R.fine_losvd(h, ["object_id"], 27), 1.25)
    return out.select("object_id", "pix", F.round("model", 5).alias("model"), F.round("weight", 5).alias("weight"))


def _smooth_sql(src: str, key: str, pos: str, value: str, sigma: float, name: str) -> str:
    r = int(4 * sigma + 0.5)
    return f"""{name} AS (SELECT s.{key}, s.{pos}, sum(o.{value} * k.w) AS smooth FROM (SELECT *, max({pos}) OVER (PARTITION BY {key}) AS last FROM {src}) s
  JOIN (SELECT d, exp(-0.5e0 * (d / {sigma}e0) ** 2) / sum(exp(-0.5e0 * (d / {sigma}e0) ** 2)) OVER () AS w FROM (SELECT unnest(range({-r}, {r + 1})) AS d)) k ON true
  JOIN {src} o ON o.{key} = s.{key} AND o.{pos} = least(greatest(s.{pos} + k.d, 0), s.last) GROUP BY 1, 2)"""


@query("gauss_smooth", f"""
WITH {HIST}, {PIXELS}, {_smooth_sql('pixels', 'object_id', 'pix', 'g', 3.0, 's1')}, {_smooth_sql('hist', 'object_id', 'bin', 'raw', 1.7, 's2')}
SELECT 'event' AS src, object_id, pix, round(smooth, 6) AS smooth FROM s1 UNION ALL SELECT 'vector', object_id, bin, round(smooth, 6) FROM s2""")
def gauss_smooth(spark, sf):
    cols = ["object_id", "pix", r6("smooth")]
    a = R.gauss_smooth(pixels(spark, sf), 3.0).select(F.lit("event").alias("src"), *cols)
    v = hist(spark, sf).withColumn("pix", F.col("bin").cast("long"))
    return a.unionByName(R.gauss_smooth(v, 1.7, "raw").select(F.lit("vector").alias("src"), *cols))


@query("flatten_templates", f"""
WITH {HIST}, tb AS (SELECT object_id AS tpl_id, bin AS pix, 1 + raw AS flux FROM hist), {_smooth_sql('tb', 'tpl_id', 'pix', 'flux', 20.0, 's')}
SELECT tpl_id, CAST(pix AS BIGINT) AS pix, round(CASE WHEN smooth > 0 THEN flux / smooth ELSE 1 END, 6) AS flux FROM tb JOIN s USING (tpl_id, pix)""")
def flatten_templates(spark, sf):
    from spectraloom.operators.mocks import flatten_templates as flatten

    t = hist(spark, sf).select(F.col("object_id").alias("tpl_id"), F.col("bin").cast("long").alias("pix"), (1 + F.col("raw")).alias("flux"))
    return flatten(t, 20.0).select("tpl_id", "pix", r6("flux"))


@query("pack_library", f"""
WITH {HIST}, tpl AS (SELECT object_id AS tpl_id, 8390 + 2e0 * bin + 0.5e0 * (object_id % 2) AS wave, raw + 0.1e0 AS flux FROM hist),
g AS (SELECT 8390 + i * 0.125e0 AS x FROM (SELECT unnest(range(0, CAST(ceil((max(wave) - min(wave)) / 0.125e0) AS BIGINT))) AS i FROM tpl)),
seg AS (SELECT tpl_id, wave, flux, lead(wave) OVER w AS nw, lead(flux) OVER w AS nf FROM tpl WINDOW w AS (PARTITION BY tpl_id ORDER BY wave))
SELECT t.tpl_id, x AS wave, round(CASE WHEN s.flux > 0 AND s.nf > 0 THEN s.flux + (s.nf - s.flux) * ((x - s.wave) / (s.nw - s.wave)) ELSE 1 END, 6) AS flux
FROM g JOIN (SELECT DISTINCT tpl_id FROM tpl) t ON true LEFT JOIN seg s ON s.tpl_id = t.tpl_id AND x >= s.wave AND x < s.nw WHERE x >= 8400 AND x < 8500""")
def packed_library(spark, sf):
    t = hist(spark, sf).select(F.col("object_id").alias("tpl_id"), (8390 + 2.0 * F.col("bin") + 0.5 * (F.col("object_id") % 2)).alias("wave"), (F.col("raw") + 0.1).alias("flux"))
    return pack_library(t, 8400.0, 8500.0, shared=False).select("tpl_id", "wave", r6("flux"))


DETREND = """u0 AS (SELECT *, 2 * pix / CAST(max(pix) OVER (PARTITION BY object_id) AS DOUBLE) - 1 AS u FROM src),
q1 AS (SELECT *, u - avg(u) FILTER (WHERE good) OVER (PARTITION BY object_id) AS p1 FROM u0),
q2 AS (SELECT *, u * u - avg(u * u) FILTER (WHERE good) OVER (PARTITION BY object_id) - p1 * sum(u * u * p1) FILTER (WHERE good) OVER (PARTITION BY object_id) / sum(p1 * p1) FILTER (WHERE good) OVER (PARTITION BY object_id) AS p2 FROM q1),
q3 AS (SELECT *, u ** 3 - avg(u ** 3) FILTER (WHERE good) OVER (PARTITION BY object_id) - p1 * sum(u ** 3 * p1) FILTER (WHERE good) OVER (PARTITION BY object_id) / sum(p1 * p1) FILTER (WHERE good) OVER (PARTITION BY object_id)
   - p2 * sum(u ** 3 * p2) FILTER (WHERE good) OVER (PARTITION BY object_id) / sum(p2 * p2) FILTER (WHERE good) OVER (PARTITION BY object_id) AS p3 FROM q2),
dt AS (SELECT object_id, pix, x, good, """ + ", ".join(
    f"CASE WHEN good THEN {y} - avg({y}) FILTER (WHERE good) OVER w" + "".join(
        f" - {p} * sum({y} * {p}) FILTER (WHERE good) OVER w / sum({p} * {p}) FILTER (WHERE good) OVER w" for p in ("p1", "p2", "p3")
    ) + f" ELSE 0 END AS {y}" for y in ("g", "t")
) + " FROM q3 WINDOW w AS (PARTITION BY object_id))"

SRC = "src AS (SELECT object_id, pix, x, good, g, lead(g, 3, 10e0) OVER (PARTITION BY object_id ORDER BY pix) AS t FROM pixels)"
XC = """xc AS (SELECT a.object_id, a.pix - b.pix AS lag, sum(a.g * b.t) AS xcorr FROM dt a JOIN dt b USING (object_id) GROUP BY 1, 2),
pk AS (SELECT object_id, min(lag) AS lag0, max(xcorr) AS y0 FROM xc WHERE (object_id, xcorr) IN (SELECT object_id, max(xcorr) FROM xc GROUP BY 1) GROUP BY 1),
nb AS (SELECT p.*, m.xcorr AS ym, n.xcorr AS yp FROM pk p LEFT JOIN xc m ON m.object_id = p.object_id AND m.lag = lag0 - 1 LEFT JOIN xc n ON n.object_id = p.object_id AND n.lag = lag0 + 1),
rf AS (SELECT object_id, lag0, lag0 + CASE WHEN ym - 2 * y0 + yp < 0 AND abs(0.5e0 * (ym - yp) / (ym - 2 * y0 + yp)) <= 1 THEN 0.5e0 * (ym - yp) / (ym - 2 * y0 + yp) ELSE 0 END AS lag FROM nb)"""


def _pair(spark, sf):
    """Each series and itself moved by three pixels."""
    return halo(pixels(spark, sf), ["object_id"], 3, lambda w: {"t": F.coalesce(F.lead("g", 3).over(w), F.lit(10.0))})


@query("detrend", f"WITH {PIXELS}, {SRC}, {DETREND} SELECT object_id, pix, round(g, 6) AS g, round(t, 6) AS t FROM dt")
def detrend(spark, sf):
    return R.detrend(_pair(spark, sf), 3, ["g", "t"]).select("object_id", "pix", r6("g"), r6("t"))


@query("cross_correlate", f"WITH {PIXELS}, {SRC}, {DETREND}, {XC} SELECT object_id, lag, round(xcorr, 4) AS xcorr FROM xc")
def cross_correlate(spark, sf):
    d = R.detrend(_pair(spark, sf), 3, ["g", "t"])
    return R.cross_correlate(d).select("object_id", "lag", F.round("xcorr", 4).alias("xcorr"))


@query("refine_peak", f"WITH {PIXELS}, {SRC}, {DETREND}, {XC} SELECT object_id, lag0, round(lag, 6) AS lag FROM rf")
def refine_peak(spark, sf):
    d = R.detrend(_pair(spark, sf), 3, ["g", "t"])
    return R.refine_peak(R.cross_correlate(d)).select("object_id", "lag0", r6("lag"))


@query("xcorr_velocity", f"""
WITH {PIXELS}, {SRC}, {DETREND}, {XC}, n AS (SELECT object_id, count(*) AS n FROM pixels GROUP BY 1)
SELECT object_id, round(least(greatest(lag * 1.25e0 * {C} / x, -300), 300), 6) AS v FROM rf JOIN n USING (object_id) JOIN pixels USING (object_id) WHERE pix = n // 2""")
def xcorr_velocity(spark, sf):
    return R.xcorr_velocity(_pair(spark, sf), 1.25, -300.0, 300.0).select("object_id", r6("v"))
