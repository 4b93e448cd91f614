"""Column expressions, axis handling and filters on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import HIST, PIXELS, RUNS, big, hist, pixels, query, r6, table
from spectraloom.functions.lines import TRIPLET_CENTRES, TRIPLET_DEPTHS, TRIPLET_WIDTH, WEAK_LINES
from spectraloom.functions import columns as C
from spectraloom.operators import pixels as P
from spectraloom.operators import shapes

CK = "299792.458e0"


@query("to_rest", f"""
WITH {PIXELS} SELECT object_id, pix, x / (1 + 0.001556e0) AS x_rest,
  least(8400 / (1 + 0.001556e0 * (object_id - 70)), 8450 / (1 + 0.001556e0 * (object_id - 70))) AS lo,
  greatest(8400 / (1 + 0.001556e0 * (object_id - 70)), 8450 / (1 + 0.001556e0 * (object_id - 70))) AS hi FROM pixels""")
def to_rest(spark, sf):
    z = 0.001556 * (F.col("object_id") - 70)
    lo, hi = C.window_to_rest(F.lit(8450.0), F.lit(8400.0), z)
    return pixels(spark, sf).select("object_id", "pix", C.to_rest("x", 0.001556).alias("x_rest"), lo.alias("lo"), hi.alias("hi"))


@query("resolve_frame", f"""
WITH {PIXELS}, zed AS (SELECT *, 0.0008e0 * (object_id % 5 - 1) AS z FROM pixels),
v AS (SELECT object_id, count(*) FILTER (WHERE x / (1 + z) > 8395 AND x / (1 + z) < 8440)
        > count(*) FILTER (WHERE x > 8395 AND x < 8440) AS shifted FROM zed GROUP BY 1)
SELECT object_id, pix, shifted, CASE WHEN shifted THEN x / (1 + z) ELSE x END AS x_fit FROM zed JOIN v USING (object_id)""")
def resolve_frame(spark, sf):
    z = 0.0008 * (F.col("object_id") % 5 - 1)
    return P.resolve_frame(pixels(spark, sf), z, 8395.0, 8440.0).select("object_id", "pix", "shifted", "x_fit")


@query("detect_index_axis", f"""
WITH {PIXELS}, raw AS (SELECT object_id, pix, CASE object_id % 3 WHEN 0 THEN pix + 1e0 WHEN 1 THEN pix + 100e0 ELSE x END AS c1 FROM pixels),
f AS (SELECT object_id, bool_and(c1 = floor(c1)) AND arg_min(c1, pix) < 100 AS is_index FROM raw GROUP BY 1)
SELECT object_id, pix, is_index, CASE WHEN is_index THEN 4750 + 1.25e0 * pix ELSE c1 END AS x FROM raw JOIN f USING (object_id)""")
def detect_index_axis(spark, sf):
    k = F.col("object_id") % 3
    raw = pixels(spark, sf).select("object_id", "pix", F.when(k == 0, F.col("pix") + 1.0).when(k == 1, F.col("pix") + 100.0).otherwise(F.col("x")).alias("c1"))
    return P.detect_index_axis(raw, 4750.0, 1.25).select("object_id", "pix", "is_index", "x")


@query("sigma_from_variance", "SELECT c_custkey, round(sqrt(greatest(c_acctbal, 0e0)), 6) AS sigma FROM customer")
def sigma_from_variance(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r6(C.sigma_from_variance("c_acctbal"), "sigma"))


@query("error_policy", f"""
WITH {PIXELS}, e AS (SELECT object_id, pix, CASE WHEN object_id % 10 = 0 THEN -1 WHEN good THEN gerr ELSE 0 END AS gerr FROM pixels),
m AS (SELECT object_id, coalesce(quantile_cont(CASE WHEN gerr > 0 THEN gerr END, 0.5), 1e0) AS med FROM e GROUP BY 1)
SELECT object_id, pix, round(med, 6) AS e_median, round(gerr, 6) AS e_file, 1e0 AS e_unit, 0.3e0 AS e_scalar, round(gerr * 2, 6) AS e_column FROM e JOIN m USING (object_id)""")
def error_policy(spark, sf):
    base = pixels(spark, sf).withColumn("gerr", F.when(F.col("object_id") % 10 == 0, -1.0).when(F.col("good"), F.col("gerr")).otherwise(0.0))
    out = base.select("object_id", "pix", "gerr", r6("gerr", "e_file"))
    for name, policy, value in [("e_unit", "unit", None), ("e_scalar", "scalar", 0.3), ("e_column", "column", F.col("e_file") * 2)]:
        out = P.apply_error_policy(out, policy, value).withColumn(name, r6("gerr")).withColumn("gerr", F.col("e_file"))
    return P.apply_error_policy(out, "median").select("object_id", "pix", r6("gerr", "e_median"), "e_file", "e_unit", "e_scalar", "e_column")


@query("sanitise", f"""
WITH {PIXELS}, e AS (SELECT object_id, pix, x, CASE WHEN pix % 7 = 0 THEN NULL WHEN pix % 11 = 0 THEN 'nan'::DOUBLE ELSE g END AS g,
  CASE WHEN pix % 13 = 0 THEN 0 WHEN pix % 17 = 0 THEN 'inf'::DOUBLE ELSE gerr END AS gerr, good FROM pixels)
SELECT object_id, pix, CASE WHEN g IS NULL OR isnan(g) THEN 0 ELSE g END AS g,
  good AND pix % 7 <> 0 AND pix % 11 <> 0 AND pix % 13 <> 0 AND pix % 17 <> 0 AS good FROM e""")
def sanitise(spark, sf):
    p = F.col("pix")
    d = pixels(spark, sf).withColumn("g", F.when(p % 7 == 0, F.lit(None)).when(p % 11 == 0, float("nan")).otherwise(F.col("g")))
    d = d.withColumn("gerr", F.when(p % 13 == 0, 0.0).when(p % 17 == 0, float("inf")).otherwise(F.col("gerr")))
    return P.sanitise(d).select("object_id", "pix", "g", "good")


@query("flux_range_mask", f"WITH {PIXELS} SELECT object_id, pix, g / 40 > 0 AND g / 40 <= 1.3e0 AS keep FROM pixels")
def flux_range(spark, sf):
    return pixels(spark, sf).select("object_id", "pix", C.flux_in_range(F.col("g") / 40).alias("keep"))


@query("nint", """SELECT event_id, CAST(CASE WHEN value - 40 >= 0 THEN floor(value - 40 + 0.5e0) ELSE ceil(value - 40 - 0.5e0) END AS BIGINT) AS n,
  CAST(CASE WHEN k >= 0 THEN floor(k + 0.5e0) ELSE ceil(k - 0.5e0) END AS BIGINT) AS halves
FROM (SELECT event_id, value, (event_id % 21 - 10) / 2e0 AS k FROM events)""")
def nint(spark, sf):
    return table(spark, sf, "events").select("event_id", C.nint(F.col("value") - 40).alias("n"), C.nint((F.col("event_id") % 21 - 10) / F.lit(2.0)).alias("halves"))


from spectraloom.catalog.ingest import LINES  # noqa: E402
from spectraloom.functions.lines import line_table  # noqa: E402


@query("line_half_width", f"""
WITH {PIXELS}, {LINES}, w AS (SELECT line_id, name, centre, greatest(5e0, centre * 300 / {CK}) AS hw_em, greatest(6e0, centre * 400 / {CK}) AS hw_abs FROM lines)
SELECT name, centre, round(hw_em, 6) AS hw_em, round(hw_abs, 6) AS hw_abs,
  (SELECT count(*) FROM pixels WHERE x BETWEEN centre - hw_em AND centre + hw_em) AS n_em,
  (SELECT count(*) FROM pixels WHERE x BETWEEN centre - hw_abs AND centre + hw_abs) AS n_abs FROM w""")
def line_half_width(spark, sf):
    ln = line_table(spark).select("line_id", "name", "centre", C.line_half_width("centre", 5.0, 300.0).alias("hw_em"), C.line_half_width("centre", 6.0, 400.0).alias("hw_abs"))
    reach = F.greatest("hw_em", "hw_abs")
    wide = ln.withColumn("_b", F.explode(F.sequence(F.floor((F.col("centre") - reach) / 25), F.floor((F.col("centre") + reach) / 25))))
    px = pixels(spark, sf).select("x", F.floor(F.col("x") / 25).alias("_b"))
    off = F.abs(F.col("x") - F.col("centre"))
    inside = lambda hw: F.count_if((F.col("x") >= F.col("centre") - F.col(hw)) & (F.col("x") <= F.col("centre") + F.col(hw)))
    n = px.join(wide, "_b").filter(off <= reach + 1).groupBy("line_id").agg(inside("hw_em").alias("n_em"), inside("hw_abs").alias("n_abs"))
    zero = F.lit(0).cast("long")
    return ln.join(n, "line_id", "left").select("name", "centre", r6("hw_em"), r6("hw_abs"), F.coalesce("n_em", zero).alias("n_em"), F.coalesce("n_abs", zero).alias("n_abs"))


FWHM = "(1 / (2 * sqrt(2 * ln(2e0))))"


@query("lsf_mismatch", f"""
WITH w AS (SELECT p_partkey, (p_size - 3) * {FWHM} AS d, (p_partkey % 20) * {FWHM} AS t FROM part)
SELECT p_partkey, CASE WHEN d > 0 AND t > 0 THEN round(CASE WHEN abs(d - t) <= 1e-6 THEN 0 ELSE sqrt(abs(d * d - t * t)) END, 6) END AS kernel_sigma,
  CASE WHEN NOT (d > 0 AND t > 0) THEN 'invalid' WHEN abs(d - t) <= 1e-6 THEN 'none' WHEN t < d THEN 'convolve_templates' ELSE 'convolve_data' END AS direction FROM w""")
def lsf_mismatch(spark, sf):
    m = C.resolution_mismatch((F.col("p_size") - 3).cast("double"), (F.col("p_partkey") % 20).cast("double"))
    return table(spark, sf, "part").select("p_partkey", r6(m["kernel_sigma"], "kernel_sigma"), m["direction"].alias("direction"))


@query("scaled_coordinate", f"""
WITH {PIXELS} SELECT object_id, pix, round((x - avg(x) OVER w) / CASE WHEN max(x) OVER w > min(x) OVER w THEN max(x) OVER w - min(x) OVER w ELSE 1 END, 6) AS xs
FROM pixels WINDOW w AS (PARTITION BY object_id)""")
def scaled(spark, sf):
    return P.scaled_coordinate(pixels(spark, sf)).select("object_id", "pix", r6("xs"))


@query("gh_basis", f"""
WITH {HIST}, w AS (SELECT object_id, bin, (v - 20) / 120 AS w FROM hist)
SELECT object_id, bin, round((2 * w * w * w - 3 * w) / sqrt(3e0), 6) AS h3, round((4 * w * w * w * w - 12 * w * w + 3) / sqrt(24e0), 6) AS h4,
  round((w * w * w - 3 * w) / sqrt(6e0), 6) AS he3, round((w ** 4 - 6 * w * w + 3) / sqrt(24e0), 6) AS he4,
  round((w ** 5 - 10 * w ** 3 + 15 * w) / sqrt(120e0), 6) AS he5, round((w ** 6 - 15 * w ** 4 + 45 * w * w - 15) / sqrt(720e0), 6) AS he6 FROM w""")
def gh_basis(spark, sf):
    w = (F.col("v") - 20) / 120
    return hist(spark, sf).select(
        "object_id", "bin", r6(C.gh_h3(w), "h3"), r6(C.gh_h4(w), "h4"), *[r6(C.gh_basis(w, n), f"he{n}") for n in (3, 4, 5, 6)]
    )


SUPP = """sup AS (SELECT s_suppkey AS object_id, s_acctbal / 100 AS vel, s_suppkey - 3e0 AS sig, (s_suppkey % 7 - 3) / 20e0 AS h3, (s_suppkey % 5 - 2) / 20e0 AS h4 FROM supplier),
grid AS (SELECT *, -300 + 600 * CAST(bin AS DOUBLE) / 28 AS v FROM (SELECT *, unnest(range(0, 29)) AS bin FROM sup))"""


def supplier_grid(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("object_id"), (F.col("s_acctbal") / 100).alias("vel"), (F.col("s_suppkey") - 3.0).alias("sig"),
        ((F.col("s_suppkey") % 7 - 3) / 20.0).alias("h3"), ((F.col("s_suppkey") % 5 - 2) / 20.0).alias("h4"),
    )
    return P.velocity_grid(s, 29, -300.0, 300.0)


@query("gh_profile", f"""
WITH {SUPP}, w AS (SELECT *, CASE WHEN sig > 0 THEN (v - vel) / sig END AS w FROM grid),
g AS (SELECT *, 100 * exp(-0.5e0 * w * w) / (sqrt(2 * pi()) * sig) AS gauss FROM w)
SELECT object_id, CAST(bin AS BIGINT) AS bin, round(v, 6) AS v, CASE WHEN sig > 0 THEN round(gauss * (1 + h3 * (2 * w * w * w - 3 * w) / sqrt(3e0) + h4 * (4 * w ** 4 - 12 * w * w + 3) / sqrt(24e0)), 6) END AS profile,
  CASE WHEN sig > 0 THEN round(gauss * (1 + h3 * (w ** 3 - 3 * w) / sqrt(6e0) + h4 * (w ** 4 - 6 * w * w + 3) / sqrt(24e0)), 6) END AS profile_higher FROM g""")
def gh_profile(spark, sf):
    return supplier_grid(spark, sf).select(
        "object_id", big("bin"), r6("v"), r6(C.gh_profile("v", 100.0, "vel", "sig", "h3", "h4"), "profile"),
        r6(C.gh_profile_higher("v", 100.0, "vel", "sig", "h3", "h4"), "profile_higher"),
    )


@query("wing_weight", f"""
WITH {SUPP}, d AS (SELECT object_id, bin, abs(v - vel) / (20 + abs(sig)) AS d FROM grid)
SELECT object_id, CAST(bin AS BIGINT) AS bin, round(CASE WHEN d > 1.8e0 THEN 1000 * (d / 1.8e0) ** 4 ELSE 1000 END, 6) AS weight,
  round(CASE WHEN d > 1.8e0 THEN (d / 1.8e0) ** 4 - 1 ELSE 0 END, 6) AS excess FROM d""")
def wing_weight(spark, sf):
    s0 = 20 + F.abs("sig")
    return supplier_grid(spark, sf).select("object_id", big("bin"), r6(C.wing_weight("v", 1000.0, s0, "vel"), "weight"), r6(C.wing_excess("v", s0, "vel"), "excess"))


@query("velocity_grid", """
WITH s AS (SELECT s_suppkey, 20 + s_suppkey AS sg FROM supplier)
SELECT s_suppkey AS object_id, CAST(bin AS BIGINT) AS bin, round(-4.5e0 * sg + 9 * sg * CAST(bin AS DOUBLE) / 28, 6) AS v,
  CAST(greatest(3, round_even(9 * sg / 1.25e0 * 8500 / 299792.458e0, 0) * 2) AS BIGINT) AS n_fine
FROM (SELECT *, unnest(range(0, 29)) AS bin FROM s)""")
def velocity_grid(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("object_id"), (20.0 + F.col("s_suppkey")).alias("sg"))
    return P.velocity_grid(s, 29, sigma="sg").select("object_id", big("bin"), r6("v"), big(P.fine_grid_size(9 * F.col("sg"), 1.25, 8500.0), "n_fine"))


@query("velocity_pixels", f"""
SELECT p_partkey, round((p_size - 25) * p_retailprice * 8 / ({CK} * 1.25e0), 6) AS shift,
  round((p_size - 25) * 1.25e0 * {CK} / (p_retailprice * 8), 6) AS back, round({CK} / (1000 + p_size * 100) * {FWHM}, 6) AS lsf FROM part""")
def velocity_pixels(spark, sf):
    k, lam = (F.col("p_size") - 25).cast("double"), F.col("p_retailprice") * 8
    return table(spark, sf, "part").select(
        "p_partkey", r6(C.kms_to_pix(k, lam, 1.25), "shift"), r6(C.pix_to_kms(k, lam, 1.25), "back"), r6(C.lsf_sigma_kms(1000 + F.col("p_size") * 100), "lsf")
    )


@query("apply_corrections", f"""
WITH {PIXELS}, s AS (SELECT *, (x - avg(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS xs FROM pixels WINDOW w AS (PARTITION BY object_id))
SELECT object_id, pix, round(g * 1.1e0, 6) AS plain, round(g * 1.1e0 + 0.2e0 * xs + 1e-9, 6) AS additive, round(g * 1.1e0 * (1 + 0.2e0 * xs) * gerr + 1e-9, 6) AS multiplied FROM s""")
def corrections(spark, sf):
    d = P.scaled_coordinate(pixels(spark, sf))
    return d.select(
        "object_id", "pix", r6(C.apply_corrections("g", "xs", "none", 1.1), "plain"), r6(C.apply_corrections("g", "xs", "additive", 1.1, 0.2) + 1e-9, "additive"),
        r6(C.apply_corrections("g", "xs", "multiplicative", 1.1, 0.2, "gerr") + 1e-9, "multiplied"),
    )


@query("bound_flags", """
WITH b AS (SELECT s_suppkey, s_acctbal AS a, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi, s_nationkey - 12e0 AS grad FROM supplier),
f AS (SELECT *, abs(a - lo) <= 1e-8 + 1e-6 * abs(lo) AS at_lower, abs(a - hi) <= 1e-8 + 1e-6 * abs(hi) AS at_upper FROM b)
SELECT s_suppkey, at_lower, at_upper, CASE WHEN (at_lower AND grad > 0) OR (at_upper AND grad < 0) THEN 0 ELSE grad END AS proj_grad FROM f""")
def bound_flags(spark, sf):
    s = table(spark, sf, "supplier")
    lim = F.broadcast(s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi")).withColumn("k", F.lit(1)))
    d = s.withColumn("k", F.lit(1)).join(lim, "k")
    flags = C.bound_flags("s_acctbal", F.col("s_nationkey") - 12.0, "lo", "hi")
    return d.select("s_suppkey", *[c.alias(n) for n, c in flags.items()])


DIPS = [(c, d, TRIPLET_WIDTH) for c, d in zip(TRIPLET_CENTRES, TRIPLET_DEPTHS)]
WEAK = WEAK_LINES


def _dips_sql(dips):
    return " - ".join(["1"] + [f"{d}e0 * exp(-0.5e0 * ((x - {c}e0) / {w}e0) ** 2)" for c, d, w in dips])


@query("spectrum_shapes", f"""
WITH {PIXELS}, n AS (SELECT *, (x - avg(x) OVER w) / (0.5e0 * (max(x) OVER w - min(x) OVER w)) AS q, min(x) OVER w AS x0 FROM pixels WINDOW w AS (PARTITION BY object_id))
SELECT object_id, pix, round({_dips_sql(DIPS)}, 6) AS triplet, round({_dips_sql(DIPS + WEAK)}, 6) AS forest,
  round(12000 * (1 + 0.8e0 * q + 0.5e0 * q * q - 0.1e0 * q ** 3 + 0.5e0 * exp(-0.5e0 * ((q - 0.2e0) / 0.45e0) ** 2) + 0.01e0 * sin(2 * pi() * (x - x0) / 50)), 5) AS continuum,
  round(1 + 0.05e0 * q + 1e-9, 6) AS tilt FROM n""")
def spectrum_shapes(spark, sf):
    d = shapes.normalised_axis(pixels(spark, sf), ["object_id"])
    return d.select(
        "object_id", "pix", r6(shapes.triplet_template("x"), "triplet"), r6(shapes.forest_template("x"), "forest"),
        F.round(shapes.galaxy_continuum("x", "xn", "x_first"), 5).alias("continuum"), r6(shapes.linear_tilt("xn") + 1e-9, "tilt"),
    )


@query("select_region", f"WITH {PIXELS} SELECT object_id, pix, x, g, gerr, good FROM pixels WHERE x > 8410 AND x < 8450")
def select_region(spark, sf):
    return P.select_region(pixels(spark, sf), 8410.0, 8450.0)


@query("count_in_window", f"WITH {PIXELS} SELECT object_id, count(*) FILTER (WHERE x > 8410 AND x < 8480) AS n_in FROM pixels GROUP BY 1")
def count_in_window(spark, sf):
    return P.count_in_window(pixels(spark, sf), 8410.0, 8480.0)


@query("require_pixels", f"WITH {PIXELS} SELECT object_id, pix, g FROM pixels WHERE object_id IN (SELECT object_id FROM pixels GROUP BY 1 HAVING count(*) >= 65)")
def require_pixels(spark, sf):
    return P.require_pixels(pixels(spark, sf), 65).select("object_id", "pix", "g")


@query("valid_pixels", f"""
WITH {PIXELS}, c AS (SELECT *, count(*) OVER (PARTITION BY object_id) AS n FROM pixels)
SELECT object_id, count(*) FILTER (WHERE good) AS n_valid, count(*) FILTER (WHERE good AND pix >= 3 AND pix < n - 3) AS n_trimmed FROM c GROUP BY 1""")
def valid_pixels(spark, sf):
    px = pixels(spark, sf)
    n = px.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return px.join(n, "object_id").groupBy("object_id").agg(F.count_if(C.valid_pixel()).alias("n_valid"), F.count_if(C.valid_pixel(3, "n")).alias("n_trimmed"))


@query("median_step", f"""
WITH {PIXELS}, t AS (SELECT user_id AS object_id, epoch(ts) AS x, event_id FROM events),
d AS (SELECT object_id, lead(x) OVER (PARTITION BY object_id ORDER BY x, event_id) - x AS d FROM t)
SELECT object_id, round(quantile_cont(d, 0.5), 3) AS step FROM d WHERE d IS NOT NULL GROUP BY 1""")
def median_step(spark, sf):
    from spectraloom.plans.scale import number_rows

    ev = table(spark, sf, "events").select(F.col("user_id").alias("object_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "event_id")
    return P.median_step(number_rows(ev, ["object_id"], ["x", "event_id"])).select("object_id", F.round("step", 3).alias("step"))
