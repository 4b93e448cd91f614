"""Sources and key derivation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog.base import PIXELS, big, pixels, query, r6, table
from spectraloom.functions.columns import object_id, template_meta
from spectraloom.functions.lines import line_rows, line_table
from spectraloom.operators.masks import mask_regions
from spectraloom.operators.pixels import affine_axis
from spectraloom.plans.scale import bucketed_windows, is_small
from spectraloom.sources import library as lib
from spectraloom.sources import runlog, text


@query("ingest_spectra", """
SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line_no, count(*) AS n_lines,
       count(*) FILTER (WHERE l_linenumber <> 7) AS n_ok,
       round(sum(l_quantity), 6) AS s1, round(sum(l_extendedprice), 6) AS s2,
       round(sum(CASE WHEN l_linenumber <> 7 THEN l_tax END), 6) AS s3
FROM lineitem GROUP BY 1, 2""")
def ingest_spectra(spark, sf):
    li = table(spark, sf, "lineitem")
    fields = [F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice")]
    lines = li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"),
        F.when(F.col("l_linenumber") != 7, F.concat_ws("  ", F.lit(" "), *fields, F.col("l_tax").cast("string")))
        .otherwise(F.concat_ws("\t", *fields)).alias("value"),
    )
    return text.parse_spectra(lines).groupBy("file", "line_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("ok").alias("n_ok"),
        r6(F.sum("c1"), "s1"), r6(F.sum("flux"), "s2"), r6(F.sum("err"), "s3"),
    )


@query("ingest_norm", """
SELECT o_orderkey AS file, o_totalprice AS wave, o_custkey + 0e0 AS normflux, 0.5e0 AS err,
       CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS orig_flux,
       CASE WHEN o_orderkey % 2 = 0 THEN 1e0 END AS orig_err,
       CASE WHEN o_orderkey % 2 = 0 THEN 2e0 END AS cont,
       CASE WHEN o_orderkey % 2 = 0 THEN 3e0 END AS cont_err, true AS ok
FROM orders""")
def ingest_norm(spark, sf):
    o = table(spark, sf, "orders")
    three = F.concat_ws(" ", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"), F.lit("0.5"))
    seven = F.concat_ws(" ", three, F.col("o_totalprice").cast("string"), F.lit("1 2 3"))
    lines = o.select(
        F.col("o_orderkey").alias("file"), F.lit(0).cast("long").alias("line_no"),
        F.when(F.col("o_orderkey") % 2 == 0, seven).otherwise(F.concat_ws(" ", three, F.lit("9"))).alias("value"),
    )
    return text.parse_norm(lines).drop("line_no")


@query("ingest_templates", """
SELECT p_partkey AS file, CAST(p_size AS DOUBLE) AS wave, p_retailprice AS flux,
       CASE WHEN p_partkey % 3 = 0 THEN 0.25e0 END AS err, true AS ok FROM part""")
def ingest_templates(spark, sf):
    p = table(spark, sf, "part")
    lines = p.select(
        F.col("p_partkey").alias("file"), F.lit(0).cast("long").alias("line_no"),
        F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"),
                    F.when(F.col("p_partkey") % 3 == 0, "0.25").otherwise("# note")).alias("value"),
    )
    return text.parse_templates(lines).drop("line_no")


@query("resolve_manifest", """
SELECT p_partkey AS line_no,
       CASE WHEN p_partkey % 5 = 0 THEN '/abs/' || p_brand ELSE p_brand END AS entry,
       CASE WHEN p_partkey % 5 = 0 THEN '/abs/' || p_brand ELSE '/lib/base/' || p_brand END AS path
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def resolve_manifest(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    lines = p.select(
        k.alias("line_no"),
        F.when(k % 7 == 0, F.concat(F.lit(" # "), "p_brand")).when(k % 11 == 0, "  ")
        .when(k % 5 == 0, F.concat(F.lit("/abs/"), "p_brand")).otherwise(F.concat(F.lit("  "), "p_brand")).alias("value"),
    )
    return text.resolve_manifest(lines, "/lib/base/")


REGION_ROWS = [(8410.0, 8415.0), (8440.5, 8452.25), (8480.0, 8481.0), (-8430.0, -8436.0), (-8490.0, -8502.0)]


@query("ingest_regions", f"""
WITH {PIXELS}, reg(lo, hi) AS (VALUES {', '.join(f'({a}e0, {b}e0)' for a, b in REGION_ROWS)})
SELECT lo, hi, (SELECT count(*) FROM pixels WHERE x BETWEEN lo AND hi) AS n_inside FROM reg""")
def ingest_regions(spark, sf):
    # The region list is a small configuration file; the pixels come from the given table.
    lines = spark.createDataFrame(
        [("reg", i, f"  {a} {b}  # note") for i, (a, b) in enumerate(REGION_ROWS)] + [("reg", 99, "# only a note")],
        "file string, line_no long, value string",
    )
    reg = text.parse_regions(lines)
    # Windows are copied into coordinate buckets, so pixels meet them by an equi-join.
    wins, width = bucketed_windows(reg)
    px = pixels(spark, sf).withColumn("_bkt", F.floor(F.col("x") / width))
    # Few buckets hold all pixels, so a shuffle by bucket would put a bucket's pixels into one task.
    hit = px.join(F.broadcast(wins) if is_small(reg) else wins, "_bkt").filter("x BETWEEN lo AND hi").groupBy("lo", "hi").count()
    return reg.join(hit, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("count", F.lit(0).cast("long")).alias("n_inside"))


@query("ingest_params", """
SELECT c_custkey AS file, c_mktsegment AS name, key, raw, number, kind FROM (
  SELECT c_custkey, c_mktsegment,
         unnest([{'key': 'nation', 'raw': CAST(c_nationkey AS VARCHAR), 'number': CAST(c_nationkey AS DOUBLE), 'kind': 'int'},
                 {'key': 'half', 'raw': CAST(c_nationkey AS VARCHAR) || '.5', 'number': c_nationkey + 0.5e0, 'kind': 'float'},
                 {'key': 'seg', 'raw': c_mktsegment, 'number': NULL, 'kind': 'text'}], recursive := true)
  FROM customer)""")
def ingest_params(spark, sf):
    c = table(spark, sf, "customer")
    nat = F.col("c_nationkey").cast("string")
    entries = F.array(
        F.lit("# parameters"), F.col("c_mktsegment"), F.lit(""), F.lit("lonely"),
        F.lit("nation 999"), F.concat(F.lit("nation "), nat, F.lit(" ignored")),
        F.concat(F.lit("half "), nat, F.lit(".5")), F.concat(F.lit("seg  "), F.col("c_mktsegment")),
    )
    lines = c.select(F.col("c_custkey").alias("file"), F.posexplode(entries).alias("line_no", "value"))
    return text.parse_params(lines)


@query("read_run_log", """
SELECT k, count(*) AS n, min(event_id) AS first_id FROM (
  SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
  WHERE event_id % 10 <> 3 AND event_id % 50 NOT IN (0, 1) AND event_id % 500 <> 2)
GROUP BY 1""")
def read_run_log(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    lines = e.select(
        "event_id",
        F.when(i % 10 == 3, F.expr("left(props, length(props) - 1)")).when(i % 50 == 0, "  ")
        .when(i % 50 == 1, F.concat(F.lit("# "), "props"))
        .when(i % 500 == 2, '{"_header": true, "started": "run"}').otherwise(F.col("props")).alias("value"),
    )
    rows = runlog.parse_run_log(lines, "k long")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


REQUESTS = [(0, 3.0, -0.2), (1, 7.0, 0.1), (2, 12.0005, 0.3), (3, 50.0, 0.0), (4, 25.0, 0.15), (5, 7.0, 0.1)]


@query("select_templates", f"""
WITH req(req, req_age, req_metal) AS (VALUES {', '.join(f'({i}, {a}e0, {m}e0)' for i, a, m in REQUESTS)}),
lib AS (SELECT p_name AS name, p_partkey AS ord, CAST(p_size AS DOUBLE) AS age, (p_partkey % 7) / 10e0 - 0.3e0 AS metal FROM part),
hit AS (SELECT req, req_age, req_metal, name, age, metal,
               row_number() OVER (PARTITION BY req ORDER BY ord) AS rn
        FROM req JOIN lib ON abs(age - req_age) <= 1e-3 + 1e-5 * abs(req_age)
                         AND abs(metal - req_metal) <= 1e-3 + 1e-5 * abs(req_metal))
SELECT CAST(r.req AS BIGINT) AS req, name, age, round(metal, 6) AS metal, h.req IS NOT NULL AS matched
FROM req r LEFT JOIN hit h ON h.req = r.req AND h.rn = 1""")
def select_templates(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("age"),
        ((F.col("p_partkey") % 7) / 10.0 - 0.3).alias("metal"),
    )
    req = spark.createDataFrame(REQUESTS, "req long, req_age double, req_metal double")
    hit = lib.select_templates(p, req).select("req", "name", "age", r6("metal"), F.lit(True).alias("matched"))
    miss = lib.unmatched_requests(p, req).select(
        "req", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("age"),
        F.lit(None).cast("double").alias("metal"), F.lit(False).alias("matched"),
    )
    return hit.unionByName(miss)


@query("epsilon_join", """
WITH lib AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS age, (p_partkey % 7) / 10e0 - 0.3e0 AS metal FROM part),
req AS (SELECT s_suppkey, 1 + s_suppkey % 50 + 0.0004e0 AS a, (s_nationkey % 7) / 10e0 - 0.3e0 AS m FROM supplier)
SELECT s_suppkey, count(*) AS n, min(p_partkey) AS first_part, max(p_partkey) AS last_part
FROM req JOIN lib ON abs(age - a) <= 1e-3 + 1e-5 * abs(a) AND abs(metal - m) <= 1e-3 + 1e-5 * abs(m)
GROUP BY 1""")
def epsilon_join(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("age"), ((F.col("p_partkey") % 7) / 10.0 - 0.3).alias("metal")
    )
    s = table(spark, sf, "supplier").select(
        "s_suppkey", (1 + F.col("s_suppkey") % 50 + F.lit(0.0004)).alias("a"), ((F.col("s_nationkey") % 7) / 10.0 - 0.3).alias("m")
    )
    return lib.epsilon_join(p, s, [("age", "a"), ("metal", "m")]).groupBy("s_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"), F.max("p_partkey").alias("last_part")
    )


def _line_values() -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    return ", ".join(f"({i}, {q(r)}, {q(t)}, {q(n)}, {c}e0)" for i, r, t, n, c in line_rows())


LINES = f"lines(line_id, region, tag, name, centre) AS (VALUES {_line_values()})"


@query("line_table", f"""
WITH {PIXELS}, {LINES}
SELECT region, tag, name, centre, count(object_id) AS n_pixels, count(DISTINCT object_id) AS n_objects
FROM lines LEFT JOIN pixels ON abs(x - centre) <= 2 GROUP BY line_id, region, tag, name, centre""")
def lines_in_data(spark, sf):
    px = pixels(spark, sf).select("object_id", "x")
    near = px.withColumn("_b", F.floor(F.col("x") / 4))
    ln = line_table(spark)
    reach = ln.withColumn("_b", F.explode(F.sequence(F.floor((F.col("centre") - 2) / 4), F.floor((F.col("centre") + 2) / 4))))
    hit = near.join(F.broadcast(reach), "_b").filter(F.abs(F.col("x") - F.col("centre")) <= 2).groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count_distinct("object_id").alias("n_objects")
    )
    zero = F.lit(0).cast("long")
    return ln.join(hit, "line_id", "left").select(
        "region", "tag", "name", "centre",
        F.coalesce("n_pixels", zero).alias("n_pixels"), F.coalesce("n_objects", zero).alias("n_objects"),
    )


@query("object_key", r"""
WITH n AS (SELECT page_id, regexp_extract(url, '([^/?]*)(\?.*)?$', 1) AS name FROM pages),
p AS (SELECT page_id, CASE WHEN name = '' THEN 'index' ELSE replace(name, '.', '_') END AS name FROM n)
SELECT page_id, 'dir/a.b/' || name || CASE page_id % 6 WHEN 0 THEN '.spec' WHEN 1 THEN '.norm' WHEN 2 THEN '.txt' WHEN 3 THEN '.dat' WHEN 4 THEN '' ELSE '.v2.fits' END AS path,
  name || CASE WHEN page_id % 6 = 5 THEN '.v2' ELSE '' END AS object_key FROM p""")
def object_key(spark, sf):
    k = F.col("page_id") % 6
    suffix = (
        F.when(k == 0, ".spec").when(k == 1, ".norm").when(k == 2, ".txt").when(k == 3, ".dat").when(k == 4, "").otherwise(".v2.fits")
    )
    name = F.regexp_extract("url", r"([^/?]*)(\?.*)?$", 1)
    name = F.when(name == "", "index").otherwise(F.replace(name, F.lit("."), F.lit("_")))
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("dir/a.b/"), name, suffix).alias("path"))
    return p.withColumn("object_key", object_id("path"))


@query("affine_axis", f"""
WITH {PIXELS} SELECT object_id, pix, 4750 + 1.25e0 * pix AS x, g FROM pixels""")
def axis(spark, sf):
    return affine_axis(pixels(spark, sf), 4750.0, 1.25).select("object_id", "pix", "x", "g")


@query("template_meta", """
SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 'un' END AS imf_type,
  CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 4) + 0.3e0 END AS imf_slope,
  CASE WHEN p_partkey % 9 <> 0 THEN (CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END) * (p_size + 0.25e0) END AS metallicity,
  CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 14) + 0.5e0 END AS age
FROM part""")
def meta(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(
        F.when(k % 9 == 0, "star_").otherwise("Eun"), (k % 4).cast("string"), F.lit(".3Z"),
        F.when(k % 2 == 0, "m").otherwise("p"), F.col("p_size").cast("string"), F.lit(".25T"),
        (k % 14).cast("string"), F.lit(".5000_iTp0.00_baseFe.fits"),
    )
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("lib/"), name).alias("name"))
    return p.select("p_partkey", *[c.alias(n) for n, c in template_meta("name").items()])


@query("mask_regions", f"""
WITH {PIXELS}, reg(lo, hi) AS (VALUES {', '.join(f'({a}e0, {b}e0)' for a, b in REGION_ROWS)})
SELECT object_id, pix, x, EXISTS (SELECT 1 FROM reg WHERE (x >= lo AND x <= hi)
  OR (x * (1 + 0.0005e0) >= -lo AND x * (1 + 0.0005e0) <= -hi)) AS excluded
FROM pixels""")
def regions(spark, sf):
    reg = spark.createDataFrame(REGION_ROWS, "lo double, hi double")
    return mask_regions(pixels(spark, sf), reg, F.lit(0.0005)).select("object_id", "pix", "x", "excluded")
