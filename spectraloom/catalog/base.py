"""Query registry and the canonical bindings of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.plans.scale import number_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    """Both engines sum doubles in their own order, so results are compared to six decimals."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def big(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = col.cast("long")
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """events as one sampled series per user."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("object_id"), "ts", "event_id", F.col("value").alias("g"),
        (0.05 * F.col("value") + 0.5).alias("gerr"),
        (F.col("event_type") != "error").alias("good"),
    )
    return number_rows(ev, ["object_id"], ["ts", "event_id"]).select(
        "object_id", "pix", (8400 + 1.25 * F.col("pix")).alias("x"), "g", "gerr", "good"
    )


PIXELS = """pixels AS (
  SELECT object_id, pix, 8400 + 1.25e0 * pix AS x, g, gerr, good FROM (
    SELECT user_id AS object_id,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pix,
           value AS g, 0.05e0 * value + 0.5e0 AS gerr, event_type <> 'error' AS good
    FROM events))"""


def hist(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as one 64-bin histogram per vector (object_id = vec_id)."""
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("object_id"), "label", F.posexplode("embedding").alias("bin", "raw"))
        .select(
            "object_id", "label", "bin", F.col("raw").cast("double").alias("raw"),
            (-300 + 600 * F.col("bin").cast("double") / 63).alias("v"),
            F.greatest(F.col("raw").cast("double"), F.lit(0.0)).alias("b"),
        )
    )


HIST = """hist AS (
  SELECT object_id, label, bin, raw, -300 + 600 * CAST(bin AS DOUBLE) / 63 AS v, greatest(raw, 0e0) AS b FROM (
    SELECT vec_id AS object_id, label, CAST(p AS INT) - 1 AS bin, CAST(embedding[p] AS DOUBLE) AS raw
    FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS p FROM embeddings)))"""


def reps(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as replicates: object = label, replicate = vec_id."""
    return hist(spark, sf).select(
        F.col("label").cast("long").alias("object_id"), F.col("object_id").alias("rep"), "bin", "v", "b"
    )


REPS = HIST + """,
reps AS (SELECT CAST(label AS BIGINT) AS object_id, object_id AS rep, bin, v, b FROM hist)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a run log with supplier truth."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scenario_id"),
        F.lit("base").alias("axis"),
        F.col("l_returnflag").alias("mode"),
        F.col("l_linenumber").cast("long").alias("seed"),
        ((F.col("l_quantity") - 25) / 2).alias("bias_v"),
        (F.col("l_extendedprice") / 10000 - 4).alias("bias_sigma"),
        (F.col("l_discount") - 0.05).alias("bias_h3"),
        (F.col("l_tax") - 0.04).alias("bias_h4"),
        (0.7 + F.col("l_discount") * 6).alias("chi2_red"),
        (F.col("l_extendedprice") / 1000).alias("wall_time_s"),
        (F.col("l_quantity") == 1).alias("crashed"),
    )
    truth = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scenario_id"),
        (F.col("s_acctbal") / 100).alias("v_true"),
        (50.0 + F.col("s_suppkey")).alias("sigma_true"),
    )
    return li.join(truth, "scenario_id", "left")


RUNS = """runs AS (
  SELECT l_suppkey AS scenario_id, 'base' AS axis, l_returnflag AS mode, CAST(l_linenumber AS BIGINT) AS seed,
         (l_quantity - 25) / 2 AS bias_v, l_extendedprice / 10000 - 4 AS bias_sigma,
         l_discount - 0.05e0 AS bias_h3, l_tax - 0.04e0 AS bias_h4, 0.7e0 + l_discount * 6 AS chi2_red,
         l_extendedprice / 1000 AS wall_time_s, l_quantity = 1 AS crashed,
         s_acctbal / 100 AS v_true, 50e0 + s_suppkey AS sigma_true
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as lambda trials per supplier: one row per (object, lambda), the cheapest line item."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("object_id"), F.col("l_quantity").alias("lam"))
        .agg(F.min(F.struct(
            F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"),
            F.col("l_partkey"), F.col("l_discount"),
        )).alias("r"))
        .select(
            "object_id", "lam",
            (F.col("r.l_extendedprice") + 400 * F.col("lam")).alias("chi2"),
            F.lit(200).cast("long").alias("ngood"),
            (1 + F.col("r.l_linenumber") % 3).cast("long").alias("n_peaks"),
            (F.col("r.l_partkey") % 200 - 100).cast("double").alias("v"),
            (20 + 300 * F.col("r.l_discount")).alias("sigma"),
            (F.col("r.l_discount") * 5).alias("rough"),
        )
    )


TRIALS = """trials AS (
  SELECT object_id, lam, r.p + 400 * lam AS chi2, CAST(200 AS BIGINT) AS ngood,
         CAST(1 + r.ln % 3 AS BIGINT) AS n_peaks, CAST(r.pk % 200 - 100 AS DOUBLE) AS v,
         20 + 300 * r.d AS sigma, r.d * 5 AS rough
  FROM (SELECT l_suppkey AS object_id, l_quantity AS lam,
               min(struct_pack(p := l_extendedprice, ok := l_orderkey, ln := l_linenumber,
                               pk := l_partkey, d := l_discount)) AS r
        FROM lineitem GROUP BY 1, 2))"""


def lcg_sql(obj: str, rep: str, k: str) -> str:
    """SQL twin of ``lcg_uniform``."""
    key = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in (obj, rep, k))
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496e0)"
