"""Incremental arrival: new pixel files are scored once, restarts pick up where they stopped.

What a score needs of earlier samples is kept as mergeable state: per object the number of pixels, the chi2 sum and how
often each valid value stands (median and MAD follow exactly from these counts). The state is a table in buckets of
objects with a version per bucket; a batch reads and writes the buckets it touches, whatever has arrived before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spectraloom.functions.columns import finite, valid_pixel
from spectraloom.operators import stats as S
from spectraloom.operators.masks import robust_sigma
from spectraloom.operators.pixels import OBJ, require_pixels, sanitise, select_region
from spectraloom.plans.scale import attach, checked_once, cut, quantiles

BUCKETS, MIN_PIXELS = 256, 2
#: A bucket is written as one file until the batch's buckets have more rows than this together.
FILE_ROWS = 4_000_000
#: A row without a value holds the object's sums, the others how often a valid value stands.
STATE = "object_id long, g double, n long, ngood long, chi2 double"


def score_batch(pix: DataFrame, lo: float, hi: float, model: str = "model", min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Robust scatter and chi2 of whole series."""
    d = require_pixels(sanitise(select_region(pix, lo, hi)), min_pixels)
    return S.chi2(d, OBJ, model).join(robust_sigma(d.filter("good"), OBJ, "g"), OBJ, "left")


def partial_state(pix: DataFrame, lo: float, hi: float, model: str = "model") -> DataFrame:
    """State rows of some samples; rows of several samples' states merge by adding up."""
    d = sanitise(select_region(pix, lo, hi))
    ok = valid_pixel(model=model)
    r = (F.col("g") - F.col(model)) / F.col("gerr")
    none = F.lit(None).cast("double")
    sums = d.groupBy(*OBJ).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ngood"), F.sum(F.when(ok, r * r)).alias("chi2"))
    zero = F.lit(0).cast("long")
    values = d.filter(F.col("good") & finite("g")).groupBy(*OBJ, F.col("g").cast("double").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return sums.select(*OBJ, none.alias("g"), "n", "ngood", "chi2").unionByName(values.select(*OBJ, "g", "n", zero.alias("ngood"), none.alias("chi2")))


def merge_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*OBJ, "g").agg(F.sum("n").alias("n"), F.sum("ngood").alias("ngood"), F.sum("chi2").alias("chi2"))


def score_state(state: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """``score_batch`` of all samples that went into a merged state."""
    sums = state.filter("g IS NULL").filter(F.col("n") >= min_pixels).select(*OBJ, F.coalesce("chi2", F.lit(float("inf"))).alias("chi2"), "ngood")
    values = state.filter("g IS NOT NULL").select(*OBJ, "g", "n")
    with checked_once(values, OBJ):
        middle = cut(quantiles(values, OBJ, "g", {"_med": 0.5}, "n"))
        mad = cut(quantiles(attach(values, middle, OBJ), OBJ, F.abs(F.col("g") - F.col("_med")), {"_mad": 0.5}, "n"))
    sigma = mad.filter("_mad > 0").select(*OBJ, (1.4826 * F.col("_mad")).alias("sigma"))
    flat = mad.filter("NOT coalesce(_mad > 0, false)").select(*OBJ)
    if not flat.isEmpty():  # half of an object's values are equal: its deviation is asked for, and only then computed
        few = values.join(flat, OBJ, "left_semi")
        mean = few.groupBy(*OBJ).agg((F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("_m"))
        away = F.col("g") - F.col("_m")
        sigma = sigma.union(few.join(mean, OBJ).groupBy(*OBJ).agg(F.sqrt(F.sum(F.col("n") * away * away) / F.sum("n")).alias("sigma")))
    return sums.join(sigma, OBJ, "left")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def update_state(spark: SparkSession, target: str, batch_id: int, partial: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Merge a batch into the buckets it touches and return the new state of these buckets.

    ``target/manifest/batch=N`` names the version (the batch that wrote it) of every bucket after batch N, and the one it
    replaced; batch N reads the manifest of N - 1, so a replayed batch starts from the same state and writes the same
    folders. Replaced versions go one batch later.
    """
    bucket = F.pmod(F.xxhash64("object_id"), F.lit(buckets)).cast("int")
    partial = partial.withColumn("bucket", bucket)
    touched = sorted(r[0] for r in partial.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    known, gone = {}, []
    if batch_id > 0:
        for r in spark.read.parquet(f"{target}/manifest/batch={batch_id - 1}").collect():  # a row per bucket
            known[r.bucket] = r.version
            if r.replaced is not None:
                gone.append((r.replaced, r.bucket))
    at = lambda version, b: f"{target}/state/batch={version}/bucket={b}"
    old = [at(known[b], b) for b in touched if b in known]
    rows = partial.drop("bucket")
    if old:
        rows = rows.unionByName(spark.read.schema(STATE).parquet(*old))
    if touched:
        merged = merge_states(rows).withColumn("bucket", bucket)
        parts = min(8, 1 + rows.count() // FILE_ROWS)
        merged.repartition("bucket", F.pmod(F.xxhash64("object_id", "g"), F.lit(parts))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/state/batch={batch_id}")
    now = {**{b: (v, None) for b, v in known.items()}, **{b: (batch_id, known.get(b)) for b in touched}}
    rows = [(b, v, r) for b, (v, r) in sorted(now.items())]
    spark.createDataFrame(rows, "bucket int, version long, replaced long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={batch_id}")
    for version, b in gone:
        _delete(spark, at(version, b))
    if not touched:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*[at(batch_id, b) for b in touched])


def score_stream(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, lo: float, hi: float,
    to_pixels: Callable[[DataFrame], DataFrame] = lambda d: d, files_per_batch: int = 1000,
    pattern: str = "*.parquet", buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process all files of a folder that arrived since the last run, then stop.

    An object's samples may come in several batches: each batch scores the objects it touches over all their samples so
    far, reading the state of their buckets only. ``latest_scores`` reads one row per object. The stream's checkpoint takes
    the place of a set of finished jobs; a batch replayed after a lost driver overwrites its own folders, so results
    appear once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        partial = cut(partial_state(to_pixels(batch), lo, hi))
        state = update_state(batch.sparkSession, target, batch_id, partial, buckets)
        live = cut(state.join(partial.select(*OBJ).distinct(), OBJ, "left_semi"))  # read often, and the state is many small files
        score_state(live).write.mode("overwrite").parquet(f"{target}/scores/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(source)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, target: str) -> DataFrame:
    """The last score of every object."""
    scores = spark.read.parquet(f"{target}/scores")
    rest = [c for c in scores.columns if c not in (*OBJ, "batch")]
    return scores.groupBy(*OBJ).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*OBJ, "_r.*")
