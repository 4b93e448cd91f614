"""Directory-wide text ingest.

``parse_*`` work on a table of lines ``(file, line_no, value)``; ``ingest_*`` read a glob into
such a table first. Parsing is columns only, so a million small files and one huge file cost the
same per byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.columns import object_id
from spectraloom.plans.scale import attach, number_rows


def text_lines(spark: SparkSession, glob: str) -> DataFrame:
    raw = spark.read.text(glob).select(
        object_id(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mono"),
        "value",
    )
    return number_rows(raw, ["file"], ["_start", "_mono"], "line_no").drop("_start", "_mono")


def _fields(lines: DataFrame) -> DataFrame:
    body = F.regexp_replace("value", r"#.*$", "")
    return (
        lines.withColumn("_body", F.trim(F.regexp_replace(body, r"\s+", " ")))
        .filter(F.col("_body") != "")
        .withColumn("_f", F.split("_body", " "))
        .drop("_body")
    )


def _number(i: int) -> Column:
    return F.get("_f", F.lit(i)).try_cast("double")


def _accept(df: DataFrame, required: int, columns: dict[str, Column]) -> DataFrame:
    """One row per data line; ``ok`` is false where the line misses required numbers."""
    names = list(columns)
    out = df.select("file", "line_no", *[c.alias(n) for n, c in columns.items()])
    ok = F.lit(True)
    for n in names[:required]:
        ok = ok & F.col(n).isNotNull()
    return out.withColumn("ok", ok)


def parse_spectra(lines: DataFrame) -> DataFrame:
    """Index or wavelength, flux, sigma or variance. Lines with fewer fields come back ``ok=false``."""
    return _accept(_fields(lines), 3, {"c1": _number(0), "flux": _number(1), "err": _number(2)})


def parse_norm(lines: DataFrame) -> DataFrame:
    """Normalised spectra; columns 4-7 count only when all four are there."""
    full = F.size("_f") >= 7
    cols = {"wave": _number(0), "normflux": _number(1), "err": _number(2)}
    for i, n in enumerate(["orig_flux", "orig_err", "cont", "cont_err"], start=3):
        cols[n] = F.when(full, _number(i))
    return _accept(_fields(lines), 3, cols)


def parse_templates(lines: DataFrame) -> DataFrame:
    return _accept(_fields(lines), 2, {"wave": _number(0), "flux": _number(1), "err": _number(2)})


def parse_regions(lines: DataFrame) -> DataFrame:
    return _accept(_fields(lines), 2, {"lo": _number(0), "hi": _number(1)}).filter("ok").select("lo", "hi")


def resolve_manifest(lines: DataFrame, base: str) -> DataFrame:
    """Manifest entries as paths: blanks and comments dropped, relative ones joined to ``base``."""
    entry = F.trim("value")
    return (
        lines.withColumn("entry", entry)
        .filter(~F.col("entry").rlike(r"^\s*(#|$)"))
        .withColumn(
            "path",
            F.when(F.col("entry").startswith("/"), F.col("entry")).otherwise(
                F.concat(F.lit(base.rstrip("/") + "/"), F.col("entry"))
            ),
        )
        .drop("value")
    )


def parse_params(lines: DataFrame) -> DataFrame:
    """Key/value files: ``(file, name, key, value, kind)``, first entry line is the object name.

    Only the first two tokens count; the last line of a repeated key wins.
    """
    body = (
        lines.withColumn("_t", F.trim("value"))
        .filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
        .withColumn("_f", F.split("_t", r"\s+"))
    )
    first = body.groupBy("file").agg(
        F.min("line_no").alias("_first"), F.min_by(F.col("_f")[0], "line_no").alias("name")
    )
    pairs = attach(body, first, ["file"]).filter("line_no > _first AND size(_f) >= 2")
    number = F.col("raw").try_cast("double")
    kept = pairs.groupBy("file", "name", F.col("_f")[0].alias("key")).agg(
        F.max_by(F.col("_f")[1], "line_no").alias("raw")
    )
    return kept.select(
        "file", "name", "key", "raw",
        number.alias("number"),
        F.when(number.isNull(), "text")
        .when(F.isnan(number) | (F.abs(number) == float("inf")), "float")
        .when(number == F.floor(number), "int").otherwise("float").alias("kind"),
    )


def params_map(params: DataFrame) -> DataFrame:
    """One map per file (a parameter file holds a few dozen keys)."""
    return params.groupBy("file", "name").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "raw"))).alias("params")
    )


def ingest_spectra(spark: SparkSession, glob: str) -> DataFrame:
    return parse_spectra(text_lines(spark, glob))


def ingest_norm(spark: SparkSession, glob: str) -> DataFrame:
    return parse_norm(text_lines(spark, glob))


def ingest_templates(spark: SparkSession, glob: str) -> DataFrame:
    return parse_templates(text_lines(spark, glob))


def ingest_params(spark: SparkSession, glob: str) -> DataFrame:
    return parse_params(text_lines(spark, glob))


def ingest_regions(spark: SparkSession, path: str | None) -> DataFrame:
    """Excluded intervals; no file means no exclusions."""
    if path is not None:
        jvm = spark._jvm.org.apache.hadoop.fs
        p = jvm.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return parse_regions(text_lines(spark, path))
    return spark.createDataFrame([], "lo double, hi double")
