"""Append-only JSON-lines result log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format: the fields of one result row.
RUN_FIELDS = (
    "scenario_id string, axis string, mode string, seed long, v_true double, sigma_true double, "
    "v_rec double, sigma_rec double, h3_rec double, h4_rec double, bias_v double, bias_sigma double, "
    "bias_h3 double, bias_h4 double, chi2_red double, lambda double, n_good long, n_peaks long, "
    "wall_time_s double, crashed boolean, error_message string"
)
FILE_ROWS = 1_000_000


def parse_run_log(lines: DataFrame, fields: str = RUN_FIELDS) -> DataFrame:
    """Result rows of a log: blank, comment and malformed lines and header records are left out."""
    value = F.trim("value")
    schema = f"{fields}, _header boolean, _bad string"
    return (
        lines.filter((value != "") & ~value.startswith("#"))
        .withColumn("_r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
        .filter("_r._bad IS NULL AND NOT coalesce(_r._header, false)")
        .select(*[c for c in lines.columns if c != "value"], "_r.*")
        .drop("_header", "_bad")
    )


def read_headers(lines: DataFrame) -> DataFrame:
    """Header records of a log."""
    schema = "_header boolean, started string, _bad string"
    return (
        lines.withColumn("_r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
        .filter("_r._bad IS NULL AND coalesce(_r._header, false)")
        .select(*[c for c in lines.columns if c != "value"], "_r.started")
    )


def read_run_log(spark: SparkSession, path: str, fields: str = RUN_FIELDS) -> DataFrame:
    return parse_run_log(spark.read.text(path), fields)


def append_run_log(rows: DataFrame, path: str) -> None:
    """Append result rows; one JSON object per line, files are never rewritten. Files are compressed (field names repeat on
    every line) and bounded in rows, as a compressed file is read by one task."""
    rows.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).json(path, compression="gzip")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
