"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.plans.scale import cut

SPACES = r"\x20\x09-\x0D"
#: Tables of keys up to this many rows (16 bytes each) are sent to every task; larger ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text): rows without an id go, a null text is empty, other columns go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``; the keys travel to the rows while they are few."""
    keys = keys.select(key)
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node that links reach. ``edges`` has a and b, in any direction.

    Each round replaces a node's label by the smallest among its neighbours' and then follows labels once
    more, so chains shorten geometrically. A node's messages are pre-aggregated by ``min``; nothing is
    gathered on the driver but the number of changes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), "comp")
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp"), F.col("comp").alias("old")))
        changed = new.filter("comp <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def crc32_sql(number: str) -> str:
    """SQL for the unsigned crc32 of a decimal number, bit by bit, as DuckDB has no such function."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    rounds = "[xor(crc, byte), 1::BIGINT, 2::BIGINT, 3::BIGINT, 4::BIGINT, 5::BIGINT, 6::BIGINT, 7::BIGINT, 8::BIGINT]"
    step = f"list_reduce({rounds}, lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda crc, byte: {step}), 4294967295::BIGINT)"
