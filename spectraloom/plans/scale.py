"""Plan shapes that keep their parallelism when one key owns much of the table.

A series, scenario or library may hold a third of all rows, so nothing here hands a whole
group to one task:

* ``halo``           row frames run per (key, block of positions) with the neighbours copied in;
* ``running_total``  prefix sums run per block, then shifted by the totals of earlier blocks;
* ``number_rows``    dense numbering, hot keys cut into sub-ranges of the order column;
* ``quantiles``      exact order statistics, hot keys answered from the blocks holding the ranks;
* ``flag_in_windows``  point-in-interval tests as an equi-join on coordinate buckets.

The cheap and the split plan of ``number_rows`` and ``quantiles`` return the same rows; a count
per key (map-side combined) decides which one is built.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = ("spectraloom.hotRows", 2_000_000)
BLOCK_ROWS = ("spectraloom.blockRows", 65_536)
SMALL_ROWS = ("spectraloom.smallRows", 4_096)
CUTS = 255

_cold: ContextVar[frozenset[str]] = ContextVar("cold", default=frozenset())


def setting(spark: SparkSession, item: tuple[str, int]) -> int:
    return int(spark.conf.get(item[0], str(item[1])))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # local mode only: one machine, one folder
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which outlives lost executors."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> DataFrame:
    """As ``cut``; the shuffle files behind it go at once, not when the driver happens to collect its garbage."""
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables next to the checkpoints."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys above the hot-row limit (a few rows, kept), or None when there is none (the usual case)."""
    if _cold.get() and _cold.get() <= set(keys):
        return None
    limit = setting(df.sparkSession, HOT_ROWS)
    hot = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n"))
    return None if hot.isEmpty() else hot


@contextmanager
def checked_once(df: DataFrame, keys: Sequence[str]) -> Iterator[None]:
    """Count rows per key of an input table once for a whole pipeline.

    When no key is hot, the operators inside skip their own check for these keys and finer ones: they
    only ever see subsets of the table per key. When one is hot, every operator checks for itself.
    """
    token = _cold.set(frozenset(keys)) if hot_keys(df, keys) is None else None
    try:
        yield
    finally:
        if token is not None:
            _cold.reset(token)


def _with_sub_ranges(df: DataFrame, hot: DataFrame, keys: Sequence[str], lead: Column) -> DataFrame:
    """Add ``_blk``: the sub-range of ``lead`` inside a hot key, 0 for every other key."""
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    cuts = (
        df.withColumn("_lead", lead)
        .join(hot, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx("_lead", probs, 20_000).alias("_cuts"))
    )
    return (
        df.withColumn("_lead", lead)
        .join(cuts, list(keys), "left")
        .withColumn("_blk", F.expr("coalesce(size(filter(array_distinct(_cuts), c -> c < _lead)), 0)"))
        .drop("_cuts", "_lead")
    )


def _block_starts(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows (or summed weight) before each block; one row per (key, block)."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, "_blk")
        .agg(total.alias("_t"))
        .withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pix") -> DataFrame:
    """Dense 0-based position of every row inside its key, in ``order`` (a unique ordering)."""
    hot = hot_keys(df, keys)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    lead = F.col(order[0])
    if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")):
        lead = lead.cast("timestamp")
    lead = lead.cast("double")
    parts = _with_sub_ranges(df, hot, keys, lead)
    starts = _block_starts(parts, keys).drop("_t")
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        parts.withColumn("_in", F.row_number().over(w) - 1)
        .join(starts, [*keys, "_blk"])
        .withColumn(name, (F.col("_in") + F.col("_start")).cast("long"))
        .drop("_in", "_start", "_blk")
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: Mapping[str, float], count: str | Column | None = None
) -> DataFrame:
    """Exact quantiles (linear interpolation, nulls skipped) per key, one column per entry.

    ``count`` says how often each row's value stands, so that tables of merged value counts have quantiles too.
    """
    weight = F.lit(1) if count is None else F.col(count) if isinstance(count, str) else count
    value = F.col(value) if isinstance(value, str) else value
    whole = not keys
    keys = list(keys) or ["_all"]
    src = df.withColumn("_all", F.lit(1)) if whole else df
    src = src.select(*keys, value.cast("double").alias("_x"), weight.cast("long").alias("_c")).filter("_x IS NOT NULL")
    hot = hot_keys(src, keys)
    plain = src if hot is None else src.join(hot, keys, "left_anti")
    out = (
        plain.groupBy(*keys)
        .agg(F.percentile("_x", F.array(*[F.lit(float(p)) for p in probs.values()]), *([] if count is None else [F.col("_c")])).alias("_q"))
        .select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    )
    if hot is not None:
        out = out.unionByName(_hot_quantiles(src.join(hot, keys, "left_semi"), hot, keys, probs))
    return out.drop("_all") if whole else out


def _hot_quantiles(src, hot, keys, probs):
    # Equal values are merged before anything is ordered, so ties cost one row. The counts are kept: everything
    # below reads them several times, and the result is kept too, so plans built on it do not read ``src`` again.
    counts = cut(src.groupBy(*keys, "_x").agg(F.sum("_c").alias("_c")))
    parts = cut(_with_sub_ranges(counts, hot, keys, F.col("_x")))
    blocks = _block_starts(parts, keys, F.col("_c"))
    totals = blocks.groupBy(*keys).agg(F.sum("_t").alias("_n"))
    ranks = totals.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("q"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"))
            for n, p in probs.items()
        ])).alias("_r"),
    ).select(*keys, "_r.q", "_r.at", F.floor("_r.at").alias("lo"))
    wanted = ranks.join(blocks, keys).filter(
        (F.col("lo") < F.col("_start") + F.col("_t")) & (F.col("lo") + 1 >= F.col("_start"))
    )
    needed = wanted.select(*keys, "_blk", "_start").distinct()
    upto = Window.partitionBy(*keys, "_blk").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        parts.join(needed, [*keys, "_blk"])
        .withColumn("_end", F.col("_start") + F.sum("_c").over(upto))
        .withColumn("_beg", F.col("_end") - F.col("_c"))
    )
    hit = ordered.select(*keys, "_blk", "_x", "_beg", "_end").join(
        wanted.select(*keys, "_blk", "q", "at", "lo"), [*keys, "_blk"]
    ).filter((F.col("_beg") <= F.col("lo") + 1) & (F.col("lo") < F.col("_end")))
    picked = hit.groupBy(*keys, "q").agg(
        F.max("at").alias("at"), F.max("lo").alias("lo"),
        F.max(F.when((F.col("_beg") <= F.col("lo")) & (F.col("lo") < F.col("_end")), F.col("_x"))).alias("a"),
        F.max(F.when((F.col("_beg") <= F.col("lo") + 1) & (F.col("lo") + 1 < F.col("_end")), F.col("_x"))).alias("b"),
    )
    part = F.col("at") - F.col("lo")
    val = F.when(F.col("b").isNull(), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    return cut(picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == n, val)).alias(n) for n in probs]
    ))


def halo(
    df: DataFrame,
    keys: Sequence[str],
    n: int | Column,
    frames: Callable[[Window], Mapping[str, Column]],
    pos: str = "pix",
) -> DataFrame:
    """Add window columns whose frames reach at most ``n`` rows either way (a column: every row's own reach).

    ``pos`` must be the dense position inside the key. Rows within ``n`` of a block border are
    copied into the neighbouring block, the frame runs per (key, block), the copies are dropped.
    """
    size = setting(df.sparkSession, BLOCK_ROWS)
    own = F.floor(F.col(pos) / size)
    spread = with_halo(df, n, pos)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    for name, column in frames(w).items():
        spread = spread.withColumn(name, column)
    return spread.filter(F.col("_blk") == own).drop("_blk")


def with_halo(df: DataFrame, n: int | Column, pos: str = "pix") -> DataFrame:
    """Every row in its own block (``_blk``) of positions and in those that reach it within ``n`` rows."""
    size = setting(df.sparkSession, BLOCK_ROWS)
    first = F.greatest(F.floor((F.col(pos) - n) / size), F.lit(0).cast("long"))
    return df.withColumn("_blk", F.explode(F.sequence(first, F.floor((F.col(pos) + n) / size))))


def running_total(df: DataFrame, keys: Sequence[str], value: Column, name: str, pos: str = "pix") -> DataFrame:
    """Inclusive prefix sum along ``pos`` without ordering a whole key in one task."""
    size = setting(df.sparkSession, BLOCK_ROWS)
    parts = df.withColumn("_v", value).withColumn("_blk", F.floor(F.col(pos) / size))
    starts = _block_starts(parts, keys, F.col("_v")).drop("_t")
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("_in", F.sum("_v").over(w))
        .join(starts, [*keys, "_blk"])
        .withColumn(name, F.col("_in") + F.col("_start"))
        .drop("_v", "_blk", "_in", "_start")
    )


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key facts back to rows; adaptive execution broadcasts or splits skew by size."""
    return df.join(extra, list(keys), "left")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into a fixed number of tasks. For work that costs far more than its bytes (small
    dense solves), where merging partitions by size would leave one task with everything."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def is_small(df: DataFrame) -> bool:
    """True when the table fits the limit under which it may be broadcast."""
    limit = setting(df.sparkSession, SMALL_ROWS)
    return df.limit(limit + 1).count() <= limit


def bucketed_windows(windows: DataFrame) -> tuple[DataFrame, float]:
    """Copy each (lo, hi) window into the coordinate buckets it touches; also the bucket width."""
    wide = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    width = float(wide or 0.0) or 1.0
    first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    return windows.filter("hi >= lo").withColumn("_bkt", F.explode(F.sequence(first, last))), width


def flag_in_windows(
    df: DataFrame, windows: DataFrame, name: str, keys: Sequence[str] = (), x: str | Column = "x"
) -> DataFrame:
    """Boolean column: ``x`` lies in any closed window (of the same key, when keys are given)."""
    x = F.col(x) if isinstance(x, str) else x
    wins, width = bucketed_windows(windows)
    on = [*keys, "_bkt"]
    left = df.withColumn("_x", x).withColumn("_bkt", F.floor(F.col("_x") / width))
    if is_small(windows):
        packed = F.broadcast(wins.groupBy(*on).agg(F.collect_list(F.struct("lo", "hi")).alias("_wins")))
        hit = F.expr("coalesce(exists(_wins, w -> _x >= w.lo AND _x <= w.hi), false)")
        return left.join(packed, on, "left").withColumn(name, hit).drop("_wins", "_x", "_bkt")
    a, b = left.alias("a"), wins.alias("b")
    cond = (F.col("a._x") >= F.col("b.lo")) & (F.col("a._x") <= F.col("b.hi"))
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    yes = a.join(b, cond, "left_semi").withColumn(name, F.lit(True))
    no = a.join(b, cond, "left_anti").withColumn(name, F.lit(False))
    return yes.unionByName(no).drop("_x", "_bkt")
