"""Masks over pixel tables: interval masks, growth, outliers, clipping."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.columns import col, finite, line_half_width
from spectraloom.functions.lines import TRIPLET_CENTRES, TRIPLET_HALF_WIDTH, triplet_windows
from spectraloom.operators.pixels import OBJ
from spectraloom.plans.scale import (
    BLOCK_ROWS, attach, bucketed_windows, checked_once, cut, flag_in_windows, halo, number_rows, quantiles, running_total, setting, spread, with_halo,
)

GOOD = "good AND g IS NOT NULL AND gerr > 0"


def mask_regions(df: DataFrame, regions: DataFrame, z=0.0, name: str = "excluded") -> DataFrame:
    """Pixels in excluded intervals. Negative stored bounds mean the observed frame."""
    observed = regions.select((-F.col("lo")).alias("lo"), (-F.col("hi")).alias("hi"))
    out = flag_in_windows(df.withColumn("_obs", F.col("x") * (1 + col(z))), observed, "_a", x="_obs")
    out = flag_in_windows(out, regions, "_b")
    return out.withColumn(name, F.col("_a") | F.col("_b")).drop("_a", "_b", "_obs")


def protect_windows(
    spark, lines: DataFrame, half_width: float = 6.0, pad_kms: float = 400.0,
    custom: list[tuple[float, float]] = (), extra: list[tuple[float, float]] = (),
) -> DataFrame:
    """One window table from line centres, custom windows and (centre, half-width) extras."""
    hw = line_half_width("centre", half_width, pad_kms)
    wins = lines.select((F.col("centre") - hw).alias("lo"), (F.col("centre") + hw).alias("hi"))
    more = [*custom, *[(c - w, c + w) for c, w in extra]]
    if more:
        wins = wins.unionByName(spark.createDataFrame([(float(a), float(b)) for a, b in more], "lo double, hi double"))
    return wins


def protect_mask(df: DataFrame, windows: DataFrame, name: str = "protect") -> DataFrame:
    return flag_in_windows(df, windows, name)


def line_excess_snr(
    df: DataFrame, lines: DataFrame, half_width: float = 5.0, pad_kms: float = 300.0,
    context: float = 20.0, lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """Per (object, line): flank medians and (peak - flank level) / flank error, >= 5 flank pixels."""
    spark = df.sparkSession
    hw = line_half_width("centre", half_width, pad_kms)
    near = lines.select("line_id", "centre", hw.alias("hw"))
    if lo is not None:
        near = near.filter((F.col("centre") >= lo - F.col("hw")) & (F.col("centre") <= hi + F.col("hw")))
    reach = F.greatest(F.col("hw"), F.lit(float(context)))
    wins, width = bucketed_windows(
        near.withColumn("lo", F.col("centre") - reach).withColumn("hi", F.col("centre") + reach)
    )
    marked = flag_in_windows(df.filter(GOOD), triplet_windows(spark), "_trip")
    pairs = (
        marked.withColumn("_bkt", F.floor(F.col("x") / width))
        .join(wins, "_bkt")
        .filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        .withColumn("_in", (F.col("x") >= F.col("centre") - F.col("hw")) & (F.col("x") <= F.col("centre") + F.col("hw")))
        .withColumn(
            "_flank",
            ~F.col("_in") & ~F.col("_trip")
            & (F.col("x") >= F.col("centre") - context) & (F.col("x") <= F.col("centre") + context),
        )
    )
    keys = [*OBJ, "line_id"]
    facts = pairs.groupBy(*keys, "centre", "hw").agg(
        F.count_if("_flank").alias("n_flank"), F.max(F.when(F.col("_in"), F.col("g"))).alias("peak")
    ).filter("n_flank >= 5 AND peak IS NOT NULL")
    flank = pairs.filter("_flank")
    level = quantiles(flank, keys, "g", {"level": 0.5})
    noise = quantiles(flank, keys, "gerr", {"noise": 0.5})
    return (
        facts.join(level, keys).join(noise, keys).filter("noise > 0")
        .withColumn("excess", (F.col("peak") - F.col("level")) / F.col("noise"))
    )


def emission_line_windows(
    df: DataFrame, lines: DataFrame, threshold: float = 3.0, half_width: float = 5.0,
    pad_kms: float = 300.0, context: float = 20.0, lo: float | None = None, hi: float | None = None,
) -> DataFrame:
    """Windows ``(object_id, lo, hi)`` of the candidate lines with enough excess in each series."""
    found = line_excess_snr(df, lines, half_width, pad_kms, context, lo, hi).filter(F.col("excess") >= threshold)
    wins = found.select(*OBJ, (F.col("centre") - F.col("hw")).alias("lo"), (F.col("centre") + F.col("hw")).alias("hi"))
    return cut(wins)  # a few rows per series, read for its size, its widest window and the join


def emission_line_mask(
    df: DataFrame, lines: DataFrame, threshold: float = 3.0, half_width: float = 5.0,
    pad_kms: float = 300.0, context: float = 20.0, lo: float | None = None, hi: float | None = None,
    name: str = "emission",
) -> DataFrame:
    """Mask windows of candidate lines with enough excess; threshold <= 0 masks all of them."""
    if threshold <= 0:
        hw = line_half_width("centre", half_width, pad_kms)
        wins = lines.select((F.col("centre") - hw).alias("lo"), (F.col("centre") + hw).alias("hi"))
        return flag_in_windows(df, wins, name)
    return flag_in_windows(df, emission_line_windows(df, lines, threshold, half_width, pad_kms, context, lo, hi), name, keys=OBJ)


def grow_mask(df: DataFrame, flag: str, n: int, name: str = "grown") -> DataFrame:
    """Flag widened by ``n`` rows on each side."""
    return halo(df, OBJ, n, lambda w: {name: F.max(flag).over(w.rowsBetween(-n, n))})


def grow_mask_by(df: DataFrame, flag: str, width: float, name: str = "grown") -> DataFrame:
    """Flag widened by ``width`` in x units: ceil(width / median step) rows, per object."""
    steps = halo(df, OBJ, 1, lambda w: {"_d": F.abs(F.lead("x").over(w) - F.col("x"))})
    rows = quantiles(steps, OBJ, "_d", {"_step": 0.5}).select(
        *OBJ, F.when(F.col("_step") > 0, F.ceil(width / F.col("_step"))).otherwise(0).cast("int").alias("_n")
    )
    at = F.when(F.col(flag), F.col("pix"))
    # A block holds what lies within a row's own reach, so the nearest flag of the block is enough on each side.
    known = attach(df, rows, OBJ).withColumn("_n", F.coalesce("_n", F.lit(0)))
    near = halo(known, OBJ, F.col("_n"), lambda w: {
        "_left": F.max(at).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_right": F.min(at).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    left = F.coalesce(F.col("pix") - F.col("_left") <= F.col("_n"), F.lit(False))
    right = F.coalesce(F.col("_right") - F.col("pix") <= F.col("_n"), F.lit(False))
    return near.withColumn(name, left | right).drop("_left", "_right", "_n")


def bloom(df: DataFrame, rejected: str, n: int, protect: str = "protect", name: str = "bloomed") -> DataFrame:
    """Rejected pixels and their ``n`` neighbours each side, the latter never inside protected pixels."""
    grown = grow_mask(df, rejected, n, "_g")
    return grown.withColumn(name, F.col(rejected) | (F.col("_g") & ~F.col(protect))).drop("_g")


def union_masks(df: DataFrame, masks: list[str], name: str = "masked") -> DataFrame:
    out = F.lit(False)
    for m in masks:
        out = out | F.coalesce(F.col(m), F.lit(False))
    return df.withColumn(name, out)


def mask_gains(df: DataFrame, masks: list[str]) -> DataFrame:
    """How many pixels each detector adds to the ones before it, per object."""
    seen, parts = F.lit(False), []
    for m in masks:
        flag = F.coalesce(F.col(m), F.lit(False))
        parts.append(F.count_if(flag & ~seen).alias(f"n_{m}"))
        seen = seen | flag
    return df.groupBy(*OBJ).agg(*parts, F.count_if(seen).alias("n_masked"))


def mask_spans(df: DataFrame, flag: str) -> DataFrame:
    """Contiguous flagged runs: first and last coordinate and length."""
    edges = halo(df, OBJ, 1, lambda w: {"_before": F.coalesce(F.lag(flag).over(w), F.lit(False))}).filter(flag)
    start = F.when(F.col("_before"), 0).otherwise(1)
    numbered = running_total(edges, OBJ, start, "span")
    return numbered.groupBy(*OBJ, "span").agg(
        F.min("x").alias("x_start"), F.max("x").alias("x_end"), F.count(F.lit(1)).alias("n")
    )


def rolling_outliers(df: DataFrame, n_sigma: float = 3.0, window: float = 50.0, name: str = "segment_emission", **segments) -> DataFrame:
    """Adds a flag for the pixels of ``rolling_flags``."""
    flagged = rolling_flags(df, n_sigma, window, **segments).withColumn(name, F.lit(True))
    return df.join(flagged, [*OBJ, "pix"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def rolling_flags(
    df: DataFrame, n_sigma: float = 3.0, window: float = 50.0,
    centres: list[float] = TRIPLET_CENTRES, margin: float = TRIPLET_HALF_WIDTH * 1.5,
) -> DataFrame:
    """(object_id, pix) of upward outliers against a rolling median and MAD inside line-free segments.

    The half-window is max(5, ceil(window / (2 * median step))) rows of the segment, truncated at
    its ends; segments need 10 good pixels. A segment runs in blocks of positions that reach as far as its own window.
    """
    cuts = sorted(centres)
    seg = F.lit(None).cast("int")
    lows = [None, *[c + margin for c in cuts]]
    highs = [*[c - margin for c in cuts], None]
    for i in reversed(range(len(lows))):
        inside = F.lit(True)
        if lows[i] is not None:
            inside = inside & (F.col("x") >= lows[i])
        if highs[i] is not None:
            inside = inside & (F.col("x") <= highs[i])
        seg = F.when(inside, i).otherwise(seg)
    keys = [*OBJ, "_seg"]
    base = df.filter(GOOD).withColumn("_seg", seg).filter("_seg IS NOT NULL")
    rows = number_rows(base.select(*keys, "pix", "x", "g"), keys, ["x", "pix"], "_k")
    steps = halo(rows, keys, 1, lambda w: {"_d": F.lead("x").over(w) - F.col("x")}, pos="_k")
    facts = attach(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 10"),
        quantiles(steps, keys, "_d", {"_dx": 0.5}), keys,
    ).select(*keys, F.greatest(F.lit(5), F.ceil(window / (2 * F.greatest("_dx", F.lit(1e-6))))).cast("int").alias("_h"))
    facts = cut(facts)  # one row per segment, read twice
    size = setting(df.sparkSession, BLOCK_ROWS)
    on = [*keys, "_blk"]
    blocks = spread(with_halo(rows.join(facts, keys), F.col("_h"), "_k"), *on).groupBy(*on, "_h").agg(F.collect_list(F.struct("_k", "pix", F.col("g").cast("double").alias("g"))).alias("_p"))
    return blocks.select(*OBJ, "_blk", "_h", "_p").mapInArrow(_outlier_batches(n_sigma, size), f"object_id {dict(df.dtypes)['object_id']}, pix {dict(df.dtypes)['pix']}")


WIDE, WINDOW_VALUES = 512, 1 << 21


def rolling_median_mad(g: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of every place's window of ``h`` places each side (cut at the ends) and the median distance from it."""
    n, width = len(g), 2 * h + 1
    med, mad = np.empty(n), np.empty(n)
    if width <= WIDE:
        padded = np.concatenate([np.full(h, np.nan), g, np.full(h, np.nan)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        at = np.arange(n)
        count = np.minimum(at + h, n - 1) - np.maximum(at - h, 0) + 1  # what lies beyond the ends sorts last
        for start in range(0, n, max(1, WINDOW_VALUES // width)):
            w = view[start : start + max(1, WINDOW_VALUES // width)]
            c = count[start : start + len(w)]
            med[start : start + len(w)] = m = _middle(w, c)
            mad[start : start + len(w)] = _middle(np.abs(w - m[:, None]), c)
        return med, mad
    values = g.tolist()
    held = sorted(values[:h])
    for i in range(n):
        # One value comes in, one goes out; the window stays sorted.
        if i + h < n:
            insort(held, values[i + h])
        if i - h > 0:
            del held[bisect_left(held, values[i - h - 1])]
        size = len(held)
        m = (held[(size - 1) // 2] + held[size // 2]) / 2
        med[i], mad[i] = m, (_distance(held, m, (size - 1) // 2) + _distance(held, m, size // 2)) / 2
    return med, mad


def _middle(w: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Median of the ``count`` smallest of each row."""
    s, row = np.sort(w, axis=1), np.arange(len(w))
    return (s[row, (count - 1) // 2] + s[row, count // 2]) / 2


def _distance(held: list[float], m: float, rank: int) -> float:
    """The distance from ``m`` of given rank (from 0) among a sorted list, by halving over its two sides."""
    split = bisect_left(held, m)
    # Distances grow to the left from split - 1 and to the right from split: take ``left`` of rank + 1 from the left.
    low, high = max(0, rank + 1 - (len(held) - split)), min(rank + 1, split)
    while low < high:
        left = (low + high) // 2
        right = rank + 1 - left
        if right > 0 and m - held[split - 1 - left] < held[split + right - 1] - m:
            low = left + 1
        else:
            high = left
    right = rank + 1 - low
    return max(m - held[split - low] if low else 0.0, held[split + right - 1] - m if right else 0.0)


def _outlier_batches(n_sigma: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("_p")
            flat, at = column.flatten(), np.asarray(column.offsets) - column.offsets[0].as_py()
            k, pix, g = (np.asarray(flat.field(c)) for c in ("_k", "pix", "g"))
            number, reach = np.asarray(b.column("_blk")), np.asarray(b.column("_h"))
            row, found = [], []
            for i in range(b.num_rows):
                order = at[i] + np.argsort(k[at[i] : at[i + 1]], kind="stable")
                med, mad = rolling_median_mad(g[order], int(reach[i]))
                out = (k[order] // size == number[i]) & (mad > 0) & (g[order] > med + n_sigma * 1.4826 * mad)
                found.append(pix[order[out]])
                row.append(np.full(int(out.sum()), i))
            if row:
                yield pa.RecordBatch.from_arrays([b.column("object_id").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(found))], ["object_id", "pix"])

    return run


def robust_sigma(df: DataFrame, by: list[str], value: str | Column, name: str = "sigma") -> DataFrame:
    """1.4826 * MAD of finite values; population std where MAD is 0 (0 for one value)."""
    src = df.withColumn("_v", col(value)).filter(finite("_v")).select(*by, "_v")
    with checked_once(src, by):
        med = cut(quantiles(src, by, "_v", {"_med": 0.5}))  # one row per key, read by two plans
        dev = attach(src, med, by).withColumn("_d", F.abs(F.col("_v") - F.col("_med")))
        mad = quantiles(dev, by, "_d", {"_mad": 0.5})
    spread = src.groupBy(*by).agg(F.stddev_pop("_v").alias("_sd"))
    return mad.join(spread, by).select(
        *by, F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd")).alias(name)
    )


def clip_round(df: DataFrame, model: str, k: float, protect: str | None, bloom_rows: int) -> DataFrame:
    """One clipping pass: adds ``good_next``. Only positive residuals are clipped, sigma is uncentred."""
    res = df.withColumn("_r", (F.col("g") - F.col(model)) / F.when(F.col("gerr") > 0, F.col("gerr")).otherwise(1.0))
    sig = robust_sigma(res.filter("good"), OBJ, "_r", "_sig")
    prot = F.col(protect) if protect else F.lit(False)
    keep = (F.col("_r") <= k * F.col("_sig")) | prot
    keep = F.when(F.col("_sig") > 0, keep).otherwise(True)
    out = attach(res, sig, OBJ).withColumn("good_next", F.col("good") & F.coalesce(keep, F.lit(True)))
    if bloom_rows:
        out = out.withColumn("_rej", F.col("good") & ~F.col("good_next")).withColumn("_prot", prot)
        out = bloom(out, "_rej", bloom_rows, "_prot", "_bl")
        out = out.withColumn("good_next", F.col("good_next") & ~F.col("_bl")).drop("_rej", "_prot", "_bl")
    return out.drop("_r", "_sig")


def sigma_clip(
    df: DataFrame, model: str | None = None, k: float = 3.0, rounds: int = 5, min_pixels: int = 10,
    protect: str | None = None, bloom_rows: int = 0, refit=None,
) -> DataFrame:
    """Iterated one-sided clipping; each object stops when stable or when too few pixels would stay.

    ``refit`` (DataFrame -> DataFrame with column ``model``) is called before every round when the
    model follows the mask; otherwise ``model`` names a fixed column. Finished objects leave the
    loop, so later rounds only touch the rest.
    """
    base = df.columns
    done, live = [], df
    for i in range(rounds):
        fitted = refit(live) if refit else live
        stepped = clip_round(fitted, model or "model", k, protect, bloom_rows)
        verdict = stepped.groupBy(*OBJ).agg(
            F.every(F.col("good") == F.col("good_next")).alias("_same"),
            (F.count_if("good_next") < min_pixels).alias("_few"),
        )
        stepped = attach(stepped, verdict, OBJ)
        stop = F.col("_same") | F.col("_few")
        stepped = cut(stepped.withColumn("_stop", stop).withColumn(
            "good", F.when(stop, F.col("good")).otherwise(F.col("good_next"))
        ).select(*base, "_stop"))
        done.append(stepped.filter("_stop").select(*base).withColumn("clip_rounds", F.lit(i + 1)))
        live = stepped.filter("NOT _stop").select(*base)
        if live.isEmpty():
            break
    else:
        done.append(live.withColumn("clip_rounds", F.lit(rounds)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
