"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists, exact confirmation.

A document's set holds its distinct 5-word shingles, lower-cased A-Z (fewer words: the whole sequence is one
shingle; no words: the empty set, linked with nothing). Its sketch is the ``K`` smallest shingle hashes. Two
documents with a Jaccard similarity of 0.75 or more share at least ``SHARED`` of the retained values (the
chance of fewer is below 1e-8; sets of at most K shingles are retained whole, so for them the bound is exact).

* Documents of equal sets are one class from the start; a class is named by its smallest doc_id.
* Because ``SHARED`` values must agree, a class may leave its SHARED - 1 most frequent values out of the
  inverted lists without losing a pair; one kept whole may leave out more, as long as it also meets the sketches of
  larger sets. So a passage that many documents share fills no list, and values seen
  once never leave the count.
* Links make components, and only pairs of different components are ever formed. In each of ``ROUNDS`` first rounds a
  class is held against one other: every list proposes a centre (first the class whose values are the most
  frequent, as an original among its copies; then one drawn by hash), and the centre that the most of its lists
  propose is filtered and confirmed. A pair that a round's filter (``NEAR`` shared sketch values) leaves out is not lost: the last step
  forms every pair of different components that may be linked.
* The last step takes the full sets of the classes whose lists still hold several components. A set A linked with a set B shares at least
  3/7 (|A| + |B|) shingles with it, so their first common shingle, those of one component first and then rare ones
  first, has 7 * (its place in A) <= 4|A| - 3|B|. The smaller set of a pair therefore needs lists for a seventh
  of its shingles and the larger one for a quarter. Members of a large group that differ by more from each other have shingles of
  their own in these places, and so do not become all pairs. The bound is exact.
* Confirmation counts common shingles of the full sets.

Defined cases: rows without doc_id go; null text is empty; repeated rows give one row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spectraloom.llm.tables import components, documents, only_keys
from spectraloom.llm.textblock import TextBlock, blocks, mix, ngrams
from spectraloom.plans.scale import cut

K, SHARED, NEAR, WORDS, ROUNDS = 48, 18, 30, 5, 3
#: Values that the sketches of a set kept whole and of a larger set share at least: of c <= K common values at most
#: 4c/3 - K lie beyond the larger one's sketch.
MIXED = 2 * K // 3


def _sets(texts: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block: its first row, the sorted distinct shingle hashes of its rows, and where each row starts."""
    for at, raw in blocks(texts):
        b = TextBlock(raw, lower=True)
        starts, ends, word0 = b.words()
        w = b.hashes(starts, ends)
        grams = ngrams(w, WORDS)
        count = np.diff(word0)
        n = np.where(count >= WORDS, count - WORDS + 1, 0)
        row = np.repeat(np.arange(len(b)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = grams[np.repeat(word0[:-1], n) + inside]
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            whole = np.array([ngrams(w[word0[i] : word0[i + 1]], int(count[i]))[0] for i in short], np.uint64)
            row, value = np.concatenate((row, short)), np.concatenate((value, whole))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
        yield at, value, np.searchsorted(row, np.arange(len(b) + 1))


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ids = f["doc_id"].to_numpy()
        for at, value, first in _sets(f["text"]):
            n = np.diff(first)
            ordered = (value ^ np.uint64(1 << 63)).view(np.int64)  # the same order as signed numbers
            keys = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))))
                keys.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            yield pd.DataFrame({
                "doc_id": ids[at : at + len(n)], "n_shingles": n, "ka": keys[0], "kb": keys[1],
                "sketch": [ordered[s : min(e, s + K)] for s, e in zip(first[:-1], first[1:])],
            })


def _full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ids = f["doc_id"].to_numpy()
        for at, value, first in _sets(f["text"]):
            yield pd.DataFrame({"doc_id": ids[at : at + len(first) - 1], "grams": [value[s:e].view(np.int64) for s, e in zip(first[:-1], first[1:])]})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, ka, kb, sketch); ka and kb name the set."""
    return documents(docs).mapInPandas(_sketches, "doc_id long, n_shingles long, ka long, kb long, sketch array<long>")


def _estimated(pairs: DataFrame, reps: DataFrame, shared: int = SHARED) -> DataFrame:
    """Pairs (a, b) that the sizes and the number of shared sketch values allow."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter("100 * least(na, nb) >= 75 * greatest(na, nb)")
        .withColumn("both", F.array_intersect("sa", "sb"))
        .filter((F.size("both") >= shared) | (F.least("na", "nb") <= K))
        .filter("na > %d OR nb > %d OR 100 * size(both) >= 75 * (na + nb - size(both))" % (K, K))
        .select("a", "b", "na", "nb")
    )


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets have the similarity asked for."""
    pairs = cut(pairs.select("a", "b", "na", "nb"))
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    full = only_keys(documents(docs), need, "doc_id").mapInPandas(_full, "doc_id long, grams array<long>").dropDuplicates(["doc_id"])
    both = pairs.join(full.withColumnsRenamed({"doc_id": "a", "grams": "ga"}), "a").join(full.withColumnsRenamed({"doc_id": "b", "grams": "gb"}), "b")
    same = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("same", same).filter("100 * same >= 75 * (na + nb - same)").select("a", "b")


def _placed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with each member's component."""
    placed = lists.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    mixed = placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("v")
    return cut(placed.join(mixed, "v"))


def _crossing(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from the full sets of the classes in ``placed``."""
    left = cut(placed.select("doc_id", "comp").distinct())
    full = only_keys(documents(docs), left, "doc_id").mapInPandas(_full, "doc_id long, grams array<long>").dropDuplicates(["doc_id"])
    rows = full.join(left, "doc_id").select("doc_id", "comp", F.size("grams").alias("n"), F.explode("grams").alias("v"))
    same, own = Window.partitionBy("v"), Window.partitionBy("doc_id")
    rows = rows.select("*", F.count(F.lit(1)).over(same).alias("df"), F.min("comp").over(same).alias("lo"), F.max("comp").over(same).alias("hi"))
    met = rows.filter("lo <> hi").select("v", "doc_id", "comp", "n", "df").withColumn("place", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "v")) - 1)
    # With the smallest partner, three quarters as large; ``reach`` is the largest partner that a place allows.
    met = cut(met.filter("4 * place <= n").select("v", "doc_id", "comp", "n", F.floor((4 * F.col("n") - 7 * F.col("place")) / 3).alias("reach")))
    x, y = met.filter("reach >= n").alias("x"), met.alias("y")
    on = "x.v = y.v AND x.comp <> y.comp AND y.n <= x.reach AND x.n <= y.reach AND (x.n < y.n OR x.n = y.n AND x.doc_id < y.doc_id)"
    return x.join(y, F.expr(on)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    base = cut(sketches(docs))
    classes = base.filter("n_shingles > 0").groupBy("ka", "kb", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = cut(base.filter("n_shingles > 0").join(classes.select("ka", "kb", "n_shingles", F.col("rep").alias("doc_id")), ["ka", "kb", "n_shingles", "doc_id"]).dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "sketch"))
    # The values travel once: both uses keep all columns, so that they read one exchange.
    rows = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("v")).repartition("v")
    seen = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.max("doc_id").alias("top"), F.max("n_shingles").alias("most"))
    seen = seen.filter("df > 1 AND top IS NOT NULL AND most > 0").select("v", "df")
    spare = F.when(F.col("n_shingles") > K, SHARED - 1).otherwise(F.least(F.ceil(F.col("n_shingles") * 75 / 100), F.lit(MIXED)) - 1)
    own = Window.partitionBy("doc_id")
    rank = F.row_number().over(own.orderBy(F.desc("df"), "v"))
    lists = rows.join(seen, "v").withColumn("weight", F.sum("df").over(own)).withColumn("rank", rank)
    lists = cut(lists.filter(F.col("rank") > spare).select("v", "doc_id", "weight"))
    listed = cut(only_keys(reps, lists.select("doc_id").distinct(), "doc_id"))

    placed, links = lists.withColumn("comp", F.col("doc_id")), None
    for turn in range(ROUNDS):
        order = F.struct("weight", -F.col("doc_id")) if turn == 0 else F.struct(F.xxhash64("doc_id", F.lit(turn)), -F.col("doc_id"))
        centre = placed.groupBy("v").agg(F.max_by("doc_id", order).alias("a"), F.max_by("comp", order).alias("ca"))
        shared = placed.join(centre, "v").filter("comp <> ca").groupBy("a", F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
        most = shared.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("r")).select("r.a", "b")
        found = _confirmed(_estimated(most, listed, NEAR), docs)
        links = cut(found if links is None else links.union(found))
        placed = _placed(placed.drop("comp"), components(links))

    comps = components(links.union(_confirmed(_estimated(_crossing(placed, docs), listed), docs)))

    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("ka", "kb", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    return base.join(named, ["ka", "kb", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
