"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

Features are hashes of 1- and 2-grams of lower-cased words and of 1-, 2- and 3-grams of word shapes (runs of
one character class count once: lower, upper, digit, other letter; punctuation stays itself). A row's vector is
log(1 + count), scaled to length 1, so a score is one sparse dot product with the learned weights.

The fit reads at most ``max_rows`` labelled rows, those of the smallest hash of doc_id (documented bound, same
rule at every size); it is one task over that bounded sample and returns at most 2**BITS weights. Scoring
covers every row and whole texts. The text is the only input of a score.

Defined cases: null text is empty and scores by the bias alone; rows without doc_id go; labels without a value or
without a document are not learned from; several labels of one document are averaged and rounded up; without
any label every score is 0.5; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.tables import documents
from spectraloom.llm.textblock import TextBlock, blocks, ngrams

BITS, MAX_ROWS, EPOCHS, THRESHOLD = 18, 12_000, 3, 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 97, 65, 48, 200


def _shapes(b: TextBlock) -> TextBlock:
    """The same words with each byte replaced by its class and runs of one class shortened to one byte."""
    kind = _KIND[b.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (b.data[1:] == 32)
    out = TextBlock.__new__(TextBlock)
    place = np.cumsum(keep) - keep
    out.data, out._sums = kind[keep], None
    out.first, out.last = place[b.first], place[b.last]
    return out


def _rows(block: TextBlock, sizes: tuple[int, ...], salt: int) -> list[tuple[np.ndarray, np.ndarray]]:
    starts, ends, word0 = block.words()
    w = block.hashes(starts, ends) ^ np.uint64(salt)
    out = []
    for n in sizes:
        g = ngrams(w, n)
        count = np.maximum(np.diff(word0) - n + 1, 0)
        row = np.repeat(np.arange(len(block)), count)
        at = np.repeat(word0[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        out.append((row, (g[at] >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a block, rows ascending."""
    parts = [*_rows(TextBlock(raw, lower=True), (1, 2), 0), *_rows(_shapes(TextBlock(raw)), (1, 2, 3), 0x5851F42D)]
    key = np.concatenate([(r << BITS) | f for r, f in parts])
    key, count = np.unique(key, return_counts=True)
    row, feature = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, len(raw)))
    return row, feature, value / norm[row] if len(row) else value


def _fit(labels: np.ndarray, texts: pd.Series) -> np.ndarray:
    """Weights; the last one is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, raw in blocks(texts):
        row, feature, value = features(raw)
        at = np.searchsorted(row, np.arange(len(raw) + 1))
        rows += [(np.append(feature[s:e], size).astype(np.int32), np.append(value[s:e], 1.0).astype(np.float32)) for s, e in zip(at[:-1], at[1:])]

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0; at most ``max_rows`` of them."""
    order = F.xxhash64("doc_id")
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .filter(f"doc_id IS NOT NULL AND y IS NOT NULL AND {fold('doc_id', 5)} <> 0")
        .groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
    )
    known = documents(docs).select("doc_id").distinct()
    sample = marked.join(known, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    rows = documents(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])  # at most max_rows ids are sent

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames) or [pd.DataFrame({"doc_id": [], "text": [], "y": []})]).sort_values("doc_id")
        w = _fit(f["y"].to_numpy(float), f["text"]) if len(f) else np.zeros((1 << BITS) + 1)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": at, "w": w[at]})

    got = rows.select("doc_id", "text", "y").coalesce(1).mapInPandas(fit, "i long, w double").toPandas()
    w = np.zeros((1 << BITS) + 1)
    w[got["i"].to_numpy(int)] = got["w"].to_numpy(float)
    return w


def fold(column: str, n: int) -> str:
    return f"crc32(CAST({column} AS STRING)) % {n}"


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` keep their place; score and predicted are added (replacing such columns)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2**BITS + 1 numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for f in frames:
            out = np.empty(len(f))
            for at, raw in blocks(f["text"]):
                row, feature, value = features(raw)
                out[at : at + len(raw)] = np.bincount(row, value * w[feature], len(raw)) + w[-1]
            f["score"] = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            f["predicted"] = (f["score"] >= threshold).astype("int32")
            yield f

    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "score double, predicted int"])
    return rows.mapInPandas(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = score(documents(docs), train(docs, labels))
    return rows.select("doc_id", F.expr(f"{fold('doc_id', 5)} = 0").alias("held_out"), "score", "predicted")
