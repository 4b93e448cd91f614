"""Exact repeats of 100-byte strings over a whole corpus, by column-wise construction over anchored contexts.

Every 100-byte string is named by its anchor, the position of the smallest hash among its 32-byte substrings (the
leftmost one of equals). Equal strings have equal anchors at equal places, so they meet under the anchor's hash.
Neighbouring strings share an anchor; together they are its context, the bytes from the first of them to the
end of the last.

* Equal contexts are one: all but the first hold only strings that start earlier elsewhere. Copies end here, first
  within a batch of documents, so a passage that stands in every document is one row per batch.
* Contexts of one anchor that differ are the documents of a collection. It is built column by column: each round
  inserts one symbol per context in front, right to left, and updates the order of all contexts by their
  suffixes (the collection's Burrows-Wheeler order) and the common prefixes of neighbours in it. Because contexts
  are aligned at their anchors, only suffixes of one column are ever compared, so a round is a stable
  distribution of the previous order by one symbol; each column is read once, in sequence.
* In the order at a column, neighbours with 100 common bytes hold the same string; all but the earliest in the
  corpus are covered.

Covered strings make up the removed bytes; texts are judged on the input. Buckets of anchors have a bounded expected
size set by ``BUCKET_ROWS``; nothing is gathered elsewhere.

Defined cases: null text is empty; rows without doc_id go; rows that repeat a doc_id with the same text are the same
document and do not cover each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.tables import documents
from spectraloom.llm.textblock import TextBlock, blocks

LENGTH, SEED = 100, 32
BUCKET_ROWS = 150_000
ANCHORS_PER_BYTE = 0.03


def anchors(b: TextBlock, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor place, anchor hash) of every context in a block."""
    width = length - seed + 1
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if len(b.data) < length:
        return none
    place = np.arange(len(b.data) - seed + 1)
    value = b.hashes(place, place + seed)
    best, at, span = value, place.astype(np.int32), 1
    while span < width:  # the smallest of ``span`` neighbours, then of twice as many, then of exactly ``width``
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        keep = left <= right
        best, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
        span += step
    n = np.maximum(b.last - b.first - length + 1, 0)
    text = np.repeat(np.arange(len(b)), n)
    start = np.repeat(b.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(start):
        return none
    anchor = at[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], start[first], start[last], anchor[first], value[anchor[first]]


_CONTEXT = "kind int, bucket int, doc_id long, s long, e long, p long, key long, ctx long"


def _contexts(buckets: int):
    """Batches of documents to contexts: kind 0 is the first of equal ones in the batch, kind 1 is covered already."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for at, raw in blocks(f["text"]):
                b = TextBlock(raw)
                text, s, last, p, key = anchors(b)
                off = b.first[text]
                found.append((f["doc_id"].to_numpy()[at + text], s - off, last - off + LENGTH, p - off, key, b.hashes(s, last + LENGTH)))
            if found:
                doc, s, e, p, key, ctx = (np.concatenate(x) for x in zip(*found))
                later = _later(key, ctx, doc, s)
                doc1, s1, e1 = _union(doc[later], s[later], e[later])
                keep = ~later
                yield pd.DataFrame({
                    "kind": 0, "bucket": (key[keep] % np.uint64(buckets)).astype(np.int32), "doc_id": doc[keep], "s": s[keep], "e": e[keep], "p": p[keep],
                    "key": key[keep].view(np.int64), "ctx": ctx[keep].view(np.int64),
                })
                yield pd.DataFrame({"kind": 1, "bucket": (doc1 % buckets).astype(np.int32), "doc_id": doc1, "s": s1, "e": e1, "p": 0, "key": 0, "ctx": 0})

    return run


def _later(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows whose context stands earlier in the corpus."""
    order = np.lexsort((s, doc, ctx, key))
    k, c, d, t = key[order], ctx[order], doc[order], s[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.empty(0, np.int64)
    out = np.empty(len(k), bool)
    out[order] = (d != d[first]) | (t != t[first])
    return out


def _union(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals per document with overlapping and touching ones joined."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    # Running ends within a document: documents are lifted apart so one running maximum serves all.
    lift = (np.cumsum(fresh) - 1) * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + lift)
    new = fresh.copy()
    new[1:] |= (s + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], (reach - lift)[last]


def _sorted_out(f: pd.DataFrame) -> pd.DataFrame:
    """One bucket: covered intervals (kind 1), and the first of each context whose anchor has different ones (kind 2)."""
    done = f["kind"].to_numpy() == 1
    held = f[~done]
    key, ctx, doc, s = (held[c].to_numpy() for c in ("key", "ctx", "doc_id", "s"))
    later = _later(key, ctx, doc, s)
    cover = held[later]
    doc1, s1, e1 = _union(np.concatenate((f["doc_id"].to_numpy()[done], cover["doc_id"])), np.concatenate((f["s"].to_numpy()[done], cover["s"])), np.concatenate((f["e"].to_numpy()[done], cover["e"])))
    one = held[~later].drop_duplicates(["key", "ctx"])
    many = one[one["key"].duplicated(keep=False)]
    return pd.concat([
        pd.DataFrame({"kind": 1, "bucket": 0, "doc_id": doc1, "s": s1, "e": e1, "p": 0, "key": 0, "ctx": 0}),
        many.assign(kind=2)[["kind", "bucket", "doc_id", "s", "e", "p", "key", "ctx"]],
    ])


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for doc, text, asked in zip(f["doc_id"], f["text"], f["asked"]):
            raw = text.encode()
            out += [(a["bucket"], doc, a["s"], a["p"], a["key"], raw[a["s"] : a["e"]]) for a in asked if a["e"] <= len(raw)]
        yield pd.DataFrame(out, columns=["bucket", "doc_id", "s", "p", "key", "bytes"])


def covered_columns(groups: np.ndarray, rank: np.ndarray, strings: list[bytes], before: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Column-wise construction: which strings of each context start earlier elsewhere.

    ``groups`` names the anchor, ``before`` how many bytes stand left of it, ``rank`` the order in the corpus. The
    result has a row per context and a column per start, counted from the left end of the context.
    """
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    left, right = int(before.max()), int((size - before).max())
    text = np.zeros((m, left + right), np.int16)  # 0 is past the end; bytes count from 1
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    row = np.repeat(np.arange(m), size)
    text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - before, size)] = flat
    out = np.zeros((m, max(int(size.max()) - length + 1, 1)), bool)
    order = np.argsort(groups, kind="stable")
    group = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    common = np.zeros(m, np.int64)  # common[i]: of order[i - 1] and order[i]
    for column in range(left + right - 1, -1, -1):
        symbol = text[:, column].astype(np.int64)
        key = (group * 512 + symbol)[order]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = np.zeros(m, bool)
        same[1:] = (key[1:] == key[:-1]) & (key[1:] % 512 > 0)
        i = np.flatnonzero(same)
        fresh = np.zeros(m, np.int64)
        if len(i):
            a, b = by[i - 1], by[i]
            if (b - a == 1).all():
                fresh[i] = common[b] + 1
            else:
                edge = np.stack((a + 1, b + 1), 1).ravel()
                fresh[i] = np.minimum.reduceat(np.append(common, 0), edge)[::2] + 1
        order, common = order[by], fresh
        if column <= left:
            run = np.flatnonzero(common < length)
            if len(run) < m:
                r = rank[order]
                first = np.repeat(np.minimum.reduceat(r, run), np.diff(np.append(run, m)))
                who = order[r != first]
                out[who, column - (left - before[who])] = True
    return out


def _built(f: pd.DataFrame) -> pd.DataFrame:
    """One bucket of contexts to the covered intervals of their documents."""
    doc, s, p = (f[c].to_numpy() for c in ("doc_id", "s", "p"))
    rank = np.empty(len(f), np.int64)
    rank[np.lexsort((p, doc))] = np.arange(len(f))
    hit = covered_columns(f["key"].to_numpy(), rank, f["bytes"].tolist(), p - s)
    row, column = np.nonzero(hit)
    start = s[row] + column
    doc1, s1, e1 = _union(doc[row], start, start + LENGTH)
    return pd.DataFrame({"doc_id": doc1, "s": s1, "e": e1})


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, s, e): byte intervals covered by strings that also start earlier. They may overlap."""
    rows = documents(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size * ANCHORS_PER_BYTE) // BUCKET_ROWS + 1)
    found = rows.mapInPandas(_contexts(buckets), _CONTEXT)
    sorted_out = found.groupBy("bucket").applyInPandas(_sorted_out, _CONTEXT)
    asked = sorted_out.filter("kind = 2").groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "s", "e", "p", "key")).alias("asked"))
    cut_out = rows.join(asked, "doc_id").mapInPandas(_slices, "bucket int, doc_id long, s long, p long, key long, bytes binary")
    built = cut_out.groupBy("bucket").applyInPandas(_built, "doc_id long, s long, e long")
    return sorted_out.filter("kind = 1").select("doc_id", "s", "e").union(built)


def _removed(with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, spans in zip(f["doc_id"], f["text"], f["spans"]):
                raw = text.encode()
                s, e = (np.array([x[c] for x in spans], np.int64) for c in ("s", "e")) if spans is not None else (np.empty(0, np.int64),) * 2
                _, s, e = _union(np.zeros(len(s), np.int64), s, e)
                kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
                out.append((doc, len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, if asked for)."""
    spans = repeated(docs).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = documents(docs).join(spans, "doc_id", "left")
    return rows.mapInPandas(_removed(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
