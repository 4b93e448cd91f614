"""Prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of byte contexts, two deep by default and ``ORDER`` deep in the query. Each context counts the symbols that followed it in the training
texts; a symbol is coded in the longest context that knows it, after an escape from every longer one. Escapes
are estimated by method C (distinct symbols over total plus distinct), and symbols known to a longer context are
excluded from the counts of the shorter ones; below order 0 all 257 symbols are alike. Symbol 256 ends a text
and also stands before its start, so probabilities of all texts add up to one.

Training counts are taken over all training texts: a task sends one row per distinct trigram, at most 2**24 of
them whatever the corpus, and so the broadcast of the trie has a proven bound. A task turns the trie into log
probabilities for whole rows of 257 symbols, so a text is scored by one lookup per byte.

Counts of longer contexts grow with the corpus and are never broadcast. Parts of the corpus hand in their distinct
longest strings (a context of ``order`` symbols and what followed), which meet once by string and once by bucket of their last
three context symbols: all longer contexts of a string then lie in one bucket, so shorter counts are sums of the longest
ones' and the bucket gives every string its probability. A part gets back one number for each of its own strings. A
bucket holds distinct strings, at most 257**3 for one such three symbols whatever the corpus. A longer context's
symbols are all known to the shorter ones, so exclusion takes one sum for each context.

The base score is an add-one word model. Word counts meet by a shuffle of one row per distinct word and part of
the corpus, never per word: parts of the corpus hand in their distinct words and get back the counts of those that other
parts have in training texts too; of the others a part's own count is the whole one.

Texts are lower-cased A-Z first. Defined cases: null text is empty (it has the end symbol and the end token
alone); rows without doc_id go; with no training text the model is uniform; repeated rows give one row each
and count as often as they stand there; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.quality_model import fold
from spectraloom.llm.tables import documents
from spectraloom.llm.textblock import TextBlock, blocks

SYMBOLS, END = 257, 256
ORDER = 5
PART_BYTES, HELD, BUCKETS, RANKS = 24_000_000, 3_000_000, 8, 15_000
_END_TOKEN = np.int64(-0x5EED5EED5EED5EE)
#: What a row sent to a part tells: a word's count, the corpus's tokens and distinct ones, a string's log probability.
_WORD, _SIZES, _STRING = 0, 1, 2


def _symbols(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(context pair, symbol) for every byte and every end, texts in order."""
    s = b.data.astype(np.int32)
    s[b.last] = END
    one, two = np.empty_like(s), np.empty_like(s)
    one[0], two[0], one[1:] = END, END, s[:-1]
    two[1:] = one[:-1]
    two[b.first] = END  # the first symbol follows the end before it; so does the second, one step back
    return two * SYMBOLS + one, s


def _strings(b: TextBlock, order: int) -> np.ndarray:
    """For every byte and every end: the symbol and the ``order`` before it as one number; END stands before a text."""
    last = b.data.astype(np.int64)
    last[b.last] = END
    out = last.copy()
    for k in range(1, order + 1):
        before = np.empty_like(last)
        before[0], before[1:] = END, last[:-1]
        before[b.first] = END
        out += before * SYMBOLS**k
        last = before
    return out


def trigrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per distinct trigram of a task."""
    keys, counts, held = [], [], 0
    for f in frames:
        for _, raw in blocks(f["text"]):
            pair, s = _symbols(TextBlock(raw, lower=True))
            key, n = np.unique(pair * np.int32(SYMBOLS) + s, return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 500_000:
                keys, counts = (lambda k, n: ([k], [n]))(*_summed(keys, counts))
                held = len(keys[0])
    if keys:
        key, n = _summed(keys, counts)
        yield pd.DataFrame({"gram": key.astype(np.int64), "n": n})


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _next(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Log10 probabilities of each row's symbols from its counts and the distribution weights of shorter contexts.

    ``shorter`` gives P(symbol | shorter context, symbols in ``seen`` excluded) as a function value array.
    """
    seen = count > 0
    total, kinds = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    escape = np.where(kinds == SYMBOLS, 0.0, np.where(total == 0, 1.0, kinds / np.maximum(total + kinds, 1)))
    return np.where(seen, (1 - escape) * count / np.maximum(total, 1), escape * shorter)


def _excluded(count: np.ndarray, banned: np.ndarray, below) -> np.ndarray:
    """P(symbol | context of these counts) with banned symbols left out, escaping to ``below``."""
    left = np.where(banned, 0, count)
    return _next(left, below(banned | (left > 0)))


class Trie:
    """Counts by context of 0, 1 and 2 symbols, from trigram counts; log10 probabilities row by row."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        pair, s = gram // SYMBOLS, gram % SYMBOLS
        self.contexts, row = np.unique(pair, return_inverse=True)
        self.two = np.zeros((len(self.contexts), SYMBOLS))
        np.add.at(self.two, (row, s), n)
        self.one = np.zeros((SYMBOLS, SYMBOLS))
        np.add.at(self.one, (self.contexts % SYMBOLS,), self.two)
        self.zero = self.one.sum(0, keepdims=True)

    def _uniform(self, banned: np.ndarray) -> np.ndarray:
        return np.where(banned, 0.0, 1 / np.maximum(SYMBOLS - banned.sum(1, keepdims=True), 1))

    def _order0(self, banned: np.ndarray) -> np.ndarray:
        return _excluded(np.broadcast_to(self.zero, banned.shape), banned, self._uniform)

    def _log(self, count: np.ndarray, last: np.ndarray) -> np.ndarray:
        free = np.zeros(count.shape, bool)
        return np.log10(_excluded(count, free, lambda banned: _excluded(self.one[last], banned, self._order0))).astype(np.float32)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Row number by context pair, and the rows: first one per last symbol, then one per known pair."""
        at = np.tile(np.arange(SYMBOLS, dtype=np.int32), SYMBOLS)
        at[self.contexts] = SYMBOLS + np.arange(len(self.contexts), dtype=np.int32)
        fresh = [self._log(np.zeros((SYMBOLS, SYMBOLS)), np.arange(SYMBOLS))]
        known = [self._log(self.two[i : i + 2048], self.contexts[i : i + 2048] % SYMBOLS) for i in range(0, len(self.contexts), 2048)]
        return at, np.concatenate(fresh + known)


class DeepTrie:
    """Counts by context of 0 to ``order`` symbols, as sorted strings; log10 probabilities of single strings.

    ``gram`` and ``n`` are all trigram counts; ``string`` and ``c`` those of all longest strings of some last three context symbols.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, string: np.ndarray, c: np.ndarray, order: int):
        self.order, self.levels, shorter = order, [], None
        string, c = string[c > 0], c[c > 0]
        for k in range(order + 1):
            g, count = _summed([(gram if k <= 2 else string) % SYMBOLS ** (k + 1)], [n if k <= 2 else c])
            count = count.astype(np.float64)
            context, first = np.unique(g // SYMBOLS, return_index=True)
            total, kinds = (np.add.reduceat(count, first) if len(g) else count), np.diff(np.append(first, len(g))).astype(np.float64)
            below = self._at(shorter[0], shorter[1], g % SYMBOLS**k) if k else count
            excluded = np.add.reduceat(below, first) if len(g) else count
            self.levels.append((g, count, context, total, kinds, excluded))
            shorter = g, count

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values of the wanted keys, 0 for unknown ones."""
        if not len(keys):
            return np.zeros(len(wanted))
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[i] == wanted, values[i], 0.0)

    def log(self, string: np.ndarray) -> np.ndarray:
        out, found = np.zeros(len(string)), np.zeros(len(string), bool)
        less, fewer = np.zeros(len(string)), np.zeros(len(string))
        for k in range(self.order, -1, -1):
            g, count, context, total, kinds, excluded = self.levels[k]
            own = string % SYMBOLS ** (k + 1)
            n, all_kinds = self._at(g, count, own), self._at(context, kinds, own // SYMBOLS)
            left, new = self._at(context, total, own // SYMBOLS) - less, all_kinds - fewer
            escape = np.where(new == SYMBOLS, 0.0, np.where(left == 0, 1.0, new / np.maximum(left + new, 1)))
            hit, miss = ~found & (n > 0), ~found & (n == 0)
            out[hit] += np.log10((1 - escape[hit]) * n[hit] / left[hit])
            out[miss] += np.log10(escape[miss])
            found |= hit
            less, fewer = self._at(context, excluded, own // SYMBOLS), all_kinds
        out[~found] -= np.log10(np.maximum(SYMBOLS - fewer[~found], 1))
        return out


def looked_up(string: np.ndarray, p: np.ndarray, order: int, raw: list[bytes]) -> np.ndarray:
    """Log10 probability of each text from those of its strings, sorted."""
    b = TextBlock(raw, lower=True)
    own, where = np.unique(_strings(b, order), return_inverse=True)
    return np.diff(np.cumsum(p[np.searchsorted(string, own)][where])[b.last], prepend=0.0)


def code_lengths(at: np.ndarray, rows: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Log10 probability of each text."""
    b = TextBlock(raw, lower=True)
    pair, s = _symbols(b)
    p = np.cumsum(rows[at[pair], s], dtype=np.float64)
    ends = p[b.last]
    return np.diff(ends, prepend=0.0)


def _word_keys(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    b = TextBlock(raw, lower=True)
    starts, ends, word0 = b.words()
    return b.hashes(starts, ends).view(np.int64), word0


def _merged(where: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (where, key) summed up."""
    order = np.lexsort((key, where))
    key, where, n = key[order], where[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1])
    first = np.flatnonzero(new)
    return where[first], key[first], np.add.reduceat(n, first)


def _distinct_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per part and distinct word, at most HELD / 2 of them at once: how often it stands in training texts."""
    found, size = [], 0
    for f in frames:
        for at, raw in blocks(unpacked(f["text"])):
            key, word0 = _word_keys(raw)
            n, of = np.diff(word0), slice(at, at + len(raw))
            keep, part = ~f["held_out"].to_numpy(bool)[of], f["part"].to_numpy()[of]
            found.append(_merged(
                np.concatenate((np.repeat(part, n), part)), np.concatenate((key, np.full(len(raw), _END_TOKEN))),
                np.concatenate((np.repeat(keep, n), keep)).astype(np.int64),
            ))
            size += len(found[-1][0])
            if size > HELD // 2:
                found = [_merged(*(np.concatenate(x) for x in zip(*found)))]
                size = len(found[0][0])
                if size > HELD // 4:
                    yield pd.DataFrame(dict(zip(("part", "word", "n"), found[0])))
                    found, size = [], 0
    if found:
        yield pd.DataFrame(dict(zip(("part", "word", "n"), _merged(*(np.concatenate(x) for x in zip(*found))))))


def _distinct_strings(order: int):
    """One row per part and distinct string of order + 1 symbols, at most HELD of them at once: how often it stands in training texts."""
    top = SYMBOLS ** (order + 1)

    def rows(names: np.ndarray, code: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        key, kept = code >> 1, np.where(code & 1, n, 0)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return pd.DataFrame({"part": names[key[first] // top], "string": key[first] % top, "n": np.add.reduceat(kept, first)})

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[first], np.add.reduceat(n, first)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held, size = np.empty(0, np.int64), [], 0
        for f in frames:
            part = f["part"].to_numpy(np.int64)
            new = np.setdiff1d(part, names)
            if held and len(names) + len(new) > RANKS:
                yield rows(names, *merged(held))
                names, held, size = np.empty(0, np.int64), [], 0
                new = np.unique(part)
            names = np.concatenate((names, new))
            by_name = np.argsort(names)
            rank = by_name[np.searchsorted(names[by_name], part)]
            train = (~f["held_out"].to_numpy(bool)).astype(np.int64)
            for at, raw in blocks(unpacked(f["text"])):
                b = TextBlock(raw, lower=True)
                n, of = b.last - b.first + 1, slice(at, at + len(raw))
                code = (np.repeat(rank[of] * top, n) + _strings(b, order)) * 2 + np.repeat(train[of], n)
                code, n = np.unique(code, return_counts=True)
                held.append((code, n.astype(np.int32)))
                size += len(code)
                if size > HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD * 4 // 5:
                        yield rows(names, *held[0])
                        held, size = [], 0
        if held:
            yield rows(names, *merged(held))

    return run


def packed(text: pd.Series) -> pd.Series:
    """Texts compressed one by one; rows travel and wait in this form."""
    return text.map(lambda t: zlib.compress(t.encode(), 1))


def unpacked(text: pd.Series) -> Iterator[bytes]:
    return (zlib.decompress(t) for t in text)


def own_counts(text: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a part's training texts and how often they stand there."""
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, raw in blocks(unpacked(text["text"])):
        key, word0 = _word_keys(raw)
        keep = ~text["held_out"].to_numpy(bool)[at : at + len(raw)]
        key, n = np.unique(key[np.repeat(keep, np.diff(word0))], return_counts=True)
        keys.append(key)
        counts.append(n)
    return _summed(keys, counts)


def shared_words(words: DataFrame, total: DataFrame) -> DataFrame:
    """(word, part, c): words that a part does not hold all training occurrences of, and the end token, with their counts."""
    own = words.groupBy("word", "part").agg(F.sum("n").alias("n")).filter("n >= 0")
    return own.join(total.select("word", "c"), "word").filter((F.col("c") != F.col("n")) | (F.col("word") == int(_END_TOKEN))).select("word", "part", "c")


def score_texts(docs: DataFrame, parts: int | None = None, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = documents(docs).withColumn("held_out", F.expr(f"{fold('doc_id', 7)} = 2"))
    if parts is None:
        parts = rows.agg(F.ceil(F.sum(F.octet_length("text") + 64) / PART_BYTES)).first()[0] or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(int(parts))).cast("int"))

    # The trie: at most 2**24 + 2**17 rows whatever the corpus.
    grams = rows.filter("NOT held_out").select("text").mapInPandas(trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    trie = docs.sparkSession.sparkContext.broadcast((grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64)))

    # One shuffle of the texts serves the word lists and the scoring; one shuffle of the lists serves both counts.
    shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("text", F.pandas_udf(packed, "binary")("text")).repartition(shuffles, "part")
    words = rows.select("part", "held_out", "text").mapInPandas(_distinct_words, "part int, word long, n long").filter("word IS NOT NULL").repartition(shuffles, "word")
    # Every use of a list keeps all its columns, so that both read one exchange and the texts are not listed twice.
    total = words.groupBy("word").agg(F.sum("n").alias("c"), F.max("part").alias("p")).filter("c > 0 AND p >= 0")
    size = total.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_train"), F.count(F.lit(1)).alias("n_distinct"))
    known = shared_words(words, total).crossJoin(F.broadcast(size))
    own = F.struct(F.lit(_WORD).cast("byte").alias("kind"), F.col("word").alias("key"), F.col("c").cast("double").alias("value"))
    sizes = F.struct(F.lit(_SIZES).cast("byte").alias("kind"), F.col("n_train").alias("key"), F.col("n_distinct").cast("double").alias("value"))
    counts = known.select("part", F.explode(F.when(F.col("word") == int(_END_TOKEN), F.array(own, sizes)).otherwise(F.array(own))).alias("x")).select("part", "x.*")
    if order > 2:
        strings = rows.select("part", "held_out", "text").mapInPandas(_distinct_strings(order), "part int, string long, n long").filter("string IS NOT NULL").repartition(shuffles, "string")
        summed = strings.groupBy("string").agg(F.sum("n").alias("c"), F.max("part").alias("p")).filter("p >= 0")
        bucket = F.pmod(F.xxhash64(F.expr(f"string div {SYMBOLS} % {SYMBOLS**3}")), F.lit(int(parts) * BUCKETS)).alias("bucket")

        def probabilities(f: pd.DataFrame) -> pd.DataFrame:
            string = f["string"].to_numpy()
            return pd.DataFrame({"string": string, "value": DeepTrie(*trie.value, string, f["c"].to_numpy(), order).log(string)})

        scored = summed.select(bucket, "string", "c").groupBy("bucket").applyInPandas(probabilities, "string long, value double")
        back = strings.join(scored, "string").filter("n >= 0 OR value > 0")
        counts = counts.union(back.select("part", F.lit(_STRING).cast("byte"), "string", "value"))

    def score(key, text: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        kind, keys, values = (known[c].to_numpy() for c in ("kind", "key", "value"))
        if order > 2:
            deep = np.flatnonzero(kind == _STRING)
            deep = deep[np.argsort(keys[deep])]
            model = partial(looked_up, keys[deep], values[deep], order)
        else:
            model = partial(code_lengths, *Trie(*trie.value).table())
        about = np.flatnonzero(kind == _SIZES)
        n_train, distinct = (int(keys[about[0]]), int(values[about[0]])) if len(about) else (0, 0)
        single = np.flatnonzero(kind == _WORD)
        mine, n = own_counts(text)
        alone = ~np.isin(mine, keys[single])
        word, c = np.concatenate((keys[single], mine[alone])), np.concatenate((values[single], n[alone]))
        word, c = (lambda order: (word[order], c[order]))(np.argsort(word))
        norm = np.log10(n_train + distinct + 1.0)
        out = []
        for at, raw in blocks(unpacked(text["text"])):
            k, word0 = _word_keys(raw)
            token = np.concatenate((k, [_END_TOKEN]))
            i = np.minimum(np.searchsorted(word, token), max(len(word) - 1, 0))
            n = np.where(word[i] == token, c[i], 0.0) if len(word) else np.zeros(len(token))
            p, has = np.log10(n + 1) - norm, n > 0
            sums = np.concatenate(([0.0], np.cumsum(p[:-1])))
            hits = np.concatenate(([0], np.cumsum(has[:-1])))
            out.append(pd.DataFrame({
                "doc_id": text["doc_id"].to_numpy()[at : at + len(raw)], "held_out": text["held_out"].to_numpy()[at : at + len(raw)],
                "n_tokens": np.diff(word0) + 1, "n_known": hits[word0[1:]] - hits[word0[:-1]] + int(has[-1]), "train_tokens": n_train,
                "base_score": sums[word0[1:]] - sums[word0[:-1]] + p[-1], "score": model(raw),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("part").cogroup(counts.groupBy("part")).applyInPandas(score, schema)
