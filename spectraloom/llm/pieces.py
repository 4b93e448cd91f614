"""SentencePiece encoding and decoding with N-best segmentations over the piece lattice.

The model file gives pieces and scores. A text gets a space in front and spaces become the mark U+2581; no piece
holds the mark after another character, so the lattice falls apart into segments (spaces and what follows up to
the next space) whose best paths are independent.

* Forward: for all distinct segments of a batch at once, the best and second-best score up to every character.
* The N best of a text differ from its best in segments whose loss from best to second best is smallest: N - 1 such
  places are enough, whatever the text's length.
* Backward: for these segments A-star search runs from the end, with the forward scores as exact heuristics, and lists
  their N best; the sums over places are merged.

A character without a piece costs 10 more than the worst piece and becomes its UTF-8 byte pieces. Paths of equal
score: the shorter last piece wins. U+2581 in a text counts as a space (as in the library).

Defined cases: null and empty texts have no pieces, one segmentation of score 0, and decode to the empty text; rows
without doc_id go; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectraloom.llm.tables import documents
from spectraloom.llm.textblock import TextBlock, blocks, mix

MARK, BEST, CHUNK_BYTES = "▁", 4, 4_000_000
MAYBE_BITS = 20
MAYBE = np.uint64((1 << MAYBE_BITS) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
NAMES = ["doc_id", "n_pieces", "ids_crc32", "scores", "decoded_equal", "ids", "changes"]


class Pieces:
    """The pieces of a model: hashes of their characters for whole-array lookup, scores, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in usual}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.unknown = float(self.score[usual].min()) - 10
        self.longest = max(map(len, self.id_of))
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a space after another character")
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        if any(model.is_unknown(int(i)) for i in self.byte_id):
            raise ValueError("the model has no byte pieces")
        texts = [b""] * n
        for p, i in self.id_of.items():
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_id):
            texts[i] = bytes([b])
        self.bytes = texts
        names = list(self.id_of)
        key = np.array([_hash(np.array([ord(c) for c in p], np.uint64)) for p in names], np.uint64)
        order = np.argsort(key)
        self.key, self.key_id = key[order], np.array([self.id_of[names[i]] for i in order])
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        self.maybe[self.key & MAYBE] = True

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none; most substrings are no piece, so only those of a marked slot are searched."""
        out = np.full(len(key), -1)
        some = np.flatnonzero(self.maybe[key & MAYBE])
        found = key[some]
        at = np.minimum(np.searchsorted(self.key, found), len(self.key) - 1)
        out[some] = np.where(self.key[at] == found, self.key_id[at], -1)
        return out


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = h * _STEP + mix(np.array([c], np.uint64))
    return mix(h + np.uint64(len(codes)))[0]


def forward(codes: np.ndarray, length: np.ndarray, p: Pieces) -> tuple[np.ndarray, ...]:
    """Best and second-best score at every position of segments (rows of code points), and the last piece of the best.

    Returns (first, second, size, piece); piece -1 is a character without a piece.
    """
    m, n = codes.shape
    first, second = np.full((m, n + 1), -np.inf), np.full((m, n + 1), -np.inf)
    size, piece = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
    first[:, 0] = 0
    char = mix(codes.astype(np.uint64))
    power = np.ones(p.longest + 1, np.uint64)
    for k in range(p.longest):
        power[k + 1] = power[k] * _STEP
    for end in range(1, n + 1):
        live = np.flatnonzero(length >= end)
        if not len(live):
            break
        key = np.zeros(len(live), np.uint64)
        for k in range(1, min(p.longest, end) + 1):
            key = key + char[live, end - k] * power[k - 1]
            ids = p.lookup(mix(key + np.uint64(k)))
            fits = np.flatnonzero((ids >= 0) | (k == 1))
            rows, ids = live[fits], ids[fits]
            cost = np.where(ids >= 0, p.score[ids], p.unknown)
            a, b = first[rows, end - k] + cost, second[rows, end - k] + cost
            old = first[rows, end]
            better = a > old
            second[rows, end] = np.maximum(np.maximum(second[rows, end], b), np.where(better, old, a))
            win = rows[better]
            first[win, end], size[win, end], piece[win, end] = a[better], k, ids[better]
    return first, second, size, piece


def n_best(text: str, p: Pieces, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of one segment: (score, piece ids; -1 - code point for a character without a piece)."""
    size = len(text)
    ahead, into = [0.0] + [-np.inf] * size, [[] for _ in range(size + 1)]
    for end in range(1, size + 1):
        for k in range(1, min(p.longest, end) + 1):
            i = p.id_of.get(text[end - k : end])
            if i is None and k > 1:
                continue
            cost, i = (float(p.score[i]), i) if i is not None else (p.unknown, -1 - ord(text[end - 1]))
            into[end].append((end - k, cost, i))
            ahead[end] = max(ahead[end], ahead[end - k] + cost)
    out: list[tuple[float, list[int]]] = []
    heap, tick = [(-ahead[size], 0, size, 0.0, None)], 0
    while heap and len(out) < n:
        total, _, at, behind, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((-total, ids))
            continue
        for start, cost, i in into[at]:
            tick += 1
            heapq.heappush(heap, (-(ahead[start] + behind + cost), tick, start, behind + cost, (i, path)))
    return out


def _distinct_segments(b: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts that begin with a space, cut before each space after a non-space: starts, ends, text, hash."""
    cuts = np.zeros(len(b.data), bool)
    cuts[1:] = (b.data[1:] == 32) & (b.data[:-1] != 32)
    cuts[b.last] = False
    cuts[b.first[b.last > b.first]] = True
    starts = np.flatnonzero(cuts)
    text = np.searchsorted(b.first, starts, "right") - 1
    text = np.where(starts >= b.last[text], text + 1, text)
    ends = np.minimum(np.append(starts[1:], len(b.data)), b.last[text])
    return starts, ends, text, b.hashes(starts, ends)


def encode(texts: list[bytes], p: Pieces, n: int = BEST) -> dict:
    """Best ids of every text (flat, with offsets), the n best scores, and whether decoding gives the text back.

    ``changed`` lists, per text and segmentation after the best, the segments that differ with their ids.
    """
    marked = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]
    which, text_no, distinct, seen = [], [], [], {}
    for at, raw in blocks(marked):
        b = TextBlock(raw)
        starts, ends, text, key = _distinct_segments(b)
        own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        data, number = b.data.tobytes(), np.empty(len(own), np.int64)
        for j, (h, i) in enumerate(zip(own.tolist(), first.tolist())):
            k = seen.get(h)
            if k is None:
                k = seen[h] = len(distinct)
                distinct.append(data[starts[i] : ends[i]])
            number[j] = k
        which.append(number[inverse])
        text_no.append(text + at)
    seg = np.concatenate(which) if which else np.empty(0, np.int64)
    row = np.concatenate(text_no) if text_no else np.empty(0, np.int64)

    words = [s.decode().replace(" ", MARK) for s in distinct]
    size = np.fromiter(map(len, words), np.int64, len(words))
    best, loss = np.zeros(len(words)), np.full(len(words), np.inf)
    ids: list[list[int]] = [[]] * len(words)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):  # segments of about one length together
        width = int(size[order[at]] * 1.25) + 1
        to = int(np.searchsorted(size[order], width, "right"))
        to = min(to, at + max(1, 2_000_000 // width))
        part = order[at:to]
        width = int(size[part].max())
        flat = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(part), width), np.uint32)
        codes[np.arange(width) < size[part][:, None]] = flat
        one, two, step, piece = forward(codes, size[part], p)
        lane = np.arange(len(part))
        best[part], loss[part] = one[lane, size[part]], one[lane, size[part]] - two[lane, size[part]]
        step_, piece_, last = step.tolist(), piece.tolist(), size[part].tolist()
        for j, i in enumerate(part.tolist()):
            end, path, sj, pj = last[j], [], step_[j], piece_[j]
            while end:
                k = pj[end]
                if k < 0:
                    path += [int(p.byte_id[c]) for c in reversed(words[i][end - 1].encode())]
                else:
                    path.append(k)
                end -= sj[end]
            ids[i] = path[::-1]
        at = to

    good = np.fromiter((b"".join([p.bytes[i] for i in path]) == s for path, s in zip(ids, distinct)), bool, len(ids))
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for path in ids for i in path), np.int32, int(count.sum()))
    begin, c = np.cumsum(count) - count, count[seg]
    out = flat[np.repeat(begin[seg], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
    offset = np.append(0, np.cumsum(np.bincount(row, c, len(texts)).astype(np.int64)))
    edge = np.searchsorted(row, np.arange(len(texts) + 1))
    total = np.bincount(row, best[seg], len(texts))
    whole = np.bincount(row, ~good[seg], len(texts)) == 0

    known: dict[int, list[tuple[float, list[int]]]] = {}
    scores, changed = [], []
    for t in range(len(texts)):
        own = seg[edge[t] : edge[t + 1]]
        gap = loss[own]
        take = np.argpartition(gap, n - 2)[: n - 1] if len(own) >= n > 1 else np.arange(len(own))
        take = take[np.isfinite(gap[take])]
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for i in sorted(take.tolist()) if n > 1 else []:
            k = int(own[i])
            if k not in known:
                known[k] = n_best(words[k], p, n)
            lists = known[k]
            sums = heapq.nsmallest(n, ((lost + lists[0][0] - s, how + (((i, j),) if j else ())) for lost, how in sums for j, (s, _) in enumerate(lists)))
        scores.append([float(total[t]) - lost for lost, _ in sums])
        changed.append([[(i, known[int(own[i])][j][1]) for i, j in how] for _, how in sums[1:]])
    return {"ids": out, "offset": offset, "scores": scores, "changed": changed, "whole": whole}


def decode(ids: list[int], p: Pieces) -> str:
    """The text of piece ids, without the space in front."""
    return b"".join(p.bytes[i] for i in ids).decode(errors="replace")[1:]


def _lists(values: pa.Array, sizes: Iterable[int]) -> pa.ListArray:
    """Runs of ``values`` as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _changes(changed: list[list[list[tuple[int, list[int]]]]]) -> pa.ListArray:
    """``changed`` of ``encode``, one list of segmentations for each text."""
    ways = [way for text in changed for way in text]
    places = [place for way in ways for place in way]
    ids = _lists(pa.array([i for _, own in places for i in own], pa.int32()), [len(own) for _, own in places])
    place = pa.StructArray.from_arrays([pa.array([i for i, _ in places], pa.int32()), ids], ["segment", "ids"])
    return _lists(_lists(place, map(len, ways)), map(len, changed))


def segmentations(docs: DataFrame, n: int = BEST, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, scores (n best, best first), decoded_equal, ids and changes of the others.

    ``changes``: per segmentation after the best, its differing segments (number in the text) with their ids; a
    character without a piece stands as -1 minus its code point there.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            for at, raw in blocks(b.column("text").to_pylist(), CHUNK_BYTES):
                got = encode(raw, p, n)
                count, ids = np.diff(got["offset"]), got["ids"].astype("<i4")
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(got["offset"][:-1], got["offset"][1:])]
                scores = _lists(pa.array([s for own in got["scores"] for s in own], pa.float64()), map(len, got["scores"]))
                columns = [b.column("doc_id").slice(at, len(raw)), pa.array(count), pa.array(crc, pa.int64()), scores, pa.array(got["whole"]), _lists(pa.array(ids), count), _changes(got["changed"])]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded_equal boolean, ids array<int>, changes array<array<struct<segment: int, ids: array<int>>>>"
    return documents(docs).mapInArrow(run, schema)
