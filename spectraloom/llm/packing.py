"""Best-fit packing with certified bin counts and repacking.

A document becomes byte-level BPE ids plus an end id; longer ones are cut into full pieces behind a first piece that
may be shorter. A full piece is a sequence of its own, so only first pieces shorter than a sequence are packed.

* Pieces are dealt by a hash of what they are over partitions of bounded size; each is packed by best-fit decreasing.
* Each partition gets a lower bound on its bins from dual feasible functions (the plain volume, and for every
  threshold up to half the capacity the classical rounding that counts big pieces whole and drops small ones;
  and the family that rounds k-fold sizes down). Bins equal to the bound: certified.
* Partitions with a gap hand the pieces of their bins with room to an exchange, certified ones those of bins with much room
  (the bound is rounded up, so it leaves up to one bin in each partition): neighbours meet in one and are repacked, in
  rounds until one partition is left. A meeting that would need more bins keeps what it had.

Memory: a task holds one partition of at most about ``PARTITION_PIECES`` short pieces, sizes only. Texts are
tokenised where they are read, and are never shuffled.

Defined cases: null text is empty (its single id is the end id); rows without doc_id go; repeated rows are packed
once each, under their own number; pieces of equal length go by that number, which changes no count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.tables import documents
from spectraloom.llm.textblock import SPACE, TextBlock, blocks
from spectraloom.plans.scale import cut

CAPACITY, END_ID, PARTITION_PIECES = 1024, 2, 20_000
#: A certified partition hands on bins with more than this share of the capacity free.
CERTIFIED_ROOM = 64


@cache
def _encoders(folder: str):
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    return own, tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_folder() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json").rpartition("/")[0]


def encode(raw: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block of texts, and the first id of each (one more at the end).

    No token reaches over a space that follows a non-space, so texts are cut there, equal chunks are encoded once
    and ids are put together by chunk number. A text that holds the special token's name is left to the
    tokenizer itself.
    """
    own, fast = _encoders(folder)
    b = TextBlock(raw)
    space = SPACE[b.data]
    cuts = np.zeros(len(b.data), bool)
    cuts[1:] = (b.data[1:] == 32) & ~space[:-1]
    cuts[b.last] = False
    full = b.last > b.first
    cuts[b.first[full]] = True
    starts = np.flatnonzero(cuts)
    which = np.searchsorted(b.first, starts, "right") - 1
    which = np.where(starts > b.last[which], which + 1, which)
    ends = np.append(starts[1:], len(b.data))
    ends = np.minimum(ends, b.last[which])
    _, first, chunk = np.unique(b.hashes(starts, ends), return_index=True, return_inverse=True)
    text = b.data.tobytes()
    ids = [fast.encode_ordinary(text[starts[i] : ends[i]].decode()) for i in first]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
    begin = np.cumsum(size) - size
    n = size[chunk]
    at = np.repeat(begin[chunk], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out, per = flat[at], np.bincount(which, n, len(raw)).astype(np.int64)
    offset = np.append(0, np.cumsum(per))
    special = [i for i, t in enumerate(raw) if b"<|endoftext|>" in t]
    if special:
        parts = [out[offset[i] : offset[i + 1]] for i in range(len(raw))]
        for i in special:
            parts[i] = np.array(own.encode(raw[i].decode(), add_special_tokens=False).ids, np.uint32)
        out, offset = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return out, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """(row_no, doc_id, piece, start, length, ids_crc32): the pieces of every document with its end id."""
    folder = folder or tokenizer_folder()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            number, doc = f["row_no"].to_numpy(), f["doc_id"].to_numpy()
            for at, raw in blocks(f["text"]):
                ids, offset = encode(raw, folder)
                out = []
                for i in range(len(raw)):
                    own = np.append(ids[offset[i] : offset[i + 1]], END_ID).astype("<u4")
                    head = len(own) % capacity or capacity
                    for k, start in enumerate([0, *range(head, len(own), capacity)]):
                        length = head if k == 0 else capacity
                        out.append((number[at + i], doc[at + i], k, start, length, zlib.crc32(own[start : start + length].tobytes())))
                yield pd.DataFrame(out, columns=["row_no", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents(docs).select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    return rows.mapInPandas(run, "row_no long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece by best-fit decreasing; open bins stand in stacks by the room they have left."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r is set if a bin has exactly r left
    out, bins = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = filled >> s
        if above:
            left = s + ((above & -above).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                filled ^= 1 << left
        else:
            b, left, bins = bins, capacity, bins + 1
        out[i] = b
        left -= s
        room[left].append(b)
        filled |= 1 << left
    return out


def lower_bound(count: np.ndarray) -> int:
    """Bins that pieces need at least; ``count[s]`` is the number of pieces of size s, the capacity is the last index.

    Dual feasible functions u map sizes so that no full bin maps above 1; the mapped sum is then a lower bound.
    """
    capacity = len(count) - 1
    s = np.arange(capacity + 1)
    best = int(-(-int((s * count).sum()) // capacity))
    whole, volume = np.cumsum(count), np.cumsum(count * s)
    for t in range(1, capacity // 2 + 1):  # sizes above capacity - t count as full, below t as nothing
        big = whole[capacity] - whole[capacity - t]
        middle = volume[capacity - t] - volume[t - 1]
        best = max(best, int(big - (-int(middle) // capacity)))
    for k in range(1, 41):  # (k + 1)-fold sizes round down to k-ths unless they are whole multiples
        exact = (s * (k + 1)) % capacity == 0
        mapped = np.where(exact, s * k, (s * (k + 1) // capacity) * capacity)
        best = max(best, int(-(-int((mapped * count).sum()) // (k * capacity))))
    return best


def _packed(capacity: int, partition: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "row_no"], ascending=[False, True], kind="stable")
        sizes = f["length"].to_numpy()
        bins = best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        gap = len(fill) - lower_bound(np.bincount(sizes, minlength=capacity + 1))
        # What goes on to an exchange: bins with room, emptiest first, half a partition of pieces at most.
        room = capacity - fill
        order = np.argsort(fill, kind="stable")
        open_ = np.zeros(len(fill), bool)
        open_[order] = np.cumsum(np.bincount(bins, minlength=len(fill))[order]) <= partition // 2
        open_ &= room > (0 if gap else capacity // CERTIFIED_ROOM)
        return pd.DataFrame({"grp": key[0], "row_no": f["row_no"], "length": sizes, "bin": bins, "loose": open_[bins]})

    return run


_SCHEMA = "grp long, row_no long, length long, bin long, loose boolean"


def pack(short: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION_PIECES) -> DataFrame:
    """(row_no, bin_key): pieces (row_no, deal, length below capacity) put into bins; bin_key names the bin.

    ``deal`` is a hash of what the piece is, so the number of bins does not depend on how the input is split. A partition
    with a gap to its bound exchanges its bins with room, a certified one only those with more than a 64th of it free, as
    its bound is rounded up. Partitions meet in pairs until one is left; a pair that would take more bins keeps what it had.
    """
    run = _packed(capacity, partition)
    n = short.count()
    groups = max(1, -(-n // partition))
    dealt = short.select(F.pmod("deal", F.lit(groups)).alias("grp"), "row_no", "length")
    now = cut(dealt.groupBy("grp").applyInPandas(run, _SCHEMA))
    done: list[DataFrame] = []
    spark, step = short.sparkSession, 0
    named = lambda df, k: df.select("row_no", F.concat_ws("-", F.lit(str(k)), "grp", "bin").alias("bin_key"))
    bins_of = lambda df: df.groupBy("grp").agg(F.countDistinct("bin").alias("bins")).toPandas()  # noqa: E731  a row per partition
    while True:
        loose = now.filter("loose")
        at = bins_of(loose)
        if len(at) < 2:
            done.append(named(now, step))
            break
        done.append(named(now.filter("NOT loose"), step))
        # Neighbours meet: two partitions in one, the last three if their number is odd.
        order = np.sort(at["grp"].to_numpy())
        meet = {int(g): min(i // 2, len(order) // 2 - 1) for i, g in enumerate(order)}
        to = F.broadcast(spark.createDataFrame(pd.DataFrame({"grp": list(meet), "next": list(meet.values())}), "grp long, next long"))
        again = cut(loose.join(to, "grp").select(F.col("next").alias("grp"), "row_no", "length").groupBy("grp").applyInPandas(run, _SCHEMA))
        before = at.assign(grp=at["grp"].map(meet)).groupby("grp")["bins"].sum()
        after = bins_of(again).set_index("grp")["bins"]
        worse = [int(g) for g in after.index if after[g] > before[g]]
        if worse:
            refused = [g for g, k in meet.items() if k in set(worse)]
            done.append(named(loose.filter(F.col("grp").isin(refused)), step))
            again = again.filter(~F.col("grp").isin(worse))
        now, step = again, step + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def sequences(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None, partition: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    from pyspark.sql import Window

    cut_up = cut(pieces(docs, capacity, folder))
    short = cut_up.filter(F.col("length") < capacity)
    keys = pack(short.select("row_no", F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32").alias("deal"), "length"), capacity, partition)
    placed = short.join(keys, "row_no")
    bins = placed.select("bin_key").distinct().select("bin_key", (2 * F.monotonically_increasing_id()).alias("sequence_id"))
    bins = cut(bins)
    before = Window.partitionBy("bin_key").orderBy(F.desc("length"), "row_no").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).join(bins, "bin_key")
    alone = cut_up.filter(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*names).unionByName(alone.select(*names))
