"""Prefix trie over conversations: double arrays per prefix shard, upper nodes merged globally.

* A turn is 128 bits of the SHA-256 of role and text; a prefix of d turns is the exclusive or of two 64-bit hashes of its
  (position, turn) pairs, so prefixes of a conversation of any length come from a running aggregate, and the parent's key
  from the node's own by the same operation. Equal conversations are merged first and count as one with a weight.
* Shards: a conversation belongs to its shortest prefix whose subtree holds at most ``SHARD_ROWS`` turns. A task packs the
  shards it gets into one double array: over turn ids made dense inside the pack, ``BASE[node] + id`` is the child's slot
  and ``CHECK[slot]`` its parent. Walking all conversations through it gives the nodes and their aggregates.
* Upper nodes (the root, and prefixes with larger subtrees: a first turn that a third of all conversations share) are
  merged by a grouped aggregate. Their subtree sums need no recursion: a node belongs to its smallest conversation, which then
  owns the rest of its path too, so a subtree's sum is what its members own, less what the node's owner owns above it.

Defined cases: rows without conv_id go; a null role or text is empty; rows are ordered by turn (null first), equal turns
by the hash of role and text; repeated rows are repeated turns; extra columns are ignored, whatever their names; an empty
table has no nodes. Texts are hashed by a column expression and go no further. A conversation may hold any share of the
rows: its turns are numbered, hashed and summed in blocks, and only its last ``SHARD_ROWS`` turns ever stand in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.tables import crc32_sql
from spectraloom.plans.scale import cut, number_rows, running_total

SHARD_ROWS, PACK_ROWS = 256, 50_000
#: Rows of one key that a join may bring together before the key is salted.
HEAVY, SALTS = 1_000, 64
GROUP, SHARED = 100, 6
BLOCK = 16
KEY = ["d", "x1", "x2"]


# --- rebuilt conversations ---------------------------------------------------------------------------


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, len, d, chars, th) of the rebuilt conversations, d from 1, and every (conv_id, len)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(whole, 1, 32)).alias("th"), F.char_length(text).alias("chars"),
    )
    turns = cut(number_rows(turns, ["conv_id"], ["turn", "th"], "pos").drop("turn"))
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumn("h", h)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    sizes = convs.filter("conv_id = base").select("base", F.col("n").alias("_bn"))
    convs = convs.join(sizes, "base", "left").withColumn("nb", F.least("h", F.coalesce("_bn", F.lit(0)))).drop("_bn")
    convs = cut(convs.withColumn("len", F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    block = F.shiftright("pos", BLOCK)
    by_block = convs.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, BLOCK))))
    own = turns.withColumn("blk", block).join(by_block.select("conv_id", "blk", "h", "nb", "len"), ["conv_id", "blk"]).filter("pos >= h")
    own = own.select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("nb") + 1).alias("d"), "chars", "th")
    shared = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), "pos", "chars", "th")
    shared = shared.join(convs.filter("nb > 0"), "base").filter("pos < nb")  # at most GROUP conversations and SHARED turns a base
    shared = shared.select("conv_id", "len", (F.col("pos") + 1).alias("d"), "chars", "th")
    return own.unionByName(shared), convs.select("conv_id", "len")


def with_prefixes(rows: DataFrame, longest: int) -> DataFrame:
    """Add the keys x1, x2 of the prefix that ends with each turn and q1, q2 of the one before."""
    rows = rows.withColumn("_h1", F.xxhash64("d", "th")).withColumn("_h2", F.xxhash64(F.lit("b"), "th", "d")).withColumn("_blk", F.shiftright(F.col("d") - 1, BLOCK))
    upto = Window.partitionBy("conv_id", "_blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    if longest > 1 << BLOCK:
        rows = cut(rows)
    out = rows.withColumn("x1", F.bit_xor("_h1").over(upto)).withColumn("x2", F.bit_xor("_h2").over(upto))
    if longest > 1 << BLOCK:
        before = Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("conv_id", "_blk").agg(F.bit_xor("_h1").alias("_t1"), F.bit_xor("_h2").alias("_t2"))
        starts = starts.select("conv_id", "_blk", *[F.coalesce(F.bit_xor(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in (1, 2)])
        out = out.join(starts, ["conv_id", "_blk"])
        out = out.withColumn("x1", F.col("x1").bitwiseXOR(F.col("_s1"))).withColumn("x2", F.col("x2").bitwiseXOR(F.col("_s2")))
    out = out.withColumn("q1", F.col("x1").bitwiseXOR(F.col("_h1"))).withColumn("q2", F.col("x2").bitwiseXOR(F.col("_h2")))
    return out.drop("_h1", "_h2", "_blk", "_s1", "_s2")


def join_nodes(rows: DataFrame, nodes: DataFrame, on: list[str], weight: str, spread: str) -> DataFrame:
    """Inner join where a node may match a large share of the rows; ``weight`` says how many rows each node may match.

    Nodes above ``HEAVY`` are copied to ``SALTS`` keys and their rows dealt over these by ``spread``; the others join plainly.
    """
    heavy = cut(nodes.filter(F.col(weight) > HEAVY))
    if heavy.isEmpty():
        return rows.join(nodes, on)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    copies = heavy.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("_s", salt)
    light = salted.join(copies.select(*on, "_s"), [*on, "_s"], "left_anti").drop("_s").join(nodes.filter(F.col(weight) <= HEAVY), on)
    return salted.join(copies, [*on, "_s"]).drop("_s").unionByName(light)


# --- double arrays -----------------------------------------------------------------------------------


class DoubleArray:
    """A forest over dense symbol ids: BASE[node] + id is the child's slot, CHECK[slot] its parent (-1: free).

    Slots 0 .. roots - 1 are the roots. ``raw`` names the symbols of all sequences one after another; ids are given in
    the order in which parents take up their children, so brothers have ids side by side.
    """

    def __init__(self, root: np.ndarray, sizes: np.ndarray, raw: np.ndarray):
        self.roots = int(root.max()) + 1 if len(root) else 0
        self.first = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.raw = raw
        self.dense = np.full(int(raw.max()) + 1 if len(raw) else 0, -1, np.int64)
        room = self.roots + len(raw) + 1
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[: self.roots] = -2
        self.levels: list[np.ndarray] = []
        self._lowest, known, node, live = self.roots, 0, root.copy(), np.arange(len(sizes))
        for k in range(int(sizes.max()) if len(sizes) else 0):
            live = live[sizes[live] > k]
            symbol = raw[self.first[live] + k]
            pairs, place = np.unique(node[live] * len(self.dense) + symbol, return_inverse=True)
            parent, symbol = np.divmod(pairs, len(self.dense))
            new = symbol[self.dense[symbol] < 0]
            new = new[np.sort(np.unique(new, return_index=True)[1])]
            self.dense[new] = known + np.arange(len(new))
            known += len(new)
            slot = self._place(parent, self.dense[symbol])
            self.levels.append(slot)
            node[live] = slot[place]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, start: int, count: int) -> np.ndarray:
        """The next ``count`` free slots from ``start`` on."""
        self._grow(len(self.check) + count - int((self.check[start:] == -1).sum()))
        return start + np.flatnonzero(self.check[start:] == -1)[:count]

    def _place(self, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots for the children (parent, id), which come sorted by parent."""
        slot = np.empty(len(parent), np.int64)
        edge = np.flatnonzero(np.diff(parent, prepend=-1))
        count = np.diff(np.append(edge, len(parent)))
        for at, n in zip(edge[count > 1].tolist(), count[count > 1].tolist()):
            mine = np.sort(ids[at : at + n])
            reach = int(mine[-1] - mine[0])
            start = self._lowest
            while True:
                self._grow(start + 256 + reach + 1)
                seen = start + np.flatnonzero(self.check[start : start + 256] == -1)
                fits = (self.check[seen[:, None] + (mine - mine[0])[None, :]] == -1).all(1)
                if fits.any():
                    base = int(seen[np.argmax(fits)]) - int(mine[0])
                    break
                start += 256
            slot[at : at + n] = base + ids[at : at + n]
            self.check[slot[at : at + n]] = parent[at]
            self.base[parent[at]] = base
        single = edge[count == 1]
        if len(single):
            slot[single] = self._free(self._lowest, len(single))
            self.check[slot[single]] = parent[single]
            self.base[parent[single]] = slot[single] - ids[single]
        ahead = np.flatnonzero(self.check[self._lowest :] == -1)
        self._lowest += int(ahead[0]) if len(ahead) else len(self.check) - self._lowest
        return slot

    def walk(self, root: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(step, sequences still going, their slots), through BASE and CHECK alone."""
        node, live = root.copy(), np.arange(len(self.sizes))
        for k in range(len(self.levels)):
            live = live[self.sizes[live] > k]
            slot = self.base[node[live]] + self.dense[self.raw[self.first[live] + k]]
            if (self.check[slot] != node[live]).any():
                raise ValueError("a sequence leaves the trie")
            node[live] = slot
            yield k, live, slot


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_n long, q1 long, q2 long"


def _pack(rows: dict[str, list]) -> pa.RecordBatch:
    conv, weight, d0 = (np.array(rows[c], np.int64) for c in ("conv_id", "n", "d0"))
    sizes = np.array([len(t) for t in rows["th"]], np.int64)
    names = pa.array([x for t in rows["th"] for x in t], pa.binary()).dictionary_encode()
    chars = np.array([x for t in rows["chars"] for x in t], np.int64)
    shard = np.array(rows["x1"], np.int64), np.array(rows["x2"], np.int64)
    root = np.cumsum(np.append(0, (np.diff(shard[0]) != 0) | (np.diff(shard[1]) != 0)))
    trie = DoubleArray(root, sizes, np.asarray(names.indices).astype(np.int64))
    size = len(trie.check)
    n, owner, held, depth, leaves = (np.zeros(size, np.int64) for _ in range(5))
    owner[:] = np.iinfo(np.int64).max
    end, end_n, top = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    for k, live, slot in trie.walk(root):
        np.add.at(n, slot, weight[live])
        np.minimum.at(owner, slot, conv[live])
        held[slot], depth[slot] = chars[trie.first[live] + k], d0[live] + k
        last = sizes[live] == k + 1
        end[slot[last]], end_n[slot[last]] = live[last], weight[live[last]]
        if k == 0:
            top[slot] = live
    saved = (n - 1) * held
    parents = [trie.check[s] for s in trie.levels]
    children = np.zeros(size, np.int64)
    for p in parents:
        np.add.at(children, p, 1)
    for slot, p in zip(trie.levels[::-1], parents[::-1]):
        leaves[slot] += children[slot] == 0
        np.add.at(leaves, p, leaves[slot])
        np.add.at(saved, p, saved[slot])
    at = np.concatenate(trie.levels)
    up = trie.check[at]
    inner = up >= trie.roots
    some = lambda values, ok: pa.array(values, pa.int64(), mask=~ok)
    ended = end[at] >= 0
    q = [np.array(rows[c], np.int64) for c in ("q1", "q2")]
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[at]), pa.array(depth[at]), some(np.where(inner, owner[up], 0), inner), pa.array(n[at]), pa.array(children[at]), pa.array(leaves[at]),
         pa.array(saved[at]), some(np.where(ended, conv[end[at]], 0), ended), pa.array(end_n[at]), *[some(np.where(inner, 0, x[top[at]]), ~inner) for x in q]],
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "end_n", "q1", "q2"],
    )


def _tries(pack_rows: int):
    """Nodes of whole shards, about ``pack_rows`` turns a double array; a shard's rows follow each other."""
    names = ("x1", "x2", "conv_id", "n", "d0", "q1", "q2", "th", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = {c: [] for c in names}, 0, None
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in names]):
                if size >= pack_rows and row[:2] != now:
                    yield _pack(held)
                    held, size = {c: [] for c in names}, 0
                now = row[:2]
                for c, v in zip(names, row):
                    held[c].append(v)
                size += len(row[-1])
        if size:
            yield _pack(held)

    return run


# --- digests of members ------------------------------------------------------------------------------


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []

    def rows() -> pa.RecordBatch:
        got = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.string())], ["end_rep", "ends_sha256"])

    for b in batches:
        for rep, ids in zip(b.column("end_rep").to_pylist(), b.column("ids").to_pylist()):
            if rep == now:
                state.update(f",{ids}".encode())
                continue
            if state:
                done.append((now, state.hexdigest()))
            now, state = rep, hashlib.sha256(ids.encode())
        if done:
            yield rows()
    if state:
        done.append((now, state.hexdigest()))
        yield rows()


def member_digests(members: DataFrame) -> DataFrame:
    """(end_rep, ends_sha256) from (end_rep, conv_id): ids ascend, in decimal, with commas between.

    Ids are joined in buckets of 1024 of them first, so what streams through one task is a thousandth of its members.
    """
    lists = members.groupBy("end_rep", F.shiftright("conv_id", 10).alias("_b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda e: e.cast("string")), ",").alias("ids"))
    return lists.repartition("end_rep").sortWithinPartitions("end_rep", "_b").select("end_rep", "ids").mapInArrow(_hash_lists, "end_rep long, ends_sha256 string")


# --- the trie ----------------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(conversations)
    longest = convs.agg(F.max("len")).first()[0] or 0
    rows = cut(with_prefixes(rows, longest))
    zero = F.lit(0).cast("long")
    finals = rows.filter("d = len").select("conv_id", "len", "x1", "x2").unionByName(
        convs.filter("len = 0").select("conv_id", F.col("len").cast("long").alias("len"), zero.alias("x1"), zero.alias("x2"))
    )
    same = ["len", "x1", "x2"]
    texts = cut(finals.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = join_nodes(finals, texts.filter("n > 1"), same, "n", "conv_id").select(F.col("rep").alias("end_rep"), "conv_id")
    # One conversation stands for all equal ones.
    blocks = texts.filter("len > 0").select(F.col("rep").alias("conv_id"), "n", F.explode(F.sequence(zero, F.shiftright(F.col("len") - 1, BLOCK))).alias("_blk"))
    rows = rows.withColumn("_blk", F.shiftright(F.col("d") - 1, BLOCK)).join(blocks, ["conv_id", "_blk"]).drop("_blk")
    rows = cut(rows)

    first = rows.filter("d = 1").groupBy("x1", "x2").agg(F.sum("len").alias("w"))
    big = not first.filter(F.col("w") > shard_rows).isEmpty()
    root = texts.select(F.col("rep").alias("conv_id"), "n", "len", zero.alias("d"), zero.alias("x1"), zero.alias("x2"), zero.alias("q1"), zero.alias("q2"), F.lit(0).alias("chars"))
    upper, cold = root, rows
    if big:
        sums = rows.groupBy(*KEY).agg(F.sum(F.col("len") - F.col("d") + 1).alias("w"), F.count(F.lit(1)).alias("m"))
        large = cut(sums.filter(F.col("w") > shard_rows).drop("w"))
        hot = cut(join_nodes(rows, large, KEY, "m", "conv_id").drop("m"))
        upper = root.unionByName(hot.select(root.columns))
        # What is not hot: a conversation's hot turns come first on its path.
        hot_len = hot.groupBy("conv_id", F.shiftright(F.col("d") - 1, BLOCK).alias("_blk")).agg(F.max("d").alias("_p"))
        cold = rows.withColumn("_blk", F.shiftright(F.col("d") - 1, BLOCK)).join(hot_len, ["conv_id", "_blk"], "left").filter("_p IS NULL OR d > _p").drop("_blk", "_p")
    # At most ``shard_rows`` turns of a conversation are left for its shard.
    turn = F.struct("d", "th", "chars", "x1", "x2", "q1", "q2")
    tails = cold.groupBy("conv_id", "n").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    tails = tails.select("conv_id", "n", *[F.col("_t")[0][c].alias(a) for c, a in (("d", "d0"), ("x1", "x1"), ("x2", "x2"), ("q1", "q1"), ("q2", "q2"))], F.col("_t.th").alias("th"), F.col("_t.chars").alias("chars"))
    dealt = tails.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "conv_id").select("x1", "x2", "conv_id", "n", "d0", "q1", "q2", "th", "chars")
    lower = cut(dealt.mapInArrow(_tries(pack_rows), NODE))
    tops = lower.filter("parent_conv_id IS NULL").withColumn("d", F.col("depth") - 1)

    above = _upper_nodes(upper, tops)
    parents = above.select("d", F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("conv_id").alias("_owner"), F.col("n_children").alias("_m"))
    known = join_nodes(tops.drop("parent_conv_id"), parents, ["d", "q1", "q2"], "_m", "conv_id").withColumnRenamed("_owner", "parent_conv_id")
    chain = above.filter("d > 0").withColumn("d", F.col("d") - 1)
    upper_known = join_nodes(chain, parents, ["d", "q1", "q2"], "_m", "conv_id").withColumn("depth", F.col("d") + 1).withColumnRenamed("_owner", "parent_conv_id")
    top = above.filter("d = 0").withColumn("depth", F.col("d")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "end_n"]
    nodes = lower.filter("parent_conv_id IS NOT NULL").select(names)
    for part in (known, upper_known, top):
        nodes = nodes.unionByName(part.select(names))
    alone = F.when(F.col("end_rep").isNull(), F.sha2(F.lit(""), 256)).otherwise(F.sha2(F.col("end_rep").cast("string"), 256))
    many = F.coalesce(F.col("end_n") > 1, F.lit(False))
    out = nodes.filter(~many).withColumn("ends_sha256", alone).unionByName(nodes.filter(many).join(member_digests(members), "end_rep"))
    return out.drop("end_rep", "end_n")


def _upper_nodes(upper: DataFrame, tops: DataFrame) -> DataFrame:
    """Merged nodes above the shards, from the (distinct conversation, depth) rows above them and the shards' tops."""
    nodes = upper.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.min(F.when(F.col("len") == F.col("d"), F.col("conv_id"))).alias("end_rep"), F.max(F.when(F.col("len") == F.col("d"), F.col("n"))).alias("end_n"),
    )
    nodes = cut(nodes)
    below = tops.select("d", F.col("q1").alias("x1"), F.col("q2").alias("x2"), F.lit(1).alias("_c"), F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s"))
    zero = F.lit(0).cast("long")
    below = below.unionByName(nodes.filter("d > 0").select((F.col("d") - 1).alias("d"), F.col("q1").alias("x1"), F.col("q2").alias("x2"), F.lit(1).alias("_c"), zero.alias("_l"), zero.alias("_s")))
    below = below.groupBy(*KEY).agg(F.sum("_c").alias("n_children"), F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
    nodes = nodes.join(below, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("_l", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("_l", zero)))
    nodes = cut(nodes.withColumn("_s", F.coalesce("_s", zero) + (F.col("n_convs") - 1) * F.col("chars")).drop("chars"))
    owned = nodes.groupBy("conv_id").agg(F.max("d").alias("_last"), F.sum("_l").alias("_tl"), F.sum("_s").alias("_ts"))
    owned = owned.withColumn("_blk", F.explode(F.sequence(zero, F.shiftright("_last", BLOCK)))).drop("_last")
    sums = upper.withColumn("_blk", F.shiftright("d", BLOCK)).join(owned, ["conv_id", "_blk"]).groupBy(*KEY).agg(F.sum("_tl").alias("_tl"), F.sum("_ts").alias("_ts"))
    out = running_total(running_total(nodes, ["conv_id"], F.col("_l"), "_pl", "d"), ["conv_id"], F.col("_s"), "_ps", "d").join(sums, KEY)
    return cut(
        out.withColumn("n_leaves", F.col("_tl") - F.col("_pl") + F.col("_l")).withColumn("saved_tokens", F.col("_ts") - F.col("_ps") + F.col("_s"))
        .drop("_l", "_s", "_pl", "_ps", "_tl", "_ts")
    )


SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql('conv_id')} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {GROUP} AND pos < h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
r AS (SELECT conv_id, row_number() OVER w AS d, string_agg(md5(role || chr(0) || text), '') OVER w AS key, length(text) AS chars FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, substr(key, 1, greatest(length(key) - 32, 0)) AS up FROM r GROUP BY key, d),
k AS (SELECT up, count(*) AS n FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.key),
s AS (SELECT r.key, sum((m.n_convs - 1) * m.chars) AS saved, count(*) FILTER (WHERE m.n_children = 0) AS leaves FROM m JOIN r ON r.conv_id = m.conv_id AND r.d <= m.d GROUP BY r.key),
e AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS len FROM r) WHERE d = len GROUP BY key)
SELECT m.conv_id, m.d AS depth, CASE WHEN m.d > 0 THEN p.conv_id END AS parent_conv_id, m.n_convs, m.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN s USING (key) LEFT JOIN n p ON p.key = m.up LEFT JOIN e USING (key)"""
