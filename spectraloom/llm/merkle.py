"""A Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf. The leaves of one ``lang``, ascending by doc_id, make a tree: while several nodes remain, every two
consecutive ones become the hash of their hex digests joined, a last single one the hash of its own. The subroots, ordered
by ``lang``, make the top tree in the same way.

The log holds a tree's nodes in the order in which they are completed as leaves are appended, so a node's position
follows from its level and index alone: the subtree of a full node of level l has 2**(l+1) - 1 nodes, contiguous, and the
node is the last of them (``position``). Builders are aligned: one takes a run of 2**BITS leaves that starts at a
multiple of 2**BITS, writes the nodes above them as they are completed and hands its top node to the builder of the next
round, so the pieces of the first round are contiguous in the log and later rounds fill the places between.
Rounds go on until every tree has one node: three rounds hold 10**9 leaves of one language.

A proof is extracted from above: the siblings of a run's top node are known first, those inside the run are read from its
own piece of the log at the positions of the closed form. Nothing of a dataset meets in one task but runs of 2**BITS rows;
ranks come from a range sort and counts per partition, so one language may hold all rows.

Defined cases: a null lang is a language of its own and first; nulls in a leaf's columns are written ``-``; a null doc_id
sorts first; repeated doc_ids (and whole rows) are leaves of their own, in the order of their leaf hashes; extra columns are
ignored, whatever their names; an empty table gives no rows. A text is hashed by a column expression, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.tables import crc32_sql
from spectraloom.plans.scale import cut

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7


def node_hash(parts: list[bytes]) -> bytes:
    """Hex digest (as bytes) of hex digests joined."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


# --- the log of one tree -----------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the postorder log of a tree of ``n`` leaves."""
    last = ((index + 1) << level) - 1
    if last < n:  # full: it follows the leaf that completes it after ``level`` others
        return 2 * last - last.bit_count() + level
    whole = 2 * n - n.bit_count()  # all full nodes come before the unfinished edge, which closes upwards
    return whole + level - ((n & -n).bit_length() - 1) - 1


def build_run(leaves: list[bytes], climb: int) -> list[bytes]:
    """The log of an aligned run: its nodes up to level ``climb`` in the order in which they are completed."""
    log, open_nodes = [], []  # open_nodes: (level, digest) without a parent yet, levels falling
    for leaf in leaves:
        level = 0
        log.append(leaf)
        while open_nodes and open_nodes[-1][0] == level:
            leaf = node_hash([open_nodes.pop()[1], leaf])
            level += 1
            log.append(leaf)
        open_nodes.append((level, leaf))
    level, node = open_nodes.pop()
    while level < climb:
        pair = [open_nodes.pop()[1]] if open_nodes and open_nodes[-1][0] == level else []
        node = node_hash([*pair, node])
        level += 1
        log.append(node)
    return log


def siblings(log: list[bytes], rank: int, n: int, climb: int) -> list[tuple[bytes, bool]]:
    """(sibling, whether it stands left) of a leaf of a run, level by level; None where a node stood alone."""
    out = []
    for level in range(climb):
        index = rank >> level
        other = index ^ 1
        out.append((log[position(level, other, n)], other < index) if other << level < n else None)
    return out


def fold(node: bytes, path: list) -> bytes:
    for s in path:
        node = node_hash([node] if s is None else [s[0], node] if s[1] else [node, s[0]])
    return node


# --- ranks -------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rank`` (from 0, in ``order``) and ``size`` of every row's tree; no tree's rows need to meet.

    A range sort deals a tree over as many tasks as its rows need; ranks are places inside a partition plus the rows of the
    same tree in earlier partitions.
    """
    here = rows.repartitionByRange(F.asc_nulls_first(tree), *order).sortWithinPartitions(F.asc_nulls_first(tree), *order)
    here = cut(here.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = here.groupBy(F.col(tree).alias("_t"), part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # A row per tree and partition: as many as partitions and trees together.
    whole = Window.partitionBy("_t")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_t", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    same = F.col(tree).eqNullSafe(F.col("_t")) & (part == F.col("_p"))
    return here.join(counts, same).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_t", "_p", "_first", "_before", "_at")


# --- building ----------------------------------------------------------------------------------------

RUN = "tree {t}, size long, run long, round int, ids array<long>, changed array<string>, log array<string>"


def _build(climb_from: int, bits: int):
    """Each aligned run of rows (tree, run, rank ...) as one row with its piece of the log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row():
            tree, size, number = now
            held.sort()
            log = build_run([h[1] for h in held], min(bits, height(size) - climb_from))
            return tree, size, number, [h[2] for h in held], [h[3] for h in held], [x.decode() for x in log]

        out, kind = [], None
        for b in batches:
            kind = b.schema.field("tree").type
            names = ("tree", "size", "run", "rank", "node", "doc_id", "changed")
            for tree, size, number, rank, node, doc, changed in zip(*[b.column(c).to_pylist() for c in names]):
                key = (tree, size, number)
                if key != now:
                    if held:
                        out.append(row())
                    now, held = key, []
                    if len(out) * 2**bits >= 65_536:
                        yield _batch(out, kind, climb_from // bits)
                        out = []
                held.append((rank, node.encode(), doc, changed))
        if held:
            out.append(row())
        if out:
            yield _batch(out, kind, climb_from // bits)

    return run


def _batch(rows: list[tuple], tree: pa.DataType, number_of_round: int) -> pa.RecordBatch:
    t, size, number, ids, changed, log = zip(*rows)
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(t, tree), pa.array(size, pa.int64()), pa.array(number, pa.int64()), pa.array([number_of_round] * len(t), pa.int32()),
         pa.array(ids, longs), pa.array(changed, texts), pa.array(log, texts)],
        ["tree", "size", "run", "round", "ids", "changed", "log"],
    )


def build(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The log of every tree, one table of runs per round, from (tree, size, rank, node, doc_id, changed).

    A row is an aligned run: its leaves' ids and replacement hashes (first round only) and its nodes in the order of their
    completion, the top last; the leaves of a later round are tops of the round before. ``log_rows`` numbers the nodes.
    """
    rounds, tree = [], dict(nodes.dtypes)["tree"]
    while True:
        dealt = nodes.withColumn("run", F.shiftright("rank", bits))
        dealt = dealt.repartition("tree", "run").sortWithinPartitions("tree", "run").select("tree", "size", "run", "rank", "node", "doc_id", "changed")
        runs = cut(dealt.mapInArrow(_build(bits * len(rounds), bits), RUN.format(t=tree)))
        rounds.append(runs)
        going = runs.filter(F.col("size") > F.lit(1 << bits * len(rounds)))
        if going.isEmpty():
            return rounds
        nodes = going.select("tree", "size", F.col("run").alias("rank"), F.element_at("log", -1).alias("node"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed"))


def _numbered(climb_from: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tree, size, number, log = (b.column(c)[i].as_py() for c in ("tree", "size", "run", "log"))
                n, left = _members(size, number, climb_from, bits)
                at, nodes = [], []
                for level in range(1 if climb_from else 0, left + 1):
                    for index in range(-(-n >> level)):
                        at.append(position(climb_from + level, (number << bits - level) + index, size))
                        nodes.append(log[position(level, index, n)])
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(at), b.schema.field("tree").type), pa.array(at, pa.int64()), pa.array(nodes, pa.string())], ["tree", "position", "node"])

    return run


def log_rows(rounds: list[DataFrame], bits: int = BITS) -> DataFrame:
    """(tree, position, node): every node of the log, as rows."""
    out = None
    for k, r in enumerate(rounds):
        rows = r.select("tree", "size", "run", "log").mapInArrow(_numbered(bits * k, bits), f"tree {dict(r.dtypes)['tree']}, position long, node string")
        out = rows if out is None else out.unionByName(rows)
    return out


PATH = "array<struct<hash: string, left: boolean>>"


def _packed(path: list) -> list:
    return [None if s is None else {"hash": s[0].decode(), "left": s[1]} for s in path]


def _unpacked(path: list) -> list:
    return [None if s is None else (s["hash"].encode(), s["left"]) for s in path or []]


def _members(size: int, number: int, climb_from: int, bits: int) -> tuple[int, int]:
    """How many nodes of level ``climb_from`` a run has, and how many levels it climbs."""
    return min(-(-size >> climb_from) - (number << bits), 1 << bits), min(bits, height(size) - climb_from)


def _member_paths(climb_from: int, bits: int):
    """Path of every member of a run: its own levels from the log, then the path of the run's top."""

    def of(size: int, number: int, log: list[str], above: list):
        n, left = _members(size, number, climb_from, bits)
        log = [x.encode() for x in log]
        above = _unpacked(above)
        for rank in range(n):
            yield rank, log[position(0, rank, n)], siblings(log, rank, n, left) + above

    return of


def _extract(climb_from: int, bits: int):
    """(tree, rank, path) of the members of each run, with the roots of its tree."""
    of = _member_paths(climb_from, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tree, size, number, log, above, subroot, root = (b.column(c)[i].as_py() for c in ("tree", "size", "run", "log", "path", "subroot", "root"))
                got = [((number << bits) + rank, _packed(path)) for rank, _, path in of(size, number, log, above)]
                kinds = [b.schema.field("tree").type, pa.int64(), b.schema.field("path").type, pa.string(), pa.string()]
                columns = [[tree] * len(got), [g[0] for g in got], [g[1] for g in got], [subroot] * len(got), [root] * len(got)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tree", "rank", "path", "subroot", "root"])

    return run


def _prove(bits: int):
    of = _member_paths(0, bits)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size, number, log, ids, changed, above, subroot, root = (b.column(c)[i].as_py() for c in ("size", "run", "log", "ids", "changed", "path", "subroot", "root"))
                rows = []
                for rank, leaf, path in of(size, number, log, above):
                    folded = fold((changed[rank] or leaf.decode()).encode(), path).decode()
                    proof = [s[0] for s in path if s is not None]
                    rows.append((ids[rank], leaf.decode(), subroot, root, node_hash(proof).decode(), folded, folded == root, _packed(path)))
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), b.schema.field("path").type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


ABOVE = f"path {PATH}, subroot string, root string"


def descend(rounds: list[DataFrame], above: DataFrame, bits: int = BITS) -> DataFrame:
    """The runs of the first round with the path from their top to the root.

    ``above`` (tree, path, subroot, root) has a row per tree: how its path goes on beyond its own root.
    """
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        last = F.col("size") <= F.lit(1 << bits * (k + 1))
        up = above.select(F.col("tree").alias("_t"), "path", "subroot", "root")
        here = rounds[k].filter(last).join(up, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")  # one run a tree
        if paths is not None:
            up = paths.select(F.col("tree").alias("_t"), F.col("rank").alias("_r"), "path", "subroot", "root")
            more = rounds[k].filter(~last).join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("run") == F.col("_r")))
            here = here.unionByName(more.drop("_t", "_r"))
        if k:
            paths = cut(here.mapInArrow(_extract(bits * k, bits), f"tree {dict(here.dtypes)['tree']}, rank long, {ABOVE}"))
    return here


def roots(rounds: list[DataFrame], bits: int = BITS) -> DataFrame:
    """(tree, node): the root of every tree, the top of its only run in the last round it takes part in."""
    out = None
    for k, r in enumerate(rounds):
        rows = r.filter(F.col("size") <= F.lit(1 << bits * (k + 1))).select("tree", F.element_at("log", -1).alias("node"))
        out = rows if out is None else out.unionByName(rows)
    return out


def manifest(docs: DataFrame, bits: int = BITS) -> dict[str, DataFrame]:
    """``log`` (tree, position, node), ``roots`` (lang, subroot, root) and ``proofs``.

    ``proofs`` has a row per document: leaf, subroot, root, its proof (sibling hashes with their side; null where a node
    stood alone), the digest of the proof and what it folds to. Where ``TAMPER`` divides crc32 of the decimal doc_id the
    leaf that is folded is that of the row with ``n_chars`` one larger.
    """
    hit = (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaf_hash().alias("node"),
        F.when(hit, leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)).alias("changed"),
    )
    # The range sort reads its input twice; the texts are hashed once.
    bottom = build(ranked(cut(leaves), "tree", [F.asc_nulls_first("doc_id"), F.col("node")]), bits)
    langs = roots(bottom, bits).select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), "node")
    numbered = cut(ranked(cut(langs), "tree", [F.asc_nulls_first("lang")]))
    top = build(numbered.select("tree", "size", "rank", "node", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed")), bits)
    root = roots(top, bits).select("tree", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    paths = descend(top, root, bits).mapInArrow(_extract(0, bits), f"tree int, rank long, {ABOVE}").select("rank", "path", "root")
    above = cut(numbered.join(paths, "rank").select(F.col("lang").alias("tree"), "path", F.col("node").alias("subroot"), "root"))
    columns = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    runs = descend(bottom, above, bits).select("size", "run", "log", "ids", "changed", "path", "subroot", "root")
    return {"log": log_rows(bottom, bits), "roots": above.select(F.col("tree").alias("lang"), "subroot", "root"), "proofs": runs.mapInArrow(_prove(bits), f"{columns}, proof {PATH}")}


def report(docs: DataFrame, bits: int = BITS) -> DataFrame:
    return manifest(docs, bits)["proofs"].drop("proof")


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_sql_field(c) for c in FIELDS)
_TREE = """
 {name} AS (SELECT tree, 0 AS level, rank AS idx, node, size FROM {leaves}
  UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(size) + 1) // 2 FROM {name} WHERE size > 1 GROUP BY tree, level, idx // 2)"""
SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang AS tree, sha256({_LEAF}) AS node, n_chars IS NOT NULL AND {crc32_sql('doc_id')} % {TAMPER} = 0 AS hit,
  sha256({_LEAF.replace('CAST(n_chars AS VARCHAR)', 'CAST(n_chars + 1 AS VARCHAR)')}) AS other FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS size FROM l),
{_TREE.format(name='a', leaves='r')},
s AS (SELECT 0 AS tree, tree AS lang, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank, count(*) OVER () AS size, level AS up FROM a WHERE size = 1),
{_TREE.format(name='b', leaves='s')},
steps AS (
  SELECT r.doc_id, r.tree, r.rank, a.level, r.rank >> a.level AS idx, o.node AS sib FROM r JOIN a ON a.tree IS NOT DISTINCT FROM r.tree AND a.idx = r.rank >> a.level AND a.size > 1
    LEFT JOIN a o ON o.tree IS NOT DISTINCT FROM r.tree AND o.level = a.level AND o.idx = xor(a.idx, 1)
  UNION ALL SELECT r.doc_id, r.tree, r.rank, b.level + s.up, s.rank >> b.level, o.node FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.tree JOIN b ON b.idx = s.rank >> b.level AND b.size > 1
    LEFT JOIN b o ON o.level = b.level AND o.idx = xor(b.idx, 1)),
f AS (SELECT tree, rank, 0 AS level, CASE WHEN hit THEN other ELSE node END AS node FROM r
  UNION ALL SELECT f.tree, f.rank, f.level + 1, sha256(CASE WHEN sib IS NULL THEN node WHEN idx % 2 = 1 THEN sib || node ELSE node || sib END)
    FROM f JOIN steps p ON p.tree IS NOT DISTINCT FROM f.tree AND p.rank = f.rank AND p.level = f.level),
p AS (SELECT tree, rank, sha256(coalesce(string_agg(sib, '' ORDER BY level), '')) AS proof, max(level) + 1 AS up FROM steps GROUP BY tree, rank),
z AS (SELECT node AS root FROM b WHERE size = 1)
SELECT r.doc_id, r.node AS leaf, s.node AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.tree CROSS JOIN z LEFT JOIN p ON p.tree IS NOT DISTINCT FROM r.tree AND p.rank = r.rank
  JOIN f ON f.tree IS NOT DISTINCT FROM r.tree AND f.rank = r.rank AND f.level = coalesce(p.up, 0)"""
