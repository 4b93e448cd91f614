"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard.

Vectors of one shard are inserted in growing batches. For each, a greedy search of the graph so far proposes
neighbours; relaxed pruning keeps the nearest and drops every other that is more than ``ALPHA`` times closer to a
kept one than to the point, so the edges kept point in different directions; reverse edges are added and pruned
the same way. A query walks each shard's graph with a beam and the best of all shards are ranked by exact distance.

Equal vectors are one node that carries its smallest ids; k + 1 of them are enough for any k nearest (a query
may be one of them), ties going to smaller ids, so a vector that stands in every third row is one node too.

Shards hold about ``SHARD`` nodes whatever the table; queries come to a shard in blocks of about ``QUERIES``, each with
its copy of the graph, so a task's memory is bounded.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite number take no part, nor do rows without
vec_id; distances exist between vectors of one length only; repeated rows count once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.plans.scale import cut

SHARD, QUERIES = 8192, 20_000
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, GROUP = 32, 64, 160, 1.2, 256


def _distances(x: np.ndarray, sq: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row's point to its listed nodes; a missing node (-1) is infinitely far."""
    d = sq[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0] + (q * q).sum(1, keepdims=True)
    return np.where(ids < 0, np.inf, np.maximum(d, 0))


def beam_search(x: np.ndarray, sq: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers (-1: none) and squared distances of each query's beam, nearest first."""
    out_id = np.full((len(queries), beam), -1, np.int64)
    out_d = np.full((len(queries), beam), np.inf)
    for at in range(0, len(queries), GROUP):
        q = queries[at : at + GROUP]
        rows = np.arange(len(q))
        ids, dist, open_ = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf), np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), len(x)), bool)
        ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
        dist[:, 0] = _distances(x, sq, q, ids[:, :1])[:, 0]
        while len(rows):
            first = open_[rows].argmax(1)
            live = open_[rows, first]
            rows, first = rows[live], first[live]
            if not len(rows):
                break
            open_[rows, first] = False
            near = edges[ids[rows, first]]
            near = np.where((near >= 0) & ~seen[rows[:, None], near], near, -1)
            hit = near >= 0
            seen[np.broadcast_to(rows[:, None], near.shape)[hit], near[hit]] = True
            d = _distances(x, sq, q[rows], near)
            all_id, all_d = np.concatenate((ids[rows], near), 1), np.concatenate((dist[rows], d), 1)
            all_open = np.concatenate((open_[rows], hit), 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :beam]
            ids[rows], dist[rows] = np.take_along_axis(all_id, best, 1), np.take_along_axis(all_d, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1) & np.isfinite(dist[rows])
        out_id[at : at + GROUP], out_d[at : at + GROUP] = ids, dist
    return out_id, out_d


def robust_prune(x: np.ndarray, sq: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1: none), diverse ones first picked by nearness."""
    out = np.full((len(points), degree), -1, np.int64)
    step = max(1, 400_000 // max(found.shape[1] ** 2, 1))
    for at in range(0, len(points), step):
        p, c = points[at : at + step], np.sort(found[at : at + step], 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == p[:, None]] = -1
        d = _distances(x, sq, x[p], c)
        v = x[c]
        between = np.maximum(sq[c][:, :, None] + sq[c][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
        rows = np.arange(len(p))
        for j in range(degree):
            pick = d.argmin(1)
            has = np.isfinite(d[rows, pick])
            if not has.any():
                break
            out[at + rows[has], j] = c[rows[has], pick[has]]
            drop = has[:, None] & (alpha * alpha * between[rows, pick] <= d)
            drop[rows, pick] = True
            d[drop] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the entry node."""
    n = len(x)
    sq = (x * x).sum(1)
    edges = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != entry]
    at, batch = 0, 1
    while at < len(order):
        new = order[at : at + batch]
        near, _ = beam_search(x, sq, edges, entry, x[new], beam)
        edges[new] = robust_prune(x, sq, new, near, degree, alpha)
        source, target = np.repeat(new, degree), edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        for most in (8, 64, n):  # nodes with about as many new edges together
            of = (count <= most) & (count > {8: 0, 64: 8, n: 64}[most])
            if of.any():
                width = int(count[of].max())
                lane = np.arange(width)
                more = np.where(lane < count[of][:, None], source[np.minimum(first[of][:, None] + lane, len(source) - 1)], -1)
                joined = np.concatenate((edges[node[of]], more), 1)
                full = (joined >= 0).sum(1) > degree
                packed = -np.sort(-joined[~full], 1)[:, :degree]
                edges[node[of][~full]] = packed
                edges[node[of][full]] = robust_prune(x, sq, node[of][full], joined[full], degree, alpha)
        at, batch = at + len(new), min(batch * 2, GROUP)
    return edges, entry


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    fine = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    return rows.filter(fine).withColumn("dim", F.size("vec"))


def build(table: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """The index: one row per distinct vector with shard, node, ids (at most k + 1), vec, edges and entry."""
    smallest = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    nodes = vectors(table).dropDuplicates(["vec_id"]).withColumn("r", smallest).filter(F.col("r") <= k + 1)
    nodes = cut(nodes.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim")))
    shards = max(1, -(-nodes.count() // shard))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))

    def graph(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(first=f["ids"].str[0]).sort_values("first", ignore_index=True)
        edges, entry = build_graph(np.stack(f["vec"].to_numpy()).astype(np.float32))
        return pd.DataFrame({"dim": key[0], "shard": key[1], "node": np.arange(len(f)), "ids": f["ids"], "vec": f["vec"], "edges": [e[e >= 0] for e in edges], "entry": entry})

    return placed.groupBy("dim", "shard").applyInPandas(graph, "dim int, shard int, node long, ids array<long>, vec array<double>, edges array<long>, entry long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vec, dim), without its own row."""
    index = cut(index)
    shards = index.select("dim", "shard").distinct().select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    n = max(1, -(-queries.count() // block))
    # Every query block goes to every shard: the query set against all rows, in blocks.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = queries.select("vec_id", "vec", "dim", part.alias("part")).join(shards, "dim")
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def walk(key, g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        g = g.sort_values("node", ignore_index=True)
        exact = np.stack(g["vec"].to_numpy())
        x = exact.astype(np.float32)
        edges = np.full((len(g), max(1, max(map(len, g["edges"])))), -1, np.int64)
        for i, e in enumerate(g["edges"]):
            edges[i, : len(e)] = e
        asked_vec = np.stack(q["vec"].to_numpy())
        found, _ = beam_search(x, (x * x).sum(1), edges, int(g["entry"].iloc[0]), asked_vec.astype(np.float32), beam)
        out = []
        for own, v, nodes in zip(q["vec_id"].to_numpy(), asked_vec, found):
            nodes = nodes[nodes >= 0]
            score = np.sqrt(((exact[nodes] - v) ** 2).sum(1))
            rows = sorted((s, i) for s, m in zip(score.tolist(), nodes) for i in g["ids"].iat[m] if i != own)[:k]
            out += [(own, i, s) for s, i in rows]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ("dim", "shard", "part")
    near = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(walk, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest of the rows whose vec_id is divisible by ``every``, among all other rows."""
    return search(build(table, k), vectors(table).filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), k)
