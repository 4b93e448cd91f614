import hashlib
import random
import zlib

import numpy as np
import pytest

from spectraloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, d string, x1 double"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    memo = {}
    for key in sorted(nodes, key=len, reverse=True):
        below = [memo[k] for k in children.get(key, [])]
        saved = (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        memo[key] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children.get(key, [])), *memo[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def names(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(df.columns) == sorted(cols)
    return sorted([tuple(r) for r in df.select(cols).collect()], key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for c in range(260):
        shared = c % 3 == 0
        turns = [("user", "hot turn")] * shared + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "😀c", ""])) for _ in range(rng.randrange(1, 6))]
        out += [(c, t, r, x, "x", 1.0) for t, (r, x) in enumerate(turns)]
    out += [(c, t, "user", f"same {t}", "x", 1.0) for c in range(3000, 5300, 7) for t in range(4)]
    out += [(301, t, "user", f"long {t % 5}", "x", 1.0) for t in range(400)] + [(302, t, "user", f"long {t % 5}", "x", 1.0) for t in range(390)]
    out += [(777, 0, "user", "lonely", "x", 1.0), (778, None, "user", None, None, None), (778, 3, None, "after", "x", 1.0), (None, 0, "user", "no id", "x", 1.0)]
    return out


@pytest.mark.parametrize("shard_rows, heavy", [(256, 1000), (6, 3), (1, 1000)])
def test_equals_brute_force(spark, rows, shard_rows, heavy, monkeypatch):
    monkeypatch.setattr(P, "HEAVY", heavy)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert names(P.prefix_trie(df, shard_rows)) == brute(rows)


def test_long_conversations_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    assert names(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), 20, 40)) == brute(rows)


def test_double_array():
    rng = np.random.default_rng(3)
    for trial in range(40):
        sizes = rng.integers(1, 9, rng.integers(1, 60))
        root = np.sort(rng.integers(0, 4, len(sizes)))
        root = np.unique(root, return_inverse=True)[1]
        raw = rng.integers(0, [3, 40, 300][trial % 3], sizes.sum())
        trie = P.DoubleArray(root, sizes, raw)
        ends = np.cumsum(sizes)
        paths, slots = {}, {}
        for k, live, slot in trie.walk(root):
            for i, s in zip(live, slot):
                key = (root[i], *raw[ends[i] - sizes[i] : ends[i] - sizes[i] + k + 1])
                assert paths.setdefault(s, key) == key and slots.setdefault(key, s) == s
        assert len(paths) == (trie.check >= 0).sum()


def test_empty_table_and_one_turn(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(5, 0, "user", "x", "x", 1.0)]
    assert names(P.prefix_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
