import hashlib
import zlib

import pytest

from spectraloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, tree string, node double"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((level[other], other < i) if other < len(level) else None)
        i >>= 1
    return out


def brute(rows):
    """Rows as the contract words it: one tree per lang, a tree of subroots, proofs and folds."""
    langs = {}
    for doc, text, lang, source, n in rows:
        hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        own = leaf(doc, source, lang, n, text)
        langs.setdefault(lang, []).append(((doc is not None, doc or 0), own, leaf(doc, source, lang, n + 1, text) if hit else own, doc))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels_of([r[1] for r in sorted(langs[k], key=lambda r: r[:2])]) for k in order}
    top = levels_of([trees[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, (_, own, used, doc) in enumerate(sorted(langs[k], key=lambda r: r[:2])):
            steps, node = path(trees[k], i) + path(top, at), used
            for s in steps:
                node = sha(node if s is None else s[0] + node if s[1] else node + s[0])
            out.append((doc, own, trees[k][-1][0], top[-1][0], sha("".join(s[0] for s in steps if s)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 13, 64, 100])
def test_positions_are_the_order_of_completion(n):
    leaves = [sha(str(i)).encode() for i in range(n)]
    log = merkle.build_run(leaves, merkle.height(n))
    levels = levels_of([x.decode() for x in leaves])
    assert len(log) == sum(map(len, levels)) and log[-1].decode() == levels[-1][0]
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            assert log[merkle.position(level, i, n)].decode() == node
    for i in range(n):
        assert merkle.fold(leaves[i], merkle.siblings(log, i, n, merkle.height(n))) == log[-1]


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_equals_brute_force(spark, bits):
    rows = [(i * 3, f"text {i} é😀" if i % 5 else None, ["en", "de", None, "ö"][i % 7 % 4], "s" if i % 3 else None, i if i % 11 else None) for i in range(43)]
    rows += [(3, "same id", "en", "s", 1), (3, "same id", "en", "s", 1), (None, "no id", "en", None, 5), (-4, "", "lone", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA).repartition(4)
    got = merkle.report(docs, bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows)
    assert 0 < got.filter("NOT verified").count() < 12


def test_log_is_gapless_and_ends_with_the_root(spark):
    docs = spark.createDataFrame([(i, "t", "en" if i < 37 else "de", "s", i, 1, "x", 1.0) for i in range(40)], SCHEMA)
    out = merkle.manifest(docs, 2)
    by = {}
    for r in out["log"].collect():
        by.setdefault(r.tree, []).append((r.position, r.node))
    for r in out["roots"].collect():
        nodes = sorted(by[r.lang])
        assert [p for p, _ in nodes] == list(range(len(nodes))) and nodes[-1][1] == r.subroot


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).count() == 0
