"""Nearest neighbours, repeated strings, piece segmentations and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
from conftest_llm import SF

import corpus_pipeline
from spectraloom.llm import ann, pieces, quality_model, repeats


def exact(rows, k=10, every=100):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            out[i] = sorted((float(s), int(j)) for s, j in zip(d, ids) if j != i)[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def recall(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / max(len(w), 1) for q, w in want.items()])


def test_nearest_on_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in t.collect()])
    got = found(ann.search(ann.build(t, shard=2000), ann.vectors(t).filter("vec_id % 100 = 0")))
    assert recall(got, want) >= 0.95
    for q, w in want.items():
        assert [s for s, _ in got[q]] == sorted(s for s, _ in got[q]) and len(got[q]) == len(w)
        best = dict((i, s) for s, i in w)
        assert all(math.isclose(best[i], s, rel_tol=1e-9, abs_tol=1e-12) for s, i in got[q] if i in best)


def test_nearest_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(0, 400)]
    copies = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400, 700)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 4), (1300, [float("nan")] * 4), (1400, [None, 1.0, 1.0, 1.0]), (1500, [float("inf")] * 4), (None, [1.0] * 4), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + copies + odd], "vec_id long, embedding array<double>, shard int")
    want, got = exact(rows + copies), found(ann.nearest(df))
    assert set(got) == set(want) and recall(got, want) > 0.97
    assert [i for _, i in got[500]][:10] == [i for i in range(400, 411) if i != 500][:10]
    few = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (200, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert {q: [i for _, i in v] for q, v in found(ann.nearest(few)).items()} == {0: [100], 100: [0]}
    assert ann.nearest(df.limit(0)).count() == 0


def covered(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            x = raw[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[d] = (len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def check_repeats(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}
    want = covered(texts)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {} and len(got) == len(want)


def test_repeats_on_table(spark, texts):
    check_repeats(spark, texts)


def test_repeats_planted(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [word(n) for n in (99, 100, 101, 150, 400)]
    texts = {i: word(rng.randrange(200)) + rng.choice(shared)[rng.randrange(5) :] + word(rng.randrange(300)) + rng.choice(shared) for i in range(80)}
    for i in range(80, 140):  # near copies: single changes
        t = list(texts[i % 20])
        t[rng.randrange(len(t))] = "#"
        texts[i] = "".join(t)
    texts |= {200: "a" * 1000, 201: "ab" * 400, 202: "a" * 99, 203: None, 204: "", 205: "abcde" * 300 + "x" + "abcde" * 100, 206: texts[3], 207: "a" * 1000}
    check_repeats(spark, texts)
    same = spark.createDataFrame([(1, "q" * 30 + word(200))] * 2, "doc_id long, text string").union(spark.createDataFrame([], "doc_id long, text string"))
    assert repeats.remove_repeats(same).count() == 2
    assert repeats.remove_repeats(same.limit(0)).count() == 0


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_n_best_segments_by_enumeration():
    p = pieces.load(model())
    for text in ("▁the", "▁▁▁a", "▁naïve", "▁日本x", "▁the the", "▁\n\n"):

        @cache
        def ways(at):
            if at == len(text):
                return [(0.0, ())]
            out = []
            for to in range(at + 1, len(text) + 1):
                i = p.id_of.get(text[at:to])
                if i is not None or to == at + 1:
                    cost, k = (float(p.score[i]), i) if i is not None else (p.unknown, -1 - ord(text[at]))
                    out += [(cost + s, (k, *rest)) for s, rest in ways(to)]
            return out

        want = sorted((-s for s, _ in ways(0)))[:6]
        got = pieces.n_best(text, p, 6)
        assert [-s for s, _ in got] == want and len({tuple(i) for _, i in got}) == len(got)


def test_segmentations(spark, docs, texts):
    import sentencepiece

    p, sp = pieces.load(model()), sentencepiece.SentencePieceProcessor(model_file=model())
    got = {r.doc_id: r for r in pieces.segmentations(docs).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        t = texts[d] or ""
        assert r.decoded_equal and pieces.decode(r.ids, p) == t and r.n_pieces == len(r.ids)
        assert sp.decode(list(r.ids)) == t and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert list(r.scores) == sorted(r.scores, reverse=True) and len(r.changes) == len(r.scores) - 1
    for d in (900004, 900005, 900009, 900002):
        t = ("▁" + texts[d].replace(" ", "▁")) if texts[d] else ""
        want = [s for s, _ in pieces.n_best(t, p, 4)] if t else [0.0]
        assert np.allclose(got[d].scores, want), d


def test_pipeline_stages(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs, names = base, base.columns
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == names
            new = {r.doc_id: r for r in docs.collect()}
            assert set(new) <= set(now) and len(new) == docs.count() > 0
            if name == "quality_classifier":
                labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
                scored = {r.doc_id: r.predicted for r in quality_model.score(base, quality_model.train(base, labels)).select("doc_id", "predicted").collect()}
                assert set(new) == {d for d, y in scored.items() if y}
            if name == "line_dedup":
                lines = [x for r in new.values() for x in r.text.split("\n") if x.strip()]
                assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in new.values() if r.text != now[r.doc_id])
            if name == "pii":
                assert not any("@" in r.text and ".com" in r.text.partition("@")[2][:20] for r in new.values())
            now = {d: r.text for d, r in new.items()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(now)
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_substrings_that_are_no_piece_are_mostly_not_searched(monkeypatch):
    import public_tokenizers

    from spectraloom.llm import pieces

    p = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    other = pieces.mix(np.arange(100_000, dtype=np.uint64))
    other = other[~np.isin(other, p.key)]
    asked, search = [], np.searchsorted
    monkeypatch.setattr(pieces.np, "searchsorted", lambda a, v, *rest: asked.append(len(v)) or search(a, v, *rest))
    assert p.lookup(p.key).tolist() == p.key_id.tolist() and (p.lookup(other) == -1).all()
    assert asked[0] == len(p.key) and asked[1] < len(other) / 10
