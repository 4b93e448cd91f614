"""Operators on documents against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from spectraloom.llm import line_dedup, near_dup, packing, pii, ppm, quality_model, queries, rules
from conftest_llm import LOW, SF, words


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def jaccard_components(texts):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    lists = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for d, s in sets.items():
        both = Counter(e for g in s for e in lists[g] if e < d)
        for e, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                label[b] = a
    return sets, {d: root(d) for d in sets}


def test_near_duplicates(docs, texts):
    got = rows(near_dup.near_duplicates(docs))
    sets, want = jaccard_components(texts)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}


def test_near_duplicates_of_a_large_group(spark):
    """Near copies that share a frequent passage with many unlike documents."""
    base = [f"w{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(40)]
    made = []
    for k in range(150):
        copy = list(base)
        copy[(k * 7) % 120] = f"edit{k}"
        made.append((k, " ".join(copy)))
        made.append((1000 + k, " ".join(passage + [f"own{k}_{j}" for j in range(30)])))
    got = rows(near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    _, want = jaccard_components(dict(made))
    assert {d: r.component_id for d, r in got.items()} == want


def test_near_duplicates_of_sets_kept_whole_and_larger_ones(spark):
    """Texts of at most 48 shingles and copies with up to 64, whose sketch lacks some of the common values."""
    made = []
    for k, (small, more) in enumerate([(48, 16)] * 30 + [(47, 15)] * 10 + [(46, 15), (45, 15), (43, 14), (37, 12)] * 3):
        text = [f"t{k}_{i}" for i in range(small + 4)]
        made += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + [f"m{k}_{i}" for i in range(more)]))]
    got = rows(near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    _, want = jaccard_components(dict(made))
    assert {d: r.component_id for d, r in got.items()} == want and sum(d != c for d, c in want.items()) == len(made) // 2


def test_near_duplicates_form_no_pairs_of_members_that_only_share_their_original(spark, monkeypatch):
    """Copies below the threshold with each other and with their original; some have copies of their own."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    made = [(0, " ".join(base))]
    for k in range(1, 61):
        copy = list(base)
        for j in rng.sample(range(80), 20):
            copy[5 * j] = f"edit{k}_{j}"
        made.append((k, " ".join(copy)))
        if k % 10 == 0:
            made.append((100 + k, " ".join(copy[3:])))
    formed, estimated = [], near_dup._estimated

    def counted(pairs, *args):
        formed.append(pairs.count())
        return estimated(pairs, *args)

    monkeypatch.setattr(near_dup, "_estimated", counted)
    got = rows(near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    _, want = jaccard_components(dict(made))
    assert {d: r.component_id for d, r in got.items()} == want and len(set(want.values())) == 61
    assert max(formed) <= len(made), formed  # all pairs: over 1800


def test_near_duplicate_pairs_of_different_components_are_all_formed(spark):
    """The last step by itself, on overlapping sets of many sizes, against all pairs."""
    rng = random.Random(8)
    made = []
    for k in range(220):
        n = rng.randrange(8, 60)
        at = rng.randrange(30)
        text = [f"w{i}" for i in range(at, at + n)]
        for _ in range(rng.randrange(3)):
            text[rng.randrange(n)] = f"own{k}"
        made.append((k, " ".join(text)))
    sets, _ = jaccard_components(dict(made))
    comp = {d: d - d % 2 for d in sets}
    placed = spark.createDataFrame([(d, c) for d, c in comp.items()], "doc_id long, comp long")
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = {tuple(sorted((r.a, r.b))) for r in near_dup._crossing(placed, docs).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(want) > 100 and want <= got and all(comp[a] != comp[b] for a, b in got)


def test_near_duplicate_candidates_carry_no_unused_estimate(spark):
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    reps = spark.createDataFrame([(1, 3, [1, 2, 3]), (2, 3, [1, 2, 3])], "doc_id long, n_shingles long, sketch array<long>")
    assert near_dup._estimated(pairs, reps).columns == ["a", "b", "na", "nb"]


def test_line_dedup_columns_and_rows(docs, texts):
    out = line_dedup.dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_line_links(spark, threshold):
    import random

    rng = random.Random(threshold)
    lines = []
    for _ in range(25):
        line = "".join(rng.choice("abcdé ") for _ in range(rng.randrange(8, 60))) + "x"
        for _ in range(5):
            other = list(line)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(other))
                kind = rng.randrange(3)
                if kind == 0:
                    other[at] = rng.choice("abcd")
                elif kind == 1:
                    del other[at]
                else:
                    other.insert(at, rng.choice("abcd"))
            lines.append("".join(other))
    lines = [x for x in dict.fromkeys(lines) if x.strip()] + ["ab", "a", "b"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if min(len(lines[i]), len(lines[j])) > threshold and distance(lines[i], lines[j]) <= threshold}
    got = {(r.ad, r.bd) for r in line_dedup.links(df, line_dedup.classes(df, threshold), threshold).collect()}
    assert got == want and len(want) > 20


def test_line_links_grow_with_the_line(spark):
    """Every pair with at most one edit per 20 characters, edits spread evenly or at random, against a full table of distances."""
    import random

    import corpus_pipeline

    rng = random.Random(11)
    lines = []
    for n in [30, 39, 40, 41, 59, 60, 79, 80, 99, 100, 124, 125, 160, 338, 380, 700]:
        line = [rng.choice("abcdefghijké ") for _ in range(n)]
        lines.append("".join(line))
        t = max(1, n // 20)
        for edits in (t, t, t + 1, max(1, t // 2)):
            even, other = rng.random() < 0.5, list(line)
            for e in range(edits):
                at = int((e + 1) * n / (edits + 1)) if even else rng.randrange(len(other))
                kind = 0 if even else rng.randrange(3)
                if kind == 0:
                    other[min(at, len(other) - 1)] = rng.choice("xyz")
                elif kind == 1:
                    del other[at]
                else:
                    other.insert(at, rng.choice("xyz"))
            lines.append("".join(other))
    lines = [x for x in dict.fromkeys(lines) if x.strip()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    allowed = lambda i, j: max(1, min(len(lines[i]), len(lines[j])) // 20)
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if abs(len(lines[i]) - len(lines[j])) <= allowed(i, j) and distance(lines[i], lines[j]) <= allowed(i, j)}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(r.ad, r.bd) for r in line_dedup.grown_links(df, line_dedup.classes(df, 1)).collect()}
    assert got == want and len(want) > 40
    docs = df.selectExpr("doc_id", "text", "CAST(length(text) AS INT) AS n_chars")
    kept = {r.doc_id for r in corpus_pipeline.lines(spark, docs, None).collect()}
    assert kept == set(range(len(lines))) - {j for _, j in want}


def test_samples_of_lines_are_few_and_lose_no_link(spark):
    """Spread, clustered and random edits, runs of one word, wide characters, repeated lines and ids, against every pair's distance."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinsrhldé🙂") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    lines = []
    for n in [40, 41, 45, 59, 60, 77, 99, 100, 150, 159, 160, 161, 199, 260, 399, 400, 401, 640, 1500]:
        line = " ".join(rng.choice(words) for _ in range(n))[:n]
        lines.append(line)
        t = n // 20
        for edits, spread in ((t, 0), (t, 0), (t, 1), (t, 2), (t + 1, 0), (t - 1, 0), (t // 2, 2)):
            other = list(line)
            for e in range(edits):
                at = [int((e + 0.5 + rng.random() / 3) * n / edits) if edits else 0, n // 3 + e, rng.randrange(n)][spread]
                at = min(at, len(other) - 1)
                other[at : at + 1] = rng.choice([["X"], [], [other[at], "Y"]])
            lines.append("".join(other))
    lines += ["ab " * 50, "ab " * 49 + "ac ", "ab " * 52, "z" * 90, "z" * 94, "z" * 96, "-" * 40, "-" * 42, "-" * 43]
    lines = list(dict.fromkeys(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    a, b = df.toDF("ad", "a"), df.toDF("bd", "b")
    size = "greatest(least(length(a), length(b)) div 20, 1)"
    want = {(r.ad, r.bd) for r in a.join(b, F.expr(f"ad < bd AND abs(length(a) - length(b)) <= {size}")).filter(f"levenshtein(a, b, CAST({size} AS INT)) >= 0").collect()}
    found = line_dedup.classes(df, 1)
    assert {(r.ad, r.bd) for r in line_dedup.grown_links(df, found).collect()} == want and len(want) > 100
    once = line_dedup._sampled(df, found).count()
    long = [(k, " ".join(rng.choice(words) for _ in range(1000))[:1000]) for k in range(200)]
    many = spark.createDataFrame(long, "doc_id long, text string")
    assert line_dedup._sampled(many, line_dedup.classes(many, 1)).count() < 0.15 * 200_000  # of 0.28 before, and more where classes of length met
    copies = df.union(df.selectExpr("doc_id + 1000", "text")).union(df.selectExpr("doc_id + 2000", "text"))
    assert line_dedup._sampled(copies, line_dedup.classes(copies, 1)).count() == once  # a line of many documents is sampled once
    same = df.selectExpr("doc_id div 2 AS doc_id", "text")  # two texts have one id
    pairs = {tuple(sorted((i // 2, j // 2))) for i, j in want if i // 2 != j // 2}
    assert pairs <= {tuple(sorted((r.ad, r.bd))) for r in line_dedup.grown_links(same, line_dedup.classes(same, 1)).collect()}


def test_packing(docs, texts, spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_folder() + "/byte_bpe_50k.json")
    want = {}
    for d, t in texts.items():
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(head, len(ids), 1024)]):
            piece = ids[s : s + (head if k == 0 else 1024)]
            want[d, k] = (s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    got = packing.sequences(docs, partition=100).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = np.bincount([x[1] for x in want.values()], minlength=1025)
    alone = packing.best_fit(np.array([x[1] for x in want.values()]), 1024).max() + 1
    assert packing.lower_bound(sizes) <= len(by) <= alone + 1


def test_best_fit_and_bounds():
    rng = np.random.default_rng(5)
    for capacity in (10, 64, 1024):
        sizes = rng.integers(1, capacity, 200)
        bins = packing.best_fit(sizes, capacity)
        assert np.bincount(bins, sizes).max() <= capacity
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1)) <= bins.max() + 1
    assert packing.lower_bound(np.bincount([6] * 5, minlength=11)) == 5
    assert packing.lower_bound(np.bincount([4] * 6, minlength=11)) == 3


def test_rules_base(docs, texts):
    for d, r in rows(rules.judge(docs)).items():
        t = texts[d] or ""
        w = words(t, lower=False)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        spots = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(spots) > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(spots), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, d
        assert not (r.kept and failed)


def spans_by_re(text):
    def luhn(s):
        n = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(n)) % 10 == 0

    digits = lambda s: sum(c in "0123456789" for c in s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= digits(s) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


PRIVATE = [
    (1, "Mail a.b@c.de_f@g.org, or x@y or é@z.com; ip 1.2.3.4.5 and 300.1.1.1 and 007.0.0.1 10.20.30.40"),
    (2, "Card 4539 1488 0343 6467, 4539148803436468, 4539-1488-0343-6467-1; call +1 (988) 555-2485 or +12 3 now"),
    (3, "Write to jane (at) example (dot) org or phone 988-555-2485. visa card 378282246310005 paid"),
    (4, "9" * 30000 + "@" + "a" * 30000), (5, None), (6, "+49 30 1234567 é +" + "1" * 40 + " server host fe80:0:0:0:1:2:3:4 ok"), (7, ""),
]


def test_pii_base(spark, docs, texts):
    df = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    for got, source in ((rows(pii.report(df)), dict(PRIVATE)), (rows(pii.report(docs)), texts)):
        assert set(got) == set(source)
        for d, r in got.items():
            want = spans_by_re(source[d])
            said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.KINDS], d
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), d
            assert set(said.split(",")) <= set(r.spans.split(",")) or not said
    masked = rows(pii.mask(df))
    assert "c.de" not in masked[1].text and "[EMAIL]" in masked[1].text and masked[5].text is None and masked[7].text == ""
    assert "é [" not in masked[1].text and masked[2].text.startswith("Card [CARD], 4539148803436468")


def test_pii_reliabilities():
    """Planted labelers: the estimate ranks them by how often they are right."""
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.4
    right = [0.95, 0.8, 0.7, 0.55]
    votes = np.stack([np.where(rng.random(20000) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    post, table = pii.reliabilities(pattern, n.astype(float))
    assert [np.argmax([table[1, j, 2] for j in range(4)])] == [0]
    assert np.allclose([table[1, j, 2] for j in range(4)], right, atol=0.06)


def test_ppm(docs, texts):
    got = rows(ppm.score_texts(docs, parts=3))
    assert set(got) == set(texts)
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    tokens = {d: words(t) + [None] for d, t in texts.items()}
    count = Counter(x for d in train for x in tokens[d])
    n, v = sum(count.values()), len(count)
    follow = [defaultdict(Counter) for _ in range(3)]
    for d in train:
        s = [256, 256, *(texts[d] or "").translate(LOW).encode(), 256]
        for i in range(2, len(s)):
            for k in range(3):
                follow[k][tuple(s[i - k : i])][s[i]] += 1

    def p(context, symbol, banned=frozenset()):
        left = {x: c for x, c in follow[len(context)][context].items() if x not in banned}
        total, kinds = sum(left.values()), len(left)
        escape = 1.0 if not total else 0.0 if kinds == 257 else kinds / (total + kinds)
        if symbol in left:
            return (1 - escape) * left[symbol] / total
        banned = banned | set(left)
        return escape * (p(context[1:], symbol, banned) if context else 1 / (257 - len(banned)))

    memo = {}
    for d in list(texts)[::9] + [900001, 900002, 900009, 900011]:
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens[d])
        s = [256, 256, *(texts[d] or "").translate(LOW).encode(), 256]
        code = 0.0
        for i in range(2, len(s)):
            key = (s[i - 2], s[i - 1], s[i])
            if key not in memo:
                memo[key] = math.log10(p(key[:2], key[2]))
            code += memo[key]
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(tokens[d]), sum(count[x] > 0 for x in tokens[d]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, code, rel_tol=1e-4), d


def test_ppm_query_knows_longer_contexts(spark):
    """The query's scores against contexts of up to five symbols, counted one by one."""
    got = rows(queries.op7_ppm_scores(spark, SF))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    coded = {d: [256] * 5 + list((t or "").translate(LOW).encode()) + [256] for d, t in texts.items()}
    follow = [defaultdict(Counter) for _ in range(6)]
    for d, s in coded.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for i in range(5, len(s)):
                for k in range(6):
                    follow[k][tuple(s[i - k : i])][s[i]] += 1

    def p(context, symbol, banned=frozenset()):
        left = {x: c for x, c in follow[len(context)][context].items() if x not in banned}
        total, kinds = sum(left.values()), len(left)
        escape = 1.0 if not total else 0.0 if kinds == 257 else kinds / (total + kinds)
        if symbol in left:
            return (1 - escape) * left[symbol] / total
        banned = banned | set(left)
        return escape * (p(context[1:], symbol, banned) if context else 1 / (257 - len(banned)))

    for d in list(texts)[::12]:
        s = coded[d]
        want = sum(math.log10(p(tuple(s[i - 5 : i]), s[i])) for i in range(5, len(s)))
        assert math.isclose(got[d].score, want, rel_tol=1e-6), d


def test_ppm_parts_get_back_words_of_other_parts_only(spark):
    """A word that stands in one part only is counted there; its lists may come in several rows."""
    end = int(ppm._END_TOKEN)
    listed = [(0, 11, 2), (0, 11, 3), (0, 12, 1), (1, 12, 4), (0, 13, 0), (1, 13, 2), (1, 14, 7), (0, end, 5), (1, end, 0)]
    listed = spark.createDataFrame(listed, "part int, word long, n long")
    total = listed.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")
    got = sorted((r.word, r.part, r.c) for r in ppm.shared_words(listed, total).collect())
    assert got == sorted([(12, 0, 5), (12, 1, 5), (13, 0, 2), (end, 0, 5), (end, 1, 5)])


def test_ppm_texts_travel_compressed(texts):
    """What the part's exchange carries is what comes back, and smaller."""
    plain = [t or "" for t in texts.values()]
    small = ppm.packed(pd.Series(plain))
    assert [t.decode() for t in ppm.unpacked(small)] == plain and sum(map(len, small)) < 0.6 * sum(len(t.encode()) for t in plain)


def test_ppm_base_scores_do_not_depend_on_parts(spark, docs):
    one, many = rows(ppm.score_texts(docs, parts=1)), rows(ppm.score_texts(docs, parts=40))
    assert all((many[d].n_known, many[d].train_tokens) == (r.n_known, r.train_tokens) and math.isclose(many[d].base_score, r.base_score, rel_tol=1e-9) for d, r in one.items())


def test_ppm_without_training_text(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2]
    r = ppm.score_texts(spark.createDataFrame([(d, "ab") for d in held], "doc_id long, text string")).first()
    assert r.train_tokens == 0 and math.isclose(r.score, -3 * math.log10(257), rel_tol=1e-5) and r.base_score == 0.0
    assert ppm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows(quality_model.classify(docs, labels))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d].score, q) for d, q in marks.items() if d in got and got[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.85, auc


def test_classifier_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, none).collect()
    assert len(got) == docs.count() - 1 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    odd = spark.createDataFrame([(900004, 1), (900004, None), (None, 1), (5, 0)], "doc_id long, quality int")
    assert quality_model.classify(docs, odd).count() == docs.count() - 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    for name in ("near_dup.near_duplicates", "line_dedup.report", "packing.sequences", "rules.judge", "pii.report"):
        module, fn = name.split(".")
        assert getattr(globals()[module], fn)(empty).count() == 0, name


def test_columns_named_like_those_of_the_work(spark):
    """Masking and the pipeline's stages keep columns whose names the operators use themselves, with their values."""
    import corpus_pipeline

    names = ["score", "predicted", "base", "spans", "loose", "_t", "_drop", "_doc", "_dropped", "_links", "_lines", "_sources", "_out", "a.b"]
    made = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40").select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    made = made.withColumn("text", F.concat("text", F.lit("\nwrite to jo@example.org")))
    want = {r.doc_id: tuple(r)[-len(names):] for r in made.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, made, SF)
        assert out.columns == made.columns, name
        got = out.collect()
        assert got and all(tuple(r)[-len(names):] == want[r.doc_id] for r in got), name
        assert name != "pii" or all("[EMAIL]" in r.text and "jo@" not in r.text for r in got)
