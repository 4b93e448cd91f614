"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

Two different lines are linked if their edit distance is at most ``threshold``. A line cut into threshold + 1 even
segments keeps one of them whole in any line it is linked with, so every line is indexed by (its length, segment
number, segment) and probes, for its own and each shorter length, the few substrings that can match that
segment given the edits left on either side. Where a single edit is allowed, the rest of the line is halved as well: one half
of it must agree too, so it joins the key, and lines that only share a frequent passage do not meet. Pairs found are verified by a banded bit-parallel edit distance.

A line goes if an equal line, or a line linked with it, starts earlier (smaller doc_id, or same document and
earlier line); lines are judged on the input. Lines without a word always stay, and lines shorter than
threshold + 1 characters have no segments and are compared for equality alone.

``threshold=None`` lets the threshold grow: a pair may differ by one edit for every ``STEP`` characters of its shorter line,
and by one at least. Pairs within one edit are found as above. For the others each line gives samples, substrings of
``GRAM`` characters taken in one order for all lines: first the central ones, whose middle three characters have a smaller hash
than those around them (so two of them never lie close together), by a hash, then the others by that hash. A line goes down the
order, level by level, until its samples hold more substrings that share no character than it may have edits. One edit
spoils one of these at most. Of two linked lines, the one that stops earlier so keeps one of them whole in the other, where
it is a sample as well. Only pairs with such a common sample, with lengths and places in their lines no further apart than the
edits, go on. From ``TWICE`` characters on a line gives one more and a pair must have two in common, so lines that meet by
chance are not compared. No linked pair is lost, for lines of any length.

Plan: lines become 128-bit hashes with their keys where they are read; equal lines meet in a hash aggregate
of numbers (combined before the shuffle, so a line standing in every document is one row per task); keys
meet in a join of numbers. Texts are read again only for candidates. A document's own list of dropped line numbers
meets its text by doc_id. No Python runs on the executors.

Defined cases: null text is empty and has one blank line; rows without doc_id go from ``links`` and stay as
they are in ``dedup``; of repeated doc_ids each row is treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.rules import let
from spectraloom.llm.tables import BROADCAST_KEYS, SPACES, documents, only_keys
from spectraloom.plans.scale import cut, freed

THRESHOLD, STEP, BLOCK = 1, 20, 4096
#: Length of samples, how far their middle is compared, shares of a line's substrings that the levels take (up to 1: of the
#: central ones, then of the others as well), how many levels take central ones alone, and the length below which those are never enough.
GRAM, REACH, LEVELS, CENTRAL, SHORT = 13, 3, [0.55, 0.62, 0.69, 0.77, 0.87, 1.0, 1.15, 1.99], 6, 60
#: Bits of a sample's key, classes of length for a factor of e, the length up to which samples that lie apart are marked, and the
#: length from which linked lines have two samples in common.
KEY_BITS, CLASSES, MARKED, TWICE = 38, 100, 20_000, 160


def segments(length: int | Column, threshold: int) -> list[tuple[Column, Column]]:
    """Start and size of the even segments of a line; later ones take the rest."""
    parts = threshold + 1
    small, longer = F.floor(length / parts), length % parts
    out, start = [], F.lit(0)
    for i in range(parts):
        size = small + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of every substring to look up; the first ones are the index keys."""
    own = [(0, i, 0) for i in range(threshold + 1)]
    rest = [
        (d, i, shift)
        for d in range(threshold + 1) for i in range(threshold + 1)
        for shift in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1)
        if (d, i, shift) not in own
    ]
    return own + rest


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings if at most ``threshold``, else threshold + 1.

    What both strings begin and end with is taken off first, found by halving. The band round the diagonal is one word of 2 * threshold + 1 bits per column; bit d stands for row
    column + d - threshold. Vertical steps of +1 and -1 are two bit sets, moved one row down from column to column.
    The distance along the target diagonal never falls, so a scan that has passed the threshold computes no further.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1

    def scan(long: Column, short: Column) -> Column:
        n, m = F.size(long), F.size(short)
        gap = n - m

        def step(s: Column, j: Column) -> Column:
            c = F.get(short, j)
            same = F.lit(0)
            for d in range(width):
                i = j + (d - threshold)
                same = same + F.when((i >= 0) & (F.get(long, i) == c), F.lit(1 << d)).otherwise(0)

            def columns(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))

                def after(z: Column) -> Column:
                    hp = vn.bitwiseOR(F.lit(mask).bitwiseXOR(z.bitwiseOR(vp)))
                    hn = z.bitwiseAND(vp)
                    down = F.shiftright(z, 1)
                    moved = hn.bitwiseOR(F.lit(mask).bitwiseXOR(down.bitwiseOR(hp)))
                    apart = 1 - F.floor(z / F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), gap + threshold + 1)).cast("int") % 2
                    return F.struct(moved.bitwiseAND(F.lit(mask)).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["far"] + apart).alias("far"))

                return let(d0, after)

            return F.when(s["far"] > threshold, s).otherwise(let(same, columns))

        start = F.struct(F.lit(mask & ~((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), gap.alias("far"))
        walked = F.when(m == 0, gap).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), start, step, lambda s: s["far"]))
        return F.when(gap > threshold, F.lit(threshold + 1)).otherwise(F.least(walked, F.lit(threshold + 1)))

    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")

    def parts(x: Column, y: Column) -> Column:
        swap = F.length(x) >= F.length(y)
        return let(F.struct(chars(F.when(swap, x).otherwise(y)).alias("l"), chars(F.when(swap, y).otherwise(x)).alias("s")), lambda p: scan(p["l"], p["s"]))

    def tails(n: Column) -> Column:
        return let(F.struct(F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b")), lambda p: let(_shared(p["a"], p["b"], False), lambda k: parts(
            F.substring(p["a"], F.lit(1), F.length(p["a"]) - k), F.substring(p["b"], F.lit(1), F.length(p["b"]) - k)
        )))

    return let(_shared(a, b, True), tails)


def _shared(a: Column, b: Column, front: bool) -> Column:
    """Length of the longest common prefix (or suffix) of two strings."""
    piece = (lambda x, n: F.substring(x, F.lit(1), n)) if front else (lambda x, n: F.right(x, n))
    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        halfway = lambda m: F.when(piece(a, m) == piece(b, m), F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi")))
        return F.when(s["lo"] >= s["hi"], s).otherwise(let(((s["lo"] + s["hi"] + 1) / 2).cast("int"), halfway))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.least(F.length(a), F.length(b)) + 1.0)).cast("int"))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def _tagged(parts: Column) -> Column:
    """Hashes of the lines of a text with their numbers, sorted, so equal lines stand together in order."""
    return F.array_sort(F.transform(parts, lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("g"), i.alias("i"), x.rlike(f"[^{SPACES}]").alias("w"))))


def _equal_before(s: Column, x: Column, i: Column) -> Column:
    p = F.get(s, i - 1)
    return F.coalesce((p["h"] == x["h"]) & (p["g"] == x["g"]), F.lit(False))


def _repeats(text: Column) -> Column:
    """Numbers of lines with a word that equal an earlier line of the same text."""
    return let(_tagged(F.split(text, "\n")), lambda s: F.transform(F.filter(s, lambda x, i: x["w"] & _equal_before(s, x, i)), lambda x: x["i"]))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, h, g, line): the first of equal lines with a word in each document."""

    def firsts(parts: Column) -> Column:
        own = let(_tagged(parts), lambda s: F.filter(s, lambda x, i: x["w"] & ~_equal_before(s, x, i)))
        return F.transform(own, lambda x: F.struct(x["i"].alias("line_no"), x["h"].alias("h"), x["g"].alias("g"), F.get(parts, x["i"]).alias("line")))

    rows = documents(docs).select("doc_id", F.explode(let(F.split("text", "\n"), firsts)).alias("x"))
    return rows.select("doc_id", "x.line_no", "x.h", "x.g", "x.line")


def _rest(n: Column, d: int, i: int, size: Column, at: Column) -> list[Column]:
    """With one edit allowed: the first and last half of what is left beside a segment, as long as in the indexed line."""
    indexed, begin = n - d - size, (at + size if i == 0 else F.lit(0))
    left = F.substring(F.col("line"), (begin + 1).cast("int"), (n - size).cast("int"))
    half = F.floor(indexed / 2).cast("int")
    return [F.substring(left, F.lit(1), half), F.right(left, (indexed - half).cast("int"))]


def keys_per_probe(threshold: int) -> int:
    return 2 if threshold == 1 else 1


def classes(docs: DataFrame, threshold: int) -> DataFrame:
    """One row per distinct line: h, g, first place (d, l), documents, length n, and its keys."""
    n = F.length("line")
    keys = []
    for d, i, shift in probes(threshold):
        start, size = segments(n - d, threshold)[i]
        at = start + shift
        fits = (n - d > threshold) & (at >= 0) & (at + size <= n)
        segment = F.substring(F.col("line"), (at + 1).cast("int"), size.cast("int"))
        for part, rest in enumerate(_rest(n, d, i, size, at) if threshold == 1 else [F.lit("")]):
            keys.append(F.when(fits, F.xxhash64(n - d, F.lit(i), F.lit(part), segment, rest)))
    named = [k.alias(f"k{j}") for j, k in enumerate(keys)]
    rows = lines(docs).select("doc_id", "line_no", "h", "g", *named)
    return rows.groupBy("h", "g").agg(
        F.min("doc_id").alias("d"), F.min_by("line_no", "doc_id").alias("l"), F.count(F.lit(1)).alias("docs"),
        *[F.first(f"k{j}").alias(f"k{j}") for j in range(len(keys))],
    )


def links(docs: DataFrame, found: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(ad, al, bd, bl): pairs of distinct lines within the threshold, each named by its first place."""
    per = keys_per_probe(threshold)
    ask = [f"k{j}" for j in range(per * len(probes(threshold)))]
    rows = lambda names: found.select("d", "l", F.explode(F.array(*names)).alias("key")).filter("key IS NOT NULL")
    index, probe = rows(ask[: per * (threshold + 1)]).alias("a"), rows(ask).alias("b")
    pairs = index.join(probe, F.expr("a.key = b.key AND (a.d <> b.d OR a.l <> b.l)")).select(
        F.expr("least(struct(a.d, a.l), struct(b.d, b.l))").alias("x"), F.expr("greatest(struct(a.d, a.l), struct(b.d, b.l))").alias("y")
    )
    both = _texts(docs, _named(pairs))
    return both.filter(edit_distance(F.col("a"), F.col("b"), threshold) <= threshold).select("ad", "al", "bd", "bl")


def _named(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("x.d").alias("ad"), F.col("x.l").alias("al"), F.col("y.d").alias("bd"), F.col("y.l").alias("bl")).distinct())


def _texts(docs: DataFrame, pairs: DataFrame, every: bool = False) -> DataFrame:
    """The pairs with their lines a and b; of repeated doc_ids one text, or every one."""
    places = pairs.select(F.col("ad").alias("doc_id"), F.col("al").alias("line_no")).union(pairs.select("bd", "bl")).distinct()
    wanted = only_keys(documents(docs), places.select("doc_id").distinct(), "doc_id")
    text = wanted.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(places, ["doc_id", "line_no"])
    text = text.distinct() if every else text.dropDuplicates(["doc_id", "line_no"])
    return pairs.join(text.toDF("ad", "al", "a"), ["ad", "al"]).join(text.toDF("bd", "bl", "b"), ["bd", "bl"])


def _middles(a: Column, b: Column) -> Column:
    """(a, b) without what both begin and end with."""

    def tails(k: Column) -> Column:
        rest = F.struct(F.substring(a, k + 1, F.length(a)).alias("a"), F.substring(b, k + 1, F.length(b)).alias("b"))
        return let(rest, lambda q: let(_shared(q["a"], q["b"], False), lambda m: F.struct(*[F.substring(q[c], F.lit(1), F.length(q[c]) - m).alias(c) for c in "ab"])))

    return let(_shared(a, b, True), tails)


def grown(n: Column) -> Column:
    """Edits that a pair with a shorter line of n characters may differ by."""
    return F.greatest(F.floor(n / STEP).cast("int"), F.lit(1))


def _trigrams(line: Column, n: Column) -> Column:
    """Hashes of all runs of three characters, by their start."""

    def block(b: Column) -> Column:
        piece = F.substring(line, (b * BLOCK + 1).cast("int"), F.lit(BLOCK + 2))
        return F.transform(F.regexp_extract_all(piece, F.lit("(?s)(?=(...))."), F.lit(1)), lambda x: F.xxhash64(x))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 3) / BLOCK).cast("int")), block))


def _samples(line: Column, n: Column) -> Column:
    """A line's samples as numbers for ``_unpacked``: the substrings of the lowest ranks, so many that one more than its edits lie apart, or two more from TWICE characters on."""
    last, half, stop = len(LEVELS) - 1, GRAM // 2 - 1, n - GRAM
    wanted = grown(n) + F.when(n >= TWICE, 2).otherwise(1)
    bound = lambda level: F.element_at(F.array(*[F.lit(int(x * (1 << 30))) for x in LEVELS]), level + 1)

    def central(t: Column, i: Column) -> Column:
        at = lambda j: F.get(t, i + j)
        out = F.lit(True)
        for j in range(1, REACH + 1):
            out = out & (at(half) < at(half - j)) & (at(half) <= at(half + j))
        return out

    def rank(t: Column, i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.get(t, i), F.get(t, i + (GRAM - 3))), 34).cast("int")

    def ranked(t: Column, starts: Column, first: bool) -> Column:
        """(i, r) of substrings: r is below 2^30 for those whose central characters have the smallest hash, and below 2^31 for the others."""
        return F.transform(starts, lambda i: F.struct(i.alias("i"), (rank(t, i) if first else F.when(central(t, i), rank(t, i)).otherwise(rank(t, i) + (1 << 30))).alias("r")))

    def apart(some: Column, level: int) -> Column:
        """How many of a level's substrings lie apart, counted from the left."""
        place = (1 << 32) - 1
        step = lambda s, e: F.when((e["r"] < bound(F.lit(level))) & (e["i"] >= s.bitwiseAND(F.lit(place))), s - s.bitwiseAND(F.lit(place)) + (place + 1) + e["i"] + GRAM).otherwise(s)
        return F.shiftright(F.aggregate(some, F.lit(0).cast("long"), step), 32)

    def level(some: Column, levels: range) -> Column:
        return F.coalesce(*[F.when(apart(some, j) >= wanted, F.lit(j)) for j in levels])

    def chosen(t: Column, some: Column, found: Column) -> Column:
        at = lambda j: F.when(j == last, F.sequence(F.lit(0), stop)).otherwise(let(bound(j), lambda top: F.transform(F.filter(some, lambda e: e["r"] < top), lambda e: e["i"])))
        return let(found, lambda j: let(at(j), lambda at: let(marks(at), lambda m: packed(t, at, m, j))))

    def marks(at: Column) -> Column:
        step = lambda w: lambda s, i: F.when((i >= F.coalesce(F.get(s, F.size(s) - 1), F.lit(-GRAM)) + GRAM) & (F.size(s) < w), F.array_append(s, i)).otherwise(s)
        return F.when(n <= MARKED, let(wanted, lambda w: F.aggregate(at, F.array().cast("array<int>"), step(w))))

    def packed(t: Column, at: Column, marks: Column, found: Column) -> Column:
        size = F.floor(F.log(n / (2.0 * STEP)) * CLASSES).cast("long")
        return let(size * (1 << 15) + found * 4, lambda head: rows(t, at, marks, head))

    def rows(t: Column, at: Column, marks: Column, head: Column) -> Column:
        x = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(t, i + j) for j in [*range(0, GRAM - 3, 3), GRAM - 3]]), 64 - KEY_BITS)
        tail = lambda i, many: head + F.floor(i * 1024.0 / n) * 32 + F.when(many, 3).when(F.coalesce(F.array_contains(marks, i), F.lit(True)), 1).otherwise(0)
        step = lambda key, i, many: F.shiftleft(key, 64 - KEY_BITS).bitwiseOR(tail(i, many))

        def firsts(s: Column) -> Column:
            hit = lambda j, e: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
            return F.filter(F.transform(s, lambda e, j: F.when(~hit(j - 1, e), step(e["x"], e["i"], hit(j + 1, e)))), lambda e: e.isNotNull())

        pairs = F.transform(at, lambda i: F.struct(x(i).alias("x"), i.alias("i")))
        once = lambda s: F.size(F.array_distinct(F.transform(s, lambda e: e["x"]))) == F.size(s)
        return let(pairs, lambda s: F.when(once(s), F.transform(s, lambda e: step(e["x"], e["i"], F.lit(False)))).otherwise(let(F.array_sort(s), firsts)))

    def from_all(t: Column) -> Column:
        under = int((LEVELS[last - 1] - 1) * (1 << 30))
        some = ranked(t, F.filter(F.sequence(F.lit(0), stop), lambda i: (rank(t, i) < under) | central(t, i)), False)
        return let(some, lambda s: chosen(t, s, F.coalesce(level(s, range(CENTRAL, last)), F.lit(last))))

    def from_central(t: Column) -> Column:
        some = ranked(t, F.filter(F.sequence(F.lit(0), stop), lambda i: central(t, i)), True)
        return let(some, lambda s: let(level(s, range(CENTRAL)), lambda j: F.when(j.isNull(), from_all(t)).otherwise(chosen(t, s, j))))

    return let(_trigrams(line, n), lambda t: F.when(n < SHORT, from_all(t)).otherwise(from_central(t)))


def _unpacked(w: Column) -> dict[str, Column]:
    """Of a sample: key; class of length; smallest and largest length of its line; place in its line, of 1024 parts; level; many places; lies apart."""
    rest = F.shiftright(w, 5)
    size = F.shiftright(rest, 10).bitwiseAND(F.lit(2047))
    length = lambda s: 2.0 * STEP * F.exp(s / CLASSES)
    return {
        "key": F.shiftrightunsigned(w, 64 - KEY_BITS), "size": size, "least": length(size) - 0.01, "most": length(size + 1) + 0.01, "place": rest.bitwiseAND(F.lit(1023)),
        "level": F.shiftright(w, 2).bitwiseAND(F.lit(7)), "many": w.bitwiseAND(F.lit(2)) > 0, "apart": w.bitwiseAND(F.lit(1)) > 0,
    }


def _sampled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(l, w, d): samples of the lines long enough for two edits; lines standing in several documents give them at their first place alone."""
    rows = lines(docs).withColumn("n", F.length("line")).filter(F.col("n") >= 2 * STEP)
    often = found.filter("docs > 1").select("h", "g", "d", "l", "docs")
    # While these are few, all of them travel to the rows; else the most frequent, and other copies meet as equal lines.
    if often.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        often = often.orderBy(F.desc("docs"), "h", "g").limit(BROADCAST_KEYS)
    rows = rows.join(F.broadcast(often.drop("docs")), ["h", "g"], "left").filter("d IS NULL OR (doc_id = d AND line_no = l)")
    return rows.select(F.col("line_no").alias("l"), F.explode(_samples(F.col("line"), F.col("n"))).alias("w"), F.col("doc_id").alias("d"))


def _proposed(rows: DataFrame) -> DataFrame:
    """(ad, al, bd, bl), once: places of lines with a common sample, lengths and positions no further apart than their edits."""
    a, b = rows.alias("a"), rows.alias("b")
    p, q = _unpacked(F.col("a.w")), _unpacked(F.col("b.w"))
    edits = F.least(p["most"], q["most"]) / STEP
    lengths = F.abs(p["size"] - q["size"]) <= math.ceil(math.log(1 + 1 / STEP) * CLASSES)
    where = lambda s, more: (s["place"] + more) * s["most" if more else "least"] / 1024
    # Edits and the difference of the lengths move a place by a STEP-th of the line each.
    places = p["many"] | q["many"] | ((F.abs(p["place"] - q["place"]) <= 2 * 1024 // STEP + 2) & (where(p, 0) - where(q, 1) <= edits) & (where(q, 0) - where(p, 1) <= edits))
    # A line of the lower level has all its samples among the other's candidates, and one of those that lie apart is common.
    least = F.when(p["level"] < q["level"], p["apart"]).when(p["level"] > q["level"], q["apart"]).otherwise(p["apart"] | q["apart"])
    pairs = a.join(b, (p["key"] == q["key"]) & lengths & F.expr("a.d < b.d OR (a.d = b.d AND a.l < b.l)") & least & places)
    place = [F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "ab" for c in "dl"]
    pairs = pairs.select(*place, F.when(p["many"] | q["many"], 2).otherwise(1).alias("n"), F.when((p["least"] >= TWICE) & (q["least"] >= TWICE), 2).otherwise(1).alias("least"))
    return pairs.groupBy("ad", "al", "bd", "bl").agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter("n >= least").drop("n", "least")


def grown_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(ad, al, bd, bl): pairs of distinct lines within the threshold of their shorter line."""
    pairs = freed(_proposed(_sampled(docs, found)))
    near = _texts(docs, pairs, every=True).withColumn("t", grown(F.least(F.length("a"), F.length("b")))).withColumn("m", _middles(F.col("a"), F.col("b")))
    near = near.filter("a <> b AND levenshtein(m.a, m.b, t) >= 0")
    both = lambda c: F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit("second"), c).alias("g"))
    near = near.select(both("a").alias("a"), both("b").alias("b")).distinct()
    place = lambda side: found.select(F.struct("h", "g").alias(side), F.struct("d", "l").alias(f"p{side}"))
    near = near.join(place("a"), "a").join(place("b"), "b").select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"))
    near = near.select(F.col("x.d").alias("ad"), F.col("x.l").alias("al"), F.col("y.d").alias("bd"), F.col("y.l").alias("bl"))
    return near.union(links(docs, found, 1)).distinct()


def plan(docs: DataFrame, threshold: int | None = THRESHOLD) -> DataFrame:
    """One row per doc_id with lines to drop besides its own repeats: doc_id, drop, n_links, sources.

    ``drop``: line numbers; ``n_links``: links of its lines to different lines; ``sources``: the documents
    where the earliest such lines start.
    """
    found = cut(classes(docs, threshold)) if threshold else freed(classes(docs, 1))
    near = cut(links(docs, found, threshold)) if threshold else freed(grown_links(docs, found))
    sides = near.select(F.struct(F.col("ad").alias("d"), F.col("al").alias("l")).alias("me"), F.struct(F.col("bd").alias("d"), F.col("bl").alias("l")).alias("other"))
    sides = sides.union(near.select(F.struct(F.col("bd").alias("d"), F.col("bl").alias("l")), F.struct(F.col("ad").alias("d"), F.col("al").alias("l"))))
    linked = sides.groupBy(F.col("me.d").alias("d"), F.col("me.l").alias("l")).agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n_links"))
    known = found.select("h", "g", "d", "l", "docs").join(linked, ["d", "l"], "left").filter("docs > 1 OR n_links > 0").withColumn("earliest", F.least(F.struct("d", "l"), F.col("other")))
    rows = lines(docs).select("doc_id", "line_no", "h", "g").join(known.select("h", "g", "earliest", "n_links"), ["h", "g"])
    drop = F.struct(F.col("doc_id").alias("d"), F.col("line_no").alias("l")) > F.col("earliest")
    return rows.groupBy("doc_id").agg(
        F.collect_set(F.when(drop, F.col("line_no"))).alias("drop"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.array_sort(F.collect_set(F.when(drop, F.col("earliest.d")))).alias("sources"),
    )


def dedup(docs: DataFrame, threshold: int | None = THRESHOLD) -> DataFrame:
    """The rows and columns of ``docs`` with repeated and near-repeated lines taken out of text, and what was done.

    Added: _lines, _dropped, _links (numbers) and _sources. ``text`` is left untouched where nothing is dropped.
    """
    todo = plan(docs, threshold).withColumnsRenamed({"doc_id": "_doc", "drop": "_drop", "n_links": "_links", "sources": "_sources"})
    rows = docs.join(todo, docs["doc_id"].cast("long") == F.col("_doc"), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = F.array_union(F.coalesce("_drop", F.array().cast("array<int>")), _repeats(text))

    def kept(p: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), p["gone"])
        return F.struct(
            F.when(F.size(p["gone"]) == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(p["lines"], i)), "\n")).alias("text"),
            F.size(p["lines"]).cast("long").alias("n"), F.size(p["gone"]).cast("long").alias("gone"),
        )

    rows = rows.withColumn("_out", let(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")), kept))
    others = [F.col(f"_out.{c}").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*others, F.col("_out.n").alias("_lines"), F.col("_out.gone").alias("_dropped"), F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_sources", F.array().cast("array<bigint>")).alias("_sources"))


def report(docs: DataFrame, threshold: int | None = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, sources, kept_sha256."""
    out = dedup(documents(docs), threshold)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_removed"), F.col("_links").alias("n_links"), F.col("_sources").alias("sources"), F.sha2("text", 256).alias("kept_sha256"))


#: The same for a threshold of 1: lines of nearly one length that share a half are compared character by character.
SQL = """
WITH l AS (SELECT doc_id, i - 1 AS no, lines[i] AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
    FROM documents WHERE doc_id IS NOT NULL)),
f AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT line, length(line) AS n, min(struct_pack(d := doc_id, l := no)) AS place FROM f GROUP BY 1, 2),
v AS (SELECT line, n, place, n - gap AS m FROM c, (VALUES (0), (1)) g(gap) WHERE n - gap > 1),
h AS (SELECT *, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS half FROM v, (VALUES (0), (1)) s(side)),
q AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS an, b.n AS bn, a.place AS pa, b.place AS pb
    FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.n = a.m AND (a.n < b.n OR a.line < b.line)),
p AS (SELECT a, b, pa, pb FROM (SELECT *, len(list_filter(range(1, an + 1), lambda i: left(a, i) = left(b, i))) AS same FROM q)
    WHERE substring(b, same + 2) = substring(a, same + CASE WHEN an = bn THEN 2 ELSE 1 END)),
k AS (SELECT a AS line, pb AS other FROM p UNION ALL SELECT b, pa FROM p),
m AS (SELECT line, min(other) AS other, count(*) AS n_links FROM k GROUP BY 1),
e AS (SELECT f.doc_id, f.no, least(c.place, coalesce(m.other, c.place)) AS earliest, coalesce(m.n_links, 0) AS n_links,
    row_number() OVER (PARTITION BY f.doc_id, f.line ORDER BY f.no) AS nth FROM f JOIN c USING (line) LEFT JOIN m USING (line)),
g AS (SELECT *, struct_pack(d := doc_id, l := no) > earliest AS gone FROM e),
s AS (SELECT doc_id, sum(CASE WHEN nth = 1 THEN n_links END) AS n_links, list_sort(list(DISTINCT earliest.d) FILTER (gone AND nth = 1)) AS sources,
    count(*) FILTER (gone) AS n_removed FROM g GROUP BY 1),
t AS (SELECT l.doc_id, count(*) AS n_lines, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(g.gone, false)) AS text FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY 1)
SELECT t.doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(sources, CAST([] AS BIGINT[])) AS sources,
    sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)
"""
