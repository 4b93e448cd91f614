"""Quality rules, line first: lines that break a rule go, then documents that lost too much text go.

Everything is DataFrame expressions. Per line with a word (in characters of the line):

* punctuation: marks of ``#*$%&|<>{}[]\\^~_=+!?`` are more than a tenth, or capitals more than 0.6 of 20 or more letters;
* navigation: three or more of ``| > »`` with at most three words between them on average;
* boilerplate: the line holds one of a few fixed phrases.

A document is rejected if its failing lines hold more than 30 in 100 of its word characters, or if it fails the
base rules: fewer than 10 words, or more than 20 in 100 of its words lie in 5-word windows found twice or more.

Defined cases: null or blank text has no words and fails the base; rows without doc_id go; repeated rows give one
row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.tables import SPACES, documents

MARKS = "#*$%&|<>{}[]\\^~_=+!?"
SYMBOLS = "#*$%&|<>"
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "use of cookies", "accept cookies",
    "click here", "sign up", "subscribe now", "enable javascript", "lorem ipsum", "powered by", "back to top", "skip to content",
]
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def removed_chars(c: Column, chars: str) -> Column:
    """How many characters of a set a string holds."""
    return F.length(c) - F.length(F.regexp_replace(c, "[" + "".join("\\" + x for x in chars) + "]+", ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more in the array."""

    def covered(grams: Column) -> Column:
        tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        spots = let(tagged, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        gain = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        total = let(spots, lambda p: F.aggregate(gain(p), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(total)

    # A window's hash is taken over its words' hashes, by zipping the array with itself shifted.
    shifted = lambda h: F.arrays_zip(*[F.slice(h, j + 1, F.size(h) - (WINDOW - 1)) for j in range(WINDOW)])
    grams = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(shifted(h), lambda x: F.xxhash64(x)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(words, grams), covered))


def line_fails(line: Column) -> Column:
    """The three rules; counts that a rule reads more than once are bound first."""

    def capitals(letters: Column) -> Column:
        return (letters >= 20) & ((F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}+", ""))) * 10 > letters * 6)

    def navigation(bars: Column) -> Column:
        return (bars >= 3) & (F.size(words_of(line)) <= 3 * (bars + 1))

    def phrase(low: Column) -> Column:
        found = low.contains(PHRASES[0])
        for p in PHRASES[1:]:
            found = found | low.contains(p)
        return found

    punctuation = (removed_chars(line, MARKS) * 10 > F.length(line)) | let(F.length(F.regexp_replace(line, r"[^\p{L}]+", "")), capitals)
    barred = line.contains("|") | line.contains(">") | line.contains("»")
    return punctuation | (barred & let(removed_chars(line, "|>»"), navigation)) | let(F.lower(line), phrase)


def solid_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[{SPACES}]+", ""))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, text, the base counts, lost_chars, cleaned): cleaned is the text without failing lines."""
    rows = documents(docs).withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    filled = F.filter("lines", lambda x: x.rlike(f"[^{SPACES}]"))
    good = F.filter("lines", lambda x: ~line_fails(x) | ~x.rlike(f"[^{SPACES}]"))
    return (
        rows.select(
            "doc_id", "text", F.size("words").cast("long").alias("n_words"), solid_chars(F.col("text")).cast("long").alias("word_chars"),
            removed_chars(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
            let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
            F.array_join(good, "\n").alias("cleaned"),
        )
        .withColumn("lost_chars", F.col("word_chars") - solid_chars(F.col("cleaned")))
    )


def judge(docs: DataFrame) -> DataFrame:
    """``measure`` with base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= 30 * F.col("word_chars")))


_MARKS_SQL = MARKS.replace("'", "''")
_PHRASES_SQL = " OR ".join(f"contains(lower(x), '{p}')" for p in PHRASES)
_SOLID_SQL = "length(translate({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, i, words[i : i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS spot FROM r) GROUP BY 1),
l AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS filled FROM w),
k AS (SELECT *, list_filter(filled, lambda x: NOT (
    (length(x) - length(translate(x, '{_MARKS_SQL}', ''))) * 10 > length(x)
    OR (length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 20 AND length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) * 10 > length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) * 6)
    OR (length(x) - length(translate(x, '|>»', '')) >= 3
        AND len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) <= 3 * (1 + length(x) - length(translate(x, '|>»', ''))))
    OR {_PHRASES_SQL})) AS good FROM l),
m AS (SELECT k.doc_id, CAST(len(words) AS BIGINT) AS n_words, {_SOLID_SQL.format('text')} AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
    CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    {_SOLID_SQL.format('text')} - coalesce({_SOLID_SQL.format("array_to_string(good, '')")}, 0) AS lost_chars FROM k LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept FROM m
"""
