"""Personal data by weak supervision: labelers vote on candidate spans, votes are weighed, a classifier decides.

Base spans (e-mail address, IP address, card number, telephone number) are found by fixed patterns and checks and
always stay. Further candidates come from looser patterns: written-out addresses ("name (at) host (dot) org"),
full IPv6 addresses, 15-digit cards, national telephone numbers. On every candidate, base or not, four labelers
vote yes, no or nothing: form (the strict pattern holds), gazetteer (known number ranges and domain endings), context
(words before the span), checksum (Luhn, part ranges, number of digits).

Expectation-maximisation over the counts of vote patterns estimates the share of true spans and each labeler's
reliability, without labels; its posteriors then train a logistic span classifier over kind and votes. Patterns
are at most 4 x 3**4 whatever the corpus; only their counts reach the driver. A looser candidate is added if the
classifier gives it ``ADD`` or more and it overlaps no base span.

Everything that runs over rows is DataFrame expressions. Positions come from the lengths of the pieces between
matches. Defined cases: null text is empty and has no span; rows without doc_id go from ``find`` and stay in
``mask``; repeated rows give one row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.rules import let
from spectraloom.llm.tables import documents

KINDS = ["email", "ip", "card", "phone"]
ADD = 0.9
#: Possessive forms and the look-behind change no match of the plain patterns: a match can only begin where a run of its
#: first characters begins or where the match before ended. They keep long runs from being tried from every start.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9-])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
ENDINGS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example|test)$"
CONTEXT = {
    "email": "mail|contact|write to|reach", "ip": r"\bip\b|server|host|address|login",
    "card": "card|visa|pay|credit|billing", "phone": r"phone|\btel|call|mobile|fax",
}
AGAINST = r"order|invoice|isbn|\bsku\b|\bitem|\bref\b|version|serial|[=#]\s*$"


def luhn(digits: Column) -> Column:
    back = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    value = lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_IP)
    n = F.length(_digits(m))
    return n.between(16, 19) & luhn(_digits(m)) if kind == "card" else n.between(8, 15)


def _hint(text: Column, kind: str, loose: bool) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.lower(text).rlike(r"[(\[]at[)\]]") if loose else text.contains("@")
    if kind == "phone" and not loose:
        return text.contains("+")
    if kind == "ip":
        return text.contains(":") if loose else text.contains(".")
    return F.lit(True)


def _matches(text: Column, kind: str, loose: bool) -> Column:
    """array<struct<kind, s, e, m, before>> of non-overlapping matches, leftmost first, in code points."""
    pattern = (LOOSE if loose else BASE)[kind]
    item = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("m"), F.lit("").alias("before"))
    none = F.filter(F.array(item), lambda x: F.lit(False))
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def placed(p: Column) -> Column:
        both = F.arrays_zip(p["m"].alias("m"), F.slice(p["gap"], 1, F.size(p["m"])).alias("g"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(state: Column, x: Column) -> Column:
            s = state["at"] + F.length(x["g"])
            e = s + F.length(x["m"])
            one = F.struct(F.lit(KINDS.index(kind)).alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(40)).alias("before"))
            return F.struct(e.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(both, start, step, lambda state: state["out"])

    found = let(parts, lambda p: F.when(F.size(p["m"]) == 0, none).otherwise(placed(p)))
    return F.when(_hint(text, kind, loose), found).otherwise(none)


def _votes(x: Column, base: bool) -> dict[str, Column]:
    """The labelers' votes on one candidate: 1 yes, -1 no, 0 nothing."""
    m, kind = x["m"], x["kind"]
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    by_kind = lambda *v: F.when(kind == 0, v[0]).when(kind == 1, v[1]).when(kind == 2, v[2]).otherwise(v[3])
    n = F.length(_digits(m))
    before = F.lower(x["before"])
    context = by_kind(*[before.rlike(CONTEXT[k]) for k in KINDS])
    return {
        "form": F.lit(1 if base else 0),
        "gazetteer": by_kind(
            yes_no(m.rlike(ENDINGS)), yes_no(~m.rlike(r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.")),
            yes_no(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), F.when(m.rlike(r"^(?:\+|00|\()"), 1).otherwise(0),
        ),
        "context": F.when(before.rlike(AGAINST), -1).when(context, 1).otherwise(0),
        "checksum": by_kind(yes_no(m.rlike(r"^[^@ (\[]{2}")), yes_no(m.rlike(_IP) | m.contains(":")), yes_no(luhn(_digits(m))), yes_no(n.between(10, 15))),
    }


LABELERS = ["form", "gazetteer", "context", "checksum"]


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, base spans (passing their checks) and looser candidates, as arrays, from whole texts."""
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    for loose in (False, True):
        for k in KINDS:
            rows = rows.withColumn(f"_{k}{int(loose)}", _matches(F.col("_t"), k, loose))
    passing = lambda k: F.filter(f"_{k}0", lambda x: _valid(k, x["m"]))
    base = F.concat(*map(passing, KINDS))
    rows = rows.withColumn("base", base)
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return rows.withColumn("loose", F.filter(F.concat(*[F.col(f"_{k}1") for k in KINDS]), apart)).select(*keep, "base", "loose")


def vote_patterns(found: DataFrame) -> pd.DataFrame:
    """Counts per kind and vote pattern; at most 4 x 3**4 rows."""
    rows = None
    for name in ("base", "loose"):
        x = found.select(F.explode(name).alias("x"))
        part = x.select(F.col("x.kind").alias("kind"), *[v.alias(k) for k, v in _votes(F.col("x"), name == "base").items()])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["kind", *LABELERS])


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern being true, and P(vote | truth) as [truth, labeler, vote + 1].

    Votes are independent given the truth; starts from the majority; counts are smoothed by one pseudo-vote.
    """
    p = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.1, 0.9)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    table = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for y, w in enumerate(((1 - p) * n, p * n)):
            c = np.einsum("i,ijk->jk", w, one_hot) + [[0.5 if y == 0 else 0.1, 0.2, 0.5 if y else 0.1]]
            table[y] = c / c.sum(1, keepdims=True)
        share = ((p * n).sum() + 1) / (n.sum() + 2)
        log = np.einsum("ijk,yjk->yi", one_hot, np.log(table)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, table


def train(patterns: pd.DataFrame, rounds: int = 400) -> np.ndarray:
    """Weights of the span classifier: bias, four kinds, and a yes and a no weight per labeler."""
    if not len(patterns):
        return np.zeros(5 + 2 * len(LABELERS))
    votes, n = patterns[LABELERS].to_numpy(int), patterns["n"].to_numpy(float)
    y, _ = reliabilities(votes, n)
    x = np.concatenate([np.ones((len(n), 1)), np.eye(4)[patterns["kind"].to_numpy(int)], votes == 1, votes == -1], 1)
    w, size = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (size * (p - y)) + 1e-3 * w
        hess = (x * (size * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _accepts(w: np.ndarray, x: Column) -> Column:
    votes = _votes(x, False)
    z = F.lit(float(w[0])) + F.element_at(F.array(*[F.lit(float(v)) for v in w[1:5]]), x["kind"] + 1)
    for j, name in enumerate(LABELERS):
        z = z + F.when(votes[name] == 1, float(w[5 + j])).when(votes[name] == -1, float(w[5 + len(LABELERS) + j])).otherwise(0.0)
    return z >= float(np.log(ADD / (1 - ADD)))


def _spans(found: DataFrame, w: np.ndarray, *keep: str) -> DataFrame:
    added = F.filter("loose", lambda x: _accepts(w, x))
    thin = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select(*keep, thin(F.col("base")).alias("base"), F.array_sort(F.concat(thin(F.col("base")), thin(added))).alias("spans"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind number, start, end), sorted."""
    found = candidates(documents(docs), "doc_id")
    return _spans(found, train(vote_patterns(found)), "doc_id")


def mask(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    keep = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]  # no column clashes with one of the work
    found = candidates(docs.toDF(*keep), *keep)
    rows = _spans(found, train(vote_patterns(found.select("base", "loose"))), *keep)
    text, names = F.coalesce(F.col("text"), F.lit("")), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def redact(order: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            more = F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.element_at(names, x["kind"] + 1))
            return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.when(x["s"] >= state["at"], more).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(order, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))

    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    new = F.when(F.size("spans") == 0, F.col("text")).otherwise(redact(by_start))
    return rows.select(*[(new if own == "text" else F.col(own)).alias(c) for own, c in zip(keep, docs.columns)])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind of base span, base_sha256, spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return find(docs).select("doc_id", *map(of_kind, range(len(KINDS))), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
