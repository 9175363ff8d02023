"""Personal data: base spans by pattern and check, and further spans by weak supervision.

Candidates are the base patterns' matches, whether they pass their check or not, and matches of wider patterns in what these leave: written-out and
encoded emails, version 6 and bracketed addresses, cards with other signs, phones without a plus. Four labelers vote on each, or
abstain: the check, a gazetteer (top-level domains, issuers, number plans, reserved networks), the words before it, and its edges. For
each kind, expectation-maximisation over the counts of vote patterns in the whole corpus estimates how reliable each labeler is and how
likely each pattern is personal data (Dawid and Skene, 1979). With these as soft labels, a logistic span classifier is trained on
votes and on the shape, which no labeler sees (many digits, several parts, different digits), and adds the candidates that it is sure of. Base spans stay whatever it says.

Everything over rows is DataFrame operations; the driver sees one count for each pattern, of which there are 4 * 2 * 27 * 8 at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import masked, none, told_spans

KINDS = ("email", "ip", "card", "phone")
#: Probability from which a span is added.
SURE = 0.9

# The base patterns. Loops are possessive and starts are bound to the beginning of a run, which changes no match that passes but keeps time and stack linear.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # those of fewer digits fail, and are too many in a text full of numbers to be told one by one
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match for any span of the kind to be possible.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Wider patterns, searched where the base pattern of their kind has no match.
_AT, _DOT = r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?"
_HEX = "[0-9A-Fa-f]{1,4}"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:(?:{_AT}|%40|&#64;)[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,8}}|\x20(?:at|AT)\x20[A-Za-z0-9-]{{1,63}}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{{1,63}}){{1,4}})",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|[0-9]{{1,3}}(?:\[\.\][0-9]{{1,3}}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9A-Za-z+().,/-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{2,4}){2,5}|\(?0[1-9][0-9]{1,4}\)?[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,5}){0,2})(?![0-9A-Za-z-])",
}
_WIDE_HINT = {
    "email": r"[\[({]\x20?(?:at|AT|@)\x20?[\])}]|%40|&#64;|\x20(?:dot|DOT)\x20",
    "ip": r"[0-9A-Fa-f]::?[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]|[0-9A-Fa-f]::[0-9A-Fa-f]|[0-9]\[\.\][0-9]",
    "card": r"[0-9]{4}[./_][0-9]{4}[./_]",
    "phone": r"[0-9]{3}[.-][0-9]{4}|(?<![0-9])0[0-9]{2,5}\)?[\x20./-][0-9]",
}

# Fixed values of the gazetteer and the context labeler.
_DOMAINS = "[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|app|dev|xyz|online|site|shop|blog|cloud|tech"  # two letters: a country's
_WORDS = {
    "email": "e-?mail|mail|contact|write|reach|reply|correo|courriel|kontakt",
    "ip": "ip|ipv6|host|server|address|client|login|from|adresse|direcci[oó]n",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|t[eé]l[eé]phone|tel[eé]fono",
}
_AGAINST = "version|release|order|invoice|serial|isbn|section|chapter|figure|build|sku|part|ref|doi|issn"


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits' check sum is right; false for none."""
    n = F.length(digits)

    def add(done: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return done + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def passes(kind: str, raw: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(raw, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(raw))
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), luhn(_digits(raw))).otherwise(False)


def _passes_wide(kind: str, raw: Column) -> Column:
    """The check of a wider pattern's match: that of the kind, but for how it is written."""
    if kind == "ip":
        return F.when(raw.contains("[.]"), passes(kind, F.replace(raw, F.lit("[.]"), F.lit(".")))).otherwise(True)
    return passes(kind, raw)


def _gazetteer(kind: str, raw: Column) -> Column:
    """1 or 0: a list knows what the span names."""
    if kind == "email":
        known = F.regexp_like(raw, F.lit(rf"(?i)(?:\.|dot|\])[\])}}\x20]*(?:{_DOMAINS})$"))
    elif kind == "ip":
        known = ~F.regexp_like(raw, F.lit(r"^0|\.0[0-9]|^127\.|^169\.254\.|^2(?:2[4-9]|[3-5][0-9])\.|^(?:::1?|[fF][eE]80:.*|2001:0?[dD][bB]8:.*)$|(?:^|\.)[0-9]{4,}|(?:^|\.)(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?:\.|$)"))
    elif kind == "card":
        known = F.regexp_like(_digits(raw), F.lit("^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|3(?:0[0-5]|[68][0-9])[0-9]{11})$"))
    else:
        known = F.regexp_like(_digits(raw), F.lit("^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|[2-9][0-9]{9,14}|0[1-9][0-9]{7,12}|00[1-9][0-9]{7,14})$"))
    return known.cast("int")


def _judged(found: Column, kind: str, base: bool) -> Column:
    """found with its kind's number, whether it is a base span, its check, the other votes (1, 0 or -1 to abstain) and its shape (0 to 7)."""

    def judge(s: Column) -> Column:
        before = F.lower(s["before"])
        edge = F.concat(F.right(s["before"], F.lit(1)), F.lit("|"), s["after"])
        near = F.when(F.regexp_like(before, F.lit(rf"\b(?:{_AGAINST})\b[^\n]{{0,12}}$")), 0).when(F.regexp_like(before, F.lit(rf"\b(?:{_WORDS[kind]})\b")), 1).otherwise(-1)
        digits = _digits(s["raw"])
        different = F.size(F.array_distinct(F.split(digits, ""))) >= 4
        parts = F.regexp_count(s["raw"], F.lit("[^A-Za-z0-9]+")) >= 2
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"), (passes if base else _passes_wide)(kind, s["raw"]).alias("check"),
            _gazetteer(kind, s["raw"]).alias("gazetteer"), near.alias("context"),
            F.when(F.regexp_like(edge, F.lit(r"[\p{L}\p{N}_]\||\|[\p{L}\p{N}_]")), 0).otherwise(1).alias("edges"),
            ((F.length(digits) >= 10).cast("int") * 4 + parts.cast("int") * 2 + different.cast("int")).alias("shape"),
        )

    marked = lambda s: F.struct(*[(s["base"] & s["check"] if c == "base" else s[c]).alias(c) for c in ("start", "end", "kind", "base", "check", "gazetteer", "context", "edges", "shape")])
    return F.transform(F.transform(found, judge), marked)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: every candidate of each row of docs (doc_id, text), judged."""
    raws = docs.select("doc_id", F.coalesce(docs.text.cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        raws = raws.withColumn(f"b_{kind}", F.when(F.regexp_like("text", F.lit(_HINT[kind])), told_spans(F.col("text"), BASE[kind])).otherwise(none()))
    for kind in WIDE:
        rest = F.when(F.size(f"b_{kind}") > 0, masked(F.col("text"), BASE[kind])).otherwise(F.col("text"))
        raws = raws.withColumn(f"w_{kind}", F.when(F.regexp_like("text", F.lit(_WIDE_HINT[kind])), told_spans(rest, WIDE[kind])).otherwise(none()))
    judged = [_judged(F.col(f"b_{k}"), k, True) for k in KINDS] + [_judged(F.col(f"w_{k}"), k, False) for k in WIDE]
    return raws.select("doc_id", F.concat(*judged).alias("spans"))


Pattern = tuple[int, int, int, int, int]  # check, gazetteer, context, edges; shape


def estimate(counts: dict[Pattern, int], rounds: int = 50) -> dict[Pattern, float]:
    """The probability of each vote pattern being personal data, by EM over two classes; check, gazetteer, context and edges vote, -1 abstains.

    Starts from the votes' majority. Each labeler's rates are smoothed by one vote a cell, so that none is ever thought infallible.
    """
    if not counts:
        return {}
    votes = {p: [(j, v) for j, v in enumerate(p[:4]) if v >= 0] for p in counts}
    soft = {p: sum(v for _, v in votes[p]) / max(1, len(votes[p])) for p in counts}
    for _ in range(rounds):
        yes = sum(n * soft[p] for p, n in counts.items())
        total = sum(counts.values())
        rate = {}
        for j in range(4):
            for c in (0, 1):
                weight = {v: sum(n * (soft[p] if c else 1 - soft[p]) for p, n in counts.items() if p[j] == v) for v in (0, 1)}
                for v in (0, 1):
                    rate[j, c, v] = (weight[v] + 1 + (v == c)) / (weight[0] + weight[1] + 3)  # a labeler is a little better than chance to begin with
        prior = (yes + 1) / (total + 2)
        for p in counts:
            log = math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in votes[p])
            soft[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return soft


def _features(p: Pattern) -> list[float]:
    return [1.0, *(float(p[j] == v) for j in range(4) for v in (0, 1)), *(float(p[4] == b) for b in range(8))]


def train(counts: dict[Pattern, int], soft: dict[Pattern, float], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier over _features(), by gradient descent on the patterns' soft labels."""
    rows = [(_features(p), n, soft[p]) for p, n in sorted(counts.items())]
    total = sum(n for _, n, _ in rows)
    w = [0.0] * 17
    for _ in range(steps if rows else 0):
        slope = [ridge * x for x in w]
        for x, n, y in rows:
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(map(float.__mul__, w, x)))))) - y) * n / total
            slope = [s + error * v for s, v in zip(slope, x, strict=True)]
        w = [a - rate * b for a, b in zip(w, slope, strict=True)]
    return w


def _score(s: Column, weights: Iterable[list[float]]) -> Column:
    """The classifier's log odds for a candidate."""

    def of(w: list[float]) -> Column:
        total = F.lit(w[0]) + F.when(s["check"], w[2]).otherwise(w[1])
        for j, name in enumerate(("gazetteer", "context", "edges"), 1):
            total = total + F.when(s[name] == 1, w[2 + 2 * j]).when(s[name] == 0, w[1 + 2 * j]).otherwise(0.0)
        return total + F.element_at(F.array(*map(F.lit, w[9:])), s["shape"] + 1)

    by = list(weights)
    out = F.when(s["kind"] == 0, of(by[0]))
    for k, w in enumerate(by[1:], 1):
        out = out.when(s["kind"] == k, of(w))
    return out


def _listed(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added: a row for each row of docs (doc_id, text).

    The counts are of base spans. Null and empty texts have none. Rows that repeat are searched each; no documents give no rows; other columns of docs are
    not read. Spans are in code points.
    """
    found = cut(candidates(docs))
    keys = ("kind", "check", "gazetteer", "context", "edges", "shape")
    rows = found.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n")).collect()
    weights = []
    for k in range(len(KINDS)):
        counts = {(int(r["check"]), r["gazetteer"], r["context"], r["edges"], r["shape"]): r["n"] for r in rows if r["kind"] == k}
        weights.append(train(counts, estimate(counts)))
    base = F.filter("spans", lambda s: s["base"])
    sure = F.filter("spans", lambda s: s["base"] | (_score(s, weights) >= math.log(SURE / (1 - SURE))))
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(sure).alias("spans"), (F.size(sure) - F.size(base)).cast("long").alias("n_added"))
