"""Quality rules whose cutoffs hold the share of good documents that they reject below a stated risk.

Five metrics of a text are counted in one pass. Two fixed rules reject a document outright. Each further
rule compares one ratio with a cutoff of a fixed grid. Labelled documents are dealt into two halves by a hash of their id. On the first,
each stratum's cutoffs are chosen: of each rule that which rejects the most bad documents that the rules before it don't, each good one set
against `worth` of them. The second half, which had no say in the choice, certifies: a rule's cutoffs are tested from the most lenient to the chosen one, in
that order and so without a correction inside the rule, and the strictest that passes holds. A test is exact: the binomial probability of so few rejected good
documents if the share were as high as the rule's part of the risk. Over rules and strata the error is split as Holm has it: what
a family that passed whole needs no more goes to the others. A stratum with too few labels gets no cutoff and keeps all that the fixed rules keep.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, cut

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Up to so many labels (8 bytes each) are broadcast, so that labelled documents alone are measured for the choice; with more, all are.
BROADCAST_ROWS = 400_000
#: Texts of more bytes have their words counted as numbers instead of objects.
LONG_TEXT = 1 << 20
SYMBOLS = b"#*$%&|<>"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def measure(text: str | None) -> tuple[int, ...]:
    """The METRICS of one text. None counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    long = len(raw) > LONG_TEXT
    spaces = len(raw) - len(raw.translate(None, SPACE.encode()))
    seen: set[bytes] = set()
    repeated_lines = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                repeated_lines += 1
            else:
                seen.add(line)
    return (
        sum(1 for _ in _WORD.finditer(raw)) if long else len(raw.split()),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        repeated_lines,
        repeat_words_of_long(raw) if long else repeat_words(raw.split()),
        lines,
    )


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = end = 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def repeat_words_of_long(raw: bytes) -> int:
    """As repeat_words(raw.split()), with some 60 bytes a word at the most."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(m.group(), len(numbers)) for m in _WORD.finditer(raw)), np.int64)
    if len(ids) < 3:
        return 0
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    at, counts = np.unique(windows, return_inverse=True, return_counts=True)[1:]
    starts = np.flatnonzero(counts[at] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def _measured(texts: pa.Array) -> pa.Array:
    counts = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(METRICS))
    return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=list(METRICS))


_measure = F.arrow_udf(_measured, T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose value is over the cutoff (or under it)."""

    name: str
    value: str
    cutoffs: tuple[float, ...]
    over: bool = True

    def rejects(self, cutoff: float, m: str = "") -> str:
        """SQL over METRICS, each named with m before it."""
        return f"({self.value.format(m=m)}) {'>' if self.over else '<'} {cutoff!r}D"

    def ladder(self, last: float) -> tuple[float, ...]:
        """The cutoffs from the one that rejects least to `last`."""
        lenient = sorted(self.cutoffs, reverse=self.over)
        return tuple(lenient[: lenient.index(last) + 1])


_SHARES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)
RULES = (
    Rule("symbols", "{m}n_symbols / greatest({m}word_chars, 1)", _SHARES),
    Rule("repeated_lines", "{m}n_dup_lines / greatest({m}n_lines, 1)", _SHARES),
    Rule("repeated_words", "{m}n_repeat_words / greatest({m}n_words, 1)", _SHARES),
    Rule("long_words", "{m}word_chars / greatest({m}n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0)),
    Rule("short_words", "{m}word_chars / greatest({m}n_words, 1)", (4.0, 3.5, 3.0, 2.5, 2.0, 1.5), over=False),
)


@dataclass(frozen=True)
class Risk:
    """At most `share` of a stratum's good documents that pass the fixed rules are rejected by the cutoffs, with confidence 1 - `delta` for all strata together.

    worth: how many bad documents a cutoff must reject for each good one.
    """

    share: float = 0.02
    delta: float = 0.05
    strata: tuple[str, ...] = ("de", "en", "es", "fr")
    min_words: int = 50
    max_repeat_percent: int = 50
    worth: int = 20


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def admissible(rejected_good: int, good: int, share: float, delta: float) -> bool:
    """True if the exact upper bound (Clopper-Pearson, confidence 1 - delta) of the rejected share is at most `share`."""
    return good > 0 and rejected_good <= share * good and binomial_at_most(rejected_good, good, share) <= delta


class Family(NamedTuple):
    """What the certifying half says of one rule in one stratum: the cutoffs from the most lenient to the chosen one, how many good documents each rejects, of how many."""

    cutoffs: tuple[float, ...]
    rejected: tuple[int, ...]
    good: int
    share: float


def certify(families: Mapping[tuple[str, str], Family], delta: float) -> dict[tuple[str, str], float]:
    """The strictest cutoff of each family that passes. The probability that any of them rejects more than its share is at most delta.

    Each family begins with an equal part of delta and tests its cutoffs in their order, each at the whole of that part, until one fails. The part of a family that
    has passed all is split among those that haven't, which then go on from where they failed (Holm's way, as Bretz and others have it for ordered tests, 2009).
    """
    passed = dict.fromkeys(families, 0)
    level = dict.fromkeys(families, delta / max(1, len(families)))
    moved = True
    while moved:
        moved = False
        for f, of in families.items():
            while passed[f] < len(of.cutoffs) and admissible(of.rejected[passed[f]], of.good, of.share, level[f]):
                passed[f], moved = passed[f] + 1, True
            left = [g for g in families if passed[g] < len(families[g].cutoffs)]
            if passed[f] == len(of.cutoffs) and level[f] and left:
                for g in left:
                    level[g] += level[f] / len(left)
                level[f] = 0.0
    return {f: families[f].cutoffs[n - 1] for f, n in passed.items() if n}


def stratum_of(lang: Column, risk: Risk) -> Column:
    return F.when(lang.isin(*risk.strata), lang).otherwise("other")


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk = Risk(), rules: tuple[Rule, ...] = RULES) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff. measured: doc_id, stratum and METRICS. labels: doc_id, quality (1 good, 0 bad).

    A doc_id that labels has more than once counts as good if any of its labels is good; null ids and labels don't count.
    Only counts come to the driver: a row for each of the risk's strata. The risk's share is split among the rules that are chosen in a stratum.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = measured.join(truth, "doc_id").where(~_base_failed(risk))
    judged = cut(judged.withColumn("certifies", F.expr("xxhash64(doc_id, 1) & 1") == 1).drop("doc_id"))
    chooses = judged.where("not certifies")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    chosen: dict[tuple[str, str], float] = {}
    for rule in rules:
        left = verdict(chosen, judged.stratum, rules=rules)
        hits = [(i, F.expr(rule.rejects(c)) & left) for i, c in enumerate(rule.cutoffs)]
        counts = [F.count_if(of & hit).alias(f"{name}_{i}") for i, hit in hits for name, of in (("bad", bad), ("good", good))]
        for row in chooses.groupBy("stratum").agg(F.count_if(good).alias("n"), *counts).collect():
            gains = {c: row[f"bad_{i}"] - risk.worth * row[f"good_{i}"] for i, c in enumerate(rule.cutoffs) if row[f"good_{i}"] <= risk.share / len(rules) * row["n"]}
            if gains and max(gains.values()) > 0:
                chosen[row["stratum"], rule.name] = max(gains, key=gains.__getitem__)
    if not chosen:
        return {}
    hits = [(f"{r.name}_{i}", F.expr(r.rejects(c))) for r in rules for i, c in enumerate(r.cutoffs)]
    counted = judged.where("certifies").groupBy("stratum").agg(F.count_if(good).alias("n"), *[F.count_if(good & hit).alias(name) for name, hit in hits]).collect()
    by, families = {r.name: r for r in rules}, {}
    for row in counted:
        mine = [name for s, name in chosen if s == row["stratum"]]
        for name in mine:
            ladder = by[name].ladder(chosen[row["stratum"], name])
            rejected = tuple(row[f"{name}_{by[name].cutoffs.index(c)}"] for c in ladder)
            families[row["stratum"], name] = Family(ladder, rejected, row["n"], risk.share / len(mine))
    return certify(dict(sorted(families.items())), risk.delta)


def _base_failed(risk: Risk, m: str = "") -> Column:
    return F.expr(f"{m}n_words < {risk.min_words} or 100 * {m}n_repeat_words > {risk.max_repeat_percent} * {m}n_words")


def verdict(cutoffs: dict[tuple[str, str], float], stratum: Column, m: str = "", rules: tuple[Rule, ...] = RULES) -> Column:
    """True for rows that no cutoff rejects; METRICS are read from columns named with m before them."""
    by = {r.name: r for r in rules}
    rejected = F.lit(False)
    for (of, name), cutoff in sorted(cutoffs.items()):
        rejected = rejected | ((stratum == of) & F.expr(by[name].rejects(cutoff, m)))
    return ~rejected


def measure_documents(docs: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, stratum and METRICS of each row of docs (doc_id, text, lang). A null text counts as empty, a null or unlisted lang as 'other'."""
    return docs.select(docs.doc_id, stratum_of(docs.lang, risk).alias("stratum"), _measure(docs.text).alias("m")).select("doc_id", "stratum", "m.*")


def assess(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the first five METRICS, base_failed, kept and n_lines: a row for each row of docs (doc_id, text, lang).

    Null text: no words, so rejected. Rows that repeat are each judged. Empty tables give no rows. Columns of docs
    other than the three named are not read, so their names can't clash.
    """
    measured = cut(measure_documents(docs, risk))
    cutoffs = choose_cutoffs(measured, labels, risk)
    failed = _base_failed(risk)
    return measured.select("doc_id", *METRICS[:-1], failed.alias("base_failed"), (~failed & verdict(cutoffs, measured.stratum)).alias("kept"), METRICS[-1])


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of docs that assess() keeps, with docs' columns as they are. No text is shuffled: rows are measured as they pass, and labelled ones before, for the cutoffs."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__tw_id")).distinct()
    few = known.count() <= BROADCAST_ROWS
    labelled = docs.join(F.broadcast(known), docs.doc_id == F.col("__tw_id"), "left_semi") if few else docs
    cutoffs = choose_cutoffs(cut(measure_documents(labelled, risk)), labels, risk)
    marked = docs.withColumn("__tw_m", _measure(docs.text))
    ok = ~_base_failed(risk, "__tw_m.") & verdict(cutoffs, stratum_of(docs.lang, risk), "__tw_m.")
    return marked.where(ok).drop("__tw_m")
