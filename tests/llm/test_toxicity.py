"""Toxicity on labels that the model hasn't seen, words that nobody misspelt for it, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import registry, toxicity

SF = "/root/testdata/sf0.01"
BAD = ["worthless", "disgusting", "pathetic", "horrible", "nuisance"]
GOOD = ["window", "garden", "river", "yellow", "morning", "paper", "weather", "thunder", "hotel", "patience", "pasta", "dust", "nurse", "worth", "horizon"]


def held_out(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


def text_of(r, bad=None, n=40):
    words = [r.choice(GOOD) for _ in range(n)]
    for w in bad or ():
        words.insert(r.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def trained():
    r = random.Random(8)
    rows = [(text_of(r, [r.choice(BAD) for _ in range(2)] if k % 4 == 0 else None), int(k % 4 == 0)) for k in range(400)]
    return toxicity.Scorer(toxicity.fit(*map(list, zip(*rows, strict=True))))


def test_misspellings_share_n_grams(trained):
    r = random.Random(9)
    clean = [trained(text_of(r)) for _ in range(200)]
    assert np.mean(np.array(clean) < 0.5) >= 0.99
    unseen = ["wortheless", "disgustinng", "pathetick", "horrrible", "nuisannce", "disgustings", "wworthless", "patheticc"]
    assert np.mean([trained(text_of(r, [w])) > max(np.quantile(clean, 0.95), 0.3) for w in unseen for _ in range(5)]) >= 0.8


def test_one_insult_in_a_long_text(trained):
    r = random.Random(10)
    assert trained(text_of(r, ["disgusting"], 200_000)) > 0.7 > trained(text_of(r, None, 200_000))


def test_scores_do_not_depend_on_slices(trained, monkeypatch):
    r = random.Random(11)
    text = text_of(r, BAD, 500)
    whole = trained(text)
    monkeypatch.setattr(toxicity, "SLICE", 50)
    monkeypatch.setattr(toxicity, "CACHED", 4)
    trained._forget()
    assert trained(text) == pytest.approx(whole)


def test_grams_against_a_plain_version():
    words = ["a", "word", "ünï", "x" * 32]
    of, buckets = toxicity.grams(words)
    for k, w in enumerate(words):
        marked = f"<{w}>"
        assert (of == k).sum() == sum(max(0, len(marked) - n + 1) for n in toxicity.GRAMS)
    again = {w: sorted(toxicity.grams([w])[1]) for w in words}
    assert all(sorted(buckets[of == k]) == again[w] for k, w in enumerate(words))  # no n-gram goes over a word's end


def test_fit_twice_is_the_same_and_one_label_is_no_model():
    texts, labels = ["some words here", "other words there"] * 10, [0, 1] * 10
    a, b = toxicity.fit(texts, labels), toxicity.fit(texts, labels)
    assert (a.vectors == b.vectors).all() and (toxicity.Model.loaded(a.dumped()).softmax == a.softmax).all()
    for labels in ([0] * 20, [1] * 20, []):
        score = toxicity.Scorer(toxicity.fit(texts[: len(labels)], labels))("any text")
        assert score == pytest.approx((sum(labels) + 1) / (len(labels) + 2))


def test_held_out_labels(spark):
    found = {r.doc_id: r for r in registry.op12_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(found) == docs.count()
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in found.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held_out(r.doc_id) and r.doc_id in found]
    pos, neg = (np.array([found[d].score for d, y in labels if y == k]) for k in (1, 0))
    assert (pos[:, None] > neg).mean() >= 0.88 and (neg < 0.7).mean() >= 0.97 and (pos >= 0.7).mean() >= 0.7


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    ids = {r.doc_id for r in toxicity.sample(docs, labels).collect()}
    assert ids and not any(map(held_out, ids))
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda y: {r.doc_id: r.score for r in toxicity.assess(docs, y).collect()}
    assert score(labels) == score(flipped)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "!!! ..."), (None, "no id"), (5, "x" * 100_000), (6, "same"), (6, "same"), (6, "other")] + [(k, f"good word {k % 3}" + " nuisance" * (k % 2)) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "model", "held_out", "predicted", "toxic", "lang", "label"):
        docs = docs.withColumn(c, F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(10, 60)] + [(10, 1), (11, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    found = toxicity.assess(docs, labels).collect()
    assert len(found) == len(rows)
    blank = {r.score for r in found if r.doc_id in (1, 2, 3, 4)}
    assert len(blank) == 1 and len({r.score for r in found if r.doc_id == 6}) <= 2
    assert toxicity.assess(docs.limit(0), labels).count() == 0
    nothing = toxicity.assess(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert toxicity.sample(docs, labels, 5).count() == 5
