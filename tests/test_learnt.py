"""The model learnt from texts: beside a plain version, on labels that it hasn't seen, and handed to whoever takes an embedder."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewell.functions import learnt
from tidewell.functions.embed import embedded, lexical
from tidewell.storage import cut

SF = "/root/testdata/sf0.01"


def plain(texts, words):
    split = [[w for w in (t or "").lower().split()] for t in texts]
    tf, df = Counter(w for s in split for w in s), Counter(w for s in split for w in set(s))
    known = sorted(tf, key=lambda w: (-tf[w], w))[:words]
    n = sum(t is not None for t in texts)
    rarity = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in known}
    met = Counter(p for s in split for a, b in zip(s, s[1:]) for p in ((a, b), (b, a)))
    out = {}
    for w in known:
        v = np.zeros(learnt.DIM)
        for (a, b), k in met.items():
            if a == w and b in rarity:
                bits = int(hashlib.md5(b.encode()).hexdigest(), 16)
                v += math.log(1 + k) * rarity[b] * np.array([1.0 if bits >> (124 - 4 * (i // 4) + i % 4) & 1 else -1.0 for i in range(learnt.DIM)])
        out[w] = (rarity[w], v / max(np.linalg.norm(v), 1e-9))
    return out


@pytest.mark.parametrize("words", [100, 4])
def test_vectors_against_a_plain_version(spark, words):
    texts = ["The cat sat", "the CAT ran to  the dog", "a dog sat", None, "", "alone", "the the the", " \n"] * 2
    found = {r.word: (r.rarity, r.vec) for r in learnt.learn(spark.createDataFrame([(t,) for t in texts], "text string"), words).collect()}
    want = plain(texts, words)
    assert set(found) == set(want)
    assert all(found[w][0] == pytest.approx(want[w][0]) and np.allclose(found[w][1], want[w][1]) for w in want)


def test_texts_without_words_and_the_transport(spark):
    model = cut(learnt.learn(spark.createDataFrame([("one two three",), ("two three four",)], "text string")))
    posts = spark.createDataFrame([(1, "one three"), (2, "  "), (3, None), (4, "unheard of"), (5, " one three ")], "id long, text string")
    a = {r.id: r.vec for r in learnt.with_vectors(posts, model).collect()}
    assert a[2] is a[3] is a[4] is None and np.allclose(a[1], a[5]) and np.linalg.norm(a[1]) == pytest.approx(1)
    b = {r.id: r.vec for r in embedded(posts, learnt.embedder(model)).collect()}
    assert np.allclose(b[1], a[1]) and b[2] is None
    assert learnt.learn(spark.createDataFrame([], "text string")).count() == 0


def test_better_than_letters_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = learnt.Words.of(learnt.learn(docs.select("text")))
    rows = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").collect()
    y, seen = np.array([r.toxic for r in rows]), np.array([zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows])

    def auc(vectors):
        v = np.array(vectors)
        score = v @ (v[seen & (y == 1)].mean(0) - v[seen & (y == 0)].mean(0))
        pos, neg = score[~seen & (y == 1)], score[~seen & (y == 0)]
        return (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2

    texts = [r.text or "" for r in rows]
    assert auc(words(texts)) > auc(lexical()(texts)) + 0.05


def test_words_are_counted_without_their_texts(spark):
    texts = spark.createDataFrame([("a b a",), ("b  c",), (None,), ("",)], "text string")
    found = learnt.vocabulary(texts, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [word") == 1 and "Aggregate [word#" in plan and ", row#" not in plan
    assert {r.word: round(r.rarity, 9) for r in found.collect()} == {w: round(math.log(4 / (1 + df)) + 1, 9) for w, df in (("a", 1), ("b", 2), ("c", 1))}
