"""Importance resampling beside a plain version of its definition, and what it is for."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import resample

CLASHING = ("n_words", "n_features", "weight", "score", "rank", "down", "uid", "pos", "counts", "__part", "__at")


def plain_features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    """doc_id, n_features, weight, score and rank of each row; rows equal in doc_id and score are in the order of docs."""
    found = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000) / ((s[b] + 1.0) * (T + 10_000))))
    rows = []
    for (d, _), (n, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r) for r in rows), key=repr)


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def drawn(spark, rows, target, **how):
    found = resample.draw(documents(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    assert [t for _, t in found.dtypes] == ["bigint"] * 6
    return sorted((tuple(r) for r in found.collect()), key=repr)


def texts(r, n):
    words = ["The", "cat", "sat", "on", "a_b", "x-y", "ÉTÉ", "été", "9", "中文", "Z", "`q`", "end."]
    return [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("window", [1 << 17, 11])
def test_features_against_a_plain_version(monkeypatch, window):
    monkeypatch.setattr(resample, "WINDOW", window)
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(" \n\tABz09é中_`{@[-.a\x7f\x00") for _ in range(r.randrange(50)))
        n, buckets = resample.features(text)
        assert (n, sorted(buckets.tolist())) == (plain_features(text)[0], sorted(plain_features(text)[1])), repr(text)
    assert [resample.features(t)[0] for t in (None, "", " ._")] == [0, 0, 0]


def test_draw_against_a_plain_version(spark):
    r = random.Random(4)
    rows = list(enumerate(texts(r, 300))) + [(None, "no id but words " * 9), (7, None), (8, ""), (9, " \n"), (10, "w" * 70_000), (11, "word after word " * 40_000)]
    rows += rows[::7]
    target = [*texts(r, 20), None, "the cat sat on"]
    assert drawn(spark, rows, target) == plain(rows, target)
    assert drawn(spark, rows, target, percent=50, least_words=3) == plain(rows, target, 50, 3)


def test_odd_tables(spark):
    assert drawn(spark, [], ["a b"]) == []
    rows = [(1, "one two three"), (2, None)]
    for target in ([], [None, ""]):
        assert drawn(spark, rows, target) == plain(rows, target)
    same = [(5, "all rows are equal " * 10)] * 400  # one key has all rows
    found = drawn(spark, same, ["equal rows"])
    assert sorted(x[4] for x in found if x[4]) == list(range(1, 21)) and len({x[:4] for x in found}) == 1


def test_counts_do_not_depend_on_partitions(spark):
    rows = documents(spark, list(enumerate(texts(random.Random(5), 200))))
    want = np.bincount([b for r in rows.collect() for b in plain_features(r.text)[1]], minlength=10_000)
    for n in (1, 3, 90):
        assert (resample.bucket_counts(rows.repartition(n)) == want).all()


def test_draw_leans_to_the_target(spark):
    r = random.Random(6)
    like = lambda words: " ".join(r.choice(words) for _ in range(60))
    near, far = [f"near{k}" for k in range(40)], [f"far{k}" for k in range(40)]
    rows = [(i, like(near if i % 10 == 0 else far)) for i in range(1000)]
    found = drawn(spark, rows, [like(near) for _ in range(30)], percent=8)
    assert sum(x[4] is not None for x in found) == 80 and all(x[0] % 10 == 0 for x in found if x[4])
