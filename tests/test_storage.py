"""Tables that functions cut, products of new blocks only, resamples and retrieval by blocks, beside plain versions."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import storage
from tidewell.functions.embed import embedded_by, preset, preset_of
from tidewell.functions.labels import largest_object
from tidewell.operators import metrics, retrieval
from tidewell.operators.components import components
from tidewell.operators.similarity import similar_pairs
from tidewell.storage import shared_dir


def exists(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_scoped_functions_keep_their_result_alone(spark, monkeypatch):
    paths = []
    real = storage.delete
    monkeypatch.setattr(storage, "delete", lambda s, p: (paths.append(p), real(s, p)))

    @storage.scoped
    def inner(n):
        return storage.cut(spark.range(n)).where("id > 1")

    @storage.scoped
    def outer():
        return storage.cut(inner(5).withColumn("x", F.lit(1)))

    @storage.scoped
    def fails():
        storage.cut(spark.range(3))
        raise ValueError

    assert sorted(r.id for r in outer().collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        fails()
    assert len(paths) == 4 and not any(exists(spark, p) for p in paths) and storage._scopes == []


def test_a_cluster_must_name_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"{master}-{folder}", master=master), conf=SimpleNamespace(get=lambda k, d: folder))

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(session("spark://host:7077", None))
    assert storage.shared_dir(session("yarn", "hdfs:///shared/")).startswith("hdfs:///shared/tidewell-")


@pytest.mark.parametrize("since", [0, 1, 100, 333, 400])
def test_pairs_since_a_row(spark, monkeypatch, since):
    from tidewell.operators import similarity

    monkeypatch.setattr(similarity, "block_size", lambda rows: 50)
    r = np.random.default_rng(31)
    vectors = r.integers(-2, 3, (400, 5)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), 6.0, i % 3) for i, v in enumerate(vectors)], "pos long, vec array<double>, tau double, author long")
    found = {(x.j, x.i) for x in similar_pairs(rows, 400, since=since).collect()}
    sims = vectors @ vectors.T
    assert found == {(j, i) for i in range(since, 400) for j in range(i) if sims[i, j] >= 6.0}


def test_bootstrap_against_a_plain_version(spark, monkeypatch):
    r = random.Random(32)
    scores = {s: (r.random(), r.random(), r.random()) for s in range(17)}
    rows = [(m, s, v[k]) for s, v in scores.items() for k, m in enumerate("abc")] + [("a", 99, 0.5)]
    df = spark.createDataFrame(rows, "model string, story long, auc double")
    found = {(x.a, x.b): x for x in metrics.bootstrap(df, ["a", "b", "c"], 500, 7).collect()}
    means = []
    for k in range(500):
        drawn = [scores[int(hashlib.md5(f"7:{k}:{j}".encode()).hexdigest()[:8], 16) % 17] for j in range(17)]
        means.append(np.mean(drawn, axis=0))
    means, whole = np.array(means), np.mean(list(scores.values()), axis=0)
    for a, b in ((0, 1), (1, 2), (0, 2)):
        d, x = means[:, a] - means[:, b], found["abc"[a], "abc"[b]]
        assert np.allclose([x.delta, x.lo, x.hi, x.p], [whole[a] - whole[b], *np.percentile(d, (2.5, 97.5)), (d > 0).mean()])
        assert x.significant == (np.percentile(d, 2.5) > 0)
    monkeypatch.setattr(metrics, "BROADCAST_ROWS", 0)
    assert {(x.a, x.b): x for x in metrics.bootstrap(df, ["a", "b", "c"], 500, 7).collect()}.keys() == found.keys()
    assert metrics.bootstrap(df.where("false"), ["a", "b"]).count() == 0


def grams_of(text):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        out.update([w] if len(w) <= 3 else [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)])
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    r = random.Random(33)
    words = ["a", "of", "the", "Ünder", "story", "stories", "told", "tolls", "river", "rivet"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))
    stories, posts = {s: text() for s in range(10)}, {p: text() for p in range(30)} | {50: "", 51: None, 52: "zzz qq"}
    df = Counter(g for t in stories.values() for g in grams_of(t))
    idf = {g: math.log((1 + len(stories)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(t):
        w = {g: n * idf[g] for g, n in grams_of(t or "").items() if g in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / length for g, x in w.items()} if length else {}

    of = {s: unit(t) for s, t in stories.items()}
    want = set()
    for p, t in posts.items():
        mine = unit(t)
        sims = sorted((-round(sum(x * of[s].get(g, 0.0) for g, x in mine.items()), 9), s) for s in of)
        want |= {(p, s, round(-x, 6) + 0.0, k) for k, (x, s) in enumerate([y for y in sims if y[0] < 0][:4], 1)}
    found = retrieval.nearest(spark.createDataFrame(list(posts.items()), "post long, text string"), spark.createDataFrame(list(stories.items()), "story long, text string"), 4)
    assert {(x.post, x.story, round(x.sim, 6), x["rank"]) for x in found.collect()} == want
    none = spark.createDataFrame([], "story long, text string")
    assert retrieval.nearest(spark.createDataFrame(list(posts.items()), "post long, text string"), none).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("a"), ((F.col("id") + 1) * 7919 % n).alias("b"))
    assert {x.root for x in components(edges).collect()} == {0}


def test_objects_in_hostile_replies():
    assert largest_object('x {"a": 1} ```json\n{"b": "}", "c": {}}\n``` {"d"') == '{"b": "}", "c": {}}'
    assert largest_object("{" * 50_000) is None and largest_object('{"a":' * 5_000) is None and largest_object("") is None


def test_presets_and_vectors_of_a_table(spark):
    df = spark.createDataFrame([(1, " a "), (2, ""), (3, None), (4, "b")], "id long, text string")
    found = embedded_by(df, spark.createDataFrame([("a", [1.0])], "text string, vec array<double>"))
    assert {x.id: x.vec for x in found.collect()} == {1: [1.0], 2: None, 3: None, 4: None}
    values = [0.94, 0.92, 0.89, 0.5, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", preset_of(F.col("v")).alias("p")).collect()
    assert all(x.p == preset(x.v) for x in rows)


@pytest.mark.parametrize("stories", [[], [[3]], [[1, 2]], [[0, 5, 6, 100], [1, 2, 50], [7]], [list(range(0, 200, 3)), [1, 400]]])
def test_gaps_against_all_pairs(spark, stories):
    rows = [(p, s) for s, positions in enumerate(stories) for p in positions]
    found = metrics.gap_profile(spark.createDataFrame(rows, "pos long, story long"), (10, 100)).first()
    gaps = [b - a for positions in stories for i, a in enumerate(positions) for b in positions[i + 1 :]]
    want = (*np.percentile(gaps, (50, 90)), *(np.mean([g <= w for g in gaps]) for w in (10, 100))) if gaps else (None,) * 4
    assert tuple(found) == pytest.approx(want) if gaps else tuple(found) == want


@pytest.mark.parametrize("block", [4096, 20])
def test_nearest_writes_less_than_the_posts_texts(spark, monkeypatch, block):
    """Features are many times their texts; they are made where posts meet stories and not written."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    r = np.random.default_rng(35)
    words = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words, n))
    posts = [(i, text(300)) for i in range(300)]
    written = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*.parquet"))
    before = written()
    found = retrieval.nearest(spark.createDataFrame(posts, "post long, text string"), spark.createDataFrame([(i, text(20)) for i in range(40)], "story long, text string"), 4)
    assert found.count() == 4 * len(posts) and {x["rank"] for x in found.collect()} == {1, 2, 3, 4}
    assert written() - before < sum(len(t) for _, t in posts) / 2
