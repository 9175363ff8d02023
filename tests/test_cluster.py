import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.functions.embed import Guarded, Limits, embedded, lexical, pieces_known, preset
from tidewell.operators.cluster import Tuning, _in_rounds, cluster, members_of, stats, view
from tidewell.operators.components import components
from tidewell.sources.memory import Store, as_prior
from tidewell.storage import cumulative, numbered
from tidewell.streaming.engine import Engine

POSTS = "id long, seq long, vec array<double>, author long"


def wave(seed, dim=24):
    v = np.sin(seed * (np.arange(dim) + 1))
    return (v / np.linalg.norm(v)).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, s, v, a) for i, s, v, a in rows], POSTS)


def walk(vectors, tau, window=None, authors=None, best=False):
    reps, out = [], []
    for i, v in enumerate(vectors):
        near = [(float(np.dot(v, vectors[j])), j) for j in reps if (window is None or i - j <= window) and (authors is None or authors[i] != authors[j]) and float(np.dot(v, vectors[j])) >= tau]
        if not near:
            reps.append(i)
            out.append(i)
        else:
            out.append(max(near, key=lambda x: (x[0], -x[1]))[1] if best else near[0][1])
    return out


@pytest.mark.parametrize(("window", "other", "rule"), [(None, False, "first"), (7, False, "first"), (None, True, "first"), (None, False, "best"), (25, True, "best")])
def test_same_as_a_walk_in_order(spark, window, other, rule):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(150, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    authors = [i % 6 for i in range(150)]
    placed = cluster(frame(spark, [(i, i, v.tolist(), authors[i]) for i, v in enumerate(vectors)]), Tuning(0.8, window, other, rule))
    assert [r.cluster_id for r in placed.orderBy("seq").collect()] == walk(vectors, 0.8, window, authors if other else None, rule == "best")


def test_rounds_find_the_same_members(spark):
    r = random.Random(3)
    edges = spark.createDataFrame([(j, i, 1.0) for i in range(60) for j in range(i) if r.random() < 0.1], "j long, i long, sim double")
    assert {x.i for x in _in_rounds(edges).collect()} == {x.i for x in members_of(edges).collect()}


def test_memory_collapses_and_promotes(spark):
    memory = spark.createDataFrame([(1, wave(1), 0)], "id long, vec array<double>, author long")
    new = view(cluster(frame(spark, [(2, 1, wave(1), 0), (3, 2, wave(1), 0)]), Tuning(0.94), memory))
    two = new.where("id = 2").first()
    assert two.from_memory and not two.is_rep and two.size == 2 and two.seen_before
    again = cluster(frame(spark, [(1, 1, wave(1), 0)]), Tuning(0.94), memory)
    assert view(again).where("live").first().is_rep and stats(again).first().posts == 1
    both = stats(cluster(frame(spark, [(1, 1, wave(1), 0), (2, 2, wave(1), 0)]), Tuning(0.94), memory)).first()
    assert (both.posts, both.collapsed, both.remembered) == (2, 2, 0)
    assert stats(cluster(frame(spark, []), Tuning(0.94), memory)).first().remembered == 1


def test_same_author_folds_and_repeats_are_one(spark):
    seen = view(cluster(frame(spark, [(1, 1, wave(2), 9), (2, 2, wave(2), 9), (1, 3, wave(5), 9), (4, 4, None, 9), (4, 5, wave(2), 9)]), Tuning(0.94)))
    rows = {r.id: r for r in seen.collect()}
    assert rows[2].size == 3 and not rows[2].is_rep and rows[1].chip_text == "+2 similar posts" and rows[4].cluster_id == 1


def test_late_duplicate_of_the_first_row_and_inclusive_threshold(spark):
    rows = [(i, i, [math.cos(i / 999), math.sin(i / 999)], i) for i in range(400)] + [(400, 400, [1.0, 0.0], 0)]
    assert cluster(frame(spark, rows), Tuning(1.0)).where("id = 400").first().cluster_id == 0
    assert cluster(frame(spark, [(0, 0, [1.0, 0.0], 0), (1, 1, [0.5, 0.1], 0)]), Tuning(0.5)).where("id = 1").first().cluster_id == 0


def test_empty_and_vectorless(spark):
    assert cluster(frame(spark, [])).count() == 0
    only = cluster(frame(spark, [(1, 1, None, 0)]))
    assert only.first().cluster_id is None and stats(only).first().posts == 0


def test_quantise(spark):
    df = spark.createDataFrame([([127.0, -2.5, 2.5, -0.4],), ([0.0, 0.0],), (wave(3, 384),)], "v array<double>")
    a, b, c = df.select("v", V.quantised("v").alias("z")).collect()
    assert a.z.q == [127, -2, 3, 0] and b.z.q == [0, 0] and b.z.s == 1 / 127
    back = np.array(c.z.q) * c.z.s
    assert abs(np.dot(back / np.linalg.norm(back), c.v) - 1) < 1e-3


def test_failing_embedder_folds_nothing_and_loses_no_row(spark):
    def broken(texts):
        raise RuntimeError

    posts = spark.createDataFrame([(1, 1, "same text", 0), (2, 2, "same text", 0), (3, 3, "  ", 0), (4, 4, None, 0)], "id long, seq long, text string, author long")
    failed = embedded(posts, broken)
    assert failed.count() == 4 and failed.where("vec is not null").count() == 0
    assert cluster(failed).where("cluster_id is not null").count() == 0
    good = embedded(posts, lexical())
    assert good.where("vec is not null").count() == 2 and cluster(good).where("id = 2").first().cluster_id == 1


def test_circuit_opens_and_closes():
    now, calls = [0.0], []

    def flaky(texts):
        calls.append(texts)
        if now[0] < 10:
            raise RuntimeError
        return [[1.0]] * len(texts)

    g = Guarded(flaky, Limits(batch=1, failures=2, pause_s=30, cached=2), clock=lambda: now[0])
    assert g(["a", "b", "c"]) == [None] * 3 and len(calls) == 2
    now[0] = 20
    assert g(["a"]) == [None] and len(calls) == 2
    now[0] = 31
    assert g(["a", "a", "b", "c"]) == [[1.0]] * 4 and list(g.cache) == ["b", "c"]


def test_small_guards():
    assert preset(0.92) == 0.92 and preset("x") == 0.94
    pieces_known(1)
    with pytest.raises(ValueError):
        pieces_known(2)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_and_running_sums(spark):
    df = spark.createDataFrame([(x * 7919 % 1009, x % 5) for x in range(1009)], "k long, v long")
    rows = numbered(df, "k").collect()
    assert all(r.pos == r.k for r in rows) and len(rows) == 1009
    sums = {r.k: r.s for r in cumulative(df, "k", s="v").collect()}
    total = 0
    for r in sorted(df.collect()):
        total += r.v
        assert sums[r.k] == total


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "memory"))
    at = lambda s: F.lit(s).cast("timestamp")
    assert store.count() == 0
    rows = spark.createDataFrame([("a", wave(1), "x"), ("b", None, "x")], "id string, vec array<double>, author string")
    store.remember(rows, at("2024-01-01"))
    store.remember(rows.union(spark.createDataFrame([("c", wave(2), "y")], rows.schema)), at("2024-01-05"), batch="1")
    store.remember(rows.union(spark.createDataFrame([("c", wave(2), "y")], rows.schema)), at("2024-01-05"), batch="1")
    assert store.count() == 2 and [r.id for r in store.recall(at("2024-01-10")).collect()] == ["a", "c"]
    store.compact(at("2024-01-13"))
    assert store.count() == 0
    store.remember(rows, at("2024-01-13"))
    assert abs(np.dot(as_prior(store.rows()).first().vec, wave(1)) - 1) < 1e-3
    store.forget_all()
    assert store.count() == 0


@pytest.mark.parametrize("tuning", [Tuning(0.8), Tuning(0.8, window=20)])
def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path, tuning):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(90, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    engine = Engine(spark, str(tmp_path / "state"), tuning)
    for n in range(3):
        batch = frame(spark, rows[30 * n : 30 * n + 30] + rows[:3] + [(999, 999, None, 0)])
        engine.step(batch, n)
        engine.step(batch, n)  # as after a failure
    batch = {r.id: r.cluster_id for r in cluster(frame(spark, rows), tuning).collect()}
    assert {r.id: r.cluster_id for r in engine.state().collect()} == batch
    assert engine.stats().first().posts == 90 and engine.view().count() == 90
    assert len(engine.published().first().duplicate_ids) == engine.stats().first().collapsed
    engine.set_threshold(0.99)
    engine.forget_all()
    assert engine.state().count() == 0


def test_stream_of_files_resumes_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(60, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, i, v.tolist(), 0) for i, v in enumerate(vectors)]
    engine = Engine(spark, str(tmp_path / "state"), Tuning(0.8))
    for n in range(3):
        frame(spark, rows[20 * n : 20 * n + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert engine.start(stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    batch = {r.id: r.cluster_id for r in cluster(frame(spark, rows), Tuning(0.8)).collect()}
    assert {r.id: r.cluster_id for r in engine.state().collect()} == batch


def test_lexical_vectors_are_those_of_each_trigram_s_crc32_and_take_long_texts():
    def plain(text, dim):
        out, padded = np.zeros(dim), f"  {text.lower()} ".encode()
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3])
            out[h % dim] += 1 if h >> 31 else -1
        return (out / max(np.linalg.norm(out), 1e-9)).tolist()

    texts = ["", "a", "Ab c", "\0\0", "é漢字 ÄÖ", "word " * 60_000]
    for dim in (7, 8, 256):
        for text, vec in zip(texts, lexical(dim)(texts), strict=True):
            assert np.allclose(vec, plain(text, dim), rtol=0, atol=1e-12)
    start = time.monotonic()
    lexical()(["some words " * 1_000_000])
    assert time.monotonic() - start < 4  # one by one, 11 MB take some 11 s
