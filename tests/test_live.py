"""The stream whose state expires, beside a walk in order; scopes by thread; tables that batches leave."""

import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import storage
from tidewell.operators.cluster import Tuning
from tidewell.streaming import live
from tidewell.streaming.engine import Engine
from tidewell.streaming.live import LiveEngine, pivots_for

POSTS = "id long, seq long, vec array<double>, author long, t timestamp"
START = datetime(2024, 1, 1)


def posts_of(n, dim=4, seed=51):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, i, x.tolist(), i % 3, START + timedelta(minutes=i)) for i, x in enumerate(v)]


def walked(rows, tau, ttl, other_author=False, best=False):
    reps, out = [], {}
    for i, _, x, author, t in rows:
        fit = [(np.dot(x, y), -k, j) for k, (j, y, a, s) in enumerate(reps) if np.dot(x, y) >= tau and t - s <= ttl and not (other_author and a == author)]
        out[i] = (max(fit) if best else max(fit, key=lambda f: f[1]))[2] if fit else i
        if not fit:
            reps.append((i, x, author, t))
    return out


def fed(spark, path, rows, schema=POSTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(path)


def engine_of(spark, tmp_path, rows, tuning, ttl="30 minutes", least=0.6):
    return LiveEngine(spark, str(tmp_path / "state"), pivots_for(spark.createDataFrame(rows, POSTS), least, 400), tuning, ttl)


@pytest.mark.parametrize("tuning", [Tuning(0.8), Tuning(0.7, other_author=True), Tuning(0.75, rule="best")])
def test_live_equals_a_walk_and_stays_bounded(spark, tmp_path, tuning):
    rows = posts_of(160)
    engine, path, sizes, ids = engine_of(spark, tmp_path, rows, tuning), str(tmp_path / "in"), [], []
    for k in range(4):  # stopped and started again after every file; each brings some of the last again, a post without a vector and one without a time
        again = rows[max(0, 40 * k - 10) : 40 * k]
        fed(spark, path, rows[40 * k : 40 * k + 40] + again + [(900 + k, 900, None, 0, START + timedelta(minutes=40 * k)), (910 + k, 910, rows[0][2], 0, None)])
        query = engine.start(source(spark, path), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(240)
        held = {o["operatorName"]: o["numRowsTotal"] for o in query.lastProgress["stateOperators"]}
        ids.append(held["dedupeWithinWatermark"])
        sizes.append(held["transformWithStateInPandasExec"])
    found = {r.id: r.cluster_id for r in engine.state().collect()}
    assert found == walked(rows, tuning.tau, timedelta(minutes=30), tuning.other_author, tuning.rule == "best")
    assert max(ids) <= 40 + 40 + 30 and sizes[-1] <= 4 * max(sizes[:2])
    assert engine.stats().first().posts == 160


def test_threshold_pivots_and_switch(spark, tmp_path):
    rows = posts_of(60)
    engine, path = engine_of(spark, tmp_path, rows, Tuning(0.8)), str(tmp_path / "in")
    with pytest.raises(ValueError, match="thresholds"):
        engine.set_threshold(0.5)
    fed(spark, path, rows[:30])
    engine.start(source(spark, path), str(tmp_path / "checkpoint")).awaitTermination()
    engine.set_threshold(0.999)
    fed(spark, path, rows[30:])
    engine.start(source(spark, path), str(tmp_path / "checkpoint")).awaitTermination()
    found = {r.id: r.cluster_id for r in engine.state().collect()}
    assert {i: c for i, c in found.items() if i < 30} == walked(rows[:30], 0.8, timedelta(minutes=30)) and all(found[i] == i for i in range(30, 60))
    assert engine.view().where("is_dup").count() == sum(i != c for i, c in found.items()) > 0
    engine.set_enabled(False)
    assert engine.view().where("is_dup or chip_text is not null").count() == 0 and engine.view().count() == 60
    engine.forget_all()
    assert engine.state().count() == 0


def files_of(spark):
    p, fs = storage.filesystem(spark, storage.shared_dir(spark))
    return {str(x.getPath().getName()) for x in fs.listStatus(p)} if fs.exists(p) else set()


def test_batches_leave_no_tables(spark, tmp_path):
    rows = [r[:4] for r in posts_of(80)]
    engine = Engine(spark, str(tmp_path / "state"), Tuning(0.8))
    before = files_of(spark) if spark.range(1).count() and storage.cut(spark.range(1)).count() else set()
    for k in range(4):
        engine.step(spark.createDataFrame(rows[20 * k : 20 * k + 20], POSTS.replace(", t timestamp", "")), k)
        assert files_of(spark) == before
    assert engine.state().count() == 80


def test_threads_have_scopes_of_their_own(spark):
    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.append(storage.cut(spark.range(5)))
        done.set()

    @storage.scoped
    def held_up():
        storage.cut(spark.range(3))
        inside.set()
        assert done.wait(60)
        return spark.range(2)

    thread = threading.Thread(target=other)
    thread.start()
    assert held_up().count() == 2
    thread.join()
    assert kept[0].count() == 5 and storage._scopes == []


def test_switch_of_the_batch_engine(spark, tmp_path):
    rows = [(i, i, [1.0, 0.0], 0) for i in range(5)]
    engine = Engine(spark, str(tmp_path / "state"), Tuning(0.8))
    engine.step(spark.createDataFrame(rows, POSTS.replace(", t timestamp", "")), 0)
    assert [r.id for r in engine.duplicate_ids().orderBy("id").collect()] == [1, 2, 3, 4] == engine.published().first().duplicate_ids
    engine.set_enabled(False)
    assert engine.duplicate_ids().count() == 0 and engine.published().count() == 1 and engine.published().first().duplicate_ids == []
    engine.step(spark.createDataFrame([(9, 9, [1.0, 0.0], 0)], POSTS.replace(", t timestamp", "")), 1)
    engine.set_enabled(True)
    assert engine.view().where(F.col("id") == 9).first().is_dup


@pytest.mark.parametrize("shuffled", [False, True])
def test_posts_meet_only_those_near_in_time(shuffled):
    rng = np.random.default_rng(5)
    n, ttl, minute = 3000, 3600 * 10**6, 60 * 10**6
    vecs = rng.normal(size=(n, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    times = np.arange(n) * minute
    if shuffled:
        rng.shuffle(times)
    rows = live._Rows(np.arange(n), times, np.arange(n) % 5, np.arange(n) % 3 > 0, vecs)
    meeting = live.Meeting(live.Partition(vecs[:2], np.eye(8), 0.5, 1.0), ttl, True)
    new, held = rows[np.arange(n) >= 1500], rows[np.arange(n) < 1500]
    made, real = [], live.Products.reach
    met = lambda itself: {(i, j) for f in meeting._pairs(new, new if itself else held, itself) for i, j in zip(f["i"], f["j"], strict=True)}
    live.Products.reach = lambda self, x, y, before=None: made.append(len(x) * len(y)) or real(self, x, y, before)
    try:
        own, old = met(True), met(False)
    finally:
        live.Products.reach = real
    sims = vecs @ vecs.T >= 0.5
    ok = lambda x, y: sims[x, y] and times[x] - times[y] <= ttl and x % 5 != y % 5 and (rows.at_home[x] or rows.at_home[y])
    assert own == {(x, y) for x in range(1500, n) for y in range(1500, x) if ok(x, y)} and own
    assert old == {(x, y) for x in range(1500, n) for y in range(1500) if ok(x, y)} and old
    if not shuffled:
        assert sum(made) < 1500 * 1500 / 2
