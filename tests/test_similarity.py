"""The similarity join by cells beside a product of all rows, and how much of that product it makes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cluster as clustering
from tidewell.operators import similarity


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


R = np.random.default_rng(41)
CENTRES = unit(R.normal(size=(60, 32)))
DATA = {
    "isotropic": unit(R.normal(size=(1200, 24))),
    "clustered": unit(CENTRES[R.integers(60, size=2400)] + 0.05 * R.normal(size=(2400, 32))),
    "copies": unit(np.repeat(R.normal(size=(3, 20)), [500, 5, 60], axis=0)),
    "norms": R.integers(-2, 3, (500, 5)).astype(float),
    "zeros": np.zeros((40, 4)),
    "one": np.ones((1, 3)),
}


def frame(spark, v, tau):
    taus = np.broadcast_to(np.asarray(tau, float), len(v))
    return spark.createDataFrame([(i, x.tolist(), float(t), i % 3) for i, (x, t) in enumerate(zip(v, taus, strict=True))], "pos long, vec array<double>, tau double, author long")


def plain(v, tau, since=0, other_author=False):
    sims = v @ v.T
    late, early = np.nonzero(np.tril(sims >= np.broadcast_to(np.asarray(tau, float), len(v))[:, None], -1))
    return sorted((int(b), int(a)) for a, b in zip(late, early, strict=True) if a >= since and not (other_author and a % 3 == b % 3))


@pytest.fixture(params=[(16 << 20, 2048), (20_000, 64)], ids=["whole", "parts"])
def parts(request, monkeypatch):
    monkeypatch.setattr(similarity, "PART_BYTES", request.param[0])
    monkeypatch.setattr(similarity, "STEP", request.param[1])
    return request.param


@pytest.mark.parametrize("name", DATA)
def test_pairs_are_those_of_the_whole_product(spark, parts, name):
    v = DATA[name]
    sims = v @ v.T
    for tau in (0.3, 0.6, 0.94, 5.0):
        if (np.abs(sims - tau) < 1e-9).any():
            tau += 1e-6
        for since in (0, len(v) // 3):
            found = sorted((x.j, x.i) for x in similarity.similar_pairs(frame(spark, v, tau), len(v), since=since).collect())
            assert found == plain(v, tau, since)


def test_thresholds_by_row_and_authors(spark, parts):
    v = DATA["isotropic"]
    tau = np.where(np.arange(len(v)) >= 700, 0.5, 0.3)
    found = sorted((x.j, x.i) for x in similarity.similar_pairs(frame(spark, v, tau), len(v), other_author=True).collect())
    assert found == plain(v, tau, other_author=True)


def test_products_are_far_fewer_than_pairs(spark, monkeypatch):
    half = lambda v: len(v) ** 2 / 2
    work = {}
    for name in ("isotropic", "clustered"):
        v = DATA[name]
        work[name] = similarity.join_work(frame(spark, v, 0.94), len(v)).agg(F.sum("rows").alias("rows"), F.sum("bounded").alias("bounded"), F.sum("whole").alias("whole")).first()
    assert work["isotropic"].whole < 0.01 * half(DATA["isotropic"])
    assert work["clustered"].bounded < 0.3 * half(DATA["clustered"]) and work["clustered"].whole < 0.1 * half(DATA["clustered"])
    # vectors of structure, in small parts: a row is copied a few times, not once for each other part
    monkeypatch.setattr(similarity, "PART_BYTES", 20_000)
    v = DATA["clustered"]
    found = similarity.join_work(frame(spark, v, 0.94), len(v)).agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    blocks = len(v) * 32 * 8 / 20_000
    assert found.rows < 0.5 * blocks * len(v) and found.most <= 2 * 3 * 20_000 / (32 * 8)


def test_no_rows_and_no_vectors(spark):
    assert similarity.similar_pairs(frame(spark, np.ones((0, 3)), 0.5), 0).count() == 0
    none = spark.createDataFrame([(0, None, 0.5, 1)], "pos long, vec array<double>, tau double, author long")
    assert similarity.similar_pairs(none, 1).count() == 0


def test_copies_follow_the_first_of_their_kind(spark, monkeypatch):
    r = np.random.default_rng(42)
    kinds = unit(r.normal(size=(40, 6)))
    v = kinds[r.integers(40, size=300)]
    v[::50] = 0  # matches nothing, itself included
    posts = spark.createDataFrame([(i, i, x.tolist(), 0) for i, x in enumerate(v)], "id long, seq long, vec array<double>, author long")
    found = {x.id: x.cluster_id for x in clustering.cluster(posts, clustering.Tuning(0.7)).collect()}
    reps, want = [], {}
    for i, x in enumerate(v):
        want[i] = next((j for j in reps if v[j] @ x >= 0.7), i)
        if want[i] == i:
            reps.append(i)
    assert found == want
    monkeypatch.setattr(clustering, "copies_of", lambda placed, tau: placed.where("false"))
    assert {x.id: x.cluster_id for x in clustering.cluster(posts, clustering.Tuning(0.7)).collect()} == want


def test_a_task_gives_its_pairs_step_by_step():
    n = 3 * similarity.STEP
    made = similarity.Partition(np.ones((1, 2)), np.eye(2), 0.5, 2.0)
    table = pa.table({
        "pos": np.arange(n), "vec": pa.array([[1.0, 0.0]] * n, pa.list_(pa.float64())), "tau": np.full(n, 0.5), "author": pa.array([None] * n, pa.int64()),
        "at_home": np.full(n, True), "part": np.zeros(n, np.int32),
    })
    sizes = [b.num_rows for b in similarity._met((0, 0, 0), table, made, False, 0, False)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= similarity.STEP**2
