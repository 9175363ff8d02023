"""Judged pairs met block by block, beside all pairs in plain Python."""

import random
import time
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import gold, judged, metrics
from tidewell.plans import catalogue, stores

SHARED = "labeller string, id long, story long, main_story long"


def made(spark, n, seed):
    """Overlaps, vectors and stories, and the judgement and similarity of each pair."""
    r = random.Random(seed)
    rows = [(w, i, r.randrange(4), r.choice([0, 1, 2, None])) for w in "abc" for i in range(n) if r.random() < 0.6]
    of = {w: {x[1]: x[2:] for x in rows if x[0] == w} for w in "abc"}
    vec = {i: [r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)] for i in range(n - 2)}
    want = {}
    for p in combinations(range(n), 2):
        sides = [(a[1] is not None and a[1] == b[1], a[0] == b[0]) for o in of.values() if p[0] in o and p[1] in o for a, b in [(o[p[0]], o[p[1]])]]
        if sides:
            y = 1 if any(m and o for m, o in sides) else 2 if any(m for m, _ in sides) != any(o for _, o in sides) else 0
            want[p] = (y, round(float(np.dot(vec[p[0]], vec[p[1]])), 6) if p[1] in vec else None)
    shared = spark.createDataFrame(rows, SHARED)
    vectors = spark.createDataFrame(list(vec.items()), "id long, vec array<double>")
    stories = spark.createDataFrame([(i, f"s{i % 3}") for i in range(n)], "id long, story string")
    return shared, vectors, stories, want


def shares(want, shift):
    sims = {p: (y, s + shift(*p)) for p, (y, s) in want.items() if s is not None}
    below = [s for y, s in sims.values() if y == 0]
    found = {}
    for p, (y, s) in sims.items():
        if y == 1:
            found.setdefault(f"s{p[0] % 3}", []).append(sum((b < s) + 0.5 * (b == s) for b in below) / len(below))
    return {k: (len(v), pytest.approx(sum(v) / len(v))) for k, v in found.items()}


@pytest.mark.parametrize("step", [5, 1024])
def test_tallies_and_stories_of_judged_pairs(spark, monkeypatch, step):
    monkeypatch.setattr(judged, "STEP", step)
    shared, vectors, stories, want = made(spark, 50, 71)
    pairs = judged.Judged(shared, vectors, stories)
    tally = {}
    for y, s in want.values():
        if y < 2 and s is not None:
            tally[s, y] = tally.get((s, y), 0) + 1
    assert {(x.sim, x.y): x.n for x in pairs.tally().collect()} == tally
    each = spark.createDataFrame([(s, y) for y, s in want.values() if y < 2 and s is not None], "sim double, y int")
    assert metrics.pooled_auc(pairs.tally()).first().auc == pytest.approx(metrics.pooled_auc(each).first().auc)
    assert metrics.sweep(pairs.tally()).orderBy("tau").collect() == metrics.sweep(each).orderBy("tau").collect()
    for shift in (None, lambda lo, hi: (lo * 31 + hi * 17) % 10 / 10 * 0.2):
        for most in (judged.BROADCAST, 0):
            monkeypatch.setattr(judged, "BROADCAST", most)
            assert {x.story: (x.n_pairs, x.auc) for x in pairs.story_auc(1, shift).collect()} == shares(want, shift or (lambda lo, hi: 0.0))


def test_values_beside_the_grid_are_tallied(monkeypatch):
    monkeypatch.setattr(judged, "LOOSE", 10)
    r = np.random.default_rng(72)
    for values, grid in ((r.integers(-9, 9, 500).astype(float), True), (r.integers(-9, 9, 500) * 1e12, True), (r.choice([0.1, 0.1 + 1e-17, 0.3], 500), False)):
        tally = judged._Tally(grid)
        for some in np.array_split(values, 60):
            tally.add(some)
        assert [list(x) for x in tally.found()] == [list(x) for x in np.unique(values, return_counts=True)]


def test_an_id_told_twice_is_refused(spark):
    shared = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 1)], SHARED)
    with pytest.raises(ValueError):
        judged.Judged(shared, spark.range(2).select("id", F.array(F.lit(1.0)).alias("vec")))


@pytest.mark.parametrize("most", [10, 1])
def test_sums_and_lists_of_gold_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(gold, "RANGE", 7)
    shared, *_, want = made(spark, 45, 73)
    sums = {y: (len(p), sum(x for x, _ in p), sum(x for _, x in p)) for y in (0, 1) if (p := [k for k, (kind, _) in want.items() if kind == y])}
    assert {x.y: (x.pairs, x.lo_sum, x.hi_sum) for x in gold.pair_sums(shared, most).collect()} == sums
    twice = shared.union(shared.limit(1))
    for rows in (shared, twice):
        assert sorted((x.lo, x.hi, x.y) for x in gold.gold_pairs(rows).collect()) == sorted((*p, y) for p, (y, _) in want.items() if y < 2)
        assert sorted((x.lo, x.hi) for x in gold.disputed(rows).collect()) == sorted(p for p, (y, _) in want.items() if y == 2)
    assert gold.pair_sums(shared.limit(0)).count() == 0


def test_gaps_of_one_story_in_the_time_of_a_sort(spark):
    n = 60_000
    rows = spark.range(n).select(F.col("id").alias("pos"), F.lit("s").alias("story"))
    found = metrics.gap_profile(rows, (100, n)).first()
    assert found.within_100 == pytest.approx(sum(n - g for g in range(1, 101)) / (n * (n - 1) / 2)) and found[f"within_{n}"] == 1
    assert found.median == pytest.approx(n * (1 - 0.5**0.5), abs=1)


def tables(spark, path, **named):
    for name, parts in named.items():
        for rows in parts:
            rows.coalesce(1).write.mode("append").parquet(f"{path}/{name}.parquet")
            time.sleep(0.1)
    return str(path)


def some_vectors(spark, ids):
    r = np.random.default_rng(74)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)], int(i) % 5) for i, v in zip(ids, r.normal(size=(len(ids), 8)), strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_texts_with_equal_vectors_stay_apart(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in enumerate(["Same text", "same text", "Same text"])], "doc_id long, text string, source string, lang string, n_chars int")
    found = catalogue.queries()["embed_fanout"](spark, tables(spark, tmp_path, documents=[docs]))
    assert sorted(tuple(x) for x in found.select("doc_id", "same_as").collect()) == [(0, 0), (1, 1), (2, 0)]


def test_a_stream_is_in_order_of_ids_whenever_its_files_were_written(spark, tmp_path):
    late, early = some_vectors(spark, range(60, 120)), some_vectors(spark, range(60))
    found = catalogue.queries()["stream_equals_batch"](spark, tables(spark, tmp_path, embeddings=[late, early]))
    assert tuple(found.select("n", "different").first()) == (120, 0)


def test_ids_far_apart_are_streamed_and_come_again(spark, tmp_path):
    ids = [4000 * i for i in range(40)]
    found = catalogue.queries()["stream_redelivered"](spark, tables(spark, tmp_path, embeddings=[some_vectors(spark, ids)]))
    assert {x.vec_id: x.placed for x in found.collect()} == dict.fromkeys(ids, 2)


def test_posts_that_come_again_come_in_bounded_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TIMED", 7)
    _, path = stores._timed(spark, tables(spark, tmp_path, embeddings=[some_vectors(spark, range(100))]), 1000)
    of = [[x["id"] for x in f.collect()] for f in (spark.read.parquet(str(p)) for p in sorted(Path(path).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns))]
    assert max(map(len, of)) <= 7 + 20 and Counter(i for ids in of for i in ids if i >= 0).keys() == set(range(100))
    marks = [k for k, ids in enumerate(of) if min(ids) < 0]
    assert len(marks) == 2 and sorted(i for ids in of[marks[-1] + 1 :] for i in ids) == list(range(100)) and max(map(len, of[marks[-1] + 1 :])) <= 7


def test_marks_are_packed_in_a_byte_or_two():
    r = np.random.default_rng(75)
    lo = r.integers(-(2**62), 2**62, 200)
    lo, hi = (x.ravel() for x in np.meshgrid(lo, lo))
    some = (lo < hi) & (r.random(len(lo)) < 0.3)
    lo, hi, out = lo[some], hi[some], r.random(some.sum()) < 0.5
    a, b = (lo % 2).astype(np.int32), (hi % 2).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, lo, hi, out)], names=["a", "b", "lo", "hi", "out"])
    packs = pa.Table.from_batches(judged._pack(iter([batch.slice(0, 100), batch.slice(100)])))
    assert packs.num_rows == 4 and sum(len(x.as_py()) for x in packs.column("marks")) < 3 * len(lo)
    back = []
    for k in range(packs.num_rows):
        said = judged._unpacked(packs.slice(k, 1)).to_pydict()
        back += [(packs["a"][k].as_py(), packs["b"][k].as_py(), *x) for x in zip(said["lo"], said["hi"], said["out"], strict=True)]
    assert sorted(back) == sorted(zip(a.tolist(), b.tolist(), lo.tolist(), hi.tolist(), out.tolist(), strict=True))
    assert judged._unpacked(packs.slice(0, 0)).num_rows == 0


def test_only_positives_are_shifted_where_they_are_placed(spark):
    shared, vectors, stories, want = made(spark, 50, 71)

    def shift(lo, hi):
        if lo.ndim > 1:
            raise ValueError("all pairs that meet were shifted")
        return 0.0 * lo

    found = judged.Judged(shared, vectors, stories)._positives(lambda code, values: {"code": np.unique(code), "pairs": np.bincount(code)[np.unique(code)]}, "pairs long", shift)
    assert sum(x.pairs for x in found.collect()) == sum(y == 1 and s is not None for y, s in want.values())
