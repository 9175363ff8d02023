"""Pairs that are counted instead of made, packing without a walk, and an inverted index beside whole products."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import chunks, cluster, gold, metrics, retrieval
from tidewell.operators.cluster import Tuning

SHARED = "labeller string, id long, story long, main_story long"


@pytest.mark.parametrize("most", [10, 2, 0])
def test_pairs_that_share_a_key(spark, most):
    r = random.Random(61)
    rows = [(i, r.choice("xy"), sorted(r.sample(range(9), r.choice([0, 1, 1, 2, 3, 5])))) for i in range(120)] + [(1000 + i, "x", [1, 2, 3, 4]) for i in range(15)]
    df = spark.createDataFrame([(i, b, [str(k) for k in ks]) for i, b, ks in rows], "id long, by string, keys array<string>")
    want = Counter(a[1] for a, b in combinations(rows, 2) if a[1] == b[1] and set(a[2]) & set(b[2]))
    found = {x["by"]: x.pairs for x in gold.shared_pairs(df, ["by"], most).collect()}
    assert found == dict(want)
    assert gold.shared_pairs(df.limit(0), ["by"], most).count() == 0


def test_signals_of_all_pairs(spark):
    r = random.Random(62)
    none = lambda v: v if r.random() < 0.7 else None
    rows = [(i, r.choice(["s", "t", None]), none(r.choice(["", "1", "2", str(i)])), none([r.choice(["ad", f"l{r.randrange(60)}", None]) for _ in range(2)]), none([f"m{r.randrange(40)}"] * 2)) for i in range(150)]
    posts = spark.createDataFrame(rows, "id long, story string, quoted_id string, urls array<string>, media_keys array<string>")
    n = Counter(u for x in rows for u in set(x[3] or []) if u is not None)
    key = lambda x: ({("q", x[2])} if x[2] else set()) | {("u", u) for u in x[3] or [] if u is not None and n[u] <= 4} | {("m", m) for m in x[4] or []}
    tp = fp = fn = 0
    for a, b in combinations([x for x in rows if x[1]], 2):
        said, same = bool(key(a) & key(b)), a[1] == b[1]
        tp, fp, fn = tp + (said and same), fp + (said and not same), fn + (same and not said)
    found = metrics.exact_signals_of_all(posts).first()
    assert (found.pairs_caught, found.false_pairs) == (tp, fp) and found.recall == pytest.approx(tp / (tp + fn))


def overlaps_of(r, n):
    return [(w, i, r.randrange(4), r.choice([0, 1, 2, None])) for w in "abc" for i in range(n) if r.random() < 0.6]


def test_judgement_and_counts_of_classes(spark):
    rows = overlaps_of(random.Random(63), 40)
    shared = spark.createDataFrame(rows, SHARED)
    sides = {}
    for w in "abc":
        for x, y in combinations(sorted((x for x in rows if x[0] == w), key=lambda x: x[1]), 2):
            main, other = x[3] is not None and x[3] == y[3], x[2] == y[2]
            sides.setdefault((x[1], y[1]), []).append((main, other))
    want = {}
    for pair, s in sides.items():
        want[pair] = 1 if any(m and o for m, o in s) else None if any(m for m, _ in s) != any(o for _, o in s) else 0
    pairs = spark.createDataFrame(list(combinations(range(42), 2)), "lo long, hi long")
    found = {(x.lo, x.hi): x.y for x in gold.judge(pairs, shared).collect()}
    assert found == {p: want.get(p) for p in combinations(range(42), 2)}
    counts, kinds = gold.pair_counts(shared).first().asDict(), Counter(want.values())
    assert counts == {"judged": len(want), "positive": kinds[1], "negative": kinds[0], "disputed": kinds[None]}
    assert {(x.lo, x.hi): x.y for x in gold.gold_pairs(shared).collect()} == {p: y for p, y in want.items() if y is not None}
    small, large = gold.gold_form(shared), gold.gold_form(shared, 10)
    assert set(small) == {"pairs"} and set(large) == {"rows", "counts"} and large["rows"].count() == len({x[1] for x in rows})


def test_a_large_overlap_is_counted_without_its_pairs(spark):
    n = 100_000
    shared = spark.range(n).select(F.lit("b").alias("labeller"), "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("story"), (F.col("id") % 50).alias("main_story"))
    both = shared.groupBy("story", "main_story").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    found = gold.pair_counts(shared).first()
    assert found.judged == n * (n - 1) // 2 and found.positive == both and found.judged == found.positive + found.negative + found.disputed
    assert not gold.is_enumerable(shared) and gold.judge(spark.createDataFrame([(0, 3), (1, 2)], "lo long, hi long"), shared).count() == 2


def walked(groups, size):
    out, chunk, waiting, held = {}, 0, [], 0
    for g, n, _ in sorted(groups, key=lambda x: (-x[1], x[2], x[0])):
        if n >= size:
            out[g] = chunk
            chunk += 1
            continue
        if waiting and held + n > size:
            out |= dict.fromkeys(waiting, chunk)
            chunk, waiting, held = chunk + 1, [], 0
        waiting.append(g)
        held += n
    return out | dict.fromkeys(waiting, chunk)


@pytest.mark.parametrize("seed", range(6))
def test_chunks_are_those_of_a_walk(spark, seed):
    r = random.Random(seed)
    size = r.choice([1, 5, 20, 220])
    groups = [(f"g{k}", max(1, int(r.expovariate(3 / size))), r.randrange(50)) for k in range(r.choice([1, 30, 400]))]
    df = spark.createDataFrame(groups, "grp string, n long, first long")
    assert {x.grp: x.chunk for x in chunks.chunk_of_groups(df, size).collect()} == walked(groups, size)


def test_chunks_of_nothing(spark):
    assert chunks.chunk_of_groups(spark.createDataFrame([], "grp string, n long, first long")).count() == 0


def test_the_index_stops_early_and_finds_the_same(monkeypatch):
    r = np.random.default_rng(64)
    monkeypatch.setattr(retrieval, "FIRST", 4)
    n, n_features, whole = 300, 500, []
    weights = np.where(r.random((n, n_features)) < 0.05, r.random((n, n_features)) ** 4, 0)
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
    story, feature = np.nonzero(weights)
    block = retrieval.Block(np.arange(n) + 1000, np.bincount(story, minlength=n), feature, weights[story, feature], n_features)
    real = block._whole
    monkeypatch.setattr(block, "_whole", lambda stories, *text: (whole.append(len(stories)), real(stories, *text))[1])
    for k in (1, 3, 8):
        for _ in range(100):
            features = np.sort(r.choice(n_features, r.integers(1, 40), replace=False))
            w = r.random(len(features)) ** 6
            w /= np.linalg.norm(w)
            sims = weights[:, features] @ w
            able = np.flatnonzero(sims > 0)
            best = able[np.lexsort((able, -np.round(sims[able], 9)))[:k]]
            places, near = block.top(features, w, k)
            assert places.tolist() == (best + 1000).tolist() and np.allclose(near, sims[best])
    assert whole and np.mean(whole) < n / 10  # where bounds cut, few stories are multiplied whole


def test_pairs_of_one_group_are_dealt_over_tasks(spark):
    rows = spark.range(5000).selectExpr("'l' as labeller", "id")
    found = gold.same_pairs(rows, "labeller").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi")).collect()
    assert len(found) > 1
    n = 5000 * 4999 // 2
    assert sum(r.n for r in found) == n and sum(r.lo for r in found) == sum(k * (4999 - k) for k in range(5000)) and sum(r.hi for r in found) == sum(k * k for k in range(5000))


def test_collapse_decides_from_a_tuning_s_own_edges(spark, monkeypatch):
    """What decides few edges in one task reads those alone, not all edges through a filter."""
    plans, real = [], metrics.members_of
    monkeypatch.setattr(metrics, "members_of", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges))
    at = np.random.default_rng(3).normal(size=(60, 8))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, k, v.tolist(), k % 7) for k, v in enumerate(at)], "pos long, id long, vec array<double>, author long")
    shared = spark.createDataFrame([("b", k, k % 4, k % 5) for k in range(60)], "labeller string, id long, story long, main_story long")
    grid = [Tuning(0.3), Tuning(0.4, window=10, other_author=True)]
    found = metrics.simulate_collapse(vectors, 60, shared, grid).collect()
    assert len(found) == 2 and all(r.hidden > 0 for r in found)
    assert plans and not any("Filter" in p or "Join" in p for p in plans)


@pytest.mark.parametrize("most", [cluster.REPS_BYTES, 0])
def test_collapse_meets_representatives_alone(spark, monkeypatch, most):
    """Where only a threshold decides no pair of two rows that join others is made, and a walk in order hides the same rows."""
    monkeypatch.setattr(cluster, "FIRST_ROWS", 16)
    monkeypatch.setattr(cluster, "STEP", 7)
    monkeypatch.setattr(cluster, "REPS_BYTES", most)
    pairs, real = [], metrics.similar_pairs
    monkeypatch.setattr(metrics, "similar_pairs", lambda *a: pairs.append(a[2]) or real(*a))
    n = 400
    at = np.random.default_rng(8).normal(size=(n, 6))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, 3 * k, v.tolist(), 0) for k, v in enumerate(at)], "pos long, id long, vec array<double>, author long")
    sim, reps, first, best = at @ at.T, [], {}, {}
    for k in range(n):
        near = [r for r in reps if sim[k, r] >= 0.5]
        if near:
            first[k], best[k] = near[0], max(near, key=lambda r: sim[k, r])
        else:
            reps.append(k)
    found = cluster.represented(vectors, 0.5)
    assert (found is None) == (most == 0)
    if found is not None:
        assert {r.i: (r.first, r.best) for r in found.collect()} == {k: (first[k], best[k]) for k in first}
    shared = spark.createDataFrame([("b", 3 * k, k % 4, k % 5) for k in range(n)], "labeller string, id long, story long, main_story long")
    told = {r.rule: (r.hidden, r.correct, r.wrong, r.unjudged) for r in metrics.simulate_collapse(vectors, n, shared, [Tuning(0.5), Tuning(0.5, rule="best")]).collect()}
    for rule, rep in (("first", first), ("best", best)):
        same = [(k % 4 == j % 4, k % 5 == j % 5) for k, j in rep.items()]
        right, disputed = sum(a and b for a, b in same), sum(a != b for a, b in same)
        assert told[rule] == (len(rep), right, len(rep) - right - disputed, disputed)
    assert pairs == ([] if most else [None])
