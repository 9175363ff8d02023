"""Queries that reconcile label sets made from `embeddings` and score similarities and clusters against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, metrics
from ..operators.cluster import Tuning, cluster
from ..operators.judged import Judged
from ..schemas import table
from ..storage import cut, numbered
from .clusters import greedy_sql, posts
from .registry import query


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labellers: main has all rows, b four of five, c every third; b and c each differ from main in some."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    main = e.select(F.lit("main").alias("labeller"), "id", F.col("label").cast("long").alias("story"))
    b = e.where("id % 5 <> 0").select(F.lit("b"), "id", F.expr("bigint(if(id % 7 = 0, label * 10 + 1, label))"))
    c = e.where("id % 3 = 0").select(F.lit("c"), "id", F.expr("bigint(if(id % 11 = 0, 99, label))"))
    return main.union(b).union(c)


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.overlaps(labels(spark, sf_dir), "main")


_LABELS = """
lab AS (
  SELECT 'main' AS labeller, vec_id AS id, label::BIGINT AS story FROM embeddings
  UNION ALL SELECT 'b', vec_id, CASE WHEN vec_id % 7 = 0 THEN label * 10 + 1 ELSE label END FROM embeddings WHERE vec_id % 5 <> 0
  UNION ALL SELECT 'c', vec_id, CASE WHEN vec_id % 11 = 0 THEN 99 ELSE label END FROM embeddings WHERE vec_id % 3 = 0),
ov AS (SELECT l.labeller, l.id, l.story, m.story AS main_story FROM lab l JOIN lab m ON m.id = l.id AND m.labeller = 'main' WHERE l.labeller <> 'main'),
allp AS MATERIALIZED (
  SELECT x.labeller, x.id AS lo, y.id AS hi, x.main_story = y.main_story AS a, x.story = y.story AS b FROM ov x JOIN ov y ON x.labeller = y.labeller AND x.id < y.id),
pairs AS MATERIALIZED (
  SELECT lo, hi, bool_or(a AND b) AS pos, bool_or(a) AS sa, bool_or(b) AS sb FROM allp GROUP BY lo, hi),
gold AS MATERIALIZED (SELECT lo, hi, CASE WHEN pos THEN 1 ELSE 0 END AS y FROM pairs WHERE pos OR sa = sb)"""


@query(f"WITH {_LABELS} SELECT labeller, lo, hi FROM allp WHERE a")
def pair_expand(spark, sf_dir):
    own = shared(spark, sf_dir).select("labeller", "id", "main_story")
    return gold.same_pairs(own, "labeller", "main_story").select("labeller", "lo", "hi")


@query(f"""WITH {_LABELS}
SELECT labeller, count(*) AS pairs, count(*) FILTER (WHERE a AND b) AS both_same, count(*) FILTER (WHERE a <> b) AS disagreed, count(*) FILTER (WHERE a = b) AS agreed,
       (SELECT count(*) FROM ov WHERE ov.labeller = allp.labeller) AS posts FROM allp GROUP BY labeller""")
def agreement(spark, sf_dir):
    return gold.agreement(shared(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT y, count(*) AS pairs, sum(lo)::BIGINT AS lo_sum, sum(hi)::BIGINT AS hi_sum FROM gold GROUP BY y")
def gold_pair_counts(spark, sf_dir):
    return gold.pair_sums(shared(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT lo, hi FROM pairs WHERE sa <> sb")
def disputed_pairs(spark, sf_dir):
    return gold.disputed(shared(spark, sf_dir))


@query(f"""WITH {_LABELS}
SELECT lo, hi, y FROM (SELECT x.vec_id AS lo, z.vec_id AS hi FROM embeddings x JOIN embeddings z ON z.vec_id = x.vec_id + 1 + x.vec_id % 9)
LEFT JOIN gold USING (lo, hi)""")
def judge_pairs(spark, sf_dir):
    """Pairs of rows near each other: same, different, or not for the labellers to say."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    near = e.select(F.col("vec_id").alias("lo"), F.expr("vec_id + 1 + vec_id % 9").alias("hi")).join(e.select(F.col("vec_id").alias("hi")), "hi", "left_semi")
    return gold.judge(near, shared(spark, sf_dir)).select("lo", "hi", "y")


@query(f"""WITH RECURSIVE {_LABELS},
dbl AS (SELECT DISTINCT id FROM ov),
star AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY labeller, story, main_story) AS hub FROM ov),
edge AS MATERIALIZED (SELECT id AS a, hub AS b FROM star UNION SELECT hub, id FROM star),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
single AS (
  SELECT id, arg_min(CASE labeller WHEN 'b' THEN 'b_' WHEN 'c' THEN 'c_' ELSE 'm_' END || story, CASE labeller WHEN 'b' THEN 0 WHEN 'c' THEN 1 ELSE 2 END) AS story FROM lab GROUP BY id)
SELECT id, CASE WHEN root IS NOT NULL THEN 's_' || root ELSE story END AS story FROM single LEFT JOIN root USING (id)""")
def gold_clusters(spark, sf_dir):
    return gold.gold_clusters(shared(spark, sf_dir), labels(spark, sf_dir), {"b": "b", "c": "c", "main": "m"})


@query(f"""WITH {_LABELS}, g AS (SELECT labeller, story, count(*) AS n FROM lab GROUP BY ALL)
SELECT labeller, sum(n)::BIGINT AS "rows", count(*) AS stories, count(*) FILTER (WHERE n > 1) AS multi, max(n) AS largest, sum(n * (n - 1) // 2)::BIGINT AS pairs FROM g GROUP BY labeller""")
def story_sizes(spark, sf_dir):
    return gold.story_sizes(labels(spark, sf_dir))


@query(f"""WITH {_LABELS}, g AS (SELECT labeller, story, count(*) AS size FROM lab GROUP BY ALL) SELECT labeller, size, count(*) AS stories FROM g GROUP BY ALL""")
def story_size_histogram(spark, sf_dir):
    return gold.size_histogram(labels(spark, sf_dir))


@query(f"""WITH {_LABELS}, m AS (SELECT labeller, id, CASE WHEN story > 10 THEN story % 10 ELSE story END AS story FROM lab),
n AS (SELECT *, count(*) OVER (PARTITION BY labeller, story) AS n FROM m)
SELECT labeller, id, CASE WHEN id % 13 = 0 AND n > 1 THEN 'solo_' || id ELSE story::VARCHAR END AS story FROM n""")
def story_corrections(spark, sf_dir):
    """Stories over ten are merged into those of their last digit; every thirteenth row is put out of its story."""
    rows = labels(spark, sf_dir)
    renames = rows.select("story").distinct().where("story > 10").select("story", (F.col("story") % 10).alias("merged_story"))
    return gold.evicted(gold.merged(rows, renames), rows.where("id % 13 = 0").select("id"))


def met(spark: SparkSession, sf_dir: str) -> Judged:
    """All gold pairs and the similarities of their rows."""
    return Judged(shared(spark, sf_dir), posts(spark, sf_dir), stories(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sim (6 digits), y and n: how many gold pairs have it."""
    return met(spark, sf_dir).tally()


_SCORED = _LABELS + """,
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
scored AS MATERIALIZED (SELECT lo, hi, y, a.label AS story, round(list_dot_product(a.e, b.e), 6) AS sim FROM gold JOIN v a ON a.vec_id = lo JOIN v b ON b.vec_id = hi)"""


def _sweep_sql(low: int, high: int, per: int, undefined: str) -> str:
    return _SCORED + f""",
taus AS (SELECT k / {per} AS tau FROM range({low}, {high}) t(k)),
c AS (SELECT tau, count(*) FILTER (WHERE sim >= tau AND y = 1) AS tp, count(*) FILTER (WHERE sim >= tau AND y = 0) AS fp, count(*) FILTER (WHERE sim < tau AND y = 1) AS fn, count(*) AS n
      FROM taus CROSS JOIN scored GROUP BY tau),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {undefined} END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
swept AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


@query("WITH " + _sweep_sql(50, 96, 100, "0") + """
SELECT round(tau, 6)::DOUBLE AS tau, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, round((tp + fp) / n, 6) AS pair_fold_rate FROM swept""")
def threshold_sweep(spark, sf_dir):
    swept = metrics.sweep(scored(spark, sf_dir))
    return swept.select(F.round("tau", 6).alias("tau"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "pair_fold_rate")])


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(scored(spark, sf_dir), metrics.FINE, undefined_precision=1.0)


@query("WITH " + _sweep_sql(20, 199, 200, "1") + """
SELECT round(tau, 6)::DOUBLE AS tau, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, tau <= 0.105 OR tau >= 0.99 AS edge FROM swept ORDER BY f1 DESC, tau LIMIT 1""")
def best_f1(spark, sf_dir):
    return metrics.best_f1(_fine(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("tau", "precision", "recall", "f1")], "edge")


@query("WITH " + _sweep_sql(20, 199, 200, "1") + """
SELECT target::DOUBLE AS target, round(min(tau) FILTER (WHERE p >= target AND r > 0), 6)::DOUBLE AS tau FROM swept CROSS JOIN (VALUES (0.05), (0.2), (0.8), (0.9), (0.95)) t(target) GROUP BY target""")
def operating_points(spark, sf_dir):
    return metrics.operating_points(_fine(spark, sf_dir), (0.05, 0.2, *metrics.TARGETS)).select("target", F.round("tau", 6).alias("tau"))


_WON = _SCORED + """,
neg AS (SELECT sim, count(*) AS n FROM scored WHERE y = 0 GROUP BY sim),
won AS (SELECT p.lo, p.story, (coalesce((SELECT sum(n) FROM neg WHERE neg.sim < p.sim), 0) + 0.5 * coalesce((SELECT sum(n) FROM neg WHERE neg.sim = p.sim), 0)) / (SELECT sum(n) FROM neg) AS won
        FROM scored p WHERE y = 1)"""


@query(f"WITH {_WON} SELECT round(avg(won), 6) AS auc FROM won")
def auc_pooled(spark, sf_dir):
    return metrics.pooled_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("story"))


@query(f"WITH {_WON} SELECT story, count(*) AS n_pairs, round(avg(won), 6) AS auc FROM won GROUP BY story HAVING count(*) >= 3")
def auc_per_story(spark, sf_dir):
    return met(spark, sf_dir).story_auc().select("story", "n_pairs", F.round("auc", 6).alias("auc"))


@query(f"WITH {_WON} SELECT round(avg(auc), 6) AS macro_auc, count(*) AS n_stories FROM (SELECT avg(won) AS auc FROM won GROUP BY story HAVING count(*) >= 3)")
def auc_macro(spark, sf_dir):
    return metrics.macro_auc(met(spark, sf_dir).story_auc()).select(F.round("macro_auc", 6).alias("macro_auc"), "n_stories")


@query(greedy_sql("""
, c AS (SELECT label AS a, cluster_id AS b, count(*)::DOUBLE AS n FROM placed GROUP BY ALL),
t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS r,
             (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS k, (SELECT sum(n) FROM c) AS n)
SELECT round((x - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) AS ari FROM t"""))
def adjusted_rand_index(spark, sf_dir):
    placed = cluster(posts(spark, sf_dir), Tuning(0.3)).join(stories(spark, sf_dir), "id")
    return metrics.adjusted_rand(placed, "story", "cluster_id").select(F.round("ari", 6).alias("ari"))


def _collapse_sql(tau: float, where: str, best: bool, window: int) -> str:
    tail = f""", {_LABELS},
h AS (SELECT least(vec_id, cluster_id) AS lo, greatest(vec_id, cluster_id) AS hi FROM placed WHERE vec_id <> cluster_id),
s AS (SELECT count(*) AS hidden, count(*) FILTER (WHERE y = 1) AS correct, count(*) FILTER (WHERE y = 0) AS wrong, count(*) FILTER (WHERE y IS NULL) AS unjudged FROM h LEFT JOIN gold USING (lo, hi))
SELECT {tau}::DOUBLE AS tau, '{"best" if best else "first"}' AS rule, {window}::BIGINT AS "window", hidden, correct, wrong, unjudged, round(hidden / (SELECT count(*) FROM embeddings), 6) AS rate,
       round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) END, 6) AS "precision", round(CASE WHEN hidden > 0 THEN unjudged / hidden ELSE 0 END, 6) AS unjudged_share FROM s"""
    return greedy_sql(tail, tau, where, best)


_GRID = [(Tuning(0.3), "TRUE"), (Tuning(0.3, rule="best"), "TRUE"), (Tuning(0.3, window=50), "a.vec_id - b.vec_id <= 50"), (Tuning(0.4, window=400, other_author=True), "a.vec_id - b.vec_id <= 400 AND a.vec_id % 37 <> b.vec_id % 37")]


@query(" UNION ALL ".join(f"SELECT * FROM ({_collapse_sql(t.tau, where, t.rule == 'best', t.window or 0)})" for t, where in _GRID))
def collapse_simulation(spark, sf_dir):
    rows = cut(numbered(posts(spark, sf_dir), "seq", "id"))
    out = metrics.simulate_collapse(rows, rows.count(), shared(spark, sf_dir), [t for t, _ in _GRID])
    return out.select("tau", "rule", "window", "hidden", "correct", "wrong", "unjudged", *[F.round(c, 6).alias(c) for c in ("rate", "precision", "unjudged_share")])


@query("""
WITH g AS (SELECT a.vec_id - b.vec_id AS gap FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
SELECT round(quantile_cont(gap, 0.5), 6)::DOUBLE AS median, round(quantile_cont(gap, 0.9), 6)::DOUBLE AS p90, round(avg((gap <= 100)::INT), 6) AS within_100, round(avg((gap <= 400)::INT), 6) AS within_400 FROM g""")
def gap_profile(spark, sf_dir):
    rows = numbered(posts(spark, sf_dir).select("id", "seq", F.col("label").alias("story")), "seq", "id")
    found = metrics.gap_profile(rows, (100, 400))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def _noisy(k: int) -> str:
    return f"(p.sim + (((p.lo * 31 + p.hi * 17 + {k}) % 1000) / 1000.0 - 0.5) * {k * 0.2})"


_EACH = " UNION ALL ".join(f"""
SELECT '{name}' AS model, story, avg(won) AS auc FROM (
  SELECT p.story, ((SELECT count(*) FROM noisy{k} q WHERE q.y = 0 AND q.s < p.s) + 0.5 * (SELECT count(*) FROM noisy{k} q WHERE q.y = 0 AND q.s = p.s)) / (SELECT count(*) FROM noisy{k} q WHERE q.y = 0) AS won
  FROM noisy{k} p WHERE p.y = 1) GROUP BY story HAVING count(*) >= 3""" for k, name in enumerate(("plain", "noisy", "noisiest")))


@query("WITH " + _SCORED + "".join(f", noisy{k} AS MATERIALIZED (SELECT lo, hi, y, story, {_noisy(k)} AS s FROM scored p)" for k in range(3)) + f""",
each AS ({_EACH}),
wide AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY story) - 1 AS nth, * FROM (
    SELECT story, max(auc) FILTER (WHERE model = 'plain') AS m0, max(auc) FILTER (WHERE model = 'noisy') AS m1, max(auc) FILTER (WHERE model = 'noisiest') AS m2 FROM each GROUP BY story)
  WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL),
n AS (SELECT count(*) AS n FROM wide),
drawn AS (SELECT k, (('0x' || substr(md5('42:' || k || ':' || j), 1, 8))::BIGINT) % n AS nth FROM n, range(20000) a(k), range((SELECT n FROM n)) b(j)),
means AS (SELECT k, avg(m0) AS m0, avg(m1) AS m1, avg(m2) AS m2 FROM drawn JOIN wide USING (nth) GROUP BY k),
d AS (SELECT 'plain' AS a, 'noisy' AS b, m0 - m1 AS d FROM means UNION ALL SELECT 'noisy', 'noisiest', m1 - m2 FROM means UNION ALL SELECT 'plain', 'noisiest', m0 - m2 FROM means),
w AS (SELECT avg(m0) AS m0, avg(m1) AS m1, avg(m2) AS m2 FROM wide),
whole AS (SELECT 'plain' AS a, 'noisy' AS b, m0 - m1 AS delta FROM w UNION ALL SELECT 'noisy', 'noisiest', m1 - m2 FROM w UNION ALL SELECT 'plain', 'noisiest', m0 - m2 FROM w)
SELECT a, b, round(any_value(delta), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d > 0)::INT), 6) AS p, quantile_cont(d, 0.025) > 0 AS significant
FROM d JOIN whole USING (a, b) GROUP BY a, b""")
def bootstrap_models(spark, sf_dir):
    """Three models of more and more noise, on the same stories."""
    pairs, each = met(spark, sf_dir), None
    for k, name in enumerate(("plain", "noisy", "noisiest")):
        noise = lambda lo, hi, k=k: ((lo * 31 + hi * 17 + k) % 1000 / 1000 - 0.5) * (k * 0.2)
        one = pairs.story_auc(shift=noise if k else None).select(F.lit(name).alias("model"), "story", "auc")
        each = one if each is None else each.union(one)
    out = metrics.bootstrap(each, ["plain", "noisy", "noisiest"])
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi", "p")], "significant")


def signal_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts that quote, link and show: quoted post by id, links by source and id, images by length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("q"), (F.col("doc_id") % 30).cast("string"))).alias("quoted_id"),
        F.array(F.concat(F.lit("http://"), "source"), F.concat(F.lit("http://u/"), F.expr("string(doc_id div 3)"))).alias("urls"),
        F.when(F.col("n_chars") % 5 == 0, F.array(F.col("n_chars").cast("string"))).otherwise(F.array().cast("array<string>")).alias("media_keys"), "lang",
    )


_SIGNALS = """WITH p AS (
  SELECT doc_id AS id, source, lang, CASE WHEN doc_id % 6 = 0 THEN 'q' || (doc_id % 30) END AS quoted, ['http://' || source, 'http://u/' || (doc_id // 3)] AS urls,
         CASE WHEN n_chars % 5 = 0 THEN [n_chars::VARCHAR] ELSE []::VARCHAR[] END AS media FROM documents),
f AS MATERIALIZED (SELECT url, count(DISTINCT id) AS n FROM (SELECT id, unnest(urls) AS url FROM p) GROUP BY url)"""


@query(_SIGNALS + " SELECT url, n, n > 4 AS boilerplate FROM f")
def url_frequency(spark, sf_dir):
    return metrics.url_frequency(signal_posts(spark, sf_dir))


@query(_SIGNALS + """,
c4 AS (SELECT list(url) AS common FROM f WHERE n > 4),
u AS (SELECT id, quoted, media, lang, list_filter(urls, lambda x: NOT list_contains(common, x)) AS urls FROM p CROSS JOIN c4),
j AS (SELECT (x.lang = y.lang)::INT AS y, coalesce(x.quoted = y.quoted, FALSE) OR list_has_any(x.urls, y.urls) OR list_has_any(x.media, y.media) AS said
      FROM u x JOIN u y ON y.id BETWEEN x.id + 1 AND x.id + 40),
c AS (SELECT count(*) FILTER (WHERE said AND y = 1) AS tp, count(*) FILTER (WHERE said AND y = 0) AS fp, count(*) FILTER (WHERE NOT said AND y = 1) AS fn FROM j)
SELECT round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1,
       tp AS pairs_caught, fp AS false_pairs FROM c""")
def exact_signals(spark, sf_dir):
    """Each document with the forty after it; the same language counts as the same story."""
    p = signal_posts(spark, sf_dir)
    near = p.select(F.col("id").alias("lo"), F.col("lang").alias("la"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 40)).alias("hi"))
    pairs = near.join(p.select(F.col("id").alias("hi"), F.col("lang").alias("lb")), "hi").select("lo", "hi", (F.col("la") == F.col("lb")).cast("int").alias("y"))
    out = metrics.exact_signals(pairs, p)
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "pairs_caught", "false_pairs")


@query(_SIGNALS + """,
c4 AS (SELECT list(url) AS common FROM f WHERE n > 4),
u AS (SELECT id, quoted, media, lang, list_filter(urls, lambda x: NOT list_contains(common, x)) AS urls FROM p CROSS JOIN c4),
j AS (SELECT x.lang = y.lang AS y, coalesce(x.quoted = y.quoted, FALSE) OR list_has_any(x.urls, y.urls) OR list_has_any(x.media, y.media) AS said FROM u x JOIN u y ON y.id > x.id),
c AS (SELECT count(*) FILTER (WHERE said AND y) AS tp, count(*) FILTER (WHERE said AND NOT y) AS fp, count(*) FILTER (WHERE NOT said AND y) AS fn FROM j)
SELECT round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1,
       tp AS pairs_caught, fp AS false_pairs FROM c""")
def exact_signals_all(spark, sf_dir):
    """All pairs of documents, counted from what they share; the same language counts as the same story."""
    out = metrics.exact_signals_of_all(signal_posts(spark, sf_dir).withColumnRenamed("lang", "story"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "pairs_caught", "false_pairs")


@query(f"""WITH {_LABELS}
SELECT count(*) AS judged, count(*) FILTER (WHERE pos) AS positive, count(*) FILTER (WHERE NOT pos AND sa = sb) AS negative, count(*) FILTER (WHERE sa <> sb) AS disputed FROM pairs""")
def gold_pair_totals(spark, sf_dir):
    """How many pairs of each kind there are, by what rows have in common."""
    return gold.pair_counts(shared(spark, sf_dir))
