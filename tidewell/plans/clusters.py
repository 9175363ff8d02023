"""Queries that cluster the vectors of `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.cluster import Tuning, cluster, stats, view
from ..operators.similarity import similar_pairs
from ..schemas import table, vectors_of
from ..sources import memory
from ..storage import numbered
from .registry import query


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(table(spark, sf_dir, "embeddings"))


def greedy_sql(tail: str, tau: float = 0.3, where: str = "TRUE", best: bool = False, prior: str = "FALSE", row_tau: str | None = None) -> str:
    """A sequential walk over rows in order. tail: a SELECT over `placed` (vec_id, cluster_id). prior: which a are representatives whatever they resemble."""
    pick = "list_filter(nb.jb, lambda x: NOT list_contains(g.members, x))[1]" if best else "list_min(list_filter(nb.js, lambda x: NOT list_contains(g.members, x)))"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
edges AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON b.vec_id < a.vec_id
  WHERE list_dot_product(a.e, b.e) >= {row_tau or tau} AND ({where}) AND NOT ({prior})),
nb AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY i) AS rn, i, js, jb
  FROM (SELECT i, list(j ORDER BY j) AS js, list(j ORDER BY s DESC, j) AS jb FROM edges GROUP BY i)),
g(rn, members, i, hit) AS (
  SELECT 0::BIGINT, []::BIGINT[], -1::BIGINT, -1::BIGINT
  UNION ALL
  SELECT nb.rn, CASE WHEN len(list_filter(nb.js, lambda x: NOT list_contains(g.members, x))) > 0 THEN list_append(g.members, nb.i) ELSE g.members END,
         nb.i, coalesce({pick}, nb.i)
  FROM g JOIN nb ON nb.rn = g.rn + 1),
placed AS (SELECT vec_id, label, coalesce(hit, vec_id) AS cluster_id FROM embeddings LEFT JOIN g ON g.i = vec_id)
{tail}"""


_PLACED = "SELECT vec_id, cluster_id FROM placed"


def _ids(clustered: DataFrame) -> DataFrame:
    return clustered.select(F.col("id").alias("vec_id"), "cluster_id")


@query(greedy_sql(_PLACED))
def cluster_greedy(spark, sf_dir):
    return _ids(cluster(posts(spark, sf_dir), Tuning(0.3)))


@query(greedy_sql(_PLACED, where="a.vec_id - b.vec_id <= 50"))
def cluster_windowed(spark, sf_dir):
    return _ids(cluster(posts(spark, sf_dir), Tuning(0.3, window=50)))


@query(greedy_sql(_PLACED, where="a.vec_id % 37 <> b.vec_id % 37"))
def cluster_author_exempt(spark, sf_dir):
    return _ids(cluster(posts(spark, sf_dir), Tuning(0.3, other_author=True)))


@query(greedy_sql(_PLACED, best=True))
def cluster_best(spark, sf_dir):
    return _ids(cluster(posts(spark, sf_dir), Tuning(0.3, rule="best")))


@query(greedy_sql(_PLACED, row_tau="(CASE WHEN a.vec_id >= 250 THEN 0.4 ELSE 0.3 END)"))
def cluster_threshold_change(spark, sf_dir):
    """The threshold rises on the way and holds for later rows only."""
    return _ids(cluster(posts(spark, sf_dir).withColumn("tau", F.when(F.col("id") >= 250, 0.4).otherwise(0.3)), Tuning(0.3)))


_PER_LABEL = """
SELECT label, count(*) AS posts, count(*) FILTER (WHERE cluster_id <> vec_id) AS folded,
       round(count(*) FILTER (WHERE cluster_id <> vec_id) / count(*), 6) AS folded_share FROM placed GROUP BY label"""


@query(greedy_sql(_PER_LABEL))
def cluster_folded_share(spark, sf_dir):
    """By label, the share of posts that a reader is spared."""
    rows = posts(spark, sf_dir)
    placed = cluster(rows, Tuning(0.3)).join(rows.select("id", "label"), "id")
    folded = F.count_if(F.col("cluster_id") != F.col("id"))
    return placed.groupBy("label").agg(F.count("*").alias("posts"), folded.alias("folded"), F.round(folded / F.count("*"), 6).alias("folded_share"))


_STATS = """
SELECT sum(n)::BIGINT AS posts, count(*) AS clusters, count(*) FILTER (WHERE n > 1) AS multi, sum(n - 1)::BIGINT AS collapsed, 0::BIGINT AS remembered
FROM (SELECT count(*) AS n FROM placed GROUP BY cluster_id)"""


@query(greedy_sql(_STATS))
def cluster_stats(spark, sf_dir):
    return stats(cluster(posts(spark, sf_dir), Tuning(0.3)))


_SIZES = ", sized AS (SELECT vec_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM placed)"


@query(greedy_sql(_SIZES + " SELECT vec_id FROM sized WHERE size >= 2 AND vec_id <> cluster_id"))
def duplicate_ids(spark, sf_dir):
    return view(cluster(posts(spark, sf_dir), Tuning(0.3))).where("is_dup").select(F.col("id").alias("vec_id"))


@query(greedy_sql(_SIZES + """
SELECT vec_id, cluster_id, size, vec_id = cluster_id AS is_rep, size >= 2 AND vec_id <> cluster_id AS is_dup, FALSE AS seen_before,
       CASE WHEN vec_id = cluster_id AND size > 1 THEN '+' || (size - 1) || ' similar post' || CASE WHEN size = 2 THEN '' ELSE 's' END END AS chip_text FROM sized"""))
def cluster_view(spark, sf_dir):
    return view(cluster(posts(spark, sf_dir), Tuning(0.3))).select(F.col("id").alias("vec_id"), "cluster_id", "size", "is_rep", "is_dup", "seen_before", "chip_text")


@query(greedy_sql("""
, live AS (SELECT vec_id, cluster_id, vec_id >= 100 OR vec_id % 10 = 0 AS live FROM placed),
sized AS (SELECT vec_id, cluster_id, live, sum(live::INT) OVER (PARTITION BY cluster_id) AS size, min(vec_id) OVER (PARTITION BY cluster_id) < 100 AS from_memory FROM live)
SELECT vec_id, cluster_id, size::BIGINT AS size, from_memory, live AND vec_id <> cluster_id AND size >= 2 AS is_dup, live AND from_memory AS seen_before FROM sized WHERE live
""", prior="a.vec_id < 100"))
def cluster_with_memory(spark, sf_dir):
    """The first hundred rows are remembered and every tenth of them comes again; the others come new."""
    rows = posts(spark, sf_dir)
    seen = view(cluster(rows.where("id >= 100 or id % 10 = 0"), Tuning(0.3), rows.where("id < 100").select("id", "vec", "author")))
    return seen.where("live").select(F.col("id").alias("vec_id"), "cluster_id", "size", "from_memory", "is_dup", "seen_before")


@query(greedy_sql("""
, live AS (SELECT cluster_id, vec_id >= 100 OR vec_id % 10 = 0 AS live FROM placed),
c AS (SELECT cluster_id, sum(live::INT) AS n, cluster_id < 100 AS memory FROM live GROUP BY cluster_id)
SELECT sum(n)::BIGINT AS posts, count(*) FILTER (WHERE n > 0) AS clusters, count(*) FILTER (WHERE n > 1) AS multi,
       sum(CASE WHEN memory THEN n ELSE greatest(n - 1, 0) END)::BIGINT AS collapsed, count(*) FILTER (WHERE n = 0) AS remembered FROM c
""", prior="a.vec_id < 100"))
def cluster_memory_stats(spark, sf_dir):
    rows = posts(spark, sf_dir)
    return stats(cluster(rows.where("id >= 100 or id % 10 = 0"), Tuning(0.3), rows.where("id < 100").select("id", "vec", "author")))


def _pairs_sql(where: str) -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT b.vec_id AS j, a.vec_id AS i, round(list_dot_product(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.vec_id < a.vec_id
WHERE list_dot_product(a.e, b.e) >= 0.3 AND {where}"""


def _pairs(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    rows = numbered(posts(spark, sf_dir), "seq", "id").withColumn("tau", F.lit(0.3))
    return _named_pairs(rows, **how).withColumn("sim", F.round("sim", 6))


def _named_pairs(rows: DataFrame, **how) -> DataFrame:
    found = similar_pairs(rows, rows.count(), **how)
    ids = rows.select("pos", F.col("id").alias("__id"))
    named = found.join(ids.withColumnRenamed("pos", "j"), "j").drop("j").withColumnRenamed("__id", "j")
    return named.join(ids.withColumnRenamed("pos", "i"), "i").drop("i").withColumnRenamed("__id", "i").select("j", "i", "sim")


@query(_pairs_sql("TRUE"))
def similarity_join(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(_pairs_sql("a.vec_id - b.vec_id <= 40"))
def similarity_band_join(spark, sf_dir):
    return _pairs(spark, sf_dir, window=40)


_QUANTISED = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM v),
q AS (SELECT vec_id, e, (CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE m END) / 127 AS s FROM s),
z AS (SELECT vec_id, e, s, list_transform(e, lambda x: greatest(least(floor(x / s + 0.5), 127), -127)) AS q FROM q)"""


_BENT = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
  SELECT 1000000 + vec_id, list_concat([embedding[1]::DOUBLE * -1], embedding[2:]::DOUBLE[]) FROM embeddings UNION ALL
  SELECT 2000000 + vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 10 = 0)"""


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, each again with its first number negated, and every tenth a third time as it is."""
    rows = posts(spark, sf_dir).select("id", "seq", "vec", "author")
    near = rows.withColumn("vec", F.concat(F.array(-F.col("vec")[0]), F.slice("vec", 2, F.size("vec") - 1)))
    later = lambda df, n: df.withColumn("id", F.col("id") + n).withColumn("seq", F.col("seq") + n)
    return rows.unionByName(later(near, 1_000_000)).unionByName(later(rows.where("id % 10 = 0"), 2_000_000))


@query(_BENT + """
SELECT b.vec_id AS j, a.vec_id AS i, round(list_dot_product(a.e, b.e), 6) AS sim, list_dot_product(a.e, b.e) >= 0.94 AS same FROM v a JOIN v b ON b.vec_id < a.vec_id
WHERE list_dot_product(a.e, b.e) >= 0.6""")
def similarity_near_copies(spark, sf_dir):
    """Pairs at a threshold where pivots and bounds leave few products to make; same: those that the default threshold folds."""
    rows = numbered(_bent(spark, sf_dir), "seq", "id")
    return _named_pairs(rows.withColumn("tau", F.lit(0.6))).withColumn("same", F.col("sim") >= 0.94).select("j", "i", F.round("sim", 6).alias("sim"), "same")


@query(greedy_sql("SELECT vec_id, coalesce(hit, vec_id) AS cluster_id FROM all_ids LEFT JOIN g ON g.i = vec_id", tau=0.94).replace(
    "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", "WITH RECURSIVE " + _BENT.replace("WITH v", "v", 1) + ", all_ids AS (SELECT vec_id FROM v)"))
def cluster_copies(spark, sf_dir):
    """Clusters at the default threshold where some vectors are copies; these follow the first of their kind."""
    return _ids(cluster(_bent(spark, sf_dir)))


@query(_QUANTISED + """
SELECT vec_id, round(s, 9) AS s, list_sum(q)::BIGINT AS q_sum, array_to_string(list_transform(q, lambda x: x::BIGINT), ',') AS q FROM z""")
def quantise(spark, sf_dir):
    v = posts(spark, sf_dir).select(F.col("id").alias("vec_id"), V.quantised("vec").alias("z"))
    return v.select("vec_id", F.round("z.s", 9).alias("s"), F.aggregate("z.q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("q_sum"), F.array_join(F.transform("z.q", lambda x: x.cast("string")), ",").alias("q"))


@query(_QUANTISED + """
, d AS (SELECT list_dot_product(e, q) * 1.0 / sqrt(list_dot_product(q, q)) AS c FROM z)
SELECT round(avg(1 - c), 6) AS mean_shift, round(max(1 - c), 6) AS max_shift FROM d""")
def dequantise_shift(spark, sf_dir):
    v = posts(spark, sf_dir).select("vec", V.quantised("vec").alias("z"))
    shift = 1 - V.dot("vec", V.dequantised("z.q", "z.s"))
    return v.agg(F.round(F.avg(shift), 6).alias("mean_shift"), F.round(F.max(shift), 6).alias("max_shift"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-9))), 6) AS total FROM v""")
def normalise(spark, sf_dir):
    """Every seventh vector is zero and stays so."""
    v = posts(spark, sf_dir).select("id", F.transform("vec", lambda x: x * (F.col("id") % 7)).alias("vec"))
    return v.select(F.col("id").alias("vec_id"), F.round(F.aggregate(V.normalised("vec"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
WITH h AS (SELECT vec_id, [embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[], embedding[33:48]::DOUBLE[]] AS h, 1 + vec_id % 3 AS n FROM embeddings)
SELECT vec_id, round(h[1][1], 6) AS cls, round(h[n][1], 6) AS last_token, round((h[1][1] + CASE WHEN n > 1 THEN h[2][1] ELSE 0 END + CASE WHEN n > 2 THEN h[3][1] ELSE 0 END) / n, 6) AS mean FROM h""")
def pooling(spark, sf_dir):
    """A vector's first three quarters of 16 as token vectors, of which the last are padding."""
    n = 1 + F.col("id") % 3
    hidden = F.array(*[F.slice("vec", 1 + 16 * k, 16) for k in range(3)])
    v = posts(spark, sf_dir).select("id", hidden.alias("h"), F.array(*[(n > k).cast("int") for k in range(3)]).alias("m"))
    first = lambda mode: F.round(V.pooled("h", "m", mode)[0], 6)
    return v.select(F.col("id").alias("vec_id"), first("cls").alias("cls"), first("lasttoken").alias("last_token"), first("mean").alias("mean"))


@query("""
WITH m AS (SELECT vec_id, TIMESTAMP '2024-01-31 00:00:00' - to_hours((vec_id % 400)::INT) AS t FROM embeddings)
SELECT vec_id::VARCHAR AS id, t FROM m WHERE t >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def memory_recall(spark, sf_dir):
    """Rows remembered over the last 400 hours, of which seven days are left."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = memory.remembered(posts(spark, sf_dir), now).withColumn("t", F.col("t") - F.make_dt_interval(F.lit(0), (F.col("id").cast("long") % 400).cast("int")))
    return memory.recalled(rows, now).select("id", "t")
