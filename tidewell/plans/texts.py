"""Queries over documents and pages: text functions, caps and chunks, retrieval of known stories, extraction, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import learnt
from ..functions import text as X
from ..functions.embed import embedded, lexical
from ..functions.labels import salvage
from ..operators import chunks, retrieval
from ..operators.cluster import Tuning, cluster
from ..schemas import table, vectors_of
from ..sources import html
from ..storage import cut, numbered, shared_dir
from ..streaming.engine import Engine
from . import clusters as _clusters  # noqa: F401  (its queries come first)
from .registry import SQL, query


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""
SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 90) AS one_line, left(replace(text, chr(10), ' / '), 260) AS slashed,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'x' || doc_id END AS trimmed FROM documents""")
def text_lines(spark, sf_dir):
    edged = F.when(F.col("doc_id") % 3 == 0, " 　\t").otherwise(F.concat(F.lit("  "), F.lit("x"), F.col("doc_id").cast("string"), F.lit("　\n")))
    return docs(spark, sf_dir).select("doc_id", X.one_line("text").alias("one_line"), X.slashed_lines("text").alias("slashed"), X.blank_to_null(edged).alias("trimmed"))


@query("""
SELECT doc_id, source AS author, doc_id::VARCHAR AS status_id, lang AS tail, least(doc_id, n_chars) * 100000 + greatest(doc_id, n_chars) AS pair_key,
       CASE WHEN doc_id < 500 THEN doc_id::INT END AS idx, CASE WHEN n_chars = 1 THEN 'post' ELSE 'posts' END AS noun,
       CASE WHEN doc_id % 2 = 0 THEN lang || '?' ELSE lang END AS asked, CASE WHEN doc_id % 2 = 0 THEN '؟' || lang ELSE lang END AS asked_rtl FROM documents""")
def text_fields(spark, sf_dir):
    link = F.concat(F.lit("https://x.com/"), "source", F.lit("/status/"), F.col("doc_id").cast("string"), F.lit("?s=20"))
    even = F.col("doc_id") % 2 == 0
    return docs(spark, sf_dir).select(
        "doc_id", X.permalink(link)["author"].alias("author"), X.permalink(link)["status_id"].alias("status_id"), X.path_tail(F.concat(F.lit("a/b/"), "lang")).alias("tail"),
        X.pair_key("doc_id", "n_chars", 100_000).alias("pair_key"), X.index_of(F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit(".")), 500).alias("idx"),
        F.concat(F.lit("post"), X.plural("n_chars")).alias("noun"), X.question("lang", even).alias("asked"), X.question("lang", even, False).alias("asked_rtl"),
    )


@query("""
SELECT doc_id, 'Page ' || doc_id AS page, '(' || (doc_id % 50) || '+) Page ' || doc_id || ' / X' AS title, source AS site, 'has ' || lang || ' news' AS headline,
       CASE WHEN n_chars < 10000 THEN format('{:,}', n_chars) ELSE format('{}K', CAST(round_even(n_chars / 1000.0, 0) AS INT)) END AS compact FROM documents""")
def text_titles(spark, sf_dir):
    page = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    title = X.title_of(page, F.concat(F.lit("("), (F.col("doc_id") % 50).cast("string"), F.lit("+) ")))
    line = X.headline(F.concat("source", F.lit(" has "), "lang", F.lit(" news")))
    return docs(spark, sf_dir).select("doc_id", X.title_page(title).alias("page"), title.alias("title"), line["site"].alias("site"), line["headline"].alias("headline"), X.compact_number("n_chars").alias("compact"))


@query("""
SELECT doc_id, CASE lang WHEN 'de' THEN 'Hallo' ELSE 'Hello' END AS greeting, CASE lang WHEN 'de' THEN 'a=Hallo' WHEN 'fr' THEN '' ELSE '' END AS difference,
       CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'some' ELSE 'none' END AS boxes, 'a=' || doc_id || ',b=2,z=9' AS updated FROM documents""")
def maps_and_locales(spark, sf_dir):
    words = {"en": {"a": "Hello"}, "de": {"a": "Hallo"}, "fr": {"a": ""}}
    as_map = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    catalogue = F.create_map(*[x for k, m in words.items() for x in (F.lit(k), as_map(m))])
    own = F.when(F.col("lang") == "de", as_map(words["de"])).otherwise(as_map(words["en"]))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    flags = F.array((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 3 == 1), F.col("doc_id") % 3 == 0)
    base = docs(spark, sf_dir).withColumn("own", own).withColumn("english", as_map(words["en"])).withColumn("messages", F.create_map(F.lit("z"), F.lit("9"), F.lit("old"), F.lit("1"), F.lit("a"), F.lit("0")))
    base = base.withColumn("updates", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("doc_id").cast("string")))
    return base.select(
        "doc_id", X.localised(catalogue, "lang", F.lit("a")).alias("greeting"), flat(X.locale_difference("own", "english")).alias("difference"),
        X.tristate(flags).alias("boxes"), flat(X.locale_update("messages", "updates", F.array(F.lit("old")))).alias("updated"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("author"), "text", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("trend"), "source")


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE length(trim(text)) >= 15) WHERE n <= 20""")
def cap_per_group(spark, sf_dir):
    """The crawl's cap: twenty posts of a source, each post once though it is delivered twice."""
    p = posts(spark, sf_dir)
    again = p.withColumn("seq", F.col("seq") + 1_000_000_000)
    return chunks.harvest(p.union(again), ["source"], 20).select(F.col("id").alias("doc_id"))


@query("""SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def dedupe_first(spark, sf_dir):
    return chunks.first_of_each(docs(spark, sf_dir).select("text", "doc_id"), "text", ["doc_id"])


@query("""SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text""")
def resume_last(spark, sf_dir):
    return chunks.last_of_each(docs(spark, sf_dir).select("text", "doc_id", F.col("doc_id").alias("at")), "text", "at").select("text", "doc_id")


@query("""SELECT doc_id, text FROM documents WHERE length(text) >= 40 ORDER BY doc_id LIMIT 20""")
def speed_texts(spark, sf_dir):
    return chunks.speed_texts(posts(spark, sf_dir)).select(F.col("id").alias("doc_id"), "text")


@query("""
WITH RECURSIVE p AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, '__' || source) AS grp, text FROM documents),
g AS (SELECT grp, count(*) AS n, min(doc_id) AS f FROM p GROUP BY grp),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS rn FROM g),
w(rn, grp, chunk, held, next, open) AS (
  SELECT 0::BIGINT, '', -1::BIGINT, 0::BIGINT, 0::BIGINT, -1::BIGINT
  UNION ALL
  SELECT o.rn, o.grp, CASE WHEN o.n >= 60 THEN w.next ELSE -2 END, CASE WHEN o.n >= 60 THEN w.held WHEN w.held > 0 AND w.held + o.n > 60 THEN o.n ELSE w.held + o.n END,
         CASE WHEN o.n >= 60 OR (w.held > 0 AND w.held + o.n > 60) THEN w.next + 1 ELSE w.next END,
         CASE WHEN o.n >= 60 THEN w.open WHEN w.held > 0 AND w.held + o.n > 60 THEN w.open + 1 ELSE greatest(w.open, 0) END
  FROM w JOIN o ON o.rn = w.rn + 1),
flush AS (SELECT open AS old, min(rn) AS rn FROM w WHERE chunk = -2 GROUP BY open),
named AS (
  SELECT grp, CASE WHEN chunk >= 0 THEN chunk ELSE coalesce((SELECT w2.next - 1 FROM flush f JOIN w w2 ON w2.rn = f.rn WHERE f.old = w.open + 1), (SELECT max(next) FROM w)) END AS chunk FROM w WHERE rn > 0)
SELECT chunk, doc_id, left(text, 400) AS text FROM p JOIN named USING (grp)""")
def chunk_pack(spark, sf_dir):
    return chunks.chunked(posts(spark, sf_dir), size=60).select("chunk", F.col("id").alias("doc_id"), "text")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("story"), "text")
    return retrieval.nearest(docs(spark, sf_dir).select(F.col("doc_id").alias("post"), "text"), stories)


_NEAR = r"""
WITH w AS (SELECT 'p' AS t, doc_id AS id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents UNION ALL SELECT 's', item_id, unnest(string_split_regex(lower(text), '\s+')) FROM benchmark),
pad AS (SELECT t, id, ' ' || w || ' ' AS w FROM w WHERE w <> ''),
gr AS (
  SELECT t, id, w AS gram FROM pad WHERE length(w) <= 3
  UNION ALL SELECT t, id, substr(w, i, n) FROM (SELECT t, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM pad CROSS JOIN (VALUES (3), (4), (5)) k(n) WHERE length(w) >= n AND NOT (n = 3 AND length(w) = 3))),
tf AS MATERIALIZED (SELECT t, id, gram, count(*) AS tf FROM gr GROUP BY ALL),
idf AS MATERIALIZED (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf WHERE t = 's' GROUP BY gram),
wt AS (SELECT t, id, gram, tf * idf AS w FROM tf JOIN idf USING (gram)),
u AS MATERIALIZED (SELECT t, id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY t, id)) AS w FROM wt),
sims AS (SELECT a.id AS post, b.id AS story, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.gram = b.gram AND a.t = 'p' AND b.t = 's' GROUP BY ALL),
near AS MATERIALIZED (SELECT * FROM (SELECT post, story, sim, row_number() OVER (PARTITION BY post ORDER BY round(sim, 9) DESC, story) AS rank FROM sims) WHERE rank <= 8)"""


@query(_NEAR + " SELECT post AS doc_id, story AS item_id, round(sim, 6) AS sim, rank::INT AS rank FROM near")
def retrieve_topk(spark, sf_dir):
    """The eight benchmark items nearest to each document, by character n-grams."""
    return _near(spark, sf_dir).select(F.col("post").alias("doc_id"), F.col("story").alias("item_id"), F.round("sim", 6).alias("sim"), "rank")


@query(_NEAR + """, picked AS (
  SELECT story, row_number() OVER (ORDER BY rank, post, story) AS place FROM (SELECT story, rank, post, row_number() OVER (PARTITION BY story ORDER BY rank, post) AS k FROM near) WHERE k = 1),
first AS (SELECT * FROM picked WHERE place <= 12),
rest AS (SELECT item_id AS story, row_number() OVER (ORDER BY length(text) DESC, item_id) AS nth FROM benchmark WHERE item_id NOT IN (SELECT story FROM first))
SELECT story AS item_id, place FROM first UNION ALL SELECT story, nth + (SELECT max(place) FROM first) FROM rest WHERE nth + (SELECT max(place) FROM first) <= 18""")
def stories_to_show(spark, sf_dir):
    """Twelve by turns, then the biggest up to eighteen."""
    picked = retrieval.round_robin(_near(spark, sf_dir), 12)
    sizes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("story"), F.length("text").alias("size"))
    return retrieval.filled(picked, sizes, 6, 12).select(F.col("story").alias("item_id"), F.col("place").cast("long").alias("place"))


@query()
def html_outline(spark, sf_dir):
    """What a parser finds in pages; SQL has no parser."""
    return html.outlines(table(spark, sf_dir, "pages"))


@query("""
SELECT page_id, page_id::VARCHAR AS status_id, 'user' || (page_id % 7) AS author_id, 'Post ' || page_id || chr(10) || 'more' AS text,
       CASE WHEN page_id % 2 = 0 THEN (page_id + 1)::VARCHAR END AS quoted_id, url AS urls, 'M' || page_id AS media_keys, page_id % 3 = 0 AS is_repost, FALSE AS has_card FROM pages""")
def html_extract(spark, sf_dir):
    """Posts made of pages' urls, in markup with a script that looks like more of it."""
    n = F.col("page_id").cast("string")
    quoted = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<div role="link"><a href="/q/status/'), (F.col("page_id") + 1).cast("string"), F.lit('">q</a></div>'))).otherwise("")
    made = F.concat(
        F.lit('<main><script>var s = "<article><a href=/x/status/1><time></time></a></article>"</script><article data-testid="tweet">'), F.when(F.col("page_id") % 3 == 0, '<span data-testid="socialContext">r</span>').otherwise(""),
        F.lit('<a href="/user'), (F.col("page_id") % 7).cast("string"), F.lit("/status/"), n, F.lit('"><time datetime="2024-01-01"></time></a><div data-testid="tweetText">Post '), n, F.lit("<br>more</div>"), quoted,
        F.lit('<a href="'), F.regexp_replace("url", "&", "&amp;"), F.lit('">l</a><a href="https://x.com/own">o</a><img src="https://i/media/M'), n, F.lit('?f=1"></article></main>'),
    )
    found = html.posts_in(table(spark, sf_dir, "pages").select("page_id", made.alias("html")))
    return found.select("page_id", "status_id", "author_id", "text", "quoted_id", F.array_join("urls", " ").alias("urls"), F.array_join("media_keys", " ").alias("media_keys"), "is_repost", "has_card")


@query("""SELECT source AS name FROM documents WHERE doc_id % 5 <> 0 GROUP BY source""")
def trend_names(spark, sf_dir):
    """Cells of rank, separator, category and name; every fifth is an advertisement."""
    cell = F.concat(F.col("doc_id").cast("string"), F.lit("\n·\nSports · Trending\n"), "source", F.lit("\n12.3K posts"), F.when(F.col("doc_id") % 5 == 0, "\nPromoted by A").otherwise(""))
    return docs(spark, sf_dir).select(html.trend_of(cell).alias("name")).where("name is not null").distinct()


@query("""SELECT doc_id AS batch, 1::INT AS n, source AS story, lang AS label FROM documents UNION ALL SELECT doc_id, 2, 's' || doc_id, NULL FROM documents""")
def label_salvage(spark, sf_dir):
    """Replies in prose, with small objects before and after the one that counts, and a number that the batch doesn't have."""
    reply = F.concat(F.lit('Sure {"a": 1}:\n```json\n{"1": {"story": "'), "source", F.lit('", "label": " '), "lang", F.lit('"}, "2.": "s'), F.col("doc_id").cast("string"), F.lit('", "77": "out"}\n``` done {}'))
    return salvage(docs(spark, sf_dir).select(F.col("doc_id").alias("batch"), F.lit(5).alias("size"), reply.alias("reply")))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE length(text) > 0) AS with_vector, count(DISTINCT text) AS texts FROM documents""")
def embed_texts(spark, sf_dir):
    """Every text that isn't blank gets a vector, and equal texts the same."""
    e = embedded(posts(spark, sf_dir), lexical())
    p = posts(spark, sf_dir)
    return e.agg(F.count("*").alias("n"), F.count("vec").alias("with_vector")).crossJoin(p.agg(F.countDistinct("text").alias("texts")))


#: Rows of a micro-batch of the vectors' stream, and micro-batches of fewer rows.
BATCH, BATCHES = 25_000, 4


def _streamed(spark: SparkSession, sf_dir: str, tuning: Tuning) -> DataFrame:
    """The vectors as a stream in the order of their ids, one file a micro-batch. Files are taken by the times they were written at, so these are written one by one."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = cut(numbered(vectors_of(table(spark, sf_dir, "embeddings")).select("id", "seq", "vec", "author"), "seq", "id"))
    n = rows.count()
    size = max(1, min(BATCH, -(-n // BATCHES)))
    fields = rows.drop("pos").schema
    for k in range(max(1, -(-n // size))):
        rows.where((F.col("pos") >= k * size) & (F.col("pos") < (k + 1) * size)).drop("pos").coalesce(1).write.mode("append").parquet(f"{root}/posts")
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{root}/posts")
    engine = Engine(spark, f"{root}/state", tuning)
    engine.start(stream, f"{root}/checkpoint").awaitTermination()
    return engine.state()


@query(SQL["cluster_stats"])
def stream_stats(spark, sf_dir):
    from ..operators.cluster import stats

    return stats(_streamed(spark, sf_dir, Tuning(0.3)))


@query("SELECT count(*) AS n, 0::BIGINT AS different FROM embeddings")
def stream_equals_batch(spark, sf_dir):
    """How many rows the stream puts elsewhere than the batch does. Files come in the order of the rows."""
    streamed = _streamed(spark, sf_dir, Tuning(0.3)).select("id", F.col("cluster_id").alias("s"))
    batch = cluster(vectors_of(table(spark, sf_dir, "embeddings")), Tuning(0.3)).select("id", F.col("cluster_id").alias("b"))
    return batch.join(streamed, "id", "full").agg(F.count("*").alias("n"), F.count_if(~F.col("s").eqNullSafe(F.col("b"))).alias("different"))


@query(r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, trim(text) AS t, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT count(t) AS n FROM w),
voc AS MATERIALIZED (
  SELECT word, ln((1 + (SELECT n FROM n)) / (1 + df)) + 1 AS rarity FROM (
    SELECT word, count(*) AS tf, count(DISTINCT row) AS df FROM (SELECT row, unnest(w) AS word FROM w) GROUP BY word ORDER BY tf DESC, word LIMIT 20000)),
met AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
near AS (SELECT word, beside, ln(1 + count(*)) * r.rarity AS pull FROM (SELECT a AS word, b AS beside FROM met UNION ALL SELECT b, a FROM met) JOIN voc USING (word) JOIN voc r ON r.word = beside GROUP BY word, beside, r.rarity),
way AS MATERIALIZED (
  SELECT word, i, CASE WHEN ((instr('0123456789abcdef', substr(md5(word), 1 + i // 4, 1)) - 1) >> (i % 4)) & 1 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM voc, (SELECT unnest(range(64))::INT AS i)),
sums AS (SELECT n.word, i, sum(pull * sign) AS v FROM near n JOIN way ON way.word = n.beside GROUP BY n.word, i),
unit AS MATERIALIZED (SELECT word, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY word)), 1e-9) AS v FROM sums),
tf AS (SELECT row, word, count(*) AS tf FROM (SELECT row, unnest(w) AS word FROM w) GROUP BY row, word),
text AS (SELECT row, i, sum(tf * rarity * v) AS v FROM tf JOIN voc USING (word) JOIN unit USING (word) GROUP BY row, i),
u AS (SELECT row, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY row)), 1e-9) AS v FROM text)
SELECT doc_id, round(max(v) FILTER (WHERE i = 0), 4) AS v0, round(max(v) FILTER (WHERE i = 17), 4) AS v17, round(max(v) FILTER (WHERE i = 63), 4) AS v63 FROM w LEFT JOIN u USING (row) GROUP BY row, doc_id""")
def embed_learnt(spark, sf_dir):
    """Texts' vectors by a model learnt from the texts."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    found = learnt.with_vectors(d, learnt.learn(d))
    return found.select("doc_id", *[F.round(F.col("vec")[i], 4).alias(f"v{i}") for i in (0, 17, 63)])
