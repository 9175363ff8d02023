"""The tables of the engine as Spark schemas, and adapters that make them from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Str = str | Column

POSTS = "status_id string, author_id string, text string, ts timestamp, quoted_id string, urls array<string>, media_keys array<string>, is_repost boolean, has_card boolean, source string, trend string, seq bigint"
VECTORS = "status_id string, seq bigint, vec array<double>"
LABELS = "labeller string, status_id string, story_id string"
PAIRS = "lo string, hi string, y int"
MEMORY = "id string, q array<tinyint>, s double, a string, t timestamp"
TIMELINE = "timeline_id string, pos int, kind string, is_reply boolean, own_hide boolean, override boolean, cur_hidden boolean"
USERS = "screen_name string, following boolean, followed_by boolean, followers_count bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_of(documents: DataFrame) -> DataFrame:
    """Documents as posts: doc_id is the id and the order, source the author."""
    d = documents
    none = F.lit(None)
    return d.select(
        d.doc_id.cast("string").alias("status_id"), d.source.alias("author_id"), d.text.alias("text"), none.cast("timestamp").alias("ts"), none.cast("string").alias("quoted_id"),
        F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("media_keys"), F.lit(False).alias("is_repost"), F.lit(False).alias("has_card"),
        d.source.alias("source"), d.lang.alias("trend"), d.doc_id.alias("seq"),
    )


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """Embeddings as vectors: id and seq (long), vec (doubles), label, and a made-up author."""
    e = embeddings
    return e.select(e.vec_id.alias("id"), e.vec_id.alias("seq"), e.embedding.cast("array<double>").alias("vec"), e.label.alias("label"), (e.vec_id % 37).alias("author"))
