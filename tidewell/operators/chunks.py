"""Posts dealt into chunks for labelling, groups kept together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import numbered


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return capped(rows, [key], order, 1)


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest `order` of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__r")).select(key, "__r.*")


def harvest(posts: DataFrame, by: list[str], cap: int, min_length: int = 15) -> DataFrame:
    """Posts (id, text, seq, ...) as a crawl stores them: each id once, the earliest; texts of min_length characters or more; `cap` of each group."""
    long = posts.where(F.length(F.trim("text")) >= min_length)
    return capped(first_of_each(long, "id", ["seq"]), by, ["seq", "id"], cap)


def speed_texts(posts: DataFrame, n: int = 20, min_length: int = 40) -> DataFrame:
    """The first n texts long enough to time."""
    return posts.where(F.length("text") >= min_length).orderBy("seq").limit(n)


def group_key(trend: str, source: str) -> Column:
    return F.coalesce(trend, F.concat(F.lit("__"), source))


def _runs(counts: dict[int, int], size: int, chunk: int) -> list[tuple[int, int, int, int, int]]:
    """Of groups by their size n, the largest first: n, the groups before them, how many go to the chunk under way, its number, and how many a chunk of their own holds."""
    runs, before, held = [], 0, 0
    for n in sorted(counts, reverse=True):
        each = size // n
        joining = min(counts[n], (size - held) // n) if held else 0
        first = chunk if held else chunk - 1
        runs.append((n, before, joining, first, each))
        left = counts[n] - joining
        if left:
            filled = -(-left // each)
            chunk, held = first + filled, (left - (filled - 1) * each) * n
        else:
            held += joining * n
        before += counts[n]
    return runs


def chunk_of_groups(groups: DataFrame, size: int = 220) -> DataFrame:
    """grp and chunk (from 0) of groups (grp, n, first): the largest first, equal ones by first; those of `size` or more are chunks of their own, the others
    are put together until the next would overflow.

    Groups of one size fill chunks evenly, after those that join the chunk under way. So a count for each of the sizes below `size` tells where each of them begins, and a group's place among
    those of its size tells its chunk; no task walks over groups.
    """
    spark = groups.sparkSession
    placed = numbered(groups.withColumn("down", -F.col("n")).select("grp", "n", "first", "down"), "down", "first", "grp")
    small = {r["n"]: r["c"] for r in groups.where(F.col("n") < size).groupBy("n").agg(F.count("*").alias("c")).collect()}  # size - 1 rows at most
    big = groups.count() - sum(small.values())
    runs = F.broadcast(spark.createDataFrame(_runs(small, size, big), "n long, before long, joining long, chunk long, each long"))
    nth = F.col("pos") - big - F.col("before")
    own = F.col("chunk") + 1 + F.expr("int((pos - big - before - joining) div each)")
    found = placed.withColumn("big", F.lit(big).cast("long")).withColumn("n", F.col("n").cast("long")).join(runs, "n", "left")
    chunk = F.when(F.col("n") >= size, F.col("pos")).when(nth < F.col("joining"), F.col("chunk")).otherwise(own)
    return found.select("grp", chunk.cast("long").alias("chunk"))


def chunked(posts: DataFrame, size: int = 220, text_limit: int = 400) -> DataFrame:
    """chunk, id, author, text (its first text_limit characters) and trend of posts (id, author, text, trend, source, seq)."""
    keyed = posts.withColumn("grp", group_key("trend", "source"))
    groups = keyed.groupBy("grp").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return keyed.join(chunk_of_groups(groups, size), "grp").select("chunk", "id", "author", F.left("text", F.lit(text_limit)).alias("text"), "trend")


def top(rows: DataFrame, by: str, n: int, *tie: str) -> DataFrame:
    """The n rows with the largest `by`, ties by the columns after it: the best models, the biggest stories."""
    return rows.orderBy(F.desc(by), *tie).limit(n)


def random_pick(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that seed shuffles, the same on every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
