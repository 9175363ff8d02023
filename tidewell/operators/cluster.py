"""Greedy first-match clustering of an ordered stream of vectors, without a sequential loop.

In order, a row joins the first representative that it is similar enough to, or else becomes one. The representatives are the
lexicographically first maximal independent set of the graph of similar pairs, which rounds find in parallel (Blelloch, Fineman and Shun, SPAA 2012):
rows whose earlier neighbours are all members become representatives, and their later neighbours members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import dot
from ..storage import cut, numbered
from .similarity import similar_pairs, stacked

#: Up to so many edges (24 bytes each) one task decides in order; more are decided in rounds.
EDGES_IN_ONE_TASK = 2_000_000
#: Rows of which the first representatives are found, bytes of the vectors of all up to which they are broadcast, and rows and representatives that are multiplied at a time.
FIRST_ROWS, REPS_BYTES, STEP = 4096, 32 << 20, 1024


@dataclass(frozen=True)
class Tuning:
    """tau: least similarity, inclusive. window: how many rows back a representative is seen; None: all. other_author: only rows of other authors match.
    rule: first, the earliest matching representative, or best, the most similar."""

    tau: float = 0.94
    window: int | None = None
    other_author: bool = False
    rule: str = "first"


def _in_order(edges: DataFrame) -> DataFrame:
    """i of the members, by one pass in order."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if not found:
            return
        earlier = pd.concat(found).groupby("i", sort=True)["j"].agg(list)
        members: set[int] = set()
        for i, js in earlier.items():
            if any(j not in members for j in js):
                members.add(i)
        yield pd.DataFrame({"i": pd.Series(sorted(members), dtype="int64")})

    return edges.select("j", "i").coalesce(1).mapInPandas(walk, "i long")


def _in_rounds(edges: DataFrame) -> DataFrame:
    """i of the members, by rounds over all edges."""
    left = cut(edges.select("j", "i"))
    members = None
    while not left.isEmpty():
        # all earlier neighbours of what never comes as i are decided, so it is a representative
        later = left.select("i").distinct()
        joined = cut(left.join(later.withColumnRenamed("i", "j"), "j", "left_anti").select("i").distinct())
        members = joined if members is None else members.union(joined)
        left = cut(left.join(joined, "i", "left_anti").join(joined.withColumnRenamed("i", "j"), "j", "left_anti"))
    return members if members is not None else edges.select("i").where("false")


def members_of(edges: DataFrame, in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """i of the rows that join another; edges (j, i) have j before i. All other rows are representatives."""
    return _in_order(edges) if edges.count() <= in_one_task else _in_rounds(edges)


def assign(edges: DataFrame, members: DataFrame, rule: str = "first") -> DataFrame:
    """i and rep of each member: the first or the most similar of its representatives (the earlier of equals)."""
    reps = edges.join(members, "i", "left_semi").join(members.withColumnRenamed("i", "j"), "j", "left_anti")
    best = {"first": F.min("j"), "best": F.max_by("j", F.struct("sim", -F.col("j")))}[rule]
    return reps.groupBy("i").agg(best.alias("rep"))


def represented(placed: DataFrame, tau: float) -> DataFrame | None:
    """i, first and best of each member among placed (pos, vec): the earliest and the most similar of its representatives (the earlier of equals). None if those are too many to broadcast.

    Pairs that aren't with a representative decide nothing, so they aren't made: of the first rows pairs tell the representatives, rows that these reach fall out, and the same goes on with
    the first of what is left. Work is rows times representatives, and what is on disk are the rows left and the pairs of a round.
    """
    spark = placed.sparkSession
    rows = left = placed.where("vec is not null").select("pos", "vec")
    places, vecs, n = [np.empty(0, np.int64)], [], FIRST_ROWS
    while True:
        upto, taken = left.select("pos").orderBy("pos").limit(n).agg(F.max("pos"), F.count("*")).first()
        if not taken:
            break
        some = left.where(F.col("pos") <= upto)
        edges = cut(similar_pairs(some.withColumn("tau", F.lit(float(tau))), taken))
        members = cut(members_of(edges))
        dim = some.select(F.size("vec")).first()[0]
        if 8 * dim * (sum(map(len, places)) + taken - members.count()) > REPS_BYTES:
            return None
        new = some.join(members.withColumnRenamed("i", "pos"), "pos", "left_anti").orderBy("pos").toArrow()
        places.append(new.column("pos").to_numpy())
        vecs.append(stacked(new.column("vec")))
        held = spark.sparkContext.broadcast((places[-1], vecs[-1]))
        left = cut(left.where(F.col("pos") > upto).mapInArrow(_out_of_reach(held, tau), rows.schema))
        if edges.count() <= EDGES_IN_ONE_TASK:
            n *= 2
    if not vecs:
        return rows.select(F.col("pos").alias("i"), F.col("pos").alias("first"), F.col("pos").alias("best"))
    held = spark.sparkContext.broadcast((np.concatenate(places), np.concatenate(vecs)))
    return rows.mapInArrow(_joined(held, tau), "i long, first long, best long")


def _out_of_reach(held: Broadcast, tau: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that no representative is similar enough to."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = held.value[1]
        for whole in batches:
            for s in range(0, whole.num_rows, STEP):
                b = whole.slice(s, STEP)
                x = stacked(b.column("vec"))
                reached = np.zeros(len(x), bool)
                for t in range(0, len(reps), STEP):
                    reached |= (x @ reps[t : t + STEP].T >= tau).any(1)
                yield b.filter(pa.array(~reached))

    return rest


def _joined(held: Broadcast, tau: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows that aren't representatives the first of these that is similar enough and the most similar; all are in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps = held.value
        for whole in batches:
            for s in range(0, whole.num_rows, STEP):
                b = whole.slice(s, STEP)
                pos = b.column("pos").to_numpy()
                member = ~np.isin(pos, at)
                pos, x = pos[member], stacked(b.column("vec"))[member]
                first, best, most = np.full(len(pos), -1), np.full(len(pos), -1), np.full(len(pos), -np.inf)
                for t in range(0, len(reps), STEP):
                    own = at[t : t + STEP]
                    sim = np.where(own < pos[:, None], x @ reps[t : t + STEP].T, -np.inf)
                    near = sim >= tau
                    found = (first < 0) & near.any(1)
                    first[found] = own[near[found].argmax(1)]
                    nearest = sim.argmax(1)
                    higher = sim[np.arange(len(pos)), nearest] > most
                    best[higher], most[higher] = own[nearest[higher]], sim[higher, nearest[higher]]
                # a product that rounding put on the other side of tau
                first = np.where(first < 0, best, first)
                yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(first, pa.int64()), pa.array(best, pa.int64())], names=["i", "first", "best"])

    return join


def copies_of(placed: DataFrame, tau: float) -> DataFrame:
    """pos and first: rows of placed (pos, vec) whose vector an earlier row has, and the earliest such. Vectors too short to match themselves have none."""
    hashed = placed.select("pos", "vec", F.xxhash64("vec").alias("h"))
    again = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = hashed.join(again, "h", "left_semi").where(dot("vec", "vec") >= tau).drop("h")
    firsts = some.groupBy("vec").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return some.join(firsts, "vec").where("pos != first").select("pos", "first")


def cluster(posts: DataFrame, tuning: Tuning = Tuning(), memory: DataFrame | None = None) -> DataFrame:
    """id, seq, author, cluster_id, is_rep, is_prior and live: each row of posts (id, seq, vec, author, and tau if rows have their own), and of memory.

    Rows that repeat an id are one, the earliest by seq. A row without a vector has no cluster and matches nothing. memory (id, vec, author): rows remembered
    from before; they come first, are representatives whatever they resemble, and aren't live unless posts brings their id again. cluster_id is the
    representative's id.
    """
    first = W.partitionBy("id").orderBy("seq")
    once = posts.where("vec is not null").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    tau = F.col("tau") if "tau" in posts.columns else F.lit(tuning.tau)
    rows = once.select("id", "seq", "vec", "author", tau.alias("tau"), F.lit(False).alias("is_prior"), F.lit(True).alias("live"))
    if memory is not None:
        kept = memory.where("vec is not null").dropDuplicates(["id"])
        again = posts.select("id").distinct().withColumn("live", F.lit(True))
        prior = kept.join(again, "id", "left").select("id", F.lit(None).cast("long").alias("seq"), "vec", "author", F.lit(tuning.tau).alias("tau"), F.lit(True).alias("is_prior"), F.coalesce("live", F.lit(False)).alias("live"))
        rows = prior.unionByName(rows.join(kept.select("id"), "id", "left_anti"))
    placed = cut(numbered(rows, "seq", "id"))  # nulls, which memory's seqs are, come first
    # where only tau decides, a copy goes where the first of its kind went or joins it, so one of each kind meets the others
    copies = None
    if memory is None and "tau" not in posts.columns and tuning.rule == "first" and tuning.window is None and not tuning.other_author:
        copies = cut(copies_of(placed, tuning.tau))
        copies = None if copies.isEmpty() else copies
    different = placed if copies is None else cut(placed.join(copies.select("pos"), "pos", "left_anti"))
    edges = similar_pairs(different, different.count(), tuning.window, tuning.other_author)
    if memory is not None:
        edges = edges.join(placed.where("is_prior").select(F.col("pos").alias("i")), "i", "left_anti")
    edges = cut(edges)
    members = cut(members_of(edges))
    joined = assign(edges, members, tuning.rule)
    if copies is not None:
        followed = copies.join(joined.withColumnRenamed("i", "first"), "first", "left").select(F.col("pos").alias("i"), F.coalesce("rep", "first").alias("rep"))
        joined = joined.unionByName(followed)
    reps = placed.select(F.col("pos").alias("rep"), F.col("id").alias("cluster_id"))
    full = placed.join(joined, placed.pos == joined.i, "left").withColumn("rep", F.coalesce("rep", "pos")).join(reps, "rep")
    out = full.select("id", "seq", "author", "cluster_id", (F.col("rep") == F.col("pos")).alias("is_rep"), "is_prior", "live")
    unplaced = posts.where("vec is null").select("id", "seq", "author").join(out.select("id"), "id", "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    none = unplaced.select("id", "seq", "author", F.lit(None).cast(out.schema["id"].dataType).alias("cluster_id"), F.lit(False).alias("is_rep"), F.lit(False).alias("is_prior"), F.lit(True).alias("live"))
    return out.unionByName(none)


def view(clustered: DataFrame) -> DataFrame:
    """The placed rows of cluster() with size (its cluster's live rows), from_memory, is_dup, seen_before and chip_text, as a reader sees them.

    A duplicate is a live row of a cluster with two or more live ones that isn't its representative. seen_before: a live row whose cluster memory knew.
    The chip stands at representatives and counts the others.
    """
    group = W.partitionBy("cluster_id")
    sized = clustered.where("cluster_id is not null").withColumn("size", F.sum(F.col("live").cast("long")).over(group)).withColumn("from_memory", F.max("is_prior").over(group))
    others = F.col("size") - 1
    return (
        sized.withColumn("is_dup", F.col("live") & ~F.col("is_rep") & (F.col("size") >= 2))
        .withColumn("seen_before", F.col("live") & F.col("from_memory"))
        .withColumn("chip_text", F.when(F.col("is_rep") & F.col("live") & (others > 0), F.concat(F.lit("+"), others.cast("string"), F.lit(" similar post"), F.when(others == 1, "").otherwise("s"))))
    )


def stats(clustered: DataFrame) -> DataFrame:
    """One row: posts (live), clusters (that memory didn't have), multi (over one live), collapsed (rows a reader is spared), remembered (memory's without a live row)."""
    each = clustered.where("cluster_id is not null").groupBy("cluster_id").agg(F.sum(F.col("live").cast("long")).alias("n"), F.max("is_prior").alias("memory"))
    spared = F.when(F.col("memory"), F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0)))
    remembered = F.count_if(F.col("n") == 0)
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("posts"), (F.count("*") - remembered).alias("clusters"), F.count_if(F.col("n") > 1).alias("multi"),
        F.coalesce(F.sum(spared), F.lit(0)).alias("collapsed"), remembered.alias("remembered"),
    )
