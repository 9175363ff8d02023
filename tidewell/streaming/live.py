"""Clustering of an endless stream of posts, whose state expires by age.

Three things hold state, each bounded by the age that counts, none by the stream's length. dropDuplicatesWithinWatermark() knows the ids of the last `ttl`, so that re-delivered posts
fall out before anything else. A stateful processor, keyed by the cells of a metric partition (operators/similarity.py), holds the vectors of the last `ttl` and gives the similar
pairs of new posts with them, one block of vectors at a time. Each micro-batch then decides which of its posts become representatives, from the pairs and from the earlier
decisions that the pairs name; of those it reads the last `ttl` by their row groups' times. Vectors aren't written or read again.

A post can join a representative that is at most `ttl` older than itself. The watermark trails the newest post by `ttl`: later ones are too late and dropped, and an id that comes
again after that is a new post. A batch that runs again after a failure replaces what it wrote; a stream that was stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.cluster import Tuning, assign, members_of, stats, view
from ..operators.similarity import PART_BYTES, Partition, Products, partition_of
from ..storage import cut, delete, exists, numbered, passing
from .engine import shown

DECIDED = "id long, seq long, author long, t timestamp, pos long, cluster_id long, is_rep boolean, is_prior boolean, live boolean"
_MET = "i long, j long, sim double, seq long, author long, t timestamp"
_BLOCK = "newest long, ids binary, times binary, authors binary, at_home binary, vecs binary"
#: Blocks of a cell that are put together when there are more, and bytes of vectors up to which they are.
BLOCKS = 8
#: New posts, neighbours in time, that meet at once what is near them in time.
RUN = 256
#: The state store, whose memory all partitions of an executor share; each would have its own otherwise.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


@dataclass
class _Rows:
    """Posts of a cell: ids, event times in microseconds, authors, whether the cell is theirs, and vectors."""

    ids: np.ndarray
    times: np.ndarray
    authors: np.ndarray
    at_home: np.ndarray
    vecs: np.ndarray

    def __getitem__(self, some: np.ndarray) -> _Rows:
        return _Rows(*(x[some] for x in self.columns()))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.times, self.authors, self.at_home, self.vecs

    def packed(self) -> tuple:
        return int(self.times.max()), *(x.tobytes() for x in self.columns())

    @classmethod
    def unpacked(cls, block: tuple) -> _Rows:
        ids, times, authors = (np.frombuffer(x, np.int64) for x in block[1:4])
        return cls(ids, times, authors, np.frombuffer(block[4], bool), np.frombuffer(block[5]).reshape(len(ids), -1))

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return cls(*(np.concatenate(x) for x in zip(*(p.columns() for p in parts), strict=True)))


class Meeting(StatefulProcessor):
    """Of each cell's new posts, the pairs with those it holds and with each other; and the new posts themselves, where they are at home."""

    def __init__(self, made: Partition, ttl_us: int, other_author: bool):
        self.made, self.ttl, self.other_author = made, ttl_us, other_author

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.blocks = handle, handle.getListState("blocks", _BLOCK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        p = pd.concat(list(rows)).sort_values(["seq", "id"])
        # a post without a vector that passes has no cell
        new = _Rows(p["id"].to_numpy(np.int64), p["t"].to_numpy("datetime64[us]").astype(np.int64), p["author"].fillna(-1).to_numpy(np.int64), p["at_home"].to_numpy(bool), np.stack(p["vec"].to_list()).astype(float))
        home = p[p["at_home"]]
        if len(home):
            yield pd.DataFrame({"i": home["id"], "j": pd.array([None] * len(home), "Int64"), "sim": np.nan, "seq": home["seq"], "author": home["author"], "t": home["t"]})
        least = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        kept, stale, n = [], False, 0
        for block in self.blocks.get():
            if block[0] < least:
                stale = True
                continue
            held = _Rows.unpacked(block)
            yield from self._pairs(new, held, False)
            n += 1
            kept.append(block)
        yield from self._pairs(new, new, True)
        if stale or n >= BLOCKS:
            self.blocks.put([*_together(kept), new.packed()])
        else:
            self.blocks.appendValue(new.packed())
        self._wake(int(new.times.max()))

    def _pairs(self, new: _Rows, held: _Rows, itself: bool) -> Iterator[pd.DataFrame]:
        products, guests = Products(self.made.rotation, self.made.least, self.made.tallest), held[held.at_home]
        turns = ((np.flatnonzero(new.at_home), held, np.arange(len(held.ids))), (np.flatnonzero(~new.at_home), guests, np.flatnonzero(held.at_home)))
        # where times don't go with the order, a later post may be the older one by any time
        ordered = not itself or bool((np.diff(new.times) >= 0).all())
        for mine, theirs, places in turns:
            if not ordered:
                yield from self._met(products, new, held, mine, theirs.vecs, places, itself)
                continue
            for mine_, theirs_ in _in_reach(new.times[mine], theirs.times, self.ttl, itself):
                yield from self._met(products, new, held, mine[mine_], theirs.vecs[theirs_], places[theirs_], itself)

    def _met(self, products: Products, new: _Rows, held: _Rows, mine: np.ndarray, vecs: np.ndarray, places: np.ndarray, itself: bool) -> Iterator[pd.DataFrame]:
        for a, b, sim in products.reach(new.vecs[mine], vecs):
            x, y = mine[a], places[b]
            late, early = x, y
            keep = np.ones(len(x), bool)
            if itself:  # in order; a pair of one at home and one that visits comes by both turns
                keep = (x != y) & np.where(new.at_home[x] & new.at_home[y], x > y, new.at_home[x])
                late, early = np.maximum(x, y), np.minimum(x, y)
            keep &= new.times[late] - held.times[early] <= self.ttl
            if self.other_author:
                keep &= new.authors[late] != held.authors[early]
            if keep.any():
                i, j = new.ids[late[keep]], held.ids[early[keep]]
                yield pd.DataFrame({"i": i, "j": pd.array(j, "Int64"), "sim": sim[keep], "seq": pd.array([None] * len(i), "Int64"), "author": pd.array([None] * len(i), "Int64"), "t": pd.Series([pd.NaT] * len(i), dtype="datetime64[us]")})

    def _wake(self, newest: int) -> None:
        # when the watermark is there no post that may still come can be matched
        self.handle.registerTimer((newest + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = timerValues.getCurrentWatermarkInMs() * 1000 - self.ttl
        kept = [b for b in self.blocks.get() if b[0] >= least]
        if kept:
            self.blocks.put(kept)
        else:
            self.blocks.clear()
        return iter(())

    def close(self) -> None:
        pass


def _in_reach(times: np.ndarray, others: np.ndarray, ttl: int, either: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of `times`, RUN at a time in order of time, and those of `others` that aren't more than ttl older; where either may be the later one, nor more than ttl newer."""
    mine, theirs = np.argsort(times, kind="stable"), np.argsort(others, kind="stable")
    sorted_ = others[theirs]
    for s in range(0, len(mine), RUN):
        some = mine[s : s + RUN]
        low = np.searchsorted(sorted_, times[some[0]] - ttl)
        high = np.searchsorted(sorted_, times[some[-1]] + ttl, "right") if either else len(sorted_)
        if low < high:
            # in their own order, which is that of pairs
            yield np.sort(some), np.sort(theirs[low:high])


def _together(blocks: list[tuple]) -> list[tuple]:
    """The blocks, neighbours put together up to PART_BYTES of vectors."""
    out: list[list[_Rows]] = []
    size = 0
    for b in blocks:
        rows = _Rows.unpacked(b)
        if not out or size + rows.vecs.nbytes > PART_BYTES:
            out.append([])
            size = 0
        out[-1].append(rows)
        size += rows.vecs.nbytes
    return [_Rows.joined(some).packed() for some in out]


@dataclass
class LiveEngine:
    """path: of the decisions' table. pivots: from partition_of() a sample of the vectors, with the least threshold that will ever hold; the same for as long as a checkpoint is used.

    Vectors are of a norm of pivots.tallest at most; longer ones are refused. tuning: window isn't used, age takes its place. ttl: an interval, as '7 days'.
    """

    spark: SparkSession
    path: str
    pivots: Partition
    tuning: Tuning = Tuning()
    ttl: str = "7 days"
    on_batch: Callable[[DataFrame], None] | None = None
    enabled: bool = True

    def __post_init__(self) -> None:
        self._check(self.tuning.tau)

    def _check(self, tau: float) -> None:
        if tau < self.pivots.least:
            raise ValueError(f"the state's cells are made for thresholds of {self.pivots.least} or more")

    def set_threshold(self, tau: float) -> None:
        """For posts from the next batch on."""
        self._check(tau)
        self.tuning = replace(self.tuning, tau=tau)

    def set_enabled(self, enabled: bool) -> None:
        """While it is off view() hides and marks nothing; posts are placed all the same, so that nothing is missed when it is on again."""
        self.enabled = enabled

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Places the posts (id, seq, vec, author, t) of a stream; by default all there are now. Those without a vector or a time are left out, so they may come again."""
        for name, value in ROCKS.items():
            self.spark.conf.set(name, value)
        ttl_us = self.spark.range(1).select(F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00 UTC' + interval '{self.ttl}')")).first()[0]
        once = stream.where("vec is not null and t is not null").withWatermark("t", self.ttl).dropDuplicatesWithinWatermark(["id"])
        celled = once.select("id", "seq", "vec", "author", "t", F.posexplode(_cells_of(self.pivots)("vec")).alias("nth", "cell")).withColumn("at_home", F.col("nth") == 0).drop("nth")
        met = celled.groupBy("cell").transformWithStateInPandas(Meeting(self.pivots, ttl_us, self.tuning.other_author), _MET, "Append", "EventTime")
        return met.writeStream.foreachBatch(self._decide).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _decide(self, met: DataFrame, number: int) -> None:
        with passing():
            met = cut(met)
            new = met.where("j is null").select(F.col("i").alias("id"), "seq", "author", "t")
            if new.isEmpty():
                return
            new = cut(numbered(new, "seq", "id").withColumn("pos", F.col("pos") + F.lit(number << 40)))
            since = new.agg(F.min(F.col("t") - F.expr(f"interval '{self.ttl}'"))).first()[0]
            reps = self._earlier(number).where(F.col("is_rep") & (F.col("t") >= F.lit(since))).groupBy("id").agg(F.max("pos").alias("pos"))
            places = new.select("id", "pos").unionByName(reps)
            pairs = met.where(F.col("j").isNotNull() & (F.col("sim") >= self.tuning.tau)).select("i", "j", "sim")
            # pairs with earlier posts that joined others fall out here
            late = pairs.join(new.select(F.col("id").alias("i"), F.col("pos").alias("at")), "i").drop("i").withColumnRenamed("at", "i")
            edges = cut(late.join(places.select(F.col("id").alias("j"), F.col("pos").alias("at")), "j").select(F.col("at").alias("j"), "i", "sim"))
            joined = assign(edges, cut(members_of(edges)), self.tuning.rule)
            names = places.select(F.col("pos").alias("rep"), F.col("id").alias("cluster_id"))
            full = new.join(joined, new.pos == joined.i, "left").withColumn("rep", F.coalesce("rep", "pos")).join(names, "rep")
            out = full.select("id", "seq", "author", "t", "pos", "cluster_id", (F.col("rep") == F.col("pos")).alias("is_rep"), F.lit(False).alias("is_prior"), F.lit(True).alias("live"))
            out.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
            if self.on_batch:
                self.on_batch(out)

    def _earlier(self, before: int | None = None) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], DECIDED)
        rows = self.spark.read.schema(f"{DECIDED}, batch long").parquet(self.path)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def state(self) -> DataFrame:
        """All decisions, without vectors."""
        return self._earlier()

    def view(self) -> DataFrame:
        """cluster.view() of the decisions."""
        return shown(view(self.state()), self.enabled)

    def stats(self) -> DataFrame:
        return stats(self.state())

    def forget_all(self) -> None:
        """The decisions; the stream's own state goes with its checkpoint."""
        delete(self.spark, self.path)


def _cells_of(made: Partition):
    @F.pandas_udf("array<int>")
    def cells(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apart = made.apart()
        for some in vecs:
            if not len(some):
                yield pd.Series([], dtype=object)
                continue
            x = np.stack(some.to_list()).astype(float)
            if (np.linalg.norm(x, axis=1) > made.tallest * (1 + 1e-9)).any():
                raise ValueError(f"a vector is longer than {made.tallest}")
            home, visits = made.cells(x, apart)
            yield pd.Series([np.r_[h, np.flatnonzero(v)].astype(np.int32) for h, v in zip(home, visits, strict=True)])

    return cells


def pivots_for(vectors: DataFrame, least: float, rows: int, tallest: float = 1.0 + 1e-6) -> Partition:
    """A partition for LiveEngine: from a sample of vectors (id, vec), for thresholds from `least` on and about so many rows held at a time."""
    made = partition_of(vectors.where("vec is not null").select(F.col("id").alias("pos"), "vec", F.lit(least).alias("tau")), rows)
    if made is None:
        raise ValueError("no vectors to choose pivots from")
    return replace(made, tallest=max(tallest, made.tallest))
