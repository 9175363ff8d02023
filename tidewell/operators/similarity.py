"""Pairs of vectors whose dot product reaches a threshold: exact, by a metric partition.

A pair whose dot product is tau or more isn't farther apart than its norms and tau allow. Rows go to the cell of the nearest of some pivots, and visit the cells on the other side of
whose dividing plane a partner may lie; of two cells only the row of the later one visits. So each pair meets in one task, and rows that lie well inside their cell
are multiplied with that cell alone. A cell's rows are cut into parts of PART_BYTES, and a task multiplies two, so that memory is bounded wherever rows crowd.
In a task, what the first HEAD dimensions of a rotation say bounds each product (the rest by Cauchy and Schwarz); only pairs that may reach tau are multiplied whole. Where vectors have
structure, the pivots cut the copies; where they have none, no row is copied more often than blocks of the same bytes would be. join_work() counts both.

With a count window only rows near each other meet: blocks of positions, and work that grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Rows of a block of positions: at 768 doubles a row, 12 MB.
BLOCK = 2048
#: A smaller input is cut into about this many blocks or cells, so that all cores have pairs.
LEAST_BLOCKS = 6
#: Bytes of the vectors of a part of a cell, of which a task holds two; rows of it that are multiplied at a time.
PART_BYTES, STEP = 16 << 20, 1024
#: Rows that pivots and the rotation are chosen from, brought to the driver: at 768 doubles a row, 12 MB.
SAMPLE = 2048
#: Copies of a row that more pivots may cost beyond those of the fewest.
COPIES = 8
#: Dimensions of the rotation that a product's bound is made of, and how much rounding may be off by, for vectors of norm 1.
HEAD, SLACK = 16, 1e-9


def block_size(rows: int) -> int:
    return max(64, min(BLOCK, -(-rows // LEAST_BLOCKS)))


@dataclass(frozen=True)
class Partition:
    """pivots; rotation (its first columns tell most of the sample's vectors apart); least and tallest: the least tau and the greatest norm of the rows."""

    pivots: np.ndarray
    rotation: np.ndarray
    least: float
    tallest: float

    def apart(self) -> np.ndarray:
        square = (self.pivots * self.pivots).sum(1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * self.pivots @ self.pivots.T, 0))

    def cells(self, x: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and for each row and cell whether it visits it. Of two cells in which partners may lie one's rows visit the other, the lower or the higher one by turns."""
        d = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T
        home, every = d.argmin(1), np.arange(len(self.pivots))
        reach = np.sqrt(np.maximum((x * x).sum(1) + self.tallest**2 - 2 * self.least, 0)) + SLACK * max(1, self.tallest)
        # a partner in another cell is at least as far off as the plane between the two pivots
        near = d - d[np.arange(len(x)), home][:, None] <= 2 * apart[home] * reach[:, None] + SLACK * max(1, self.tallest**2)
        turn = (every < home[:, None]) == ((every + home[:, None]) % 2 == 0)
        return home, near & turn & (every != home[:, None])


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def partition_of(vectors: DataFrame, rows: int) -> Partition | None:
    """Pivots for so many rows of vectors (pos, vec, tau), from a sample by a hash of pos: as many as parts of PART_BYTES need, or more while a row isn't copied much oftener for it."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    told = vectors.agg(F.min("tau").alias("least"), F.max(norm).alias("tallest")).first()
    if told["least"] is None:
        return None
    x = np.array([r.vec for r in vectors.select("pos", "vec").orderBy(F.xxhash64("pos"), "pos").limit(SAMPLE).collect()], float)
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    fewest = max(LEAST_BLOCKS, -(-rows * x.shape[1] * 8 // PART_BYTES))
    made, copies = None, 0.0
    for pivots in (fewest, 4 * fewest, 16 * fewest):
        if made and pivots > len(x) // 4:
            break
        tried = Partition(x[: min(pivots, max(1, len(x) // 2))], rotation, told["least"], told["tallest"])
        n = tried.cells(x[len(tried.pivots) :], tried.apart())[1].sum(1).mean() if len(x) > len(tried.pivots) else 0.0
        if made and n > copies + COPIES:
            break
        made, copies = tried, n if made is None else copies
    return made


def _assigned(vectors: DataFrame, held: Broadcast) -> DataFrame:
    """vectors with home, the row's cell, and visits, the cells before it that it visits."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, apart = held.value, held.value.apart()
        for b in batches:
            if not b.num_rows:
                continue
            home, visits = made.cells(stacked(b.column("vec")), apart)
            row, cell = np.nonzero(visits)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), lists], names=[*b.schema.names, "home", "visits"])

    return vectors.mapInArrow(assign, vectors.schema.simpleString()[7:-1].replace(":", " ", len(vectors.columns)) + ", home int, visits array<int>")


def _parts(assigned: DataFrame, dim: int) -> DataFrame:
    """assigned rows with cell, at_home, a and b: the tasks that each goes to. Parts 0 to own - 1 of a cell are its own rows', those after are visitors'; a task (cell, a, b) has part a of the
    cell's own and any part b from a on. Where both are one part, one task has both."""
    rows_of_part = max(1, PART_BYTES // (8 * dim))
    cells = assigned.select(F.col("home").alias("cell"), F.lit(1).alias("own"), F.lit(0).alias("guest")).union(assigned.select(F.explode("visits"), F.lit(0), F.lit(1)))
    sizes = cells.groupBy("cell").agg(F.ceil(F.sum("own") / rows_of_part).cast("int").alias("own"), F.ceil(F.sum("guest") / rows_of_part).cast("int").alias("guests"))
    # at most one row a pivot
    sizes = F.broadcast(cut(sizes.where("own > 0")))
    kept = [c for c in assigned.columns if c not in ("home", "visits")]
    own = assigned.select(*kept, F.col("home").alias("cell"), F.lit(True).alias("at_home")).join(sizes, "cell")
    part = F.pmod(F.xxhash64("pos"), F.col("own")).cast("int")
    merged = (F.col("own") == 1) & (F.col("guests") <= 1)
    width = F.when(merged, 1).otherwise(F.col("own") + F.col("guests"))
    own = own.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), width - 1)))
    own = own.select(*kept, "cell", "at_home", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    guests = assigned.select(*kept, F.explode("visits").alias("cell"), F.lit(False).alias("at_home")).join(sizes, "cell")
    guests = guests.withColumn("part", F.when(merged, 0).otherwise(F.col("own") + F.pmod(F.xxhash64("pos"), F.col("guests")).cast("int")))
    guests = guests.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    return own.unionByName(guests.select(*kept, "cell", "at_home", "part", "a", F.col("part").alias("b")))


class Products:
    """Pairs of rows of two matrices whose dot product reaches a bound; counts what it multiplies."""

    def __init__(self, rotation: np.ndarray, least: float, tallest: float):
        self.head = rotation[:, :HEAD] if rotation.shape[1] > HEAD else None
        self.least = least - SLACK * max(1.0, tallest**2)
        self.bounded = self.whole = 0

    def _bounding(self, x: np.ndarray) -> np.ndarray:
        """A row's head and the norm of what is left: the products of two such bound those of the rows."""
        head = x @ self.head
        return np.c_[head, np.sqrt(np.maximum((x * x).sum(1) - (head * head).sum(1), 0))]

    def reach(self, x: np.ndarray, y: np.ndarray, before: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of x, rows of y, and their products. before: x are rows of y from there on, and meet those before themselves (and some after, where steps do)."""
        if not len(x) or not len(y):
            return
        bx, by = (None, None) if self.head is None else (self._bounding(x), self._bounding(y))
        for s in range(0, len(x), STEP):
            for t in range(0, len(y) if before is None else min(len(y), before + s + STEP), STEP):
                a, b = x[s : s + STEP], y[t : t + STEP]
                i = None
                if bx is not None:
                    self.bounded += len(a) * len(b)
                    i, j = np.nonzero(bx[s : s + STEP] @ by[t : t + STEP].T >= self.least)
                if i is None or 8 * len(i) > len(a) * len(b):
                    self.whole += len(a) * len(b)
                    product = a @ b.T
                    i, j = np.nonzero(product >= self.least)
                    sim = product[i, j]
                else:
                    self.whole += len(i)
                    sim = np.einsum("ij,ij->i", a[i], b[j])
                yield i + s, j + t, sim


def _met(task: tuple[int, int, int], table: pa.Table, made: Partition, other_author: bool, since: int, told: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a task, a step's at a time, so that it never holds all of its own; or if told its work."""
    cell, a, b = task
    vec, pos, tau = stacked(table.column("vec")), table.column("pos").to_numpy(), table.column("tau").to_numpy()
    author, first = table.column("author").to_numpy(), table.column("at_home").to_numpy(zero_copy_only=False) & (table.column("part").to_numpy() == a)
    own, others = np.flatnonzero(first), np.flatnonzero(~first)
    own = own[np.argsort(pos[own])]
    fresh, old = own[pos[own] >= since], own[pos[own] < since]
    turns = [(fresh, others, None), (old, others[pos[others] >= since], None)]
    if a == b:  # a part with itself, and where they are one part with the cell's visitors
        turns.append((fresh, own, len(old)))
    products = Products(made.rotation, made.least, made.tallest)
    for x, y, before in turns:
        for i, j, sim in products.reach(vec[x], vec[y], before):
            i, j = x[i], y[j]
            late, early = np.where(pos[i] > pos[j], i, j), np.where(pos[i] > pos[j], j, i)
            keep = sim >= tau[late]
            if before is not None:
                keep &= pos[i] > pos[j]
            if other_author:
                keep &= author[late] != author[early]
            if not told and keep.any():
                yield pa.record_batch({"j": pos[early[keep]], "i": pos[late[keep]], "sim": sim[keep]})
    if told:
        yield pa.record_batch({"cell": pa.array([cell], pa.int32()), "rows": [len(pos)], "bounded": [products.bounded], "whole": [products.whole]})


def _work(vectors: DataFrame, rows: int, other_author: bool, since: int, told: bool) -> DataFrame:
    """The pairs, or if told the work of each task."""
    placed = vectors.where("vec is not null").select("pos", "vec", "tau", F.col("author") if other_author else F.lit(None).alias("author"))
    made = partition_of(placed, rows)
    schema = "cell int, rows long, bounded long, whole long" if told else "j long, i long, sim double"
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    held = vectors.sparkSession.sparkContext.broadcast(made)
    members = _parts(cut(_assigned(placed, held)), made.pivots.shape[1])

    def multiply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(tuple(k.as_py() for k in key), pa.Table.from_batches(list(batches)), held.value, other_author, since, told)

    return members.groupBy("cell", "a", "b").applyInArrow(multiply, schema)


def similar_pairs(vectors: DataFrame, rows: int, window: int | None = None, other_author: bool = False, since: int = 0) -> DataFrame:
    """j, i and sim of the pairs of rows with pos j < i, sim = dot product >= i's tau, and i - j <= window if there is one.

    vectors: pos (from 0, without gaps, `rows` of them), vec, tau, author. Rows without a vector have no pairs. other_author: only pairs of
    different authors. since: only pairs whose i is there or later; rows before it don't meet each other.
    """
    return _work(vectors, rows, other_author, since, False) if window is None else _near_pairs(vectors, rows, window, other_author, since)


def join_work(vectors: DataFrame, rows: int) -> DataFrame:
    """What similar_pairs() does without a window: of each task its cell, its rows (those copied there, too), and the products it bounds and makes whole."""
    return _work(vectors, rows, False, 0, True)


def _near_pairs(vectors: DataFrame, rows: int, window: int, other_author: bool, since: int) -> DataFrame:
    """similar_pairs() by blocks of positions, each with those that the window reaches."""
    size = block_size(rows)
    blocks = max(1, -(-rows // size))
    reach = -(-window // size)
    placed = vectors.where("vec is not null").select("pos", "vec", "tau", "author", F.expr(f"int(pos div {size})").alias("block"))
    lo, hi = F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))
    lo = F.when(F.col("block") < since // size, F.greatest(lo, F.lit(since // size))).otherwise(lo)
    met = placed.where(lo <= hi).withColumn("with", F.explode(F.sequence(lo, hi))).withColumn("early", F.least("block", "with")).withColumn("late", F.greatest("block", "with"))

    def multiply(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("pos")
        a, b = rows[rows.block == key[0]], rows[rows.block == key[1]]
        if not len(a) or not len(b):
            return
        sim = np.stack(b.vec.to_list()) @ np.stack(a.vec.to_list()).T  # late by early
        i, j = np.nonzero(sim >= b.tau.to_numpy()[:, None])
        pi, pj = b.pos.to_numpy()[i], a.pos.to_numpy()[j]
        keep = (pj < pi) & (pi >= since) & (pi - pj <= window)
        if other_author:
            keep &= b.author.to_numpy()[i] != a.author.to_numpy()[j]
        yield pd.DataFrame({"j": pj[keep], "i": pi[keep], "sim": sim[i, j][keep]})

    return met.groupBy("early", "late").applyInPandas(multiply, "j long, i long, sim double")


def dots_of_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (lo, hi, ...) with sim, the dot product of their vectors (id, vec)."""
    from ..functions.vectors import dot

    a, b = vectors.select(F.col("id").alias("lo"), F.col("vec").alias("__x")), vectors.select(F.col("id").alias("hi"), F.col("vec").alias("__y"))
    return pairs.join(a, "lo").join(b, "hi").withColumn("sim", dot("__x", "__y")).drop("__x", "__y")
