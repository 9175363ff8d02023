"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Documents come in bands of length, each half as long as the one before, and a band is placed in rounds. A round
range-sorts the band's documents and the gaps that sequences have left, longest first, into ranges of a bounded number of rows. Each range is swept on
its own: its documents, the longest first, go to their successors, the smallest gaps that hold them, and what is left of a gap is a gap
again. Documents that find none in their range all want the gaps that larger ranges have left over: this is settled by rank, the n-th document getting
the n-th gap of the next larger range that has any, or as many documents one gap as are sure to fit. Only each range's counts reach the driver for that. Gaps are
updated, and rounds go on until the documents left are longer than any gap. These are packed among themselves into new sequences, range by range. Sequences
are named after the piece that opened them. Where one range holds all, this is best-fit decreasing, piece by piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut
from .tokens import byte_bpe_array

CAPACITY = 2048
END = 0
#: Rows (some 60 bytes each) of a range that one task sweeps, and that a range has at least where there are fewer ranges than shuffle partitions.
RANGE_ROWS, LEAST_ROWS = 250_000, 2_000
#: Pieces shorter than capacity / SHORTEST_BAND are one band.
SHORTEST_BAND = 32

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_GAP, _PLACED, _LEFT, _OFFERED = range(4)
_SWEPT = f"{_PIECE}, uid long, state int, part int, rank long, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """The lengths of the pieces of a document of `total` tokens: all full but the first."""
    head = total % capacity
    return [head] * bool(head) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and uid (of the piece's row, from 0 up) of each piece of each row of docs (doc_id, text); a null text is empty."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = byte_bpe_array(ranks), TaskContext.get().partitionId() << 33
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    for column, x in zip(rows, (doc.as_py(), k, start, n, zlib.crc32(ids[start : start + n]), uid), strict=True):
                        column.append(x)
                    start, uid = start + n, uid + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.alias("text")).mapInArrow(cut_up, f"{_PIECE}, uid long")


class Gaps:
    """The gaps of a range's sequences by size."""

    def __init__(self) -> None:
        self.of: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def put(self, size: int, sequence: int) -> None:
        if size:
            if size not in self.of:
                insort(self.sizes, size)
                self.of[size] = []
            self.of[size].append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """The smallest gap that holds length, and its sequence."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        size = self.sizes[i]
        sequence = self.of[size].pop()
        if not self.of[size]:
            del self.of[self.sizes.pop(i)]
        return size, sequence


def _sweeper(capacity: int, opens: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sweeps a range of pieces and gaps (rows of _SWEPT; of gaps, length is the size); a piece that fits no gap of the range opens a sequence, or is _LEFT with its rank."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        length, state, uid, sequence, offset = (table.column(c).to_numpy().copy() for c in ("length", "state", "uid", "sequence_id", "offset"))
        part, least = TaskContext.get().partitionId(), int(length.min())
        gaps, left = Gaps(), 0
        for i in np.flatnonzero(state == _GAP).tolist():
            gaps.put(int(length[i]), int(sequence[i]))
        todo = np.flatnonzero(state != _GAP)
        todo = todo[np.argsort(-length[todo], kind="stable")]
        rank = np.zeros(len(length), np.int64)
        for i in todo.tolist():
            n = int(length[i])
            found = gaps.take(n) or ((capacity, int(uid[i])) if opens else None)
            if found:
                size, sequence[i] = found
                offset[i], state[i] = capacity - size, _PLACED
                gaps.put(size - n, int(sequence[i]))
            else:
                rank[i], state[i] = left, _LEFT
                left += 1
        told = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "uid"]).take(todo)
        columns = [state[todo].astype(np.int32), np.full(len(todo), part, np.int32), rank[todo], sequence[todo], offset[todo]]
        yield from pa.table([*told.columns, *map(pa.array, columns)], names=_names()).to_batches(max_chunksize=50_000)
        sizes = np.array([s for s in gaps.sizes for _ in gaps.of[s]], np.int64)
        of = np.array([x for s in gaps.sizes for x in gaps.of[s]], np.int64)
        # what this range has left over fits any piece of a smaller range, unless it has shrunk out of the range
        offered = sizes >= least
        rank = np.where(offered, np.cumsum(offered) - 1, 0)
        yield from _gap_rows(sizes, of, np.where(offered, _OFFERED, _GAP).astype(np.int32), np.full(len(of), part, np.int32), rank).to_batches(max_chunksize=50_000)

    return sweep


def _names() -> list[str]:
    return [c.split()[0] for c in _SWEPT.split(", ")]


def _gap_rows(sizes: np.ndarray, sequences: np.ndarray, state: np.ndarray, part: np.ndarray, rank: np.ndarray) -> pa.Table:
    n, none = len(sizes), lambda kind: pa.nulls(len(sizes), kind)
    columns = [none(pa.int64()), none(pa.int32()), none(pa.int64()), sizes, none(pa.int64()), np.zeros(n, np.int64), state, part, rank, sequences, np.zeros(n, np.int64)]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_names())


def _swept(rows: DataFrame, capacity: int, opens: bool) -> DataFrame:
    """rows after a sweep of each range. Gaps stand before pieces of their size, so that a piece's gaps are in its range or in larger ones."""
    n, partitions = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-n // RANGE_ROWS), min(partitions, -(-n // LEAST_ROWS)))
    named = rows.select(*_names())
    dealt = named.repartitionByRange(ranges, F.desc("length"), F.expr(f"state != {_GAP}"), "sequence_id", "uid") if ranges > 1 else named.coalesce(1)
    return cut(dealt.mapInArrow(_sweeper(capacity, opens or ranges <= 1), _SWEPT))


def _intervals(counts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(part, low, high, of_part, first, each): pieces left in `part` with ranks from low to below high go, `each` to a gap, to the gaps that of_part has left, from rank `first` on.

    counts: (part, pieces left, the longest of them, gaps left, the smallest of them), of larger ranges first.
    """
    larger: list[list[int]] = []
    out = []
    for part, n, longest, gaps, smallest in sorted(counts):
        rank = 0
        while rank < n and larger:
            of, first, end, size = larger[-1]
            each = size // longest
            used = min(end - first, -(-(n - rank) // each))
            high = min(n, rank + used * each)
            out.append((part, rank, high, of, first, each))
            rank, larger[-1][1] = high, first + used
            if first + used == end:
                larger.pop()
        if gaps:
            larger.append([part, 0, gaps, smallest])
    return out


def _by_rank(swept: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, bool]:
    """What swept has left: pieces placed by rank; the other pieces and all gaps; and whether a piece may fit a gap yet."""
    is_left, is_gap = F.col("state") == _LEFT, F.col("state") == _OFFERED
    told = swept.where(is_left | is_gap).groupBy("part").agg(F.count_if(is_left).alias("n"), F.max(F.when(is_left, F.col("length"))), F.count_if(is_gap), F.min(F.when(is_gap, F.col("length"))))
    found = _intervals([tuple(r) for r in told.collect()])
    if not found:
        return swept.where("false"), swept.where(F.col("state") != _PLACED), False
    table = swept.sparkSession.createDataFrame(found, "part int, low long, high long, of_part int, first long, each long")
    asked = swept.where(is_left).join(F.broadcast(table), "part").where("rank >= low and rank < high")
    asked = asked.select("doc_id", "piece", "start", "length", "ids_crc32", "uid", F.col("of_part").alias("part"), F.expr("first + (rank - low) div each").alias("rank"))
    gaps = swept.where(is_gap).select("part", "rank", "sequence_id", F.col("length").alias("gap"))
    met = asked.join(gaps, ["part", "rank"])
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")
    placed = cut(met.withColumn("offset", F.lit(capacity) - F.col("gap") + before).withColumn("state", F.lit(_PLACED)).select(*_names()))
    filled = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    gaps = swept.where(F.col("state").isin(_GAP, _OFFERED)).join(filled, "sequence_id", "left").withColumn("length", F.col("length") - F.coalesce("filled", F.lit(0)))
    others = swept.where(is_left).join(F.broadcast(table), (swept.part == table.part) & F.expr("rank >= low and rank < high"), "left_anti")
    rest = cut(others.select(*_names()).union(gaps.where("length > 0").select(*_names())))
    last = rest.agg(F.min(F.when(is_left, F.col("length"))), F.max(F.when(~is_left, F.col("length")))).first()
    return placed, rest, last[0] is not None and last[1] is not None and last[1] >= last[0]


def pack(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset: a row for each piece of each row of docs (doc_id, text).

    A document is its token ids and END; one longer than capacity is cut into full pieces but for the first. Null and empty texts are END alone.
    Rows that repeat are packed each. No documents give no rows. Other columns of docs are not read. ranks: path of the byte-level vocabulary.
    """
    cuts = cut(pieces(docs, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity))
    return pack_pieces(cuts, capacity)


def pack_pieces(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of cuts, as pieces() gives them, with sequence_id and offset; lengths are 1 to capacity."""
    opened = {"state": F.lit(_PLACED), "part": F.lit(0), "rank": F.lit(0).cast("long"), "sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")}
    alone = cuts.where(F.col("length") > capacity // 2).withColumns(opened)  # no two of these share a sequence
    done = [alone]
    gaps = alone.where(F.col("length") < capacity).select(F.col("uid").alias("sequence_id"), (F.lit(capacity) - F.col("length")).alias("length"))
    empty = {"doc_id": "long", "piece": "int", "start": "long", "ids_crc32": "long"}
    gaps = gaps.select(*[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "length", F.lit(0).cast("long").alias("uid"), F.lit(_GAP).alias("state"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("rank"), "sequence_id", F.lit(0).cast("long").alias("offset")).select(*_names())
    high = capacity // 2
    while high:
        low = 0 if high <= capacity // SHORTEST_BAND else high // 2
        band = cuts.where(F.col("length").between(low + 1, high)).withColumns(opened | {"state": F.lit(_LEFT)}).select(*_names())
        small, rows = gaps.where(F.col("length") <= low), band.unionByName(gaps.where(F.col("length") > low))
        goes_on = True
        while goes_on:
            rows = rows.withColumn("state", F.expr(f"if(state = {_OFFERED}, {_GAP}, state)"))
            swept = _swept(rows, capacity, opens=False)
            placed, rows, goes_on = _by_rank(swept, capacity)
            done += [swept.where(F.col("state") == _PLACED), placed]
        left = rows.where(F.col("state") == _LEFT)
        gaps = small.unionByName(rows.where(F.col("state") != _LEFT))
        if not left.isEmpty():
            fresh = _swept(left, capacity, opens=True)
            done.append(fresh.where(F.col("state") == _PLACED))
            gaps = gaps.unionByName(fresh.where(F.col("state") != _PLACED))
        gaps = gaps.withColumn("state", F.lit(_GAP))
        high = low
    out = done[0].select(*_names())
    for d in done[1:]:
        out = out.unionByName(d.select(*_names()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
