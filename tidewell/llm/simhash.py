"""Near-duplicate documents by SimHash, joined over a grid of per-segment bit counts.

A fingerprint's 64 bits fall into 16 segments of 4. The segments' bit counts place it in a 16-dimensional grid; the
Manhattan distance of two places is at most the fingerprints' Hamming distance. Two places at distance 2 or less have a
grid point within 1 of both, so each fingerprint enters its own point and the neighbours, and meets every candidate
in a shared point. Pairs of a point with few fingerprints are verified by the exact distance. A crowded point, such as
thousands of copies with small edits make, doesn't pair its members: these enter all values within one bit of theirs, and
all that share such a value are within 2 bits of each other, so linking each to the least of them keeps components exact.

keep_one() goes on to texts that share SIMILAR of their SIMILAR_SHINGLE-word shingles. Their fingerprints differ in some 4 to 14 of 64 bits, a distance at which places in the
grid tell nothing apart, so candidates come from TABLES fingerprints of 32 bits more instead: two that are within 2 bits in one of them share a value within
one bit of both. Candidates are verified by the exact Jaccard similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, scoped
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: A grid point with more fingerprints than this is crowded.
CROWD = 64
#: Up to so many keys of rows (8 bytes each) are broadcast to drop them; with more, the rows that stay are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Fingerprints of 32 bits for keep_one(). Texts at SIMILAR meet in one of them with probability .9, if words are edited here and there; at .9 with .999.
TABLES = 8
SIMILAR_SHINGLE, SIMILAR = 5, 0.8
#: Rows of a task that enters their values within one bit, 264 a row.
ENTERED = 4_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Bytes of a text whose words are held at a time.
_WINDOW = 1 << 17
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_windows(raw: bytes, shingle: int = SHINGLE) -> Iterator[list[bytes]]:
    """The words of a text, window by window; each begins with the shingle - 1 words before it, so that the windows' shingles are the text's."""
    carried: list[bytes] = []
    told = 0  # words of carried that a window has had
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + _WINDOW)
        end = space.start() if space else len(raw)
        words = carried + raw[at:end].lower().split()
        at = end
        if len(words) > told and (len(words) >= shingle or at == len(raw)):
            yield words
            carried = words[1 - shingle :]
            told = len(carried)
        else:
            carried = words


def _shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle of a text, window by window; of fewer words than a shingle has, that of all."""
    digest = xxhash.xxh64_intdigest
    for words in _word_windows(raw, shingle):
        joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - 1])]
        stops = ends[min(shingle, len(words)) - 1 :]
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def _bits(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, total: int) -> np.uint64:
    return np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]


def fingerprint(text: str | bytes | None, tables: int = 0) -> int | tuple[int, list[int]]:
    """The unsigned 64-bit SimHash of a text (bytes are its UTF-8); 0 if it has no words. Holds a window of its words, however long it is.

    With tables, also so many fingerprints of 32 bits (signed), of the same shingles hashed again; none if it has no words.
    """
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    counts, total = np.zeros((1 + tables // 2, 64), np.int64), 0
    for h in _shingle_hashes(raw):
        counts[0] += _bits(h)
        for k in range(tables // 2):
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[k])
            counts[1 + k] += _bits((mixed ^ (mixed >> np.uint64(29))) * np.uint64(_MIX[k - 1]))
        total += len(h)
    whole = int(_majority(counts[0], total))
    if not tables:
        return whole
    return whole, np.array([_majority(c, total) for c in counts[1:]], "<u8").view("<i4").tolist() if total else []


def _fingerprints(batches: Iterator[pa.RecordBatch], tables: int = 0) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())  # no copy; texts leave the batch one by one
        found = [fingerprint(t.as_py(), TABLES) if tables else (fingerprint(t.as_py()), None) for t in texts]
        columns = [b.column("doc_id"), b.column("rk"), pa.array(np.array([f for f, _ in found], np.uint64).view(np.int64))]
        more = [pa.array([t for _, t in found], pa.list_(pa.int32()))] if tables else []
        yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "rk", "fp", "tables"][: 3 + len(more)])


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), row_key(docs.doc_id, docs.text).alias("rk"), docs.text.alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rk (the row's key) and fp (the fingerprint's bits as a long) of each row of docs (doc_id, text)."""
    return _named(docs).mapInArrow(_fingerprints, "doc_id long, rk long, fp long")


def fingerprints_and_tables(docs: DataFrame) -> DataFrame:
    """As fingerprints(), with tables, TABLES fingerprints of 32 bits; none for texts without words."""
    return _named(docs).mapInArrow(lambda batches: _fingerprints(batches, TABLES), "doc_id long, rk long, fp long, tables array<int>")


def _segment_counts() -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned("fp", 4 * i).bitwiseAND(F.lit(15))).cast("long") for i in range(16)]


def grid_points(distinct: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint at its place in the grid and at the places next to it. A cell holds 3 bits for each segment's count."""
    counts = _segment_counts()
    place = counts[0]
    for i, c in enumerate(counts[1:], 1):
        place = place + F.shiftleft(c, 3 * i)
    near = [F.col("place")]
    for i in range(16):
        c, one = F.shiftright("place", 3 * i).bitwiseAND(F.lit(7)), F.lit(1 << 3 * i)
        near += [F.when(c < 4, F.col("place") + one), F.when(c > 0, F.col("place") - one)]
    return distinct.select("fp", place.alias("place")).select("fp", F.explode(F.array(*near)).alias("cell")).where("cell is not null")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints, which connect just those that a chain of steps of 2 bits or fewer connects."""
    cells = grid_points(distinct)
    sizes = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(cells.join(sizes, "cell"))
    few = met.where(F.col("n") <= CROWD).select("cell", "fp")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")))
    near = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = met.where(F.col("n") > CROWD).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    balls = crowd.select("fp", F.explode(flips).alias("point"))
    hubs = balls.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("point", "hub")
    stars = balls.join(hubs, "point").where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return near.union(stars)


@scoped
def groups(prints: DataFrame) -> DataFrame:
    """(fp, root): for each distinct fingerprint the least one, as a signed long, that it is linked with, itself included."""
    distinct = cut(prints.select("fp").distinct())
    found = components(links(distinct))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def assign(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text).

    component_id is the least doc_id that links of MAX_BITS or fewer differing bits reach. Null and blank texts have fingerprint
    zero and are linked like any other. Rows that repeat are kept, each with its group. A group whose doc_ids are all null has a
    null component_id. Other columns of docs are not read.
    """
    prints = cut(fingerprints(docs))
    roots = groups(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = least.join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b): keys of rows (rk, tables) of which a fingerprint is within one bit of a value that one of b's is within one bit of, too; b is each value's least.

    Of values that many rows meet at, such as those of copies with small edits, each row has one pair for each value, not one with every other.
    """
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 31 else -(1 << 31))) for i in range(32)])
    points = rows.select("rk", F.posexplode("tables").alias("nth", "fp")).select("rk", "nth", F.explode(one_bit).alias("point"))
    hubs = cut(points.groupBy("nth", "point").agg(F.min("rk").alias("hub"), F.max("rk").alias("last")).where("hub != last").drop("last"))
    hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs
    return points.join(hubs, ["nth", "point"]).where("rk != hub").select(F.col("rk").alias("a"), F.col("hub").alias("b")).distinct()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(np.concatenate([*_shingle_hashes(t.as_py() or b"", SIMILAR_SHINGLE), np.empty(0, "<u8")])).view(np.int64) for t in b.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("rk"), pa.array(found, pa.list_(pa.int64()))], names=["rk", "shingles"])


@scoped
def similar_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root): the keys among rows (rk, tables) of docs whose texts share SIMILAR of their shingles with another's, directly or by a chain; root is the least."""
    rows = cut(rows)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ENTERED))
    pairs = cut(_candidates(rows.repartition(tasks, "rk")))
    wanted = cut(pairs.select(F.col("a").alias("rk")).union(pairs.select("b")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    # cut, so that the join's memory is free when Python runs
    texts = cut(_named(docs).select("rk", "text").join(wanted, "rk", "left_semi").dropDuplicates(["rk"]))
    sets = cut(texts.mapInArrow(_shingle_sets, "rk long, shingles array<long>"))
    x, y = sets.select(F.col("rk").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rk").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("both"))
    return components(met.where(F.col("same") >= SIMILAR * (F.col("both") - F.col("same"))).select("a", "b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (null first), and of equal rows one.

    A group is what links of MAX_BITS or fewer differing bits connect, as in assign(), and then what of the rows left is SIMILAR by shingles of SIMILAR_SHINGLE words.
    """
    prints = cut(fingerprints_and_tables(docs))
    rows = prints.groupBy("fp", "doc_id", "rk").agg(F.count("*").alias("copies"))
    firsts = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "rk", "copies")).alias("row"))
    left = cut(firsts.join(groups(prints), "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*"))
    tables = prints.join(left.select("rk"), "rk", "left_semi").groupBy("rk").agg(F.first("tables").alias("tables"))
    roots = similar_rows(docs, tables)
    grouped = left.join(roots, left.rk == roots.node, "left").groupBy(F.coalesce("root", "rk").alias("root")).agg(F.min(F.struct("doc_id", "rk", "copies")).alias("row"))
    kept = cut(grouped.select(F.col("row.rk").alias("__tw_rk"), F.col("row.copies").alias("__tw_copies")))
    keyed = docs.withColumn("__tw_rk", row_key(docs.doc_id, docs.text))
    several = kept.where("__tw_copies > 1").select("__tw_rk")
    # where few rows go they are broadcast and no text is shuffled
    others = cut(rows.select(F.col("rk").alias("__tw_rk")).distinct().join(kept.where("__tw_copies = 1"), "__tw_rk", "left_anti").select("__tw_rk"))
    few = others.count() <= BROADCAST_ROWS
    once = keyed.join(F.broadcast(others), "__tw_rk", "left_anti") if few else keyed.join(kept.where("__tw_copies = 1"), "__tw_rk", "left_semi")
    if several.isEmpty():
        return once.drop("__tw_rk")
    return once.unionByName(keyed.join(several, "__tw_rk", "left_semi").dropDuplicates(["__tw_rk"])).drop("__tw_rk")
