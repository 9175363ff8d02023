"""Importance resampling of documents toward a target text (Xie, Santurkar, Ma and Liang, NeurIPS 2023), in two passes over Arrow batches.

Features are runs of one to three words, hashed into BUCKETS. The first pass makes one vector of bucket counts a partition by np.bincount, and treeReduce adds the vectors up,
so the driver sees the sum of a few of them, whatever the number of partitions. From the source's and the target's counts each bucket has a gain, the log of how much more
frequent it is in the target. The gains (80 KB) are broadcast; the second pass gathers each feature's gain and adds up a document's by bincount weights. Gumbel noise
from a hash of doc_id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import numbered
from .common import cut, scoped

BUCKETS = 10_000
SEED = 42
#: Documents with fewer words aren't drawn; of the others, so many in a hundred.
LEAST_WORDS, PERCENT = 20, 5
#: Vectors that one step of the reduction adds up, about.
FAN_IN = 64
#: Bytes of a text whose words are held at a time.
WINDOW = 1 << 17
#: Bytes outside words (all of ASCII but digits and letters) become spaces, A-Z lower case; other bytes stay.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256)))
_SPACE = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _hashes(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """How many words, and the CRC-32 of their features, of one window of a text's words after the other."""
    last: list[int] = []  # of the words before: that of the last one, and of the last two joined
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + WINDOW)
        end = space.start() if space else len(raw)
        words = raw[at:end].translate(_WORDS).split()
        at = end
        if not words:
            continue
        # a CRC goes on from that of what stands before: of two words from the one before, of three from those two
        single = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), last[:1] + single[:-1]))
        double = list(map(crc32, words if last else words[1:], spaced))
        before = last[1:] + double[:-1]
        third = words[len(double) - len(before) + (0 if last else 1) :]
        triple = list(map(crc32, third, map(crc32, repeat(b" "), before)))
        yield len(words), np.array(single + double + triple, np.uint32)
        last = [single[-1], *double[-1:]]


def features(text: str | bytes | None) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its features."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    found = list(_hashes(raw))
    if not found:
        return 0, np.empty(0, np.int64)
    return sum(n for n, _ in found), (np.concatenate([h for _, h in found]) % BUCKETS).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column("text").cast(pa.binary()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in _texts(b):
            for _, h in _hashes(text or b""):
                total += np.bincount(h % BUCKETS, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket has a feature of all texts of docs (text)."""
    vectors = docs.select("text").mapInArrow(_count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(parts, FAN_IN)))
    return vectors.treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of its share in target to that in source, each with one added, in thousandths and rounded down."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of its features' gains, of each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value.astype(float)  # sums stay below 2**53, so doubles are exact
        for b in batches:
            words, total, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            rows, buckets, held_features = [], [], 0

            def add_up() -> None:
                nonlocal held_features
                if rows:
                    row, found = np.concatenate(rows), np.concatenate(buckets)
                    total[:] += np.bincount(row, weights=gain[found], minlength=len(total)).astype(np.int64)
                    n[:] += np.bincount(row, minlength=len(n))
                    rows.clear()
                    buckets.clear()
                    held_features = 0

            for i, text in enumerate(_texts(b)):
                for k, h in _hashes(text or b""):
                    words[i] += k
                    buckets.append(h % BUCKETS)
                    rows.append(np.full(len(h), i))
                    held_features += len(h)
                    if held_features > WINDOW:
                        add_up()
            add_up()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(n), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    named = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.alias("text"))
    return named.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and doc_id; a null doc_id counts as empty."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


@scoped
def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (all long) of each row of docs (doc_id, text), drawn toward the texts of target (text); n_words comes after them.

    rank is 1, 2, 3... for the highest scores, ties to the smaller doc_id (null first), among rows of least_words words or more, as far as percent of those (rounded down); null for
    all others. Null and empty texts have no features and a weight of 0. Rows that repeat count, weigh and are drawn each; rows equal in doc_id and score are in any order. Empty tables
    give no rows; an empty target makes all buckets as frequent in it. Other columns aren't read.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # a row's number, once written, parts rows that are equal in all the rest
    rows = cut(scored.withColumn("down", -F.col("score")).withColumn("uid", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = numbered(able, "down", "doc_id", "uid").withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1))
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(others.select(*columns))
