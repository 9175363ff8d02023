"""Passages and paragraphs that repeat across documents.

Paragraphs are the newline-separated parts of a text. Those with equal words are one class; classes meet in bands of a MinHash
signature tuned for high recall at the threshold (16 bands of 4: a pair at Jaccard 0.8 meets with probability .9998). The colliding are
verified by the exact Jaccard similarity of their 5-word shingles, and components of verified pairs are what removals go by. Below 5 words
equal words alone make a class. Paragraphs below MIN_WORDS are compared with all that can be like them, in components of their own kind: with so few shingles a
signature is the least hashes of one permutation, and a band is two of those that like ones must share two of, so that none is missed.

Passages are also copied into the middle of paragraphs, where no paragraph is like another. So content-defined blocks are paragraphs, too: of every
24 consecutive shingles the one of least hash begins a block of 26 words. Two documents that share any 50 words in a row share a block, wherever it
stands. Equal blocks in several documents mark a passage; a document's overlapping marked blocks are one span of it. The words before the first
block and after the last are compared with those round the same block in other documents, so that a span is the whole of what is shared: more than
STEP - 1 words at an end would hold a block of their own. What a longer run has more than the first document's belongs to the first that has it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, row_key, scoped
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Words of a block, and shingles of which one begins a block: a shared run of STEP + BLOCK words or more always has a block.
BLOCK, STEP = 26, 24
#: Components with paragraphs of fewer words are of the kind "short"; those of the kind "paragraph" are formed without them.
MIN_WORDS = 26
#: Different shingles that a paragraph like one of fewer than MIN_WORDS words has at most.
FEW = int((MIN_WORDS - SHINGLE) / SIMILAR)
#: Up to so many paragraphs' places (20 bytes each) are broadcast to the scan that fetches their texts; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Places of a block that are compared in one task, at 200 bytes each; those of blocks that have more are dealt over tasks by each of their keys.
MANY = 50_000
_P = 0x9E3779B97F4A7C15
_SCHEMA = "doc_id long, rk long, start int, n int, h long, line int, bands array<long>, keys array<long>"
_U = np.uint64


def _hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """Each word's 64-bit hash."""
    whole, offsets = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = whole.to_pybytes() if whole else b""
    return np.fromiter((xxhash.xxh64_intdigest(held[x:y], 42) for x, y in pairwise(offsets)), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _permutations() -> np.ndarray:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * _U(2) + _U(1)


class Words:
    """The words of a batch of texts as hashes, one text after the other."""

    def __init__(self, texts: pa.Array | list[str | None]):
        if isinstance(texts, list):
            texts = pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        split = pc.split_pattern(texts.cast(pa.large_binary()).fill_null(b""), b"\n")
        of, first = np.asarray(split.value_parent_indices()), np.asarray(split.offsets)[:-1]
        # views as strings: bytes that are no UTF-8 are split at the same white space
        words = pc.ascii_split_whitespace(split.flatten().view(pa.large_string()))
        line, words = np.asarray(words.value_parent_indices()), words.flatten()
        full = np.asarray(pc.binary_length(words)) > 0  # white space at the ends of a line leaves empty ones
        line, words = line[full], words.filter(pa.array(full)).view(pa.large_binary()).dictionary_encode()
        # of paragraphs: text, from, to, and their number in the text
        begin = np.flatnonzero(np.diff(line, prepend=-1))
        at = line[begin]
        self.lines = np.stack((of[at], begin, np.append(begin[1:], len(line))[: len(begin)]), axis=1).astype(np.int64)
        self.numbers = (at - (first - first[:1])[of[at]]).tolist()
        self.text = of[line]
        self.starts = np.searchsorted(self.text, np.arange(len(texts)))
        self.hash = _hashes(words.dictionary)[np.asarray(words.indices)]
        powers = np.cumprod(np.full(len(line) + 1, _P, np.uint64)) if len(line) else np.ones(1, np.uint64)
        self.powers = np.concatenate((np.ones(1, np.uint64), powers[:-1]))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * self.powers[: len(line)])))
        n = max(0, len(line) - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            s = s * _U(_P) + self.hash[k : n + k]
        self.shingles = _mixed(s)

    def run_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the words from start to stop, the same wherever they stand."""
        inverse = _U(pow(_P, -1, 1 << 64))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(start.max(initial=0)), inverse, np.uint64))))
        return _mixed((self.sums[stop] - self.sums[start]) * down[start] + (stop - start).astype(np.uint64) * _U(_P))

    def blocks(self) -> np.ndarray:
        """Where blocks start."""
        span = STEP + SHINGLE - 1
        if len(self.hash) < max(span, BLOCK):
            return np.empty(0, np.int64)
        # where the least of 1, 2, 4 .. STEP shingles is, the first of equal ones
        least, at, n = self.shingles, np.arange(len(self.shingles)), 1
        while n < STEP:
            k = min(n, STEP - n)
            right = least[k:] < least[:-k]
            least, at, n = np.where(right, least[k:], least[:-k]), np.where(right, at[k:], at[:-k]), n + k
        inside = self.text[: len(at)] == self.text[span - 1 : span - 1 + len(at)]
        at = at[inside]
        at = at[np.diff(at, prepend=-1) > 0]  # they ascend
        at = at[at + BLOCK <= len(self.hash)]
        return at[self.text[at] == self.text[at + BLOCK - 1]]

    def long(self) -> np.ndarray:
        """Which paragraphs of lines have MIN_WORDS words or more."""
        return self.lines[:, 2] - self.lines[:, 1] >= MIN_WORDS

    def few(self) -> np.ndarray:
        """Which paragraphs of lines have a shingle and no more than FEW different ones."""
        n = self.lines[:, 2] - self.lines[:, 1] - SHINGLE + 1
        out, many = (n > 0) & (n <= FEW), np.flatnonzero(n > FEW)
        begin = np.sort(self.shingles[self.lines[many, 1][:, None] + np.arange(FEW + 1)], axis=1)
        for i in many[(begin[:, 1:] == begin[:, :-1]).any(axis=1)]:  # the others begin with more
            out[i] = len(np.unique(self.shingles[self.lines[i, 1] : self.lines[i, 1] + n[i]])) <= FEW
        return out

    def bands(self) -> np.ndarray:
        """BANDS keys for each paragraph that is long."""
        edges = self.lines[self.long(), 1:] - np.array([0, SHINGLE - 1])
        if not len(edges):
            return np.empty((0, BANDS), np.uint64)
        used = np.append(self.shingles, _U(0))  # an edge may be the end
        signature = np.empty((len(edges), BANDS * ROWS), np.uint64)
        for k, (a, b) in enumerate(_permutations().T):
            signature[:, k] = np.minimum.reduceat(used * a + b, edges.ravel())[::2]
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(edges), BANDS))
        for r in range(ROWS):
            keys = _mixed(keys * _U(_P) + signature[:, r::ROWS])
        return keys

    def few_keys(self) -> list[list[int] | None]:
        """For each paragraph of lines that is among the few, keys of which it shares one with any that is SIMILAR; for those without a shingle none; null for others.

        Of n different shingles like paragraphs have o = ceil(SIMILAR * n) in common at least, so of the n - o + 2 with the least hashes two, if o is two or more.
        """
        out: list[list[int] | None] = [[] if n < SHINGLE else None for n in (self.lines[:, 2] - self.lines[:, 1]).tolist()]
        alike = defaultdict(list)  # by how many hashes count: paragraphs and their least hashes
        for i in np.flatnonzero(self.few()).tolist():
            s = sorted(set(self.shingles[self.lines[i, 1] : self.lines[i, 2] - SHINGLE + 1].tolist()))
            o = math.ceil(SIMILAR * len(s) - 1e-9)
            n = 1 if o < 2 else len(s) - o + 2
            alike[n].append((i, s[:n]))
        for n, found in alike.items():
            least = np.array([s for _, s in found], np.uint64)
            a, b = np.array(list(combinations(range(n), 2)) or [(0, 0)]).T
            second = least[:, b] if n > 1 else _U(0)
            for (i, _), keys in zip(found, _mixed(_mixed(least[:, a]) * _U(_P) + second).view(np.int64).tolist(), strict=True):
                out[i] = keys
        return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 400):
            b = whole.slice(i, 400)
            w = Words(b.column("text"))
            at = w.blocks()
            text, start, stop = (np.concatenate(x) for x in zip((w.text[at], at, at + BLOCK), w.lines.T, strict=True))
            line = pa.array([None] * len(at) + w.numbers, pa.int32())
            bands, none = iter(w.bands().view(np.int64).tolist()), [None] * len(at)
            lists = [none + [next(bands) if x else None for x in w.long()], none + w.few_keys()]
            take = pa.array(text)
            columns = [b.column("doc_id").take(take), b.column("rk").take(take), pa.array((start - w.starts[text]).astype(np.int32)), pa.array((stop - start).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w.run_hash(start, stop).view(np.int64)), line, *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["doc_id", "rk", "start", "n", "h", "line", "bands", "keys"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, rk, start, side, h, seen (another hash of the block's words, one after the other) and keys for each place (start, h, side) of rows (rk, doc_id, text, places).

    keys are of h and the 1, 2 .. STEP - 1 words before (side 0) or after the block.
    """
    k = np.arange(1, STEP)
    for whole in batches:
        for i in range(0, whole.num_rows, 100):
            b = whole.slice(i, 100)
            w = Words(b.column("text"))
            lists = b.column("places")
            text, places = np.asarray(lists.value_parent_indices()), lists.flatten()
            start, h, side = (np.asarray(places.field(f)) for f in ("start", "h", "side"))
            at, first, ends = (w.starts[text] + start)[:, None], w.starts[text][:, None], np.append(w.starts[1:], len(w.hash))[text][:, None]
            a, z = np.where(side[:, None] == 0, at - k, at + BLOCK), np.where(side[:, None] == 0, at, at + BLOCK + k)
            inside = (a >= first) & (z <= ends)
            key = _mixed(w.run_hash(a[inside], z[inside]) + np.broadcast_to(_mixed(h.view(np.uint64) + side.astype(np.uint64))[:, None], a.shape)[inside])
            offsets = np.append(0, np.cumsum(inside.sum(axis=1))).astype(np.int32)
            take = pa.array(text)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))
            seen = np.array([xxhash.xxh64_intdigest(w.hash[x : x + BLOCK].tobytes(), 7) for x in at[:, 0].tolist()], np.uint64).view(np.int64)
            columns = [b.column("doc_id").take(take), b.column("rk").take(take), *map(pa.array, (start, side, h, seen)), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "start", "side", "h", "seen", "keys"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come in the order of h, with no h in two tables."""
    rest = []
    for b in batches:
        h = np.asarray(b.column("h"))
        if not len(h):
            continue
        last = int(np.searchsorted(h, h[-1]))
        if last or (rest and rest[-1].column("h")[-1].as_py() != h[0]):
            if last or rest:
                yield pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = []
        rest.append(b.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _more() gives of _contexts()' rows, which come in the order of h."""
    for t in _by_block(batches):
        t = t.combine_chunks()
        rk, start, side, h, seen = (np.asarray(t.column(c).combine_chunks()) for c in ("rk", "start", "side", "h", "seen"))
        doc, none = np.asarray(t.column("doc_id").combine_chunks().fill_null(np.iinfo(np.int64).max)), np.asarray(t.column("doc_id").is_null().combine_chunks())
        equal = np.ones(len(h), bool)
        edge = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        for a, z in zip(edge, np.append(edge[1:], len(h)), strict=True) if (np.minimum.reduceat(seen, edge) != np.maximum.reduceat(seen, edge)).any() else ():
            kinds, counts = np.unique(seen[a:z], return_counts=True)
            equal[a:z] = seen[a:z] == kinds[counts.argmax()]
        lists = t.column("keys").combine_chunks()
        offsets, keys = np.asarray(lists.offsets), np.asarray(lists.values)
        shared, later = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
        rows = np.flatnonzero(equal)
        for k in range(1, STEP):
            rows = rows[np.diff(offsets)[rows] >= k]
            if not len(rows):
                break
            key = keys[offsets[rows] + k - 1]
            order = np.argsort(key)
            rows, key = rows[order], key[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(edge, len(key)))
            several = np.minimum.reduceat(rk[rows], edge) != np.maximum.reduceat(rk[rows], edge)
            first, nameless = np.minimum.reduceat(doc[rows], edge), np.logical_and.reduceat(none[rows], edge)
            own = (doc[rows] == np.repeat(first, n)) & (none[rows] == np.repeat(nameless, n))
            shared[rows[np.repeat(several, n)]] = k
            later[rows[np.repeat(several, n) & ~own]] = k
            rows = rows[np.repeat(several, n)]  # the others share no more words either
        tell = np.flatnonzero((shared > 0) | ~equal)
        tell = tell[np.lexsort((side[tell], start[tell], rk[tell]))]
        same = [x[tell][1:] == x[tell][:-1] for x in (rk, start, side)]
        tell = tell[np.append(True, ~(same[0] & same[1] & same[2]))] if len(tell) else tell  # rows of one document
        yield pa.RecordBatch.from_arrays([pa.array(x[tell]) for x in (rk, start, side, shared, later, equal)], names=["rk", "start", "side", "shared", "later", "equal"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h and the sorted different shingles of each paragraph (h, text)."""
    for b in batches:
        w = Words(b.column("text"))
        sets = [np.unique(w.shingles[a : z - SHINGLE + 1]).view(np.int64) for _, a, z in w.lines]
        yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(w.lines[:, 0])), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])


def units(docs: DataFrame) -> DataFrame:
    """doc_id, rk, start and n (words), h (hash of the words), line (number), bands (of long paragraphs) and keys (of the few) of every block (line null) and paragraph of docs (doc_id, text)."""
    named = docs.select(docs.doc_id.cast("long").alias("doc_id"), row_key(docs.doc_id, docs.text).alias("rk"), docs.text.alias("text"))
    return named.mapInArrow(_units, _SCHEMA)


@scoped
def _sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """h, shingles, size and shared (how many of them another paragraph has, too) of those of classes (h, at) that are among members (h)."""
    places = cut(classes.select("h", F.col("at.rk").alias("rk"), F.col("at.line").alias("line")).join(members.select("h").distinct(), "h", "left_semi"))
    wanted = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = docs.select(row_key(docs.doc_id, docs.text).alias("rk"), docs.text.alias("text")).join(wanted, "rk")
    found = texts.select("h", F.get(F.split("text", "\n"), F.col("line")).alias("text")).dropDuplicates(["h"]).mapInArrow(_shingle_sets, "h long, shingles array<long>")
    sets = cut(found)
    of = sets.select("h", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("h").alias("h"), F.max("h").alias("hi")).where("h = hi")
    own = of.groupBy("h").agg(F.count("*").alias("own"))
    return sets.join(own, "h", "left").select("h", "shingles", F.size("shingles").alias("size"), (F.size("shingles") - F.coalesce("own", F.lit(0))).cast("int").alias("shared"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, same (common shingles) and similar of the pairs (a, b)."""
    x, y = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    counted = pairs.distinct().join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("both"))
    return counted.select("a", "b", "same", (F.col("same") >= SIMILAR * (F.col("both") - F.col("same"))).alias("similar"))


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members of buckets that hold several components yet, with their root."""
    roots = components(edges).withColumnRenamed("node", "h")
    placed = members.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    return cut(placed.join(several, "bucket", "left_semi"))


@scoped
def similar_paragraphs(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(h, root) of the paragraph classes that are similar to others; root is the least of the component.

    Only shingles that another paragraph has can be shared, so a paragraph with s such of n has similarity s / n at most, and with one of m shingles
    s / (n + m - s). First the members of each bucket are verified against one of them, that which meets most others in all its buckets: the
    text that they are copies of. Where a bucket then holds several components, each member outside the main one is verified against all
    that the bounds admit, by size and by what each has in common with the hub, so no pair at SIMILAR that meets in a bucket is missed; and
    copies with edits of their own, of which there may be thousands in a bucket, are admitted to few.
    """
    classes = cut(paragraphs.groupBy("h").agg(F.min(F.struct("rk", "line")).alias("at"), F.first("bands").alias("bands")))
    entered = classes.select("h", F.explode("bands").alias("bucket"))
    others = W.partitionBy("bucket")  # one shuffle and sort of all buckets, most of which have one class
    met = cut(entered.select("h", "bucket", F.min("h").over(others).alias("lo"), F.max("h").over(others).alias("hi")).where("lo != hi").select("h", "bucket"))
    sets = _sets(docs, classes, met)
    able = cut(met.select("bucket", "h").join(sets.where(F.col("shared") >= SIMILAR * F.col("size")).select("h", "size", "shared"), "h"))
    crowd = able.join(able.groupBy("bucket").agg(F.count("*").alias("n")), "bucket").groupBy("h").agg(F.sum("n").alias("meets"))
    members = cut(able.join(crowd, "h"))

    hubs = members.groupBy("bucket").agg(F.max_by("h", F.struct("meets", "h")).alias("hub"))
    pair = (F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b"))
    stars = cut(_measured(members.join(hubs, "bucket").where("h != hub").select(*pair), sets))
    edges = stars.where("similar").select("a", "b")
    open_ = _open(members, edges)
    # the main component of a bucket is the one with most members
    most = open_.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    # what x and y have in common is in the hub, or in what others than the hub share with either
    hubbed = open_.join(hubs, "bucket").select("*", *pair).join(stars.select("a", "b", "same"), ["a", "b"], "left").withColumn("hub_same", F.coalesce("same", "size")).drop("a", "b", "same", "hub", "meets")
    held = cut(hubbed.join(classes.select("h", "bands"), "h").withColumn("nth", F.array_position("bands", F.col("bucket"))))
    outside = held.join(most, "bucket").where("root != main").select("bucket", "main", *[F.col(c).alias(f"x_{c}") for c in ("h", "root", "size", "shared", "hub_same", "bands")])
    top = (1 + 1 / SIMILAR) * F.col("x_shared") - F.col("x_size")  # of m in shared / (size + m - shared) >= SIMILAR
    low, high = F.ceil(SIMILAR * F.col("x_size")).cast("int"), F.floor(F.least(top, F.col("x_size") / SIMILAR)).cast("int")
    asked = outside.where(low <= high).withColumn("size", F.explode(F.sequence(low, high)))
    common = F.least("hub_same", "x_hub_same") + F.least(F.col("shared") - F.col("hub_same"), F.col("x_shared") - F.col("x_hub_same"))
    possible = (1 + SIMILAR) * common >= SIMILAR * (F.col("size") + F.col("x_size"))
    before = F.col("nth").cast("int") - 1  # a pair is made in the first bucket that both are in
    first = ~F.arrays_overlap(F.slice("bands", F.lit(1), before), F.slice("x_bands", F.lit(1), before))
    met_again = asked.join(held, ["bucket", "size"]).where((F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("main")) | (F.col("h") > F.col("x_h"))) & possible & first)
    rest = _measured(met_again.select(F.least("x_h", "h").alias("a"), F.greatest("x_h", "h").alias("b")), sets)
    edges = cut(edges.union(rest.where("similar").select("a", "b")))
    return components(edges).withColumnRenamed("node", "h")


@scoped
def _near(docs: DataFrame, all_units: DataFrame) -> DataFrame:
    """The paragraphs of components that several documents have: first without those below MIN_WORDS, then components that have such."""
    paragraphs = all_units.where("line is not null")
    long = paragraphs.where(F.col("n") >= MIN_WORDS)
    roots = similar_paragraphs(docs, long)
    # a pair with a short one is among the few; pairs of others are in roots
    few = paragraphs.where("keys is not null").withColumn("bands", F.col("keys"))
    linked = cut(roots.union(similar_paragraphs(docs, few)).where("h != root").toDF("a", "b"))
    return _grouped(long, roots, "paragraph").unionByName(_grouped(paragraphs, components(linked).withColumnRenamed("node", "h"), "short"))


def _grouped(paragraphs: DataFrame, roots: DataFrame, kind: str) -> DataFrame:
    rooted = paragraphs.select("doc_id", "rk", "start", "n", "h").join(roots, "h", "left").withColumn("component", F.coalesce("root", "h"))
    rooted = cut(rooted.select("doc_id", "rk", "start", "n", "component"))
    groups = rooted.groupBy("component").agg(F.min("doc_id").alias("first_doc_id"), F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.min("n").alias("least")).where("lo != hi")
    # cut, so that the join isn't bound to the aggregate's partitions and a very large component's rows can be split
    groups = cut((groups.where(F.col("least") < MIN_WORDS) if kind == "short" else groups).drop("lo", "hi", "least"))
    return rooted.join(groups, "component").select("doc_id", F.lit(kind).alias("kind"), F.col("start").alias("start_word"), (F.col("start") + F.col("n")).alias("end_word"), "component", "first_doc_id")


def _placed(docs: DataFrame, spans: DataFrame, islands: DataFrame) -> DataFrame:
    """_contexts() of the places of all blocks that begin or end an island."""
    edges = islands.select(F.col("h0").alias("h"), F.lit(0).alias("side")).union(islands.select("h1", F.lit(1))).distinct()
    places = cut(spans.join(cut(edges).hint("shuffle_hash"), "h").groupBy("rk").agg(F.collect_set(F.struct("start", "h", "side")).alias("places")))
    n = places.agg(F.sum(F.size("places"))).first()[0] or 0
    texts = docs.select(docs.doc_id.cast("long").alias("doc_id"), row_key(docs.doc_id, docs.text).alias("rk"), docs.text.alias("text"))
    joined = texts.join(F.broadcast(places) if n <= BROADCAST_ROWS else places, "rk").select("doc_id", "rk", "text", "places")
    if n > BROADCAST_ROWS:
        joined = cut(joined)  # so that the join's memory is free when Python runs
    return joined.mapInArrow(_contexts, "doc_id long, rk long, start int, side int, h long, seen long, keys array<long>")


@scoped
def _more_of_few(docs: DataFrame, spans: DataFrame, islands: DataFrame) -> DataFrame:
    """_more() for blocks of up to MANY places: these meet in one task, which tells by the keys what they share."""
    dealt = _placed(docs, spans, islands).repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(_agreeing, "rk long, start int, side int, shared int, later int, equal boolean")


@scoped
def _more_of_many(docs: DataFrame, spans: DataFrame, islands: DataFrame) -> DataFrame:
    """_more() for blocks of any number of places: each key meets its like on its own."""
    places = cut(_placed(docs, spans, islands))
    mixed = cut(places.groupBy("h").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi")).where("lo != hi").select("h"))
    usual = places.join(mixed, "h").groupBy("h", "seen").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("seen", F.struct("n", "seen")).alias("most"))
    wrong = cut(places.join(cut(usual), "h").where("seen != most").select("rk", "start", "side").distinct())
    fine = places if wrong.isEmpty() else places.join(wrong, ["rk", "start", "side"], "left_anti")
    runs = fine.where("size(keys) > 0").withColumn("all", F.element_at("keys", -1))
    # those that agree in all words are one class; only one of it is compared with others, word by word
    classes = cut(runs.groupBy("all").agg(F.min("doc_id").alias("own"), F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.first("keys").alias("keys")))
    each = classes.select("all", "own", "lo", "hi", F.posexplode("keys").alias("k", "key"))
    several = each.groupBy("key").agg(F.min("own").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("key", "first")
    found = each.drop("lo", "hi").join(cut(several), "key").withColumn("n", F.col("k") + 1)
    told = cut(found.groupBy("all", "own").agg(F.max("n").alias("shared"), F.max(F.when(~F.col("own").eqNullSafe(F.col("first")), F.col("n"))).alias("others")))
    # whoever isn't the first of the class has that before it at every length
    later = F.when(F.col("doc_id").eqNullSafe(F.col("own")), F.col("others")).otherwise(F.col("shared"))
    more = runs.select("doc_id", "rk", "start", "side", "all").join(told, "all").select("rk", "start", "side", "shared", F.coalesce(later, F.lit(0)).alias("later"), F.lit(True).alias("equal")).distinct()
    return more.unionByName(wrong.select("*", F.lit(0).alias("shared"), F.lit(0).alias("later"), F.lit(False).alias("equal")))


def _more(docs: DataFrame, spans: DataFrame, islands: DataFrame) -> DataFrame:
    """rk, start, side, shared, later and equal: by how many words what several documents have goes on before (side 0) or after (1) the block at start, and as far as another has it first.

    Blocks were taken for equal by one hash; equal says whether the words are, too, as those of most other places of that hash.
    """
    few = _more_of_few(docs, spans.where("not many"), islands)
    many = spans.where("many")
    return few if many.isEmpty() else few.unionByName(_more_of_many(docs, many, islands))


@scoped
def _verbatim(docs: DataFrame, all_units: DataFrame) -> DataFrame:
    """The spans of what several documents have; a component is a span of the document that has its blocks first."""
    blocks = all_units.where("line is null").select("doc_id", "rk", "start", "h")
    classes = blocks.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.min("rk").alias("lo"), F.max("rk").alias("hi"), (F.count("*") > MANY).alias("many")).where("lo != hi").drop("lo", "hi")
    # classes have a row for each h: a table of them spares all blocks a sort
    marked = blocks.join(cut(classes).hint("shuffle_hash"), "h").withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    order = W.partitionBy("rk", "doc_id", "later").orderBy("start")
    opened = marked.withColumn("opens", F.coalesce(F.col("start") > F.lag("start").over(order) + BLOCK, F.lit(True)))
    spans = cut(opened.withColumn("island", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))))
    # cut, so that the join isn't bound to the aggregate's partitions and a very common passage's rows can be split
    firsts = cut(spans.where("not later").groupBy("h").agg(F.min(F.xxhash64("rk", "island")).alias("component")))
    named = spans.join(firsts, "h", "left")
    edges = [F.min("start").alias("s0"), F.max("start").alias("s1"), F.min_by("h", "start").alias("h0"), F.max_by("h", "start").alias("h1")]
    islands = cut(named.groupBy("rk", "doc_id", "later", "island").agg(*edges, F.min("component").alias("component"), F.min("first_doc_id").alias("first_doc_id")))
    more = _more(docs, spans, islands)
    for side in (0, 1):
        own = more.where(F.col("side") == side).select("rk", F.col("start").alias(f"s{side}"), F.col("shared").alias(f"all{side}"), F.col("later").alias(f"later{side}"), "equal")
        islands = islands.join(own, ["rk", f"s{side}"], "left").where("coalesce(equal, true)").drop("equal").fillna(0, [f"all{side}", f"later{side}"])
        islands = islands.withColumn(f"by{side}", F.when(F.col("later"), F.col(f"later{side}")).otherwise(F.col(f"all{side}")))
    start, end = F.col("s0") - F.col("by0"), F.col("s1") + BLOCK + F.col("by1")
    piece = lambda a, z, first: F.struct(a.alias("start_word"), z.alias("end_word"), first.alias("first_doc_id"))
    # what this document is the first to have, before and after what an earlier one has
    pieces = F.array(piece(start, end, F.col("first_doc_id")), piece(F.col("s0") - F.col("all0"), start, F.col("doc_id")), piece(end, F.col("s1") + BLOCK + F.col("all1"), F.col("doc_id")))
    found = islands.select("doc_id", "component", F.explode(pieces).alias("p")).where("p.start_word < p.end_word")
    return found.select("doc_id", F.lit("passage").alias("kind"), "p.start_word", "p.end_word", "component", "p.first_doc_id")


@scoped
def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kind (passage, paragraph or short), start_word, end_word, component, first_doc_id and removed: what documents share with others.

    A row for each span, in words; removed is true in all documents but first_doc_id, the least doc_id that has it. Paragraphs of
    MIN_WORDS or more are of the kind paragraph where they are alike; a component that has shorter ones, too, is given whole as short, so that a paragraph
    may stand in both. Null and empty texts, and those without words, share nothing. Rows equal in doc_id and text are one document. Rows with a null doc_id are documents of
    their own; null is no least doc_id but where all are null, and then all of these keep what they share. Other columns of docs are not read.
    """
    all_units = cut(units(docs))
    found = _verbatim(docs, all_units).unionByName(_near(docs, all_units))
    whole = found.select("doc_id", "kind", F.col("start_word").cast("long"), F.col("end_word").cast("long"), "component", "first_doc_id")
    return whole.withColumn("removed", ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
