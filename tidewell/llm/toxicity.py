"""Toxicity of texts by bags of subwords: vectors of character n-grams, averaged into a linear softmax, all trained together (Joulin, Grave, Bojanowski and Mikolov, EACL 2017).

A word's features are its character n-grams with its ends marked, hashed into a table of vectors, so a misspelling that was never seen still has most of its word's
vectors. A window of a few words has the average of their features' vectors, and a linear softmax over it; a text is as toxic as its most toxic window, so that an insult counts
the same in a long text. Training goes from averages of longer stretches to that of each text's most toxic window. It also misspells words at random, in all texts, so that
no single n-gram has to carry a word.

The model is fitted in one task on a bounded sample of labelled rows (LABELLED rows, of texts of LONGEST characters at most), kept as a table of one row (some 2 MB,
whatever the corpus) and broadcast from there. Scoring is linear in the vectors, so a worker adds up one number for each word, which it keeps for words it has met.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped

#: Labelled rows that the model is fitted on, and characters of one's text at most.
LABELLED, LONGEST = 6_000, 50_000
#: Words of a window; windows begin at every second of it.
WINDOW = 4
#: Characters of an n-gram, buckets of the table, and numbers of a vector.
GRAMS, BUCKETS, DIM = (3, 4, 5, 6), 1 << 16, 8
#: Rounds over the sample: on a stretch of so many words of each text, anywhere in it, then on windows.
FIRST, STRETCH, ROUNDS = 15, 64, 150
#: N-grams that fewer texts of the sample have aren't learnt.
LEAST_TEXTS = 3
#: Share of texts that are labelled toxic without being so, which the loss allows for: such a text pulls less, the surer the model is that it isn't.
MISLABELLED = 0.02
#: Share of words that a round misspells, in so many ways each at most.
MISSPELT, WAYS = 0.3, 2
RATE, RATE_SOFTMAX, DECAY, SEED = 3.0, 0.1, 1e-3, 42
#: Longer words are taken apart into pieces of so many characters.
PIECE = 32
THRESHOLD = 0.7
#: Words that n-grams are found of at a time when fitting.
WORDS = 20_000
#: Words that a worker keeps, and characters of a text whose words are held at a time.
CACHED, SLICE = 400_000, 1 << 17
_SPACE = re.compile(r"\s")
_EDGES = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~\u00a1\u00bf\u2026\u201c\u201d\u2018\u2019"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789*@$!."
_ALIKE = str.maketrans("aeiost", "@31057")


class Model(NamedTuple):
    """vectors: BUCKETS x DIM; softmax: 2 x DIM; bias: 2; prior: the score of a text without words."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    prior: float

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, softmax=self.softmax, bias=self.bias, prior=self.prior)
        return out.getvalue()

    @classmethod
    def loaded(cls, raw: bytes) -> Model:
        held = np.load(io.BytesIO(raw))
        return cls(held["vectors"], held["softmax"], held["bias"], float(held["prior"]))


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case, without signs at their ends, slice by slice; words of more than PIECE characters in pieces."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)
        end = space.start() if space else len(text)
        words = [w for x in text[at:end].lower().split() if (w := x.strip(_EDGES))]
        at = end
        if words and max(map(len, words)) > PIECE:
            words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
        if words:
            yield words


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of words, and the word (its index) that each is of."""
    marked = "".join(f"<{w}>" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    index, buckets, h = [], [], chars
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] if len(h) > 1 else h[:0]
        if n in GRAMS:
            inside = of[: len(h)] == of[n - 1 :] if len(h) else np.zeros(0, bool)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS)
            index.append(of[: len(h)][inside])
    return np.concatenate(index), np.concatenate(buckets)


def misspelt(word: str, r: np.random.Generator) -> str:
    """The word with one character changed, left out, doubled, put in, or two exchanged, or from one on with digits and signs that look like letters."""
    i, how, new = int(r.integers(len(word))), int(r.integers(6)), _LETTERS[int(r.integers(len(_LETTERS)))]
    if how == 5:
        return word[:i] + word[i:].translate(_ALIKE)
    if how == 0:
        return word[:i] + new + word[i + 1 :]
    if how == 1:
        return word[:i] + word[i + 1 :]
    if how == 2:
        return word[:i] + word[i] + word[i:]
    if how == 3:
        return word[:i] + new + word[i:]
    return word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]


def _starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end, where windows begin and end, and the text that each is of; a text has one that reaches its end."""
    step = WINDOW // 2
    n = np.maximum(1, -(-(lengths - WINDOW) // step) + 1)
    of = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lengths) - lengths)[of]
    begin = first + np.maximum(0, np.minimum(nth * step, lengths[of] - WINDOW))
    return begin, np.minimum(begin + WINDOW, first + lengths[of]), of


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many features each word has, and their buckets, word by word; found for some words at a time."""
    sizes, buckets = [], []
    for i in range(0, len(words), WORDS):
        of, bucket = grams(words[i : i + WORDS])
        sizes.append(np.bincount(of))
        buckets.append(bucket[np.argsort(of, kind="stable")].astype(np.uint16))
    return np.concatenate(sizes), np.concatenate(buckets)


def _texts_of(places: np.ndarray, lengths: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of texts laid end to end as words' numbers, how many have each bucket, or more: a word counts for as many as it stands in."""
    found, first = np.zeros(BUCKETS), 0
    texts = np.zeros(len(size))
    for n in lengths:
        texts[np.unique(places[first : first + n])] += 1
        first += n
    ends = np.cumsum(size, dtype=np.int64)
    for i in range(0, len(size), WORDS):
        some = slice(i, i + WORDS)
        found += np.bincount(bucket[ends[i] - size[i] : ends[some][-1]], weights=np.repeat(texts[some], size[some]), minlength=BUCKETS)
    return found


class _Adam:
    """Adam with one second moment for a whole array, so that n-grams move by how many texts pull them: those of a few mislabelled texts hardly do."""

    def __init__(self, of: np.ndarray, rate: float):
        self.of, self.rate, self.m, self.v, self.t = of, rate, np.zeros_like(of), 0.0, 0

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.1 * ((gradient * gradient).sum() - self.v)
        self.of -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.9**self.t)) + 1e-12)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of labelled texts; the same for the same texts in the same order. Without texts of both labels all vectors are zero, and scores the share of toxic ones."""
    r = np.random.default_rng(SEED)
    prior = (sum(toxic) + 1) / (len(toxic) + 2)
    ids: dict[str, int] = {}
    numbers = [np.fromiter((ids.setdefault(w, len(ids)) for some in words_of(t) for w in some), np.int32) for t in texts]
    told = [(n, label) for n, label in zip(numbers, toxic, strict=True) if len(n)]
    vectors, softmax, bias = r.normal(0, 1e-3, (BUCKETS, DIM)), r.normal(0, 1, (2, DIM)), np.log([1 - prior, prior])
    if len({label for _, label in told}) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), softmax.astype(np.float32), bias, prior)
    places, lengths, y = np.concatenate([n for n, _ in told]), np.array([len(n) for n, _ in told]), np.array([label for _, label in told])
    plain = list(ids)
    ways = np.array([[i] + [ids.setdefault(misspelt(w, r) if len(w) > 3 else w, len(ids)) for _ in range(WAYS)] for i, w in enumerate(plain)], np.int32)
    size, bucket = _features(list(ids))
    ends = np.cumsum(size, dtype=np.int64)
    learnt = _texts_of(places, lengths, size, bucket) >= LEAST_TEXTS
    begin, end, of = _starts(lengths)
    first_window = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    last = np.cumsum(lengths)
    steps = [_Adam(vectors, RATE), _Adam(softmax, RATE_SOFTMAX), _Adam(bias, RATE_SOFTMAX)]
    for k in range(ROUNDS):
        change = np.where(r.random(len(places), np.float32) < MISSPELT, r.integers(1, WAYS + 1, len(places), np.int8), 0)
        now = ways[places, change]
        if k < FIRST:
            chosen_begin = last - lengths + (r.random(len(y)) * np.maximum(1, lengths - STRETCH + 1)).astype(np.int64)
            chosen_end = np.minimum(chosen_begin + STRETCH, last)
        else:  # the most toxic window of each text
            gain = (vectors @ (softmax[1] - softmax[0])).astype(np.float32)[bucket]
            by_word = np.add.reduceat(gain, ends - size, dtype=np.float64)
            del gain
            total, n = np.r_[0, np.cumsum(by_word[now])], np.r_[0, np.cumsum(size[now])]
            z = (total[end] - total[begin]) / (n[end] - n[begin])
            best = np.maximum.reduceat(z, first_window)
            hit = np.flatnonzero(z == best[of])
            _, firsts = np.unique(of[hit], return_index=True)
            chosen_begin, chosen_end = begin[hit[firsts]], end[hit[firsts]]
        count = chosen_end - chosen_begin
        text_of = np.repeat(np.arange(len(y)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(chosen_begin, count)
        used, word = np.unique(now[at], return_inverse=True)
        sizes = size[used]
        feature = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[used] - sizes, sizes)
        b, head = bucket[feature], np.cumsum(sizes) - sizes
        summed = np.add.reduceat(vectors[b], head)  # of each used word
        n = np.bincount(text_of, weights=sizes[word])
        mean = np.stack([np.bincount(text_of, weights=summed[word, d]) for d in range(DIM)], 1) / n[:, None]
        z = mean @ softmax.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        toxic_now = p[:, 1]
        pull = np.where(y == 1, (1 - MISLABELLED) * toxic_now * (toxic_now - 1) / (MISLABELLED + (1 - MISLABELLED) * toxic_now), toxic_now) / len(y)
        p = np.stack([-pull, pull], 1)
        back = (p @ softmax) / n[:, None]
        by_used = np.stack([np.bincount(word, weights=back[text_of, d], minlength=len(used)) for d in range(DIM)], 1)
        owner = np.repeat(np.arange(len(used)), sizes)
        gradient = np.stack([np.bincount(b, weights=by_used[owner, d], minlength=BUCKETS) for d in range(DIM)], 1)
        gradient = np.where(learnt[:, None], gradient + DECAY * vectors / len(y), 0)
        for a, g in zip(steps, (gradient, p.T @ mean, p.sum(0)), strict=True):
            a.step(g)
    return Model(vectors.astype(np.float32), softmax.astype(np.float32), bias, prior)


class Scorer:
    """Scores texts by a model; keeps what it has added up for words."""

    def __init__(self, model: Model):
        self.gain = model.vectors.astype(float) @ (model.softmax[1] - model.softmax[0]).astype(float)
        self.bias, self.prior = float(model.bias[1] - model.bias[0]), model.prior
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.total, self.size = np.zeros(1 << 12), np.zeros(1 << 12)

    def _meet(self, words: list[str]) -> None:
        word, bucket = grams(words)
        first, n = len(self.ids), len(self.ids) + len(words)
        while n > len(self.total):
            self.total, self.size = np.r_[self.total, np.zeros_like(self.total)], np.r_[self.size, np.zeros_like(self.size)]
        self.total[first:n] = np.bincount(word, weights=self.gain[bucket], minlength=len(words))
        self.size[first:n] = np.bincount(word, minlength=len(words))
        self.ids.update(zip(words, range(first, n), strict=True))

    def __call__(self, text: str) -> float:
        totals, sizes = [], []
        for words in words_of(text):
            if new := [w for w in dict.fromkeys(words) if w not in self.ids]:
                if len(self.ids) + len(new) > CACHED:
                    self._forget()
                    new = list(dict.fromkeys(words))
                self._meet(new)
            at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            totals.append(self.total[at])
            sizes.append(self.size[at])
        if not totals:
            return self.prior
        total, size = np.r_[0, np.cumsum(np.concatenate(totals))], np.r_[0, np.cumsum(np.concatenate(sizes))]
        n = len(total) - 1
        begin = np.r_[np.arange(0, max(1, n - WINDOW), WINDOW // 2), max(0, n - WINDOW)]
        end = np.minimum(begin + WINDOW, n)
        z = float(((total[end] - total[begin]) / (size[end] - size[begin])).max()) + self.bias
        return 1 / (1 + np.exp(-z))


def is_held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from: the CRC-32 of its doc_id in decimals leaves 1 when divided by 3. A null doc_id isn't held out, and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """doc_id, text and toxic of at most `rows` labelled rows that aren't held out, by a hash of doc_id; texts over LONGEST characters and null ones aren't taken.

    A doc_id that labels has twice is toxic if one of them says so. Ids are drawn first, so that only the rows drawn are joined; `rows` ids are broadcast.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    drawn = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.alias("text")).where(F.length("text") <= LONGEST)
    # rows that repeat an id, with whatever texts, must not make the sample larger
    return texts.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: model, as Model.dumped() has it, fitted on sample()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        found = pd.concat(rows) if rows else pd.DataFrame({"text": [], "toxic": []})
        yield pd.DataFrame({"model": [fit(found["text"].tolist(), found["toxic"].astype(int).tolist()).dumped()]})

    drawn = cut(sample(docs, labels))
    return cut(drawn.coalesce(1).sortWithinPartitions("doc_id", "text").mapInPandas(run, "model binary"))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of each row of docs (doc_id, text): the whole text is read, null as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            found = [scorer(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    named = docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.alias("text"))
    return named.mapInArrow(score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@scoped
def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of each row of docs (doc_id, text), by a model of labels (doc_id, toxic).

    Null, empty and blank texts have the share of toxic rows in the sample as their score. Rows that repeat are scored each. Without documents there are no rows; without
    labels of both kinds all have that share. Other columns aren't read.
    """
    made = train(docs, labels).first()
    model = Model.loaded(bytes(made["model"]))
    return scored(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
