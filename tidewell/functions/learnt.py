"""An embedding model with parameters, learnt from texts: words' vectors from the words beside them, by random projection (Kanerva, Kristofersson and Holst, CogSci 2000).

Each word has a direction of signs that its hash tells; a word's vector is the sum of the directions of its neighbours, weighted by how often they meet (by the logarithm) and how rare they are. So words that
stand beside the same words point the same way. Counting is one aggregation of neighbouring pairs; the vocabulary is bound by a parameter, and so is the table of vectors (a row a word), which is broadcast.
A text's vector is the mean of its words', weighted by rarity, at length 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut
from .embed import Embedder, ModelSpec, register
from .text import blank_to_null

#: Words of the vocabulary, and numbers of a vector (a bit of a 128-bit hash each).
WORDS, DIM = 20_000, 64
#: Texts that the model is given at a time.
BATCH = 256
_BLANK = re.compile("[ \t\n\x0b\f\r]+")
SPEC = register(ModelSpec("neighbours", DIM, 0.94, "mean"))


def words_of(text: str | Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def signs(word: Column, dim: int = DIM) -> list[Column]:
    """A word's direction: 1 or -1 in each dimension, by the bits of its hash."""
    nibble = lambda i: F.conv(F.substring(F.md5(word), 1 + i // 4, 1), 16, 10).cast("int")
    return [F.when(F.shiftright(nibble(i), i % 4).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) for i in range(dim)]


def vocabulary(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """word and rarity (ln((1 + n) / (1 + df)) + 1) of the `words` most frequent words of texts (text), ties by word."""
    n = texts.agg(F.count("text").alias("n"))
    # a text says each of its words once more for df, so that no word is shuffled with its text
    w, said = words_of("text"), lambda tf, df: lambda x: F.struct(x.alias("word"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    each = texts.select(w.alias("w")).select(F.explode(F.concat(F.transform("w", said(1, 0)), F.transform(F.array_distinct("w"), said(0, 1)))).alias("x")).select("x.*")
    most = each.groupBy("word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).orderBy(F.desc("tf"), "word").limit(words)
    return most.crossJoin(F.broadcast(n)).select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("rarity"))


def learn(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """word, rarity and vec (DIM numbers, of length 1; zeros for a word that stands alone) of the vocabulary of texts (text). Null texts have no words."""
    known = cut(vocabulary(texts, words).withColumn("at", F.monotonically_increasing_id()))
    w = texts.select(words_of("text").alias("w")).where(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    # words outside the vocabulary fall out where texts are; pairs of numbers are counted there, then once by both ends
    number = lambda c: F.broadcast(known.select(F.col("word").alias(c), F.col("at").alias(f"at_{c}")))
    met = pairs.join(number("a"), "a").join(number("b"), "b").groupBy("at_a", "at_b").agg(F.count("*").alias("n"))
    both = met.select(F.col("at_a").alias("at"), F.col("at_b").alias("beside"), "n").unionByName(met.select(F.col("at_b").alias("at"), F.col("at_a").alias("beside"), "n"))
    beside = F.broadcast(known.select(F.col("at").alias("beside"), F.col("rarity").alias("weight"), F.array(*signs(F.col("word"))).alias("way")))
    near = both.groupBy("at", "beside").agg(F.sum("n").alias("n")).join(beside, "beside")
    pull = F.log(1 + F.col("n")) * F.col("weight")
    sums = near.groupBy("at").agg(*[F.sum(pull * F.col("way")[i]).alias(f"v{i}") for i in range(DIM)])
    vec = F.array(*[F.coalesce(f"v{i}", F.lit(0.0)) for i in range(DIM)])
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    made = known.join(sums, "at", "left").select("word", "rarity", vec.alias("vec"))
    return made.select("word", "rarity", F.transform("vec", lambda v: v / F.greatest(length, F.lit(1e-9))).alias("vec"))


class Words:
    """The learnt table as workers hold it."""

    def __init__(self, words: list[str], rarity: np.ndarray, vectors: np.ndarray):
        self.at, self.rarity, self.vectors = {w: i for i, w in enumerate(words)}, rarity, vectors

    @classmethod
    def of(cls, model: DataFrame) -> Words:
        """From the table of learn(), whose rows its parameter bounds."""
        rows = model.select("word", "rarity", "vec").collect()
        return cls([r.word for r in rows], np.array([r.rarity for r in rows], float), np.array([r.vec for r in rows], float).reshape(len(rows), -1))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """The vectors of texts; zeros for a text without known words."""
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for row, text in zip(out, texts, strict=True):
            at = np.array([i for w in _BLANK.split((text or "").lower()) if (i := self.at.get(w)) is not None], np.int64)
            if len(at):
                row += self.rarity[at] @ self.vectors[at]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()


def embedder(model: DataFrame) -> Embedder:
    """The model as a function of texts, for embed.embedded() and whoever else is handed one."""
    held = model.sparkSession.sparkContext.broadcast(Words.of(model))
    return lambda texts: held.value(texts)


def with_vectors(posts: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """posts with vec, the model's vector of their text, in batches; null for blank texts and those without a word that it knows."""
    held = model.sparkSession.sparkContext.broadcast(Words.of(model))

    def load() -> Callable[[np.ndarray], np.ndarray]:
        words = held.value
        return lambda texts: np.array(words([t for t in texts]))

    predict = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=BATCH)
    found = posts.withColumn("__text", blank_to_null(text)).withColumn("vec", predict(F.coalesce("__text", F.lit(""))))
    return found.withColumn("vec", F.when(F.exists("vec", lambda v: v != 0), F.col("vec"))).drop("__text")
