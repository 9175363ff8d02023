"""Vectors of texts by a pluggable function, which may fail and never costs a row."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from queue import Empty, SimpleQueue
from threading import Thread

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class ModelSpec:
    """A model as the registry knows it; tau is the similarity from which it calls two posts the same."""

    id: str
    dim: int
    tau: float
    pooling: str = "mean"
    prompt: str = ""
    dtype: str = "fp32"
    download_mb: int = 0
    licence: str = ""


MODELS: dict[str, ModelSpec] = {}


def register(spec: ModelSpec) -> ModelSpec:
    MODELS[spec.id] = spec
    return spec


register(ModelSpec("lexical", 256, 0.94))

#: Thresholds that a user may pick; anything else is the default.
PRESETS, DEFAULT_TAU = (0.94, 0.92, 0.89), 0.94


def preset(value: object) -> float:
    return next((p for p in PRESETS if value == p), DEFAULT_TAU)


def preset_of(value: Column) -> Column:
    """preset() of a column."""
    return F.when(value.isin(*PRESETS), value).otherwise(F.lit(DEFAULT_TAU))


@dataclass(frozen=True)
class Limits:
    """Texts of a call, cached vectors of a worker, failures in a row that open the circuit, the seconds it stays open, and those that a call may take."""

    batch: int = 32
    cached: int = 5_000
    failures: int = 5
    pause_s: float = 30.0
    timeout_s: float = 60.0


class Guarded:
    """An embedder with a cache of the last used vectors, which gives None for texts whose call failed, took too long or came while the circuit was open.

    A call that takes too long is left to itself: its answer is dropped when it comes. An answer of another number of vectors is a failure.
    """

    def __init__(self, embed: Embedder, limits: Limits = Limits(), clock: Callable[[], float] = time.monotonic):
        self.embed, self.limits, self.clock = embed, limits, clock
        self.cache: OrderedDict[str, list[float]] = OrderedDict()
        self.failed, self.closed_until = 0, -1.0

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        new = [t for t in dict.fromkeys(texts) if t not in self.cache]
        found: dict[str, list[float]] = {}
        for t in dict.fromkeys(texts):
            if t in self.cache:
                self.cache.move_to_end(t)
                found[t] = self.cache[t]
        for i in range(0, len(new), self.limits.batch):
            if self.clock() < self.closed_until:
                break
            some = new[i : i + self.limits.batch]
            try:
                vectors = self._answer(some)
                self.failed = 0
            except Exception:
                self.failed += 1
                if self.failed >= self.limits.failures:
                    self.failed, self.closed_until = 0, self.clock() + self.limits.pause_s
                continue
            for t, v in zip(some, vectors, strict=True):
                found[t] = self.cache[t] = v
                if len(self.cache) > self.limits.cached:
                    self.cache.popitem(last=False)
        return [found.get(t) for t in texts]


    def _answer(self, some: list[str]) -> list[list[float]]:
        answers: SimpleQueue[tuple[list[list[float]] | None, Exception | None]] = SimpleQueue()

        def call() -> None:
            try:
                answers.put((self.embed(some), None))
            except Exception as e:
                answers.put((None, e))

        Thread(target=call, daemon=True).start()  # a daemon, so that one that never answers doesn't hold the worker
        try:
            vectors, failure = answers.get(timeout=self.limits.timeout_s)
        except Empty:
            raise TimeoutError(f"no answer in {self.limits.timeout_s} s") from None
        if failure:
            raise failure
        if len(vectors) != len(some):
            raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
        return vectors


#: Bytes of a text whose trigrams are hashed at a time.
HASHED = 128 << 10


def _crc_tables() -> tuple[np.ndarray, np.uint32]:
    """What a byte at each place of three adds to their crc32; the three parts and the crc32 of three zero bytes make it by exclusive or."""
    import zlib

    zero = zlib.crc32(bytes(3))
    return np.array([[zlib.crc32(bytes(b if k == place else 0 for k in range(3))) ^ zero for b in range(256)] for place in range(3)], np.uint32), np.uint32(zero)


def lexical(dim: int = 256) -> Embedder:
    """Unit vectors of hashed character trigrams: the same on every machine, without a model."""
    (first, second, third), zero = _crc_tables()
    third = third ^ zero

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            padded = np.frombuffer(f"  {t.lower()} ".encode(), np.uint8)
            for i in range(0, len(padded) - 2, HASHED):
                some = padded[i : i + HASHED + 2]
                h = first[some[:-2]] ^ second[some[1:-1]] ^ third[some[2:]]
                # up or down by the highest bit
                counts = np.bincount((h % np.uint32(dim)).astype(np.int64) * 2 + (h >> np.uint32(31)), minlength=2 * dim)
                row += counts[1::2] - counts[::2]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).tolist()

    return embed


def embedded(posts: DataFrame, embed: Embedder, text: str = "text", prompt: str = "", limits: Limits = Limits()) -> DataFrame:
    """posts with vec, the vector of their trimmed text, one call for each distinct one; null for blank texts and failures."""
    keyed = posts.withColumn("__text", blank_to_null(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guarded = Guarded(lambda texts: embed([prompt + t for t in texts]), limits)
        for b in batches:
            yield pd.DataFrame({"__text": b["__text"], "vec": guarded(b["__text"].tolist())})

    vectors = keyed.select("__text").where("__text is not null").distinct().mapInPandas(run, "__text string, vec array<double>")
    return keyed.join(vectors, "__text", "left").drop("__text")


def embedded_by(posts: DataFrame, vectors: DataFrame, text: str = "text") -> DataFrame:
    """posts with vec from vectors (text, vec), a model's vectors of trimmed texts as a table; null for blank texts and those that it lacks."""
    keyed = posts.withColumn("__text", blank_to_null(text))
    return keyed.join(vectors.select(F.col("text").alias("__text"), "vec"), "__text", "left").drop("__text")


def pieces_known(unknown: int, most: int = 1) -> None:
    """Refuses a tokenizer that knows too little of a plain sentence."""
    if unknown > most:
        raise ValueError(f"{unknown} unknown tokens in a plain sentence: the tokenizer isn't the model's")
