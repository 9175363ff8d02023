"""Token counts by a two-tier lookup of pre-token lengths.

A piece of the vocabulary holds the word mark only at its start, and none holds a line feed, so a text's tokens are those of its
pre-tokens one by one: words with the space before them, and line feeds with what follows. Their lengths come from a table. Its
first tier is broadcast: the pre-tokens that are frequent where the vocabulary was made, since those became its pieces. It is bound by the vocabulary's size, and no
pass over the corpus is needed for it. What it misses each worker encodes once and keeps in a bounded cache of its own, from task to task, which so comes to hold what is
frequent in this corpus. Nothing of pre-tokens is shuffled. The table decides how fast a length is found, never what it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import marked_pieces, sentencepiece_model

LIMIT = 4096
#: Characters of a pre-token of the broadcast table at most: 32,000 such are 2 MB at most. A worker's cache has four times as long ones.
LONGEST = 24
#: A worker's cache is emptied beyond so many entries.
CACHED = 400_000
MARK = "▁"


def pre_tokens(text: str) -> list[str] | None:
    """The text's pre-tokens without the space before them; None where spaces or marks meet, which pieces may join."""
    if "  " in text or text[:1] == " " or MARK in text:
        return None
    return text.replace("\n", " \n").split(" ") if text else []


class Lengths(dict):
    """Tokens by pre-token: the frequent ones, and those met since."""

    def __init__(self, frequent: dict[str, int], encode: Callable[[str], list[int]]):
        super().__init__(frequent)
        self.frequent, self.encode = frequent, encode

    def __missing__(self, word: str) -> int:
        # the encoder puts a mark before each; a lone mark is one token, and before a line feed there is none in the text
        n = len(self.encode(word)) - (word[:1] == "\n") if word else 1
        if len(word) <= 4 * LONGEST:
            if len(self) > CACHED:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        words = pre_tokens(text)
        return len(self.encode(text)) if words is None else sum(map(self.__getitem__, words))


def frequent_lengths(model: str) -> dict[str, int]:
    """Tokens of the pre-tokens that are pieces of the vocabulary with a mark."""
    encode = sentencepiece_model(model)
    pieces = (p[1:] for p in marked_pieces(model))
    return {w: len(encode(w)) for w in pieces if w and MARK not in w and len(w) <= LONGEST}


#: This worker's tables by model, for as long as the worker lives.
_TABLES: dict[str, Lengths] = {}


def _lengths(model: str, frequent: Broadcast) -> Lengths:
    if model not in _TABLES:
        _TABLES[model] = Lengths(frequent.value, sentencepiece_model(model))
    return _TABLES[model]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    Tokens are those of the sentencepiece model at path `model`, without begin, end or other added tokens. Null and empty texts have 0.
    Rows that repeat are counted each; other columns of docs are not read.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model, frequent)
        for b in batches:
            tokens = [lengths.count(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    named = docs.select(docs.doc_id.cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs.text), F.lit(0)).cast("long").alias("n_bytes"), docs.text.alias("text"))
    return named.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
