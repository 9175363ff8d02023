"""Labellers' replies: the JSON in noisy text, and what it says of which row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import one_line

_JSON = json.JSONDecoder()


def largest_object(text: str | None) -> str | None:
    """The longest part of text that is a JSON object, the first of equals; None without one."""
    text, best = text or "", None
    start = text.find("{")
    while start >= 0:
        try:
            end = _JSON.raw_decode(text, start)[1]
        except (ValueError, RecursionError):
            start = text.find("{", start + 1)
            continue
        if best is None or end - start > len(best):
            best = text[start:end]
        start = text.find("{", end)  # those inside are shorter
    return best


def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(largest_object)


def salvage(replies: DataFrame) -> DataFrame:
    """batch, n, story and label of replies (batch, size, reply): entries {"n": {"story": s, "label": l}} or {"n": s}, of rows that the batch has."""
    found = replies.withColumn("object", F.pandas_udf(_objects, "string")("reply"))
    entries = found.select("batch", "size", F.explode(F.from_json("object", "map<string,string>")).alias("key", "value"))
    nested = F.from_json("value", "story string, label string")
    story = F.coalesce(F.when(F.col("value").startswith("{"), nested["story"]), F.when(~F.col("value").startswith("{"), F.col("value")))
    told = entries.select("batch", F.regexp_replace("key", r"\D", "").try_cast("int").alias("n"), "size", F.trim(story).alias("story"), one_line(nested["label"]).alias("label"))
    return told.where("n < size and story != ''").drop("size")



Labeller = Callable[[list[str]], str]
#: Labellers by name: each takes the texts of a batch and answers in prose that holds JSON.
LABELLERS: dict[str, Labeller] = {}


def ask(batches: DataFrame, name: str) -> DataFrame:
    """batch, size and reply of batches (batch, texts: array); a labeller that fails leaves its batch without a reply, to be asked again."""
    labeller = LABELLERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows = []
            for batch, texts in zip(b.batch, b.texts, strict=True):
                try:
                    rows.append((batch, len(texts), labeller(list(texts))))
                except Exception:
                    rows.append((batch, len(texts), None))
            yield pd.DataFrame(rows, columns=["batch", "size", "reply"])

    return batches.select("batch", "texts").mapInPandas(run, "batch long, size int, reply string")
