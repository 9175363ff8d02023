"""Message catalogues: one JSON file for each language, and the texts looked up in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_locales(spark: SparkSession, path: str) -> DataFrame:
    """lang, key and message of files <lang>/messages.json that map keys to {"message": ...}."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("lang"), F.from_json("value", "map<string, struct<message: string>>").alias("m"))
    return files.select("lang", F.explode("m").alias("key", "v")).select("lang", "key", F.col("v.message").alias("message"))


def catalogue(rows: DataFrame) -> DataFrame:
    """lang and messages (a map) of rows (lang, key, message), as localised() takes it."""
    return rows.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "message")))).alias("messages"))


def with_fallback(rows: DataFrame, fallback: str = "en") -> DataFrame:
    """lang, key and message for every key of every language: its own message, or the fallback's where that is missing or empty."""
    base = rows.where(F.col("lang") == fallback).select("key", F.col("message").alias("__base"))
    every = rows.select("lang").distinct().crossJoin(base)  # languages are few
    own = rows.select("lang", "key", F.nullif("message", F.lit("")).alias("__own"))
    return every.join(own, ["lang", "key"], "left").select("lang", "key", F.coalesce("__own", "__base").alias("message"))
