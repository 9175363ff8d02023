"""Timelines that come again and again, of which only those that changed are decided anew.

A digest of each timeline's items is kept from one coming to the next. Where it is the same, the decisions are; where it isn't, as when a heading comes late, the whole timeline is decided anew,
and what differs from before is told as retractions and additions, as a stream's consumer takes them. Digests are sums over items, added up where these are, so a long timeline is no group.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


class Refreshed(NamedTuple):
    """digests and decisions: what the next coming takes. changes: the decisions' columns and op, - for a decision that no longer holds and + for a new one. redone: timelines decided anew."""

    digests: DataFrame
    decisions: DataFrame
    changes: DataFrame
    redone: int


def digests(items: DataFrame, timeline: str = "timeline_id") -> DataFrame:
    """timeline and digest of each timeline: two sums of hashes of 64 bits, and a count."""
    rest = sorted(c for c in items.columns if c != timeline)
    # a null and another column's value must not hash alike
    said = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return items.groupBy(timeline).agg(F.concat_ws(":", F.count("*").cast("string"), total(F.xxhash64(said)), total(F.xxhash64(F.lit("again"), said))).alias("digest"))


def refreshed(items: DataFrame, decide: Callable[[DataFrame], DataFrame], before: Refreshed | None = None, timeline: str = "timeline_id", pos: str = "pos") -> Refreshed:
    """The decisions on items (timeline, pos, and others), given those of the last coming. decide: from items of whole timelines to rows (timeline, pos, and what is decided).

    Timelines that are gone are retracted. Null timelines aren't decided; of repeated places each counts, so decide should give each place once.
    """
    items = items.where(F.col(timeline).isNotNull())
    now = cut(digests(items, timeline))
    if before is None:
        decided = cut(decide(items))
        return Refreshed(now, decided, decided.withColumn("op", F.lit("+")), now.count())
    old = before.digests.withColumnRenamed("digest", "was")
    other = cut(now.join(old, timeline, "full").where(~F.col("digest").eqNullSafe(F.col("was"))).select(timeline, F.col("digest").isNotNull().alias("here")))
    fresh = cut(decide(items.join(other.where("here").select(timeline), timeline, "left_semi")))
    stale = before.decisions.join(other.select(timeline), timeline, "left_semi")
    said = [c for c in fresh.columns if c not in (timeline, pos)]
    a = stale.select(timeline, pos, F.struct(*said).alias("__old"), F.lit(True).alias("__had"))
    b = fresh.select(timeline, pos, F.struct(*said).alias("__new"), F.lit(True).alias("__has"))
    met = a.join(b, [timeline, pos], "full").where(~F.col("__old").eqNullSafe(F.col("__new")) | F.col("__had").isNull() | F.col("__has").isNull())
    told = F.array(F.struct(F.lit("-").alias("op"), F.col("__had").alias("is"), F.col("__old").alias("said")), F.struct(F.lit("+").alias("op"), F.col("__has").alias("is"), F.col("__new").alias("said")))
    changes = met.select(timeline, pos, F.explode(told).alias("__c")).where("__c.is").select(timeline, pos, "__c.said.*", "__c.op")
    kept = before.decisions.join(other.select(timeline), timeline, "left_anti")
    return Refreshed(now, cut(kept.unionByName(fresh)), changes, other.where("here").count())
