"""Removal of lines that an earlier line of the corpus equals, or equals but for one edited character.

A deletion neighbourhood says which lines may be one edit apart: deleting one character of each, or of the longer one,
gives the same variant. A line has as many variants as characters, so they are hashed only where a partner can exist. Of
a line cut into segments, one edit changes one segment; all else of the line is a key for it. Lines that share such a
key with another line, first for two segments and then for about sqrt(length) of them, emit the variants of that one
segment. Nothing is lost: two lines within the bound share the key of the segment where they differ, and in it a variant.

Everything is DataFrame operations, and sizes are linear: groups of equal variants are reduced to their earliest line,
never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, row_key, scoped

#: Shorter lines (in characters, trimmed) are duplicates only of equal ones.
MIN_FUZZY = 20
MAX_EDITS = 1
#: Up to so many suspect lines are broadcast to the scan that fetches their texts (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 400_000
_BLANK = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame) -> DataFrame:
    """rk, doc_id, pos (from 0) and line (trimmed) of every line with a word."""
    lines = docs.select(row_key(docs.doc_id, docs.text).alias("rk"), docs.doc_id.alias("doc_id"), F.posexplode(F.split(docs.text, "\n")).alias("pos", "line"))
    return lines.select("rk", "doc_id", "pos", F.btrim("line", F.lit(_BLANK)).alias("line")).where("line != ''")


def _half_keys() -> Column:
    """A line's keys when it is cut in two: for its own length, and as the shorter of a pair, for a length of one more."""
    return F.expr(f"""
        case when n >= {MIN_FUZZY} then array(
            xxhash64(n, 0, substring(line, n div 2 + 1)), xxhash64(n, 1, left(line, int(n div 2))),
            xxhash64(n + 1, 0, substring(line, int((n + 1) div 2))), xxhash64(n + 1, 1, left(line, int((n + 1) div 2))))
        else cast(array() as array<bigint>) end""")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """h, first (doc_id, rk and pos of the earliest line of this text) and keys of each distinct line."""
    keyed = lines.select(F.xxhash64("line").alias("h"), F.struct("doc_id", "rk", "pos").alias("first"), F.length("line").alias("n"), "line").select("h", "first", _half_keys().alias("keys"))
    return keyed.groupBy("h").agg(F.min("first").alias("first"), F.first("keys").alias("keys"))


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (h, key, ...) whose key several lines have."""
    often = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").select("key")
    return keyed.join(often, "key", "left_semi")


def _suspects(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h, first and line of the distinct lines that share all but one half with another."""
    ids = _shared(distinct.select("h", F.explode("keys").alias("key"))).select("h").distinct()
    firsts = cut(distinct.join(ids, "h", "left_semi").select("h", "first"))
    small = firsts.count() <= BROADCAST_ROWS
    wanted = firsts.select("h", "first", F.col("first.rk").alias("rk"), F.col("first.pos").alias("pos"))
    found = lines.select("rk", "pos", "line").join(F.broadcast(wanted) if small else wanted, ["rk", "pos"])
    # a row that is there twice gives its lines twice
    return cut(found.groupBy("h").agg(F.first("first").alias("first"), F.first("line").alias("line")))


_SEGMENTS = "transform(sequence(0, m - 1), j -> named_struct('j', j, 'from', int(j * l div m), 'to', int((j + 1) * l div m)))"


def _segment_keys(suspects: DataFrame) -> DataFrame:
    """h, first, key and part: a row for each segment that may differ from a partner's. short: the line is the shorter of the pair."""
    roles = suspects.withColumn("n", F.length("line")).withColumn("short", F.explode(F.array(F.lit(False), F.lit(True))))
    sized = roles.withColumn("l", F.expr("bigint(n) + int(short)")).withColumn("m", F.expr("int(greatest(2, ceil(sqrt(l) / 3)))"))
    cutup = sized.withColumn("s", F.explode(F.expr(_SEGMENTS)))
    return cutup.select(
        "h", "first", "short", F.col("s.from").alias("from"),
        F.expr("xxhash64(l, s.j, left(line, s.from), substring(line, s.to + 1 - int(short)))").alias("key"),
        F.expr("substring(line, s.from + 1, s.to - s.from - int(short))").alias("part"),
    )


def _variants(segments: DataFrame) -> DataFrame:
    """v, p, h and first: the deletion variants of each segment, and of the shorter role the segment as it is, with p = -1."""
    deleted = "transform(sequence(1, length(part)), i -> named_struct('p', from + i, 'v', xxhash64(key, concat(left(part, i - 1), substring(part, i + 1)))))"
    own = segments.where("not short and part != ''").select("h", "first", F.explode(F.expr(deleted)).alias("d")).select("d.v", "d.p", "h", "first")
    return own.union(segments.where("short").select(F.xxhash64("key", "part"), F.lit(-1), "h", "first"))


@scoped
def near_duplicates(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """h and near: each distinct line that is one edit from an earlier one, and the earliest such (struct first, h)."""
    suspects = _suspects(lines, distinct)
    met = _variants(_shared(_segment_keys(suspects)))
    me = F.struct("first", "h")
    group, place = W.partitionBy("v"), W.partitionBy("v", "p")
    seen = met.select(
        "h", "first", "p",
        F.min(F.when(F.col("p") < 0, me)).over(group).alias("whole"),
        F.min(F.when(F.col("p") >= 0, me)).over(group).alias("longer"),
        F.min(me).over(place).alias("same"),
    )
    near = seen.select("h", "first", F.when(F.col("p") < 0, F.col("longer")).otherwise(F.least("whole", "same")).alias("near"))
    earliest = near.where("near.first < first").groupBy("h").agg(F.min("near").alias("near"))
    texts = suspects.select("h", "line")
    both = earliest.join(texts, "h").join(texts.toDF("near_h", "near_line"), F.col("near.h") == F.col("near_h"))
    return both.where(F.levenshtein("line", "near_line", MAX_EDITS) >= 0).select("h", "near")


@scoped
def _kept(docs: DataFrame) -> DataFrame:
    """rk and kept: the numbers of the lines that each document keeps, in order."""
    lines = lines_of(docs)
    distinct = cut(distinct_lines(lines))
    near = near_duplicates(lines, distinct).select("h")
    kept = distinct.select("h", "first.rk", "first.pos").join(near, "h", "left_anti")
    return kept.groupBy("rk").agg(F.collect_list("pos").alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with duplicate lines gone from text, and two columns more: __tw_lines and __tw_removed, counts of lines with a word.

    A line (between \\n, compared without white space at its ends) goes if a line earlier by (doc_id, place in the document) equals it,
    or is MAX_EDITS edit from it and both have MIN_FUZZY characters or more. Lines without a word stay. Null texts stay null, empty ones
    empty. Rows equal in doc_id and text are one document delivered twice: both keep the same lines. A null doc_id comes before all others.
    """
    kept = _kept(docs).select(F.col("rk").alias("__tw_rk"), F.col("kept").alias("__tw_kept"))
    joined = docs.withColumn("__tw_rk", row_key(docs.doc_id, docs.text)).join(kept, "__tw_rk", "left")
    split = joined.withColumn("__tw_split", F.split(F.coalesce(docs.text, F.lit("")), "\n"))
    blank = F.expr(f"filter(transform(__tw_split, (x, i) -> if(btrim(x, '{_BLANK}') = '', i, null)), i -> i is not null)")
    counted = split.withColumn("__tw_blank", blank).withColumn("__tw_kept", F.coalesce("__tw_kept", F.expr("cast(array() as array<int>)")))
    counted = counted.withColumn("__tw_lines", F.expr("bigint(size(__tw_split) - size(__tw_blank))")).withColumn("__tw_removed", F.expr("__tw_lines - size(__tw_kept)"))
    text = F.when(F.col("__tw_removed") == 0, F.col("text")).otherwise(F.expr("array_join(transform(array_sort(concat(__tw_blank, __tw_kept)), i -> get(__tw_split, i)), '\n')"))
    return counted.withColumn("text", text).drop("__tw_rk", "__tw_split", "__tw_kept", "__tw_blank")


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without duplicate lines, as dedup(); documents that lose every line go. n_chars, where docs has it, is counted anew."""
    left = dedup(docs).where("__tw_removed = 0 or __tw_removed < __tw_lines").drop("__tw_lines", "__tw_removed")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
