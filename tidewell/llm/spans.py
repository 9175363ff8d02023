"""Places of a regex's matches as column expressions, in time linear in the text and nearly so in the matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before and after a match that it is told with.
BEFORE, AFTER = 48, 1
_NONE = "array<struct<start:int,end:int,raw:string,before:string,after:string>>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once, however often f names it and in whatever loops."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def none() -> Column:
    return F.array().cast(_NONE)


def spans(text: Column, regex: str) -> Column:
    """told_spans() without what stands next to them."""
    return F.transform(told_spans(text, regex), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw")))


def told_spans(text: Column, regex: str) -> Column:
    """The leftmost non-overlapping matches of regex: an array of structs start, end (code points, end exclusive), raw, before and after, in order.

    before and after are up to BEFORE and AFTER characters of the text next to the match; of before, no more than the gap before the match, the match before
    that and its gap. regex mustn't match the empty string. No matches and null texts give an empty array.

    The gaps between matches and the matches' own lengths add up to the places. They are added up in blocks of about the root of their number, and the
    blocks' sums after that, since what a fold appends to is copied each time. Nothing is cut from the text's beginning again for each match.
    """
    end = lambda of, n: F.right(of, F.lit(n))

    def tell(raws: Column, gaps: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            before = F.concat(end(F.coalesce(F.get(gaps, i - 1), F.lit("")), BEFORE), end(F.coalesce(F.get(raws, i - 1), F.lit("")), BEFORE), end(F.get(gaps, i), BEFORE))
            after = F.concat(F.left(F.get(gaps, i + 1), F.lit(AFTER)), F.left(F.coalesce(F.get(raws, i + 1), F.lit("")), F.lit(AFTER)))
            return F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(raw).alias("n"), raw.alias("raw"), end(before, BEFORE).alias("before"), F.left(after, F.lit(AFTER)).alias("after"))

        return F.transform(raws, one)

    def search(raws: Column) -> Column:
        return F.when(F.size(raws) > 0, bound(bound(F.split(text, regex, -1), lambda gaps: tell(raws, gaps)), _placed)).otherwise(none())

    return F.coalesce(bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), search), none())


def _placed(told: Column) -> Column:
    """told (gap, n, raw, before, after) with places for gap and n."""
    size = F.ceil(F.sqrt(F.size(told))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(told) - 1) / size).cast("int")), lambda b: F.slice(told, b * size + 1, size))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        stop = start + x["n"]
        here = F.struct(start.alias("start"), stop.alias("end"), x["raw"].alias("raw"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(stop.alias("at"), F.array_append(done["out"], here).alias("out"))

    def walk(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none().alias("out")), step)

    def from_here(done: Column, block: Column) -> Column:
        return F.struct((done["at"] + block["at"]).alias("at"), F.array_append(done["starts"], done["at"]).alias("starts"))

    def moved(block: Column, from_: Column) -> Column:
        move = lambda s: F.struct((s["start"] + from_).alias("start"), (s["end"] + from_).alias("end"), s["raw"].alias("raw"), s["before"].alias("before"), s["after"].alias("after"))
        return F.transform(block["out"], move)

    def joined(w: Column) -> Column:
        starts = F.aggregate(w, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), from_here)["starts"]
        return F.flatten(F.zip_with(w, starts, moved))

    return bound(F.transform(blocks, walk), joined)


def masked(text: Column, regex: str, filler: str = "") -> Column:
    """text with as many fillers as characters in place of each match of regex, so that nothing else is found there and places stay."""
    fill = lambda raws: F.transform(F.split(text, regex, -1), lambda gap, i: F.concat(gap, F.repeat(F.lit(filler), F.coalesce(F.length(F.get(raws, i)), F.lit(0)))))
    return F.array_join(bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), fill), "")
