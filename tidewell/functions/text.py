"""String, number, array, map and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import Str

_EDGE_SPACE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def trim_unicode(c: Str) -> Column:
    """c without white space of any script at its ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def blank_to_null(c: Str) -> Column:
    return F.nullif(trim_unicode(c), F.lit(""))


def permalink(href: Str) -> Column:
    """A struct of author and status_id of a link to a post; null where href is none."""
    regex = r"/([^/]+)/status/(\d+)"
    found = F.struct(F.regexp_extract(href, regex, 1).alias("author"), F.regexp_extract(href, regex, 2).alias("status_id"))
    return F.when(F.regexp_like(href, F.lit(regex)), found)


def one_line(c: Str, limit: int = 90) -> Column:
    """c on one line: runs of white space become a space; the first `limit` characters."""
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(limit))


def slashed_lines(c: Str, limit: int = 260) -> Column:
    """c with ' / ' for line feeds; the first `limit` characters."""
    return F.left(F.regexp_replace(c, "\n", " / "), F.lit(limit))


def localised(catalogue: Column, lang: Str, key: Str, fallback: str = "en") -> Column:
    """catalogue[lang][key], or the fallback language's where that is missing or empty. catalogue: map of maps."""
    own = F.nullif(F.try_element_at(F.try_element_at(catalogue, _col(lang)), _col(key)), F.lit(""))
    return F.coalesce(own, F.try_element_at(F.try_element_at(catalogue, F.lit(fallback)), _col(key)))


def plural(n: Str, one: str = "", many: str = "s") -> Column:
    return F.when(_col(n) == 1, one).otherwise(many)


def question(c: Str, add: Str, left_to_right: bool = True) -> Column:
    """c with a question mark where add is true, in front for scripts that run right to left."""
    marked = F.concat(_col(c), F.lit("?")) if left_to_right else F.concat(F.lit("؟"), _col(c))
    return F.when(F.coalesce(_col(add), F.lit(False)), marked).otherwise(_col(c))


def compact_number(n: Str, cutover: int = 10_000, long: bool = False) -> Column:
    """n as English readers see it: in full below cutover, else 12K or 1.2M (long: 12 thousand); two digits are kept, more if whole."""
    n = _col(n).cast("double")
    steps = [(1e9, "B", " billion"), (1e6, "M", " million"), (1e3, "K", " thousand")]
    out = F.when(n < cutover, F.format_number(n, 0))
    for size, short, name in steps:
        scaled = n / size
        digits = F.when(scaled < 9.95, F.regexp_replace(F.format_number(scaled, 1), r"\.0$", "")).otherwise(F.format_number(scaled, 0))
        out = out.when(n >= size * (0.9995 if size > 1e3 else 1), F.concat(digits, F.lit(name if long else short)))
    return out.otherwise(F.format_number(n, 0))


def title_page(title: Str, name: str = "X", left_to_right: bool = True) -> Column:
    """The page that a window title names: without a count in front, and without the application's name."""
    bare = F.regexp_replace(title, r"^\(\d+\+?\) ", "")
    tail = rf" / \Q{name}\E$" if left_to_right else rf"^\Q{name}\E \\ "
    return F.regexp_replace(bare, tail, "")


def title_of(page: Str, count: Str, name: str = "X", left_to_right: bool = True) -> Column:
    parts = (_col(page), F.lit(" / "), F.lit(name)) if left_to_right else (F.lit(name), F.lit(" \\ "), _col(page))
    return F.concat(F.coalesce(_col(count), F.lit("")), *parts)


def headline(label: Str) -> Column:
    """A struct of site, the first word of a card's label, and headline, the rest."""
    words = F.split(label, " ")
    return F.struct(words[0].alias("site"), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("headline"))


def path_tail(url: Str) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def pair_key(i: Str, j: Str, n: int) -> Column:
    """One long for an unordered pair of row numbers below n."""
    i, j = _col(i).cast("long"), _col(j).cast("long")
    return F.least(i, j) * n + F.greatest(i, j)


def index_of(key: Str, size: int) -> Column:
    """The digits of key as a number, if below size; else null."""
    n = F.regexp_replace(key, r"\D", "").try_cast("int")
    return F.when(n < size, n)


def round_even(c: Str, digits: int) -> Column:
    return F.bround(c, digits)


def sorted_map(m: Str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def locale_difference(other: Str, english: Str) -> Column:
    """The entries of map `other` that differ from English."""
    english = _col(english)
    return F.map_filter(other, lambda k, v: ~v.eqNullSafe(F.try_element_at(english, k)))


def locale_update(messages: Str, updates: Str, removed: Column) -> Column:
    """messages with updates put in, the keys in removed taken out, sorted by key."""
    gone = F.map_filter(messages, lambda k, v: ~F.map_contains_key(_col(updates), k) & ~F.array_contains(removed, k))
    return sorted_map(F.map_concat(gone, _col(updates)))


def quoted_strings(code: Str) -> Column:
    """A map of the KEY: 'value' entries in source code."""
    regex = r"([A-Z_]+): '((?:[^'\\]|\\.)*)'"
    keys, values = F.regexp_extract_all(code, F.lit(regex), F.lit(1)), F.regexp_extract_all(code, F.lit(regex), F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.regexp_replace(v, r"\\'", "'")))


def tristate(flags: Column) -> Column:
    """all, some or none of an array of booleans are true."""
    true = F.forall(flags, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(true, "all").when(F.exists(flags, lambda x: F.coalesce(x, F.lit(False))), "some").otherwise("none")


def medium_date(ts: Str) -> Column:
    return F.date_format(ts, "MMM d, y")


def _col(c: Str) -> Column:
    return F.col(c) if isinstance(c, str) else c
