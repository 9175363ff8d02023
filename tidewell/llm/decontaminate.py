"""Documents that hold benchmark items, verbatim or with other numbers, names and quantities.

Texts become templates: a number, a quantity (number and unit) and a name (a capitalised word inside a sentence) each turn
into a placeholder of their type; all else is lower-cased words. Windows of WINDOW template words are hashed and joined with those
of the benchmark. Matches of a document and an item line up on diagonals (place in the document less place in the item).
On a diagonal, the values in the item's placeholders must map to the document's as a function: a re-parameterised
question puts 7 wherever the original has 5. Windows with a value other than the one that most places have for it don't count, and where no
value has most, none of its windows do. What the other windows cover of the item's decides.

Templates say little of items with few literal words, and nothing of text without spaces. Items that a verbatim copy might not be found of by
template windows are also matched by windows of their tokens as they stand: words, numbers, signs of arithmetic, single characters of scripts without spaces.

Items of equal templates whose values repeat in the same places are held by the same documents, so they are one class from the start: what is
matched, and by op6 reported, is classes, however many items a benchmark makes of one template.

Everything is DataFrame operations. Documents are read and made templates of once, for windows of all sizes. The benchmark's windows are broadcast while they are
few; no document text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key

WINDOW = 8
#: Words of a template window that must not be placeholders.
LITERALS = 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Up to so many benchmark windows (24 bytes each), or matched documents, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000

# Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "grams", "pounds", "dollars", "euros", "cents", "percent", "degrees")

_NUMBER, _NAME, _QUANTITY = "\ue000", "\ue001", "\ue002"
_NAME_RE = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+"  # the capital first, since most places lack one
_NUMBER_RE = r"\p{N}+(?:[.,]\p{N}+)*"
_QUANTITY_RE = rf"{_NUMBER_RE} ?(?:{'|'.join(sorted(UNITS, key=len, reverse=True))}|%)(?![\p{{L}}\p{{N}}])"


def _plain(text: Column) -> Column:
    """The text with one space for any white space, so that its layout doesn't count, and without the placeholders' characters."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\x20*[\t-\r\ue000-\ue002][\s\ue000-\ue002]*|\x20{2,}", " ")


def _steps(plain: Column) -> tuple[Column, Column, Column]:
    """The text with names replaced and lower-cased; with quantities replaced, too; with numbers replaced, too."""
    named = F.lower(F.regexp_replace(plain, _NAME_RE, _NAME))
    measured = F.regexp_replace(named, _QUANTITY_RE, _QUANTITY)
    return named, measured, F.regexp_replace(measured, _NUMBER_RE, _NUMBER)


def template(text: Column) -> Column:
    """The template words of a text, an array; empty for null and for texts without letters or digits."""
    return F.regexp_extract_all(_steps(_plain(text))[2], F.lit(r"[\p{L}\p{M}\ue000-\ue002]+"), F.lit(0))


_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN_RE = rf"[{_UNSPACED}]|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]+|\p{{N}}+|[-*/^%\p{{Sm}}]"


def tokens(text: Column) -> Column:
    """The lower-cased words, numbers, signs and characters of a text as they stand, an array."""
    return F.regexp_extract_all(F.lower(_plain(text)), F.lit(_TOKEN_RE), F.lit(0))


def slots(text: Column) -> Column:
    """A struct of three arrays: the names, quantities and numbers of a text in order, as template() replaces them."""
    plain = _plain(text)
    named, measured, _ = _steps(plain)
    found = lambda s, r: F.regexp_extract_all(s, F.lit(r), F.lit(0))
    return F.struct(found(plain, _NAME_RE).alias("names"), found(named, _QUANTITY_RE).alias("quantities"), found(measured, _NUMBER_RE).alias("numbers"))


def _slot_value(words: str, values: str, k: str) -> str:
    """SQL: what stands at word k (from 1) of a template if that is a placeholder, with its type; else null."""
    one = lambda mark, field: f"when {mark!r} then concat({mark!r}, get({values}.{field}, length(regexp_replace(array_join(slice({words}, 1, {k}), ''), '[^{mark}]', '')) - 1))"
    return f"case get({words}, {k} - 1) {one(_NAME, 'names')} {one(_QUANTITY, 'quantities')} {one(_NUMBER, 'numbers')} end"


def _windows(words: str, exact: bool, size: int) -> str:
    """SQL: the windows of `size` words, each with its place (from 1) and a hash that those of other sizes and kinds don't share."""
    one = f"i -> named_struct('pos', i, 'h', xxhash64({str(exact).lower()}, {size}, slice({words}, i, {size})))"
    return f"case when size({words}) >= {size} then transform(sequence(1, size({words}) - {size} + 1), {one}) else cast(array() as array<struct<pos:int,h:bigint>>) end"


def _classed(benchmark: DataFrame, coverage: float) -> DataFrame:
    """item_id, if benchmark has it, item (the class), words, slots, tokens, size (of template windows), at (those that count) and unsure of each item with a text.

    Of a verbatim copy all template windows are found but those with the first or last word, which what stands beside may change; where the others are too few, or there are none, the
    item is unsure, and its tokens say whose class it is.
    """
    ids = ["item_id"] if "item_id" in benchmark.columns else []
    text = F.col("__tw_text")
    texts = benchmark.where("text is not null").select(*ids, F.col("text").cast("string").alias("__tw_text"))
    out = texts.select(*ids, template(text).alias("words"), slots(text).alias("slots"), tokens(text).alias("tokens"))
    literal = f"size(filter(slice(words, i, size), w -> not w rlike '^[\ue000-\ue002]+$')) >= {LITERALS}"
    windows = "if(size > 0, sequence(1, size(words) - size + 1), cast(array() as array<int>))"
    used = out.withColumn("size", F.expr(f"least(size(words), {WINDOW})")).withColumn("at", F.expr(f"filter({windows}, i -> {literal})"))
    inside = F.expr("size(filter(at, i -> i > 1 and i + size - 1 < size(words)))")
    sure = used.withColumn("unsure", (F.size("at") == 0) | (inside < coverage * F.size("at")))
    # where each value stands first
    repeats = ", ".join(f"transform(slots.{k}, v -> array_position(slots.{k}, v))" for k in ("names", "quantities", "numbers"))
    return sure.withColumn("item", F.expr(f"xxhash64(words, {repeats}, if(unsure, tokens, null))"))


def _items(benchmark: DataFrame, coverage: float) -> DataFrame:
    """item, exact, words, slots, size (of its windows), at (windows that count) and n_windows of each class: a row by its template, if that has windows, and one by its tokens (exact), if unsure."""
    each = _classed(benchmark, coverage).groupBy("item").agg(F.first(F.struct("words", "slots", "tokens", "size", "at", "unsure")).alias("of")).select("item", "of.*")
    columns = ("item", "exact", "words", "slots", "size", "at")
    by_template = each.where("size(at) > 0").withColumn("exact", F.lit(False)).select(*columns)
    by_tokens = each.where("unsure").select("item", F.lit(True).alias("exact"), F.col("tokens").alias("words"), "slots").withColumn("size", F.expr(f"least(size(words), {WINDOW})"))
    by_tokens = by_tokens.where("size > 0").withColumn("at", F.expr("sequence(1, size(words) - size + 1)")).select(*columns)
    return by_template.union(by_tokens).withColumn("n_windows", F.size("at"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """rk, doc_id, item, exact, diagonal and at (the item's windows found on it, from 1): what each row of docs shares with each row of items."""
    one = "xxhash64(exact, size, slice(words, at, size))"
    wanted = cut(items.select("item", "exact", "size", F.explode("at").alias("at"), "words").select("item", "exact", "size", "at", F.expr(one).alias("h")))
    kinds = sorted(tuple(r) for r in wanted.select("exact", "size").distinct().collect())  # 2 * WINDOW values at most
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    made = [f(docs.text).alias(c) for exact, f, c in ((False, template, "words"), (True, tokens, "tokens")) if any(k[0] == exact for k in kinds)]
    texts = docs.select(row_key(docs.doc_id, docs.text).alias("rk"), docs.doc_id.alias("doc_id"), *made)
    windows = ", ".join(_windows("tokens" if exact else "words", exact, size) for exact, size in kinds) or "cast(array() as array<struct<pos:int,h:bigint>>)"
    hashed = texts.select("rk", "doc_id", F.explode(F.expr(f"concat({windows})")).alias("w")).select("rk", "doc_id", "w.pos", "w.h")
    found = hashed.join(wanted, "h").select("rk", "doc_id", "item", "exact", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    return found.groupBy("rk", "doc_id", "item", "exact", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """rk, doc_id, item, n_windows, n_found and coverage: the classes of items that each row of docs (doc_id, text) holds to `coverage` or more.

    Null and empty texts hold nothing; null items, and those without letters, digits and signs of arithmetic, are held by nothing. An item as short as one word is held
    wherever the word stands. Rows of docs equal
    in doc_id and text are judged as one. Items of equal texts, or of equal templates with equal values in the same places, are one class.
    """
    both = cut(_items(benchmark, coverage))
    all_found = cut(matches(docs, both))
    found, items, exact = all_found.where("not exact"), both.where("not exact"), both.where("exact")
    verbatim = not exact.isEmpty()
    hit = cut((all_found if verbatim else found).select("rk").distinct())
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    keyed = docs.select(row_key(docs.doc_id, docs.text).alias("rk"), docs.text.alias("text"))
    held = keyed.join(hit, "rk", "left_semi").dropDuplicates(["rk"])
    made = [template(F.col("text")).alias("dwords"), slots(F.col("text")).alias("dslots"), *([tokens(F.col("text")).alias("dtokens")] if verbatim else [])]
    held = held.select("rk", *made)
    # windows were taken for equal by a hash; here are their words
    same = lambda words: F.expr(f"filter(at, a -> slice(words, a, size) = slice({words}, a + diagonal, size))")
    lined = found.join(items.select("item", "words", "slots", "size", "n_windows"), "item").join(held, "rk").withColumn("at", same("dwords"))
    covered = "array_distinct(flatten(transform(at, a -> sequence(a, a + size - 1))))"
    pairs = f"transform({covered}, k -> struct(k, {_slot_value('words', 'slots', 'k')} as theirs, {_slot_value('dwords', 'dslots', '(k + diagonal)')} as ours))"
    paired = lined.select("rk", "doc_id", "item", "n_windows", "size", "at", F.expr(f"filter({pairs}, p -> p.theirs is not null and p.ours is not null)").alias("pairs"))
    votes = "transform(array_distinct(transform(pairs, p -> struct(p.theirs, p.ours))), d -> struct(d.theirs, d.ours, size(filter(pairs, p -> p.theirs = d.theirs and p.ours = d.ours)) as n))"
    # each step is bound to a lambda's name, so that it is computed once
    lost = "transform(filter(pairs, p -> exists(votes, v -> v.theirs = p.theirs and v.ours = p.ours and exists(votes, u -> u.theirs = v.theirs and u.ours != v.ours and u.n >= v.n))), p -> p.k)"
    left = f"transform(transform(array({votes}), votes -> {lost}), lost -> filter(at, a -> not exists(lost, k -> k between a and a + size - 1)))[0]"
    agree = "size(array_distinct(transform(pairs, p -> struct(p.theirs, p.ours)))) = size(array_distinct(transform(pairs, p -> p.theirs)))"
    consistent = paired.withColumn("at", F.expr(f"if({agree}, at, {left})"))
    judged = consistent.where("size(at) > 0").groupBy("rk", "doc_id", "item", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_found"))
    if verbatim:
        told = all_found.where("exact").join(exact.select("item", "words", "size", "n_windows"), "item").join(held, "rk").withColumn("at", same("dtokens")).where("size(at) > 0")
        counted = told.groupBy("rk", "doc_id", "item", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_found"))
        # the better of the two
        best = F.max(F.struct((F.col("n_found") / F.col("n_windows")).alias("share"), "n_windows", "n_found")).alias("best")
        judged = judged.unionByName(counted).groupBy("rk", "doc_id", "item").agg(best).select("rk", "doc_id", "item", "best.n_windows", "best.n_found")
    return judged.withColumn("coverage", F.col("n_found") / F.col("n_windows")).where(F.col("coverage") >= coverage)


def classes(benchmark: DataFrame) -> DataFrame:
    """item_id and class: which items are held by the same documents. Items without a text have no class."""
    return _classed(benchmark, COVERAGE).select("item_id", F.col("item").alias("class"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage: a row for each document and benchmark item that it holds; see contaminated()."""
    held = contaminated(docs, benchmark).join(classes(benchmark).withColumnRenamed("class", "item"), "item")
    return held.select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_found").cast("long"), "coverage")


def report_classes(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_items, n_windows, n_found, coverage: as report(), but one row for a class of items, with its least item_id (null if all are null) and its size."""
    named = classes(benchmark).groupBy(F.col("class").alias("item")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    held = contaminated(docs, benchmark).join(named, "item")
    return held.select("doc_id", "item_id", "n_items", F.col("n_windows").cast("long"), F.col("n_found").cast("long"), "coverage")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item, with docs' columns as they are."""
    bad = cut(contaminated(docs, benchmark).select(F.col("rk").alias("__tw_rk")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.withColumn("__tw_rk", row_key(docs.doc_id, docs.text)).join(bad, "__tw_rk", "left_anti").drop("__tw_rk")
