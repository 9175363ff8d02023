"""Label sets of independent labellers, reconciled to gold pairs and clusters.

Pairs are unordered, written lo < hi. A pair was judged if one overlap, the rows that a labeller shares with the main one, has both rows. It is positive
where both say same in one, disputed if only the main labeller or only others ever say so, and negative otherwise. A pair outside every overlap is unjudged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import cut, numbered
from .components import components
from .judged import DISPUTED, NEGATIVE, POSITIVE, listed, told_once

#: Beyond so many judged pairs negatives aren't written out; they follow from overlaps, positives and disputed pairs.
ENUMERATED = 6_000_000
#: Keys of a row up to which all their sets are counted.
MOST_KEYS = 10
#: Rows, in order of id, of a range whose places are counted by themselves.
RANGE = 50_000
#: Rows of a part of a group whose pairs are listed, pairs that a task lists about, and most tasks.
MET, LISTED, MOST_TASKS = 2048, 2_000_000, 20_000


def same_pairs(rows: DataFrame, *by: str) -> DataFrame:
    """by, lo and hi: the pairs of rows (id, and the columns by) that agree in by.

    A group's rows are cut into parts by a hash of id, a power of two of them, and each two parts meet by themselves, dealt over as many tasks as there are pairs for: a group's rows are few bytes, its pairs aren't."""
    rows = rows.select(*by, "id").where(" and ".join(f"{c} is not null" for c in (*by, "id")))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    pairs = sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-pairs // LISTED)))
    parts = sizes.select(*by, F.expr(f"shiftleft(1, int(ceil(log2(greatest(1, n / {MET})))))").alias("parts"))
    dealt = rows.join(parts, list(by)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    x = dealt.select(*by, F.col("part").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("b"), F.col("id").alias("x"))
    y = dealt.select(*by, F.explode(F.sequence(F.lit(0), "part")).alias("a"), F.col("part").alias("b"), F.col("id").alias("y"))
    keys = [*by, "a", "b"]
    met = x.repartition(tasks, *keys).join(y.repartition(tasks, *keys), keys).where("a < b or x < y")
    return met.select(*by, F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))


def shared_pairs(keyed: DataFrame, by: list[str], most: int = MOST_KEYS) -> DataFrame:
    """by and pairs: how many pairs of rows of keyed (id, keys: sorted, and by), equal in by, have a key in common; no pair is listed.

    By inclusion and exclusion: the rows that have all of some keys pair up, and a pair that has n keys in common counts in 2 ** n - 1 such sets, which with signs by their size make one.
    Sets are counted where rows are before they are shuffled, so a key that a third of all rows have is one more sum. Rows of more than `most` keys would have too many sets: these are taken
    by classes of equal keys, and their classes meet those that share a key.
    """
    few, many = keyed.where(F.size("keys").between(1, most)), keyed.where(F.size("keys") > most)
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(keys)) - 1), mask -> filter(keys, (k, i) -> (mask & shiftleft(1, i)) != 0))")
    sets = few.select(*by, F.explode(subsets).alias("some"))
    counted = sets.groupBy(*by, "some").agg(F.count("*").alias("n")).where("n > 1")
    sign = F.when(F.size("some") % 2 == 1, 1).otherwise(-1)
    total = counted.select(*by, (sign * F.expr("n * (n - 1) div 2")).alias("pairs"))
    # of wide rows: classes of equal keys, with themselves and with others
    classes = keyed.groupBy(*by, "keys").agg(F.count("*").alias("n")).withColumn("wide", F.size("keys") > most)
    same = classes.where("wide").select(*by, F.expr("n * (n - 1) div 2").alias("pairs"))
    wide = classes.where("wide").select(*by, F.col("keys").alias("a"), F.col("n").alias("na"), F.explode("keys").alias("key"))
    other = classes.select(*by, F.col("keys").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("both"), F.explode("keys").alias("key"))
    met = wide.join(other, [*by, "key"]).where("a != b and (not both or a < b)").select(*by, "a", "b", "na", "nb").distinct()
    found = total if many.isEmpty() else total.unionByName(same).unionByName(met.select(*by, (F.col("na") * F.col("nb")).alias("pairs")))
    return found.groupBy(*by).agg(F.sum("pairs").alias("pairs"))

def overlaps(labels: DataFrame, main: str) -> DataFrame:
    """labeller, id, story and main_story of the rows (labeller, id, story) that both a labeller and the main one have."""
    own = labels.where(F.col("labeller") == main).select("id", F.col("story").alias("main_story"))
    return labels.where(F.col("labeller") != main).join(own, "id").select("labeller", "id", "story", "main_story")


def judgements(shared: DataFrame) -> DataFrame:
    """lo, hi, n_positive, n_main and n_other of each pair that any side of any overlap calls same: how many overlaps agree, and how many say so at all."""
    main = same_pairs(shared.select("labeller", "id", F.col("main_story").alias("story")), "labeller", "story").select("labeller", "lo", "hi", F.lit(1).alias("main"), F.lit(0).alias("other"))
    other = same_pairs(shared, "labeller", "story").select("labeller", "lo", "hi", F.lit(0).alias("main"), F.lit(1).alias("other"))
    each = main.unionByName(other).groupBy("labeller", "lo", "hi").agg(F.max("main").alias("main"), F.max("other").alias("other"))
    return each.groupBy("lo", "hi").agg(F.sum(F.col("main") * F.col("other")).alias("n_positive"), F.sum("main").alias("n_main"), F.sum("other").alias("n_other"))


def gold_pairs(shared: DataFrame) -> DataFrame:
    """lo, hi and y (1 positive, 0 negative) of the judged pairs; disputed ones are left out. What one overlap confirms, no other disputes.

    Blocks of rows meet, and no pair is shuffled, unless a labeller has an id twice."""
    if told_once(shared):
        return listed(shared, (POSITIVE, NEGATIVE))
    said = judgements(shared).where("n_positive > 0 or (n_main > 0) != (n_other > 0)")
    positive = said.where("n_positive > 0").select("lo", "hi", F.lit(1).alias("y"))
    judged = same_pairs(shared, "labeller").select("lo", "hi").distinct()
    negative = judged.join(said, ["lo", "hi"], "left_anti").select("lo", "hi", F.lit(0).alias("y"))
    return positive.unionByName(negative)


def disputed(shared: DataFrame) -> DataFrame:
    """lo and hi of the pairs that only the main labeller or only others call same, over all overlaps together; found as in gold_pairs()."""
    if told_once(shared):
        return listed(shared, (DISPUTED,)).select("lo", "hi")
    return judgements(shared).where("(n_main > 0) != (n_other > 0)").select("lo", "hi")


def agreement(shared: DataFrame) -> DataFrame:
    """labeller, posts, pairs, both_same, disagreed and agreed: how far each labeller and the main one say the same of pairs."""
    pairs = lambda n: F.sum(F.expr(f"{n} * ({n} - 1) div 2"))
    size = shared.groupBy("labeller").agg(F.count("*").alias("posts"))
    a = shared.groupBy("labeller", "main_story").agg(F.count("*").alias("n")).groupBy("labeller").agg(pairs("n").alias("a"))
    b = shared.groupBy("labeller", "story").agg(F.count("*").alias("n")).groupBy("labeller").agg(pairs("n").alias("b"))
    both = shared.groupBy("labeller", "main_story", "story").agg(F.count("*").alias("n")).groupBy("labeller").agg(pairs("n").alias("both_same"))
    all_ = size.join(a, "labeller").join(b, "labeller").join(both, "labeller").withColumn("pairs", F.expr("posts * (posts - 1) div 2"))
    return all_.withColumn("disagreed", F.col("a") + F.col("b") - 2 * F.col("both_same")).select("labeller", "posts", "pairs", "both_same", "disagreed", (F.col("pairs") - F.col("disagreed")).alias("agreed"))


def gold_clusters(shared: DataFrame, labels: DataFrame, priority: dict[str, str]) -> DataFrame:
    """id and story of every labelled row: components of confirmed pairs (s_ and the least id) for rows that two labelled, else the label of the first labeller in
    priority (labeller -> prefix of its stories)."""
    # a confirmed pair agrees in the labeller and both stories, so linking each row to the first of its group connects the same
    group = W.partitionBy("labeller", "story", "main_story")
    links = shared.select(F.min("id").over(group).alias("a"), F.col("id").alias("b"))
    roots = components(links)
    double = shared.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left")
    double = double.select("id", F.concat(F.lit("s_"), F.coalesce("root", "id").cast("string")).alias("story"), F.lit(-1).alias("rank"))
    rank, prefix = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (who, name) in enumerate(priority.items()):
        rank, prefix = F.when(F.col("labeller") == who, i).otherwise(rank), F.when(F.col("labeller") == who, name).otherwise(prefix)
    single = labels.select("id", F.concat(prefix, F.lit("_"), F.col("story").cast("string")).alias("story"), rank.alias("rank")).where("rank is not null")
    return double.unionByName(single).groupBy("id").agg(F.min_by("story", "rank").alias("story"))


def merged(labels: DataFrame, renames: DataFrame) -> DataFrame:
    """labels with stories renamed (renames: story, merged_story); others stay."""
    return labels.join(renames, "story", "left").withColumn("story", F.coalesce("merged_story", "story")).select(*labels.columns)


def evicted(labels: DataFrame, wrong: DataFrame) -> DataFrame:
    """labels whose rows in wrong (id) get a story of their own, if their story has other rows."""
    n = F.count("*").over(W.partitionBy("labeller", "story"))
    marked = labels.withColumn("__n", n).join(wrong.select("id", F.lit(True).alias("__out")).distinct(), "id", "left")
    alone = F.concat(F.lit("solo_"), F.col("id").cast("string"))
    return marked.withColumn("story", F.when(F.col("__out") & (F.col("__n") > 1), alone).otherwise(F.col("story").cast("string"))).select(*labels.columns)


def story_sizes(labels: DataFrame) -> DataFrame:
    """labeller, rows, stories, multi (stories of several rows), largest, and pairs inside stories."""
    each = labels.groupBy("labeller", "story").agg(F.count("*").alias("n"))
    return each.groupBy("labeller").agg(F.sum("n").alias("rows"), F.count("*").alias("stories"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def size_histogram(labels: DataFrame) -> DataFrame:
    """labeller, size and stories: how many stories have how many rows."""
    return labels.groupBy("labeller", "story").agg(F.count("*").alias("size")).groupBy("labeller", "size").agg(F.count("*").alias("stories"))


def said_of(shared: DataFrame) -> DataFrame:
    """id, who, agreed, main and other: the overlaps that a row is in, and in each what both sides, the main one and the other call it."""
    kept = lambda *c: F.collect_set(F.when(F.expr(" and ".join(f"{x} is not null" for x in c)), F.struct("labeller", *c)))
    return shared.groupBy("id").agg(F.collect_set("labeller").alias("who"), kept("story", "main_story").alias("agreed"), kept("main_story").alias("main"), kept("story").alias("other"))


def judge(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs (lo, hi, ...) with y: 1 if positive, 0 if negative, null if disputed or unjudged. What is said of each row decides; no other pair is made."""
    rows = said_of(shared)
    a, b = rows.select(F.col("id").alias("lo"), F.struct("who", "agreed", "main", "other").alias("__a")), rows.select(F.col("id").alias("hi"), F.struct("who", "agreed", "main", "other").alias("__b"))
    met: Callable[[str], Column] = lambda c: F.coalesce(F.arrays_overlap(f"__a.{c}", f"__b.{c}"), F.lit(False))
    found = pairs.join(a, "lo", "left").join(b, "hi", "left")
    return found.withColumn("y", F.when(met("agreed"), 1).when(met("main") != met("other"), None).when(met("who"), 0)).drop("__a", "__b")


def _keys_of(shared: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The rows of said_of() as text, and the keys that two of them have in common if they were judged, are positive, or are called same by the main labeller, by others, and by either."""
    told = lambda c: F.transform(c, lambda x: F.to_json(x))
    rows = said_of(shared).select(F.lit(1).alias("all"), "id", "who", told("agreed").alias("agreed"), told("main").alias("main"), told("other").alias("other"))
    either = F.concat(F.transform("main", lambda x: F.concat(F.lit("m"), x)), F.transform("other", lambda x: F.concat(F.lit("o"), x)))
    return rows, {"judged": F.col("who"), "positive": F.col("agreed"), "main": F.col("main"), "other": F.col("other"), "either": either}


def pair_counts(shared: DataFrame) -> DataFrame:
    """judged, positive, negative and disputed: how many pairs there are of each, in one row. Pairs are products of what rows have in common, and are counted as such, not made."""
    rows, kinds = _keys_of(shared)
    rows, counts = cut(rows), None
    for name, keys in kinds.items():
        n = shared_pairs(rows.select("all", "id", F.array_sort(keys).alias("keys")), ["all"]).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias(name))
        counts = n if counts is None else counts.crossJoin(n)
    # by main or by others alone: by either, less what is said by main or by others, is what both say
    odd = 2 * F.col("either") - F.col("main") - F.col("other")
    return counts.select("judged", "positive", (F.col("judged") - F.col("positive") - odd).alias("negative"), odd.alias("disputed"))


def pair_sums(shared: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """y, pairs, lo_sum and hi_sum: how many gold pairs are positive (1) and negative (0), and what their lower and their higher ids (numbers) add up to. No pair is made.

    As in shared_pairs() rows are taken by the sets of keys that they have. In order of id the k-th of n rows of a set is the higher one of k pairs and the lower one of n - 1 - k; places in a
    set are those in a range of ids and the counts of the ranges before it. Rows of more than `most` keys would have too many sets: pairs are listed and added up then.
    """
    rows, kinds = _keys_of(shared)
    if not rows.where((F.size(kinds["either"]) > most) | (F.size("who") > most)).isEmpty():
        return gold_pairs(shared).groupBy("y").agg(F.count("*").alias("pairs"), F.sum("lo").alias("lo_sum"), F.sum("hi").alias("hi_sum"))
    placed = cut(numbered(rows, "id", name="at").withColumn("range", F.expr(f"at div {RANGE}")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.array_sort(c).alias("keys")) for k, c in kinds.items()])).alias("x")
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(keys)) - 1), mask -> filter(keys, (k, i) -> (mask & shiftleft(1, i)) != 0))")
    sets = placed.select("id", "at", "range", each).select("id", "at", "range", "x.kind", "x.keys").where("size(keys) > 0").select("id", "at", "range", "kind", F.explode(subsets).alias("some"))
    sets = sets.select("id", "at", "range", "kind", F.size("some").alias("size"), F.to_json("some").alias("some"))
    own = W.partitionBy("kind", "some", "range").orderBy("at")
    here = sets.withColumn("k", F.row_number().over(own) - 1).groupBy("kind", "some", "size", "range").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.col("id") * F.col("k")).alias("up"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("kind", "some").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(W.partitionBy("kind", "some"))
    told = here.withColumn("before", before).withColumn("every", every).withColumn("high", F.col("up") + F.col("ids") * F.col("before"))
    sign = F.when(F.col("size") % 2 == 1, 1).otherwise(-1)
    added = lambda c: F.coalesce(F.sum(sign * c), F.lit(0))
    pairs = F.expr("n * before + n * (n - 1) div 2")
    sums = told.groupBy("kind").agg(added(pairs).alias("pairs"), added((F.col("every") - 1) * F.col("ids") - F.col("high")).alias("lo_sum"), added(F.col("high")).alias("hi_sum"))
    # negative: judged, not positive, and not said by main or by others alone, which is by either twice, less by main and by others
    weights = {"judged": (0, 1), "positive": (1, -1), "main": (0, 1), "other": (0, 1), "either": (0, -2)}
    weight = lambda i: F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w[i])])[F.col("kind")]
    both = sums.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), weight(0).alias("w")), F.struct(F.lit(0).alias("y"), weight(1).alias("w")))).alias("z"), "pairs", "lo_sum", "hi_sum").select("z.y", "z.w", "pairs", "lo_sum", "hi_sum")
    return both.groupBy("y").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("pairs", "lo_sum", "hi_sum")]).where("pairs > 0")


def gold_form(shared: DataFrame, limit: int = ENUMERATED) -> dict[str, DataFrame]:
    """The gold in the form that its size allows. Where there are few judged pairs, pairs: gold_pairs(). Else rows: said_of(), from which judge() tells any pair, and counts: pair_counts()."""
    if is_enumerable(shared, limit):
        return {"pairs": gold_pairs(shared)}
    return {"rows": said_of(shared), "counts": pair_counts(shared)}


def is_enumerable(shared: DataFrame, limit: int = ENUMERATED) -> bool:
    """True if the judged pairs, counted without making them, are few enough to write out."""
    n = shared.groupBy("labeller").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    return (n or 0) <= limit
