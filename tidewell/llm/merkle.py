"""A manifest of a table as a Merkle tree: built bottom-up, with proofs pushed top-down.

Rows are leaves, and those of a group (a language) in order are a tree of their own; the groups' roots, in order, are the leaves of one more. Every ARITY nodes in a row
become one, their run's hash. Each level is written as a table of runs, which hold their children's digests. Proofs go the other way: a node is joined to its
run above, inherits what that one's proof has, and puts its own siblings before it. A level has an eighth of the rows of the one below, so the work is that of the
leaves: one range sort, one shuffle into runs, and one join at an eighth of their number. No table but that of the range sort's counts reaches the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import numbered
from .common import cut, scoped

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The siblings of a node on each level, to the left and to the right, lowest level first.
PROOF = "array<struct<left:string,right:string>>"


def digest(said: Column) -> Column:
    return F.sha2(said, 256)


def told(column: Column) -> Column:
    """A value as a leaf has it: its length in bytes and itself, so that no two rows say the same; `-` for null."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    return digest(F.concat(*map(told, columns)))


def folded(first: Column, proof: str) -> Column:
    """The root that a leaf's digest and its proof make."""
    return F.aggregate(proof, first, lambda d, p: digest(F.concat(p["left"], d, p["right"])))


def siblings_digest(proof: str) -> Column:
    """The hash of a proof's digests, level by level, from left to right."""
    return digest(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""))


class Tree(NamedTuple):
    """levels: of runs, lowest first; each has tree, at (the run's place), size (the tree's runs on this level), digest, kids (digests), leaves (what the lowest level's
    leaves carry, null above) and joined (false where a tree's only node goes up as it is). The last level has one run for each tree."""

    levels: list[DataFrame]


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def grown(nodes: DataFrame, largest: int) -> Tree:
    """The levels above nodes (tree, at from 0, size: nodes of the tree, digest, and carried), of which the largest tree has so many."""
    levels = []
    while largest > 1 or not levels:
        run = F.array_sort(F.collect_list(F.struct("at", "digest", "carried")))
        runs = nodes.groupBy("tree", F.expr(f"at div {ARITY}").alias("run")).agg(run.alias("run_kids"), F.first("size").alias("n"))
        kids, joined = F.transform("run_kids", lambda k: k["digest"]), F.col("n") > 1
        level = runs.select(
            "tree", F.col("run").alias("at"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("size"), F.when(joined, digest(F.array_join(kids, ""))).otherwise(kids[0]).alias("digest"),
            kids.alias("kids"), (F.lit(None) if levels else F.transform("run_kids", lambda k: k["carried"])).alias("leaves"), joined.alias("joined"),
        )
        levels.append(cut(level))
        nodes, largest = levels[-1].withColumn("carried", F.lit(None)), -(-largest // ARITY)
    return Tree(levels)


def pushed(tree: Tree, above: DataFrame) -> DataFrame:
    """The rows of above (tree, at: nodes of the last level, proof, and others) handed down to the leaves: tree, at, proof, digest, leaf (what it carried) and the others.

    Each child's siblings stand before the proof that its run inherited.
    """
    others = [c for c in above.columns if c not in ("tree", "at", "proof")]
    nodes = above
    for k, level in reversed(list(enumerate(tree.levels))):
        kids = F.posexplode("kids").alias("nth", "digest") if k else F.posexplode(F.arrays_zip("kids", "leaves")).alias("nth", "kid")
        below = level.select("tree", "at", "kids", "leaves", "joined").join(nodes.select("tree", "at", "proof", *others), ["tree", "at"])
        below = below.select("tree", "at", "proof", "joined", F.col("kids").alias("run"), *others, kids)
        own = F.struct(F.array_join(F.slice("run", 1, F.col("nth")), "").alias("left"), F.array_join(F.slice("run", F.col("nth") + 2, ARITY), "").alias("right"))
        proof = F.when(F.col("joined"), F.concat(F.array(own), F.col("proof"))).otherwise(F.col("proof"))
        told_kid = [F.col("digest")] if k else [F.col("kid.kids").alias("digest"), F.col("kid.leaves").alias("leaf")]
        nodes = below.select("tree", (F.col("at") * ARITY + F.col("nth")).alias("at"), proof.alias("proof"), *told_kid, *others)
    return nodes


def proofs(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """leaves (its columns group, order, digest and others) with subroot (its group's), root, and proof (PROOF; lowest level first).

    A group's leaves ascend by order, then digest; nulls come first; groups ascend bytewise, null first. A group's lone leaf is its subroot, and a lone subroot
    the root: their proofs have no level for that tree. Rows that repeat are leaves each. A group, or one value of order, may hold all rows.
    """
    names = [c for c in leaves.columns if c != "digest"]
    # a row's number, once written, parts rows that are equal in all the rest
    rows = cut(leaves.select(F.col(group).alias("g"), F.col(order).alias("o"), "digest", F.struct(*names).alias("carried"), F.monotonically_increasing_id().alias("uid")))
    placed = numbered(rows, "g", "o", "digest", "uid")
    groups = cut(numbered(placed.groupBy("g").agg(F.min("pos").alias("start"), F.count("*").alias("size")), "g", name="tree"))
    nodes = placed.join(groups.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")))
    trees = grown(nodes.select("tree", (F.col("pos") - F.col("start")).alias("at"), "size", "digest", "carried"), _largest(groups))
    subroots = trees.levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(groups.count()).cast("long").alias("size"), "digest", F.lit(None).alias("carried"))
    top = grown(subroots, _largest(subroots))
    root = top.levels[-1].select("tree", "at", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))
    heads = pushed(top, root).select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", F.col("digest").alias("subroot"), "root")
    return pushed(trees, heads).select("leaf.*", "digest", "subroot", "root", "proof")


@scoped
def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest, subroot, root and proof of each row of docs (FIELDS), as proofs() has them; nulls count as such in a leaf. An empty table has no rows and no root."""
    return proofs(docs.select("doc_id", "lang", leaf(*[docs[c] for c in FIELDS]).alias("digest")), "lang", "doc_id")


def tampered(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is tampered with, and its text then: where 3 divides the CRC-32 of its doc_id in decimals, A-Z become a-z. A null doc_id is never tampered with."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return hit, F.when(hit, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


@scoped
def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (FIELDS; other columns aren't read), after tampering with some.

    leaf to proof_sha256 are those of the table as it is; folded_root is what the row, as tampered() leaves it, and its original siblings make; verified says whether that is the root.
    Null and empty texts have leaves, too; a text without A-Z isn't changed by tampering, and is verified.
    """
    hit, text = tampered(docs.doc_id, docs.text)
    now = leaf(*[text if c == "text" else docs[c] for c in FIELDS])
    rows = docs.select("doc_id", "lang", leaf(*[docs[c] for c in FIELDS]).alias("digest"), F.when(hit, now).alias("now"))
    found = proofs(rows, "lang", "doc_id")
    made = folded(F.coalesce("now", "digest"), "proof")
    told_rows = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", siblings_digest("proof").alias("proof_sha256"), made.alias("folded_root"))
    return told_rows.withColumn("verified", F.col("folded_root") == F.col("root"))
