"""Allow and block rules on hosts and paths, by a sort-merge range join.

A host's labels in reverse, each ended by a dot, make its key: all subdomains of a host lie in the interval of keys that begin with
the host's. Intervals nest or are apart. Each task sorts its urls by key and sweeps them and the sorted rules together; a
stack holds the hosts with rules whose intervals the sweep is in. A url's rules are those of the stack whose path begins its path.

Rules are a stated set: they are broadcast in blocks of a checked size, and any further blocks are swept in turn. Pages aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of a block; at some 100 bytes each, 20 MB.
BLOCK = 200_000
DEFAULT = "allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    """action: allow or block. pattern: a host, and from the first slash on the beginning of a path."""

    action: str
    pattern: str


class Node(NamedTuple):
    """The rules of one host: by path, and the paths' lengths, longest first."""

    key: str
    paths: dict[str, Rule]
    lengths: list[int]

    def longest(self, path: str) -> Rule | None:
        return next((self.paths[path[:n]] for n in self.lengths if path[:n] in self.paths), None)


def key_of(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


def nodes_of(rules: list[Rule]) -> list[Node]:
    """Sorted by key. Of rules with equal patterns the last holds; hosts are compared in lower case (A-Z)."""
    by_key: dict[str, dict[str, Rule]] = {}
    for r in rules:
        host, slash, path = r.pattern.partition("/")
        by_key.setdefault(key_of(host.translate(str.maketrans(_UPPER, _UPPER.lower()))), {})[slash + path] = r
    return [Node(k, p, sorted({len(x) for x in p}, reverse=True)) for k, p in sorted(by_key.items())]


class Sweep:
    """Finds the longest rule of each url; urls come sorted by key."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.next = nodes, 0
        self.stack: list[Node] = []

    def find(self, key: str, path: str) -> Rule | None:
        while self.next < len(self.nodes) and self.nodes[self.next].key <= key:
            node = self.nodes[self.next]
            self._leave(node.key)
            self.stack.append(node)
            self.next += 1
        self._leave(key)
        # hosts nest, so of patterns equally long that of the inner host comes last
        found = [r for n in self.stack if (r := n.longest(path))]
        return max(reversed(found), key=lambda r: len(r.pattern), default=None)

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def judge(pages: DataFrame, rules: list[Rule], default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url).

    The longest pattern wins, of equal ones that of the longer host; without any, rule is null and the verdict the default. A null url, or one
    without ://, has an empty host and path, which only a rule of an empty pattern fits. Rows that repeat are judged each; no pages
    give no rows; other columns of pages are not read.
    """
    judged = pages.select("page_id", host_of(pages.url).alias("host"), path_of(pages.url).alias("path"))
    judged = judged.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    key = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    keyed = judged.withColumn("key", key).sortWithinPartitions("key")
    ordered = sorted(rules, key=lambda r: key_of(r.pattern.partition("/")[0]))
    for i in range(0, len(ordered), BLOCK):
        keyed = keyed.mapInArrow(_sweeper(pages, ordered[i : i + BLOCK]), keyed.schema)
    return keyed.drop("key")


def _sweeper(pages: DataFrame, rules: list[Rule]):
    block = pages.sparkSession.sparkContext.broadcast(rules)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(nodes_of(block.value))
        for b in batches:
            rule, verdict = b.column("rule").to_pylist(), b.column("verdict").to_pylist()
            for i, (key, path) in enumerate(zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True)):
                found = sweep.find(key, path)
                if found and len(found.pattern) >= len(rule[i] or ""):
                    rule[i], verdict[i] = found.pattern, found.action
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), b.column("key")], schema=b.schema)

    return sweep
