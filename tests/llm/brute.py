"""The same results, the plain way."""

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from typing import NamedTuple

import xxhash

WORD = r"[^\x20\x09-\x0D]+"


def metrics(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(WORD, text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def simhash_groups(docs):
    """doc_id -> (fingerprint, component_id)"""
    prints = {d: simhash(t) for d, t in docs}
    values = sorted(set(prints.values()))
    root = components(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for d, f in prints.items():
        least[root[f]] = min(least.get(root[f], d), d)
    return {d: (format(f, "016x"), least[root[f]]) for d, f in prints.items()}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, raw):
    digits = re.sub("[^0-9]", "", raw)
    if kind == "card":
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in raw.split("."))) or (kind == "phone" and 10 <= len(digits) <= 15)


def pii(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, r) in enumerate(PATTERNS.items()) for m in re.finditer(r, text or "") if _passes(k, m.group()))
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
    return *(sum(f[3] == k for f in found) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), listed


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def line_dedup(docs, fuzzy=20):
    """texts of docs (in order of doc_id) after removal, and how many lines went."""
    firsts, out = {}, []
    for d, (doc, text) in enumerate(docs):
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                firsts.setdefault(line.strip(" \t\r\x0b\x0c"), (d, p))
    near = set()
    by_length = defaultdict(list)
    for line in firsts:
        by_length[len(line)].append(line)
    for line, at in firsts.items():
        if len(line) >= fuzzy and any(firsts[o] < at and one_edit(line, o) for n in (-1, 0, 1) if len(line) + n >= fuzzy for o in by_length[len(line) + n] if o != line):
            near.add(line)
    for d, (doc, text) in enumerate(docs):
        if text is None:
            out.append((doc, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for p, x in enumerate(lines) if not (s := x.strip(" \t\r\x0b\x0c")) or (firsts[s] == (d, p) and s not in near)]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return out


def best_fit(lengths, capacity):
    """How many sequences best-fit decreasing opens, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


class Run(NamedTuple):
    """Documents of `length` with ranks from `low` to below `high` go, `each` to a sequence, from sequence `first` on, the first of them at `offset`."""

    length: int
    low: int
    high: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int = 2048) -> list[Run]:
    """The runs that best-fit decreasing gives for counts, a map of lengths (1 to capacity) to numbers of documents."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, sorted
    runs, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                need = -(-left // (capacity // length))
                gap, first, n, opened = capacity, opened, need, opened + need
            else:
                gap = sizes[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(i)
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, rank + full * each, first, each, capacity - gap))
                rank, left = rank + full * each, left - full * each
                put(gap - each * length, first, full)
            if full < n and left:  # fewer than one sequence holds
                runs.append(Run(length, rank, rank + left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, n - full)
    return runs


def shared_runs(docs, n):
    """doc_id -> starts of runs of n words that another document has."""
    seen = defaultdict(set)
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add((d, i))
    out = defaultdict(set)
    for v in seen.values():
        if len({d for d, _ in v}) > 1:
            for d, i in v:
                out[d].add(i)
    return out


def paragraph_groups(docs, similar=0.8, least=26):
    """Sets of (doc_id, first word) of paragraphs that several documents have alike."""
    sets = defaultdict(list)
    for d, t in docs:
        at = 0
        for line in (t or "").encode().split(b"\n"):
            w = line.split()
            if len(w) >= least:
                sets[frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))].append((d, at))
            at += len(w)
    keys, inverted = list(sets), defaultdict(list)
    for i, s in enumerate(keys):
        for x in s:
            inverted[x].append(i)
    links = []
    for i, s in enumerate(keys):
        common = Counter(j for x in s for j in inverted[x] if j > i)
        links += [(i, j) for j, k in common.items() if k >= similar * (len(s) + len(keys[j]) - k)]
    groups = defaultdict(set)
    for i, r in components(range(len(keys)), links).items():
        groups[r] |= set(sets[keys[i]])
    return {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1}
