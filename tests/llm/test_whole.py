"""What operators once left out."""

import random
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewell.llm import decontaminate, passages, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


def documents(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s") for d, t in pairs], "doc_id long, text string, lang string, source string")


# 7: passages


def short_groups(pairs, similar=0.8, below=26):
    """As brute.paragraph_groups, over paragraphs of any length; those groups that have one below `below` words. Under 5 words all words are one shingle."""
    sets, short = defaultdict(set), set()
    for d, t in pairs:
        at = 0
        for line in (t or "").encode().split(b"\n"):
            w = line.split()
            if w:
                key = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
                sets[key].add((d, at))
                if len(w) < below:
                    short.add((d, at))
            at += len(w)
    keys, inverted = list(sets), defaultdict(set)
    for i, s in enumerate(keys):
        for x in s:
            inverted[x].add(i)
    links = [(i, j) for i, s in enumerate(keys) for j in {j for x in s for j in inverted[x] if j > i} if len(s & keys[j]) >= similar * len(s | keys[j])]
    groups = defaultdict(set)
    for i, r in brute.components(range(len(keys)), links).items():
        groups[r] |= sets[keys[i]]
    return {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1 and g & short}


def check_short(found, pairs):
    groups = defaultdict(set)
    for r in found:
        if r.kind == "short":
            groups[r.component].add((r.doc_id, r.start_word))
            assert r.removed == (r.doc_id != r.first_doc_id)
    assert {frozenset(g) for g in groups.values()} == short_groups(pairs)


def test_short_paragraphs(spark):
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line, longer, tiny = words(24), words(60), words(3)
    cut = {0: line, 1: [*line, "more"], 2: [*line, "some", "words", "more"], 3: words(9)}
    pairs = [(d, "\n".join(" ".join(x) for x in (words(4), cut[d % 4], tiny if d % 2 else words(2), longer if d > 5 else words(40), (["round", "it", "goes"] * (6 if d == 7 else 30)) if d > 6 else words(30)))) for d in range(9)]
    found = passages.repeats(documents(spark, pairs)).collect()
    check_short(found, pairs)
    kinds = {(x.doc_id, x.kind) for x in found}
    assert (2, "short") in kinds and (7, "short") in kinds and (8, "paragraph") in kinds and (3, "short") in kinds


def test_short_paragraphs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_short(passages.repeats(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def check_cover(found, pairs):
    """Every run of 50 words that two documents share lies in spans whole, and the least doc_id that has it keeps one."""
    spans, runs = defaultdict(list), defaultdict(set)
    for x in found:
        if x.kind == "passage":
            spans[x.doc_id].append((x.start_word, x.end_word))
    for d, starts in brute.shared_runs(pairs, 50).items():
        covered = {i for a, z in spans[d] for i in range(a, z)}
        assert all(covered.issuperset(range(s, s + 50)) for s in starts), d
        runs[d] = starts
    return spans, runs


def test_spans_are_whole_runs(spark):
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    runs = [words(r.randrange(51, 121)) for _ in range(12)]
    pairs = [(d, " ".join(words(r.randrange(1, 60)) + run + words(r.randrange(1, 60)))) for d, run in enumerate(runs * 3)]
    at = {d: next(i for i, w in enumerate(t.split()) if w == runs[d % 12][0]) for d, t in pairs}
    # 101 and 102 share 15 words before and after what 100 has of it
    inner, before, after = words(70), words(15), words(15)
    pairs += [(100, " ".join(words(9) + inner + words(9))), *((d, " ".join(words(30) + before + inner + after + words(30))) for d in (101, 102))]
    found = passages.repeats(documents(spark, pairs)).collect()
    spans, _ = check_cover(found, pairs)
    assert all(spans[d] == [(at[d], at[d] + len(runs[d % 12]))] for d in range(36))
    told = {d: tuple(sorted({i for x in found if x.doc_id == d and x.removed in which for i in range(x.start_word, x.end_word)}) for which in ((True, False), (True,))) for d in (100, 101, 102)}
    whole = list(range(30, 130))
    assert told == {100: (list(range(9, 79)), []), 101: (whole, list(range(45, 115))), 102: (whole, whole)}


def test_spans_cover_shared_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_cover(passages.repeats(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


# 6: decontamination


def held(spark, texts, item):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return [r.doc_id for r in decontaminate.report(documents(spark, list(enumerate(texts))), items).orderBy("doc_id").collect()]


def test_one_edited_value_does_not_clear_a_copy(spark):
    item = "At noon the girl Anna meets 12 friends in the park, then Anna sells 30 cakes to them and Anna counts what Anna has left. How many of the cakes did Anna keep for the party on the next day?"
    once = item.replace("Anna", "Ana", 1)
    mixed = item
    for name in ("Bea", "Cleo", "Dora", "Eve", "Fay"):
        mixed = mixed.replace("Anna", name, 1)
    assert held(spark, [once, item.replace("Anna", "Ana"), mixed, item], item) == [0, 1, 3]


def test_verbatim_copies_of_any_items(spark):
    items = ["12 + 7 * 3 - 4 = ?", "What is the capital of France?", "Anna Maria Peter Paul Hannah", "中国的首都是哪里？请用一句话回答。", "Name Three Great Old German Painters", "..."]
    texts = [f"You see {x.rstrip('?')} here." for x in items[:5]] + ["我问：" + items[3] + "他说", "12 + 7 * 4 - 3 = ?", "the capital", "中国的人", "none ... of it"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.report(documents(spark, list(enumerate(texts))), bench).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 3)}


# 5: secrets


def test_names_and_values_of_other_forms(spark):
    texts = {
        "run DB_PASSWORD=Xk29fLq8Zt now": "Xk29fLq8Zt", "db_password: 'Xk29fLq8Zt41'": "Xk29fLq8Zt41", "GITHUB_TOKEN=abc123def456": "abc123def456", 'SECRET_KEY = "n8Qz71LmPq0d"': "n8Qz71LmPq0d",
        "password   =\tXk29fLq8Zt": "Xk29fLq8Zt", "password: P@ss!w0rd#92x": "P@ss!w0rd#92x", '{"api_key_2": "q8$ z(71){L]mP"}': "q8$ z(71){L]mP",
    }
    rows = [*texts, "a password_" * 3000, "password" * 7000, "token=" + "." * 50_000, "api.key " + " " * 50_000]
    docs = documents(spark, list(enumerate(rows)))
    assert {(r.doc_id, r.value) for r in secrets.candidates(docs, "doc_id").collect()} == set(enumerate(texts.values()))
    said = {r.doc_id: r.is_secret for r in secrets.scan(docs).collect()}
    assert all(said[d] for d in range(6)), said
    false = ["DB_PASSWORD=changeme_please_1 here", "my password: service.account.name is"]
    assert not any(r.is_secret for r in secrets.scan(documents(spark, list(enumerate(false)))).collect())
