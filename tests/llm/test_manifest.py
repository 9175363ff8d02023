"""Merkle manifests beside a plain version that builds the whole tree and looks siblings up."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import merkle, registry

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CLASHING = ("tree", "at", "size", "digest", "kids", "leaves", "joined", "proof", "root", "subroot", "uid", "pos", "g", "o", "carried", "now", "leaf", "__part", "__at", "__g")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def sides(levels, at):
    for level in levels[:-1]:
        run = at // 8 * 8
        yield "".join(level[run:at]), "".join(level[at + 1 : run + 8])
        at //= 8


def null_first(v):
    return (v is not None, v.encode() if isinstance(v, str) else v)


def plain(rows):
    """The rows of merkle.audit(), sorted."""
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r: h("".join(map(told, r)))
    trees = {lang: sorted(((null_first(r[0]), leaf(r), r) for r in rows if r[2] == lang), key=lambda x: x[:2]) for lang in {r[2] for r in rows}}
    langs = sorted(trees, key=null_first)
    built = {lang: levels_of([x[1] for x in trees[lang]]) for lang in langs}
    top = levels_of([built[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, d, r) in enumerate(trees[lang]):
            proof = [*sides(built[lang], i), *sides(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            made = leaf((*r[:4], lower(r[4]))) if hit else d
            for a, b in proof:
                made = h(a + made + b)
            out.append((r[0], d, built[lang][-1][0], top[-1][0], h("".join(a + b for a, b in proof)), made, made == top[-1][0]))
    return sorted(out, key=repr)


def audited(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = merkle.audit(df)
    assert found.columns == columns
    return sorted(map(tuple, found.collect()), key=repr)


def documents(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "de": 64, None: 65}, {f"l{k}": k for k in range(1, 19)}, {"en": 600, "": 1, "Z": 2, "é": 3, "z": 4}])
def test_manifest_against_a_plain_version(spark, sizes):
    r = random.Random(7)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((r.choice([None, *range(-3, 900)]), r.choice([None, "s", ""]), lang, r.choice([None, 0, -5, 2**40]), r.choice([None, "", "Text", "ÄÖ Text", "lower", "3:x", "-"])))
    rows += rows[::5]  # delivered twice
    assert audited(documents(spark, rows)) == plain(rows)


def test_whole_table_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    found = audited(docs)
    assert found == plain(rows)
    hit = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in r[4] or "")}
    assert hit and {x[0] for x in found if not x[-1]} == hit


def test_empty_long_and_equal_rows(spark):
    assert audited(documents(spark, [])) == []
    rows = [(4, "s", "en", 1, "x" * 3_000_000)] + [(5, "s", "en", 1, "the same")] * 300
    found = audited(documents(spark, rows))
    assert found == plain(rows) and len(found) == 301


def test_proofs_say_more_than_the_digest(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(200)]
    for x in merkle.manifest(documents(spark, rows)).collect():
        made = x.digest
        for p in x.proof:
            assert (len(p.left) + len(p.right)) // 64 <= 7
            made = h(p.left + made + p.right)
        assert made == x.root
    one_changed = [(i, "s", "en" if i % 3 else "de", i, "other" if i == 77 else f"text {i}") for i in range(200)]
    roots = [{(r.lang, r.subroot, r.root) for r in merkle.manifest(documents(spark, x)).select("lang", "subroot", "root").collect()} for x in (rows, one_changed)]
    assert {lang for lang, subroot, _ in roots[0] if subroot not in {s for _, s, _ in roots[1]}} == {"en"} and not {r for *_, r in roots[0]} & {r for *_, r in roots[1]}


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert audited(docs.repartition(9)) == audited(docs.coalesce(1))


def test_crc_in_sql():
    import duckdb

    for s in ("", "0", "12345678901234567890", "é中👍 x", "-7"):
        assert duckdb.execute(f"SELECT {registry.crc32_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [s]).fetchone()[0] == zlib.crc32(s.encode())
