import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.labels import largest_object
from tidewell.operators import gold, metrics, retrieval, timeline
from tidewell.sources import files, html


def test_torn_lines_are_counted_and_skipped(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"status_id": "1", "text": "a"}\n\n{"status_id": "2", "te')
    lines = files.read_lines(spark, str(tmp_path / "p.jsonl"), "status_id string, text string")
    assert files.torn_lines(lines).first().asDict() == {"n": 2, "torn": 1}
    assert [r.status_id for r in files.read_posts(spark, str(tmp_path / "p.jsonl")).collect()] == ["1"]


def test_label_maps_last_file_wins_and_stories_merge(spark, tmp_path):
    (tmp_path / "labels_00.json").write_text('{"1": "a", "2": "b"}')
    (tmp_path / "labels_01.json").write_text('{\n"2": "c"}')
    found = {r.status_id: r.story_id for r in files.read_label_maps(spark, str(tmp_path / "labels_*.json"), {"c": "d"}).collect()}
    assert found == {"1": "a", "2": "d"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(0, "1", "t"), (1, "2", "u")], "chunk long, id string, text string")
    files.write_chunks(rows, str(tmp_path / "c"))
    files.append_results(rows, str(tmp_path / "r"))
    files.append_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 4
    assert files.markdown(rows).splitlines()[0] == "| chunk | id | text |"
    made = []
    for _ in range(2):
        df = files.cached_table(spark, str(tmp_path / "e"), lambda: made.append(1) or rows, model="m", max_len=128)
    assert df.count() == 2 and made == [1]
    assert files.not_done(rows, rows.where("id = '1'")).count() == 1
    assert files.resumed(rows.withColumn("seq", F.lit(1)), rows.withColumn("seq", F.lit(2)), "id").count() == 2


def test_gold_pairs_sources_agree(spark):
    ids = list("abcdef")
    clusters = spark.createDataFrame([(x, "s" if x in "abc" else x) for x in ids], "id string, story string")
    pairs = lambda p: spark.createDataFrame(p, "lo string, hi string")
    compact = {"overlaps": spark.createDataFrame([("l", x) for x in ids], "labeller string, id string"), "positives": pairs([("a", "b"), ("a", "c"), ("b", "c")]), "disputed": pairs([("d", "e")])}
    a = {(r.lo, r.hi): r.y for r in files.gold_pairs(spark, compact, None, None).collect()}
    b = {(r.lo, r.hi): r.y for r in files.gold_pairs(spark, None, None, clusters).collect()}
    assert len(b) == 15 and a == {k: v for k, v in b.items() if k != ("d", "e")}
    listed = spark.createDataFrame([("a", "b", True)], "lo string, hi string, same boolean")
    assert files.gold_pairs(spark, None, listed, None).first().y == 1
    with pytest.raises(ValueError):
        files.gold_pairs(spark, None, None, None)


def test_compact_pairs_are_one_each_whatever_tells_them_often(spark):
    overlaps = spark.createDataFrame([(w, x) for w, own in (("l", range(600)), ("m", range(300, 900)), (None, (900, 901))) for x in own] + [("l", 1)], "labeller string, id long")
    pairs = lambda p: spark.createDataFrame(p, "lo long, hi long")
    positive, disputed = [(1, 2), (1, 2), (3, 590), (310, 320), (0, 899), (900, 901), (7, 9)], [(2, 5), (310, 890), (7, 9), (5000, 6000)]
    found = files.gold_pairs(spark, {"overlaps": overlaps, "positives": pairs(positive), "disputed": pairs(disputed)}, None, None).collect()
    want = {(a, b): int((a, b) in positive) for own in (range(600), range(300, 900)) for a in own for b in own if a < b and (a, b) not in disputed}
    assert len(found) == len(want) and {(r.lo, r.hi): r.y for r in found} == want


def test_largest_object():
    assert json.loads(largest_object('{"a": 1} then ```json\n{"b": {"c": "x"}, "d": 2}``` {bad}')) == {"b": {"c": "x"}, "d": 2}
    assert largest_object("no {json") is None and largest_object(None) is None and largest_object("{" * 50_000) is None


def test_html_is_parsed_not_matched():
    page = '<script>"</p><article>"</script><article><a href="/u/status/9"><time datetime="d"></time></a><div data-testid="tweetText">a<br>b<img alt="c"></div><a data-testid="card.wrapper" href="http://e.org/x">k</a><a href="http://e.org/x">again</a></article>'
    article = next(n for n in html.parse(page).walk() if n.tag == "article")
    assert html.post_of(article) == {"status_id": "9", "author_id": "u", "text": "a\nb", "ts": "d", "quoted_id": None, "urls": ["http://e.org/x"], "media_keys": [], "is_repost": False, "has_card": True}
    assert html.quoted_text("<div>a<img alt='!'>b</div>") == "a!b" and html.parse(None).text() == ""


def test_texts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.trim_unicode(F.lit("  　x  "))) == "x"
    assert value(X.quoted_strings(F.lit("A_B: 'it\\'s', C: 'd'"))) == {"A_B": "it's", "C": "d"}
    assert value(X.round_even(F.lit(2.5), 0)) == 2 and value(X.medium_date(F.lit("2024-03-05").cast("date"))) == "Mar 5, 2024"
    assert [value(X.compact_number(F.lit(n))) for n in (999, 9999, 10_000, 1_234_567, 2_000_000_000)] == ["999", "9,999", "10K", "1.2M", "2B"]
    assert value(X.title_page(F.lit("(12) X \\ Home"), left_to_right=False)) == "Home"


def test_auc_equals_counting(spark):
    r = random.Random(2)
    rows = [(str(i), "x", int(r.random() < 0.3), round(r.random(), 1)) for i in range(200)]
    pos, neg = [s for *_, y, s in rows if y], [s for *_, y, s in rows if not y]
    expected = sum((n < p) + 0.5 * (n == p) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.pooled_auc(spark.createDataFrame(rows, "lo string, hi string, y int, sim double")).first()[0] - expected) < 1e-9


def test_rand_index_of_equal_partitions_is_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a int, b int")
    assert metrics.adjusted_rand(df, "a", "b").first()[0] == 1.0
    assert metrics.adjusted_rand(spark.createDataFrame([(1, 1), (2, 2)], "a int, b int"), "a", "b").first()[0] == 1.0


def test_latency_and_enumeration(spark):
    trials = spark.createDataFrame([("m", 1, 40.0, 20), ("m", 2, 60.0, 20), ("m", 3, 50.0, 20)], "model string, trial int, ms double, n int")
    assert metrics.latency(trials).first().ms_per_post == 2.5
    shared = spark.createDataFrame([("l", i) for i in range(10)], "labeller string, id long")
    assert gold.is_enumerable(shared, 45) and not gold.is_enumerable(shared, 44)


def test_descriptions(spark):
    labels = spark.createDataFrame([("1", "s"), ("2", "t"), ("3", "u")], "id string, story string")
    posts = spark.createDataFrame([("1", "a\n b"), ("2", "c")], "id string, text string")
    known = spark.createDataFrame([("t", "told")], "story string, label string")
    assert {r.story: r.label for r in retrieval.described(labels, posts, known).collect()} == {"s": "a b", "t": "told", "u": "u"}


def test_carrying_equals_a_walk(spark):
    r = random.Random(4)
    rows = [(t, p, r.choice("TRUN"), r.random() < 0.5, r.random() < 0.3) for t in range(60) for p in range(r.randrange(1, 14))]
    for carry in (True, False):
        expected, prev, last = [], None, None
        for t, p, kind, own, forced in rows:
            prev = prev if t == last else None
            if kind == "N" or (kind == "U" and not carry):
                hide = None
            elif kind == "U":
                hide = prev
            else:
                hide = (prev if kind == "R" and prev is not None else own) or forced
            expected.append(hide)
            prev, last = hide, t
        df = spark.createDataFrame(rows, "timeline_id int, pos int, kind string, own_hide boolean, override boolean")
        assert [x.hide for x in timeline.propagated(df, untyped_carry=carry).orderBy("timeline_id", "pos").collect()] == expected


def test_labellers_and_locales(spark, tmp_path):
    from tidewell.functions import labels
    from tidewell.operators.chunks import random_pick, top
    from tidewell.sources import locales
    from tidewell.streaming.engine import observed

    labels.LABELLERS["echo"] = lambda texts: '{"0": {"story": "s", "label": "' + texts[0] + '"}}' if texts[0] != "bad" else 1 / 0
    asked = labels.ask(spark.createDataFrame([(1, ["a", "b"]), (2, ["bad"])], "batch long, texts array<string>"), "echo")
    assert [tuple(r) for r in labels.salvage(asked).collect()] == [(1, 0, "s", "a")] and asked.where("reply is null").count() == 1
    for lang, text in (("en", '{"a": {"message": "A"}, "b": {"message": "B"}}'), ("de", '{"a": {"message": "Ä"}, "b": {"message": ""}}')):
        (tmp_path / lang).mkdir()
        (tmp_path / lang / "messages.json").write_text(text)
    rows = locales.read_locales(spark, str(tmp_path / "*/messages.json"))
    assert {(r.lang, r.key): r.message for r in locales.with_fallback(rows).collect()} == {("en", "a"): "A", ("en", "b"): "B", ("de", "a"): "Ä", ("de", "b"): "B"}
    assert locales.catalogue(rows).where("lang = 'en'").first().messages == {"a": "A", "b": "B"}
    df = spark.range(50)
    assert [r.id for r in top(df, "id", 2).collect()] == [49, 48]
    assert random_pick(df, "id", 5).collect() == random_pick(df.repartition(3), "id", 5).collect()
    counted, seen = observed(spark.createDataFrame([([1.0],), (None,)], "vec array<double>"))
    counted.collect()
    assert seen.get == {"posts": 2, "embedded": 1, "failed": 1}


def test_config_and_precedence(spark):
    config = timeline.FilterConfig().merged({"retweets": "hide", "nonsense": 1})
    assert config.retweets == "hide"
    home = timeline.home_policy(F.lit("UNAVAILABLE_RETWEET"), timeline.FilterConfig(), F.lit(False), F.lit(0))
    assert spark.range(1).select(home).first()[0] is False
