"""Queries over ordered timelines: conversations as timelines of posts, events as items with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages, refresh
from ..operators import timeline as T
from ..schemas import table
from .registry import query

CONFIG = T.FilterConfig()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timelines: system is identified without opinion, assistant replies, user posts or, where the text's length is a multiple of 3, is unidentified."""
    n = F.length("text")
    kind = F.when(F.col("role") == "system", "N").when(F.col("role") == "assistant", "R").when(n % 3 > 0, "T").otherwise("U")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("timeline_id"), F.col("turn").alias("pos"), kind.alias("kind"), (n % 2 == 0).alias("own_hide"), (n % 11 == 0).alias("override"), (n % 5 == 0).alias("cur_hidden"), n.alias("n"),
    )


_ITEMS = """
items AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'N' WHEN role = 'assistant' THEN 'R' WHEN length(text) % 3 > 0 THEN 'T' ELSE 'U' END AS kind,
         length(text) % 2 = 0 AS own, length(text) % 11 = 0 AS forced, length(text) % 5 = 0 AS cur, length(text) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)"""


def _walk(carry: bool) -> str:
    untyped = "w.hide" if carry else "NULL"
    step = lambda prev: f"""CASE i.kind WHEN 'N' THEN NULL WHEN 'U' THEN {untyped if prev else 'NULL'}
      WHEN 'T' THEN i.own OR i.forced ELSE coalesce({'w.hide' if prev else 'NULL'}, i.own) OR i.forced END"""  # noqa: E731
    return f"""
walk(conv_id, rn, turn, kind, cur, hide) AS (
  SELECT conv_id, rn, turn, kind, cur, ({step(False)})::BOOLEAN FROM items i WHERE rn = 1
  UNION ALL
  SELECT i.conv_id, i.rn, i.turn, i.kind, i.cur, ({step(True)})::BOOLEAN FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.rn = w.rn + 1)"""


def _named(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("timeline_id").alias("conv_id"), F.col("pos").alias("turn"), *columns)


@query(f"WITH RECURSIVE {_ITEMS}, {_walk(True)} SELECT conv_id, turn, kind, hide FROM walk")
def hide_propagate(spark, sf_dir):
    return _named(T.propagated(items(spark, sf_dir)), "kind", "hide")


@query(f"WITH RECURSIVE {_ITEMS}, {_walk(False)} SELECT conv_id, turn, kind, hide FROM walk")
def hide_propagate_notifications(spark, sf_dir):
    """Where unidentified items follow nothing."""
    return _named(T.propagated(items(spark, sf_dir), untyped_carry=False), "kind", "hide")


@query(f"WITH RECURSIVE {_ITEMS}, {_walk(True)} SELECT conv_id, turn, hide FROM walk WHERE hide IS NOT NULL AND hide <> cur")
def hide_changes(spark, sf_dir):
    return _named(T.changes(T.propagated(items(spark, sf_dir))), "hide")


@query(f"WITH RECURSIVE {_ITEMS}, {_walk(True)} SELECT kind, count(*) AS n, count(*) FILTER (WHERE hide) AS n_hidden FROM walk GROUP BY kind")
def hide_counts(spark, sf_dir):
    return T.counts(T.propagated(items(spark, sf_dir)))


@query(f"WITH {_ITEMS} SELECT conv_id, turn, coalesce(bool_or(n % 7 = 0) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hide FROM items")
def sticky_section(spark, sf_dir):
    """Items after a heading (texts whose length is a multiple of 7)."""
    df = items(spark, sf_dir)
    return _named(df.withColumn("hide", T.sticky(df, F.col("n") % 7 == 0)), "hide")


@query(f"""WITH {_ITEMS},
w AS (SELECT *, coalesce(bool_or(n % 7 = 0) OVER o, FALSE) AS now, conv_id % 4 <> 0 AND coalesce(bool_or(n % 7 = 0) OVER o, FALSE) AS was
      FROM items WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT conv_id, turn, unnest(['-', '+']) AS op, unnest([was, now]) AS hide FROM w WHERE was <> now)
SELECT conv_id, turn, op, hide, (SELECT count(DISTINCT conv_id) FROM items WHERE conv_id % 4 = 0 AND n % 7 = 0) AS redone FROM c""")
def pages_refreshed(spark, sf_dir):
    """Headings that come late, in every fourth timeline: what was decided before is retracted, and only timelines with such a heading are decided anew."""
    now = items(spark, sf_dir).withColumn("heading", F.col("n") % 7 == 0)
    decide = lambda df: df.withColumn("hide", T.sticky(df, F.col("heading"))).select("timeline_id", "pos", "hide")
    first = refresh.refreshed(now.withColumn("heading", F.col("heading") & (F.col("timeline_id") % 4 != 0)), decide)
    later = refresh.refreshed(now, decide, first)
    return _named(later.changes.withColumn("redone", F.lit(later.redone).cast("long")), "op", "hide", "redone")


@query(f"""WITH {_ITEMS}, f AS (SELECT conv_id, max(turn) AS last FROM items WHERE n % 6 = 0 GROUP BY conv_id)
SELECT conv_id, turn FROM items LEFT JOIN f USING (conv_id) WHERE own <> cur AND (last IS NULL OR turn > last)""")
def focused_reset(spark, sf_dir):
    """Changes after the focused item only (the last text whose length is a multiple of 6)."""
    df = items(spark, sf_dir).withColumn("hide", F.col("own_hide")).withColumn("before", T.before_focus(F.col("n") % 6 == 0))
    return _named(T.changes(df).where("not before"))


@query(f"""WITH {_ITEMS}, k AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'HEADING' WHEN n % 4 = 1 THEN 'SEE_MORE' ELSE 'TWEET' END AS what FROM items),
s AS (SELECT b.conv_id, b.rn, min(b.rn - h.rn) AS off FROM k b JOIN k h ON h.conv_id = b.conv_id AND b.what = 'SEE_MORE' AND h.what = 'HEADING' AND b.rn - h.rn BETWEEN 2 AND 4 GROUP BY ALL)
SELECT k.conv_id, k.turn, k.what AS kind, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.conv_id = k.conv_id AND k.rn BETWEEN s.rn - s.off AND s.rn - 1) THEN k.own END AS group_hide FROM k""")
def see_more_group(spark, sf_dir):
    """What lies between a heading and a link to more, with the setting off: rows keep their own decision."""
    kind = F.when(F.col("n") % 4 == 0, "HEADING").when(F.col("n") % 4 == 1, "SEE_MORE").otherwise("TWEET")
    df = items(spark, sf_dir).withColumn("kind", kind).withColumn("hide", F.col("own_hide"))
    return _named(T.more_from_author(df, T.FilterConfig(hide_more_from_author=False)), "kind", "group_hide")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items: bits of the number in props say what their markup shows."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", k.alias("k"))
    icon = F.when(F.col("k") % 5 == 0, T.COMMUNITY_ICON + "z").when(F.col("k") % 5 == 1, T.PINNED_ICON + "z")
    return e.select(
        "*", (F.col("event_type") == "error").alias("promoted"), (F.col("k") % 2 == 1).alias("social_context"), icon.alias("icon_path"),
        (F.col("k") % 3 == 0).alias("has_article"), (F.col("k") % 7 < 3).alias("has_quote"), (F.col("user_id") % 2 == 0).alias("sep"), (F.col("user_id") % 4).alias("tab"),
    )


_TYPES = """
f AS (
  SELECT event_id, event_type, user_id, (props->>'$.k')::INT AS k FROM events),
t AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'PROMOTED_TWEET'
    WHEN k % 2 = 1 AND k % 5 = 0 THEN 'COMMUNITY_TWEET' WHEN k % 2 = 1 AND k % 5 = 1 THEN 'PINNED_TWEET'
    WHEN k % 2 = 1 AND k % 3 = 0 THEN 'UNAVAILABLE_RETWEET' WHEN k % 2 = 1 AND k % 7 < 3 THEN 'RETWEETED_QUOTE_TWEET' WHEN k % 2 = 1 THEN 'RETWEET'
    WHEN k % 7 < 3 THEN 'QUOTE_TWEET' WHEN k % 3 = 0 THEN 'UNAVAILABLE_QUOTE_TWEET' ELSE 'TWEET' END AS kind, user_id % 2 = 0 AS sep, user_id % 4 AS tab FROM f)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn("kind", T.tweet_type(check_social=True))


@query(f"WITH {_TYPES} SELECT event_id, kind FROM t")
def timeline_types(spark, sf_dir):
    return _typed(spark, sf_dir).select("event_id", "kind")


@query(f"""WITH {_TYPES} SELECT event_id,
  CASE WHEN kind IN ('TWEET', 'COMMUNITY_TWEET') THEN sep WHEN kind = 'QUOTE_TWEET' THEN sep
       WHEN kind = 'RETWEET' THEN CASE WHEN tab >= 2 THEN FALSE ELSE NOT sep END WHEN kind = 'RETWEETED_QUOTE_TWEET' THEN CASE WHEN tab >= 2 THEN FALSE ELSE TRUE END
       WHEN kind = 'UNAVAILABLE_QUOTE_TWEET' THEN TRUE WHEN kind = 'UNAVAILABLE_RETWEET' THEN FALSE ELSE TRUE END AS home,
  kind IN ('UNAVAILABLE_QUOTE_TWEET', 'UNAVAILABLE_RETWEET') AS list,
  kind NOT IN ('TWEET', 'COMMUNITY_TWEET', 'PINNED_TWEET', 'QUOTE_TWEET', 'RETWEET', 'RETWEETED_QUOTE_TWEET') AS profile,
  kind IN ('COMMUNITY_TWEET', 'PINNED_TWEET', 'PROMOTED_TWEET', 'UNAVAILABLE_QUOTE_TWEET', 'UNAVAILABLE_RETWEET') AS thread,
  kind IN ('PINNED_TWEET', 'PROMOTED_TWEET') AS other FROM t""")
def timeline_policies(spark, sf_dir):
    """What each kind of page hides with the default settings."""
    k = "kind"
    return _typed(spark, sf_dir).select(
        "event_id", T.home_policy(k, CONFIG, "sep", "tab").alias("home"), T.list_policy(k, CONFIG).alias("list"), T.profile_policy(k, CONFIG).alias("profile"),
        T.thread_policy(k, CONFIG).alias("thread"), T.other_policy(k).alias("other"),
    )


@query(f"""WITH {_TYPES}, h AS (SELECT kind, CASE WHEN kind IN ('TWEET', 'COMMUNITY_TWEET') THEN sep WHEN kind = 'QUOTE_TWEET' THEN TRUE WHEN kind = 'RETWEET' THEN CASE WHEN tab >= 2 THEN TRUE ELSE sep END
       WHEN kind = 'RETWEETED_QUOTE_TWEET' THEN TRUE WHEN kind = 'UNAVAILABLE_QUOTE_TWEET' THEN TRUE
       WHEN kind = 'UNAVAILABLE_RETWEET' THEN CASE WHEN tab >= 2 THEN TRUE ELSE sep END ELSE TRUE END AS hide FROM t)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE hide) AS n_hidden FROM h GROUP BY kind""")
def timeline_counts(spark, sf_dir):
    """Hidden items of the home page by kind, with other settings."""
    config = T.FilterConfig(retweets="ignore", quote_tweets="hide", list_retweets="hide", hide_unavailable_quotes=False)
    return T.counts(_typed(spark, sf_dir).withColumn("hide", T.home_policy("kind", config, "sep", "tab")))


@query("""
WITH f AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'AD' WHEN 'click' THEN 'LIKE' WHEN 'view' THEN 'FOLLOW' WHEN 'signup' THEN 'RETWEET' END AS k FROM events)
SELECT event_id, 'NOTIFICATION_' || k AS kind, CASE k WHEN 'AD' THEN TRUE WHEN 'LIKE' THEN TRUE WHEN 'RETWEET' THEN FALSE END AS hide FROM f""")
def notification_types(spark, sf_dir):
    icons = F.create_map(*[F.lit(x) for pair in zip(("error", "click", "view", "signup"), T.NOTIFICATION_ICONS.values(), strict=True) for x in pair])
    e = table(spark, sf_dir, "events").select("event_id", T.notification(F.concat(F.try_element_at(icons, F.col("event_type")), F.lit("z")), T.FilterConfig(hide_notification_likes=True)).alias("n"))
    return e.select("event_id", "n.kind", "n.hide")


@query(f"""WITH {_TYPES}, h AS (SELECT event_id, kind, user_id, k, CASE WHEN kind IN ('TWEET', 'COMMUNITY_TWEET', 'QUOTE_TWEET') THEN sep
       WHEN kind = 'RETWEET' THEN CASE WHEN tab >= 2 THEN FALSE ELSE NOT sep END WHEN kind = 'RETWEETED_QUOTE_TWEET' THEN tab < 2 WHEN kind = 'UNAVAILABLE_RETWEET' THEN FALSE ELSE TRUE END AS hide FROM t),
q AS (SELECT *, CASE WHEN NOT hide AND kind = 'QUOTE_TWEET' THEN user_id IN (5, 7) ELSE hide END AS h1 FROM h),
g AS (SELECT *, h1 OR user_id % 10 = 3 AS h2 FROM q)
SELECT event_id, CASE WHEN NOT h2 AND kind IN ('QUOTE_TWEET', 'RETWEETED_QUOTE_TWEET') THEN user_id = 9 AND k % 2 = 0 ELSE h2 END AS hide FROM g""")
def muted_quotes(spark, sf_dir):
    """Users whose quotes are hidden, links to shared chats, and quotes that are muted."""
    config = T.FilterConfig(hide_quotes_from=("u5", "u7"), muted_quotes=(("u9", "0"),))
    rows = _typed(spark, sf_dir)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    hide = T.overridden(T.home_policy("kind", config, "sep", "tab"), "kind", config, F.col("user_id") % 10 == 3, user, user, (F.col("k") % 2).cast("string"), home=True)
    return rows.select("event_id", hide.alias("hide"))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0),
i AS (SELECT e.event_id, e.user_id, (props->>'$.k')::INT % 4 AS v, event_type, u.user_id IS NOT NULL AS known FROM events e LEFT JOIN u USING (user_id)),
a AS (SELECT *, v > 0 AND event_type NOT IN ('error', 'signup') AND user_id <> 4 AND user_id <> 8 AS applies FROM i)
SELECT event_id, CASE WHEN applies THEN ['', 'BUSINESS', 'GOVERNMENT', 'BLUE'][v + 1] || '_REPLY' ELSE 'TWEET' END AS kind,
       CASE WHEN applies THEN NOT (v = 1 OR (known AND (user_id % 5 = 0 OR user_id * 1000 >= 60000))) ELSE FALSE END AS hide FROM a""")
def premium_replies(spark, sf_dir):
    """Replies by accounts with a badge, of which some are exempt; two of three users are known."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    users = e.where("user_id % 3 <> 0").select("user_id").distinct().select(name.alias("screen_name"), (F.col("user_id") % 5 == 0).alias("following"), F.lit(True).alias("followed_by"), (F.col("user_id") * 1000).alias("followers_count"))
    v = F.get_json_object("props", "$.k").cast("int") % 4
    badge = e.withColumn("v", v)
    verified = T.verified_type(F.when(F.col("v") == 1, "Business").when(F.col("v") == 2, "Government"), F.col("v") == 3, F.lit("BusinessLabel"), F.lit("Y"))
    rows = badge.select("event_id", F.lit("TWEET").alias("kind"), F.lit(False).alias("hide"), verified.alias("verified"), name.alias("screen_name"), (F.col("event_type") == "error").alias("is_focused"), (F.col("event_type") == "signup").alias("is_reply"))
    config = T.FilterConfig(hide_premium_replies=True, show_government=False, show_followers=True, followers_at_least=60_000)
    return T.premium_replies(rows, users, config, op="u4", own="U8").select("event_id", "kind", "hide")


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*', ''), '[?#].*$', '') AS path FROM pages),
q AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '/home' WHEN 1 THEN '/user' || page_id || '/status/' || page_id WHEN 2 THEN '/i/lists/' || page_id WHEN 3 THEN '/user' || page_id || '/with_replies'
        WHEN 4 THEN '/settings/display' WHEN 5 THEN '/user' || page_id || '/status/12/quotes' WHEN 6 THEN '/explore/tabs' ELSE path END AS path FROM p)
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'home' WHEN 1 THEN 'thread' WHEN 2 THEN 'list' WHEN 3 THEN 'profile' WHEN 4 THEN 'display_settings' WHEN 5 THEN 'quotes' WHEN 6 THEN 'explore'
        ELSE CASE WHEN regexp_matches(path, '^/([a-zA-Z0-9_]{1,20})(/(affiliates|with_replies|superfollows|highlights|articles|media|likes))?/?$') THEN 'profile' END END AS page,
       page_id % 8 = 1 AND page_id % 16 = 1 AS own FROM q""")
def page_router(spark, sf_dir):
    n = F.col("page_id").cast("string")
    path = F.regexp_replace(F.regexp_replace("url", "^[^:]*://[^/]*", ""), "[?#].*$", "")
    made = [F.lit("/home"), F.concat(F.lit("/user"), n, F.lit("/status/"), n), F.concat(F.lit("/i/lists/"), n), F.concat(F.lit("/user"), n, F.lit("/with_replies")), F.lit("/settings/display"), F.concat(F.lit("/user"), n, F.lit("/status/12/quotes")), F.lit("/explore/tabs")]
    for k, p in enumerate(made):
        path = F.when(F.col("page_id") % 8 == k, p).otherwise(path)
    me = F.when(F.col("page_id") % 16 == 1, F.concat(F.lit("user"), n)).otherwise("nobody")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), me.alias("me"))
    return rows.select("page_id", T.page_of("path").alias("page"), (T.own_post("path", "me") & (F.col("page_id") % 8 == 1)).alias("own"))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'SHOW_MORE' ELSE 'UNAVAILABLE' END AS kind, CASE WHEN event_type IN ('view', 'error') THEN TRUE END AS hide FROM events""")
def unavailable_items(spark, sf_dir):
    button = F.when(F.col("event_type") == "click", "Show").when(F.col("event_type") == "view", "View")
    text = F.when(F.col("event_type") == "error", "This post is unavailable.").otherwise("gone")
    rows = table(spark, sf_dir, "events").select("event_id", button.alias("b"), text.alias("t"))
    return rows.select("event_id", T.unavailable("b", "t", CONFIG).alias("u")).select("event_id", "u.kind", "u.hide")


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'INLINE_PROMPT' WHEN event_type = 'click' THEN 'HEADING' END AS kind,
       CASE WHEN event_type = 'view' THEN user_id % 2 = 0 WHEN event_type = 'click' THEN TRUE END AS hide FROM events""")
def prompts_and_headings(spark, sf_dir):
    """With prompts shown unless they sell."""
    rows = table(spark, sf_dir, "events")
    is_a = lambda t: F.col("event_type") == t
    said = T.prompt_or_heading(is_a("view"), F.col("user_id") % 2 == 0, is_a("click"), T.FilterConfig(hide_inline_prompts=False))
    return rows.select("event_id", said.alias("s")).select("event_id", "s.kind", "s.hide")


@query("SELECT event_id, NULL::DOUBLE AS likes, value AS reposts FROM events")
def masked_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("likes"), F.col("value").alias("reposts"))
    return rows.select("event_id", *T.masked_metrics(T.FilterConfig(hidden_metrics=("likes",)), "likes", "reposts"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages: bits of the texts' hashes say what markup shows."""
    bit = lambda k, n, of=1: (F.pmod(F.xxhash64("text", F.lit(k)), F.lit(n)) < of)
    made = {
        "timeline_id": F.col("conv_id"), "pos": F.col("turn").cast("int"), "is_post": F.col("role") != "system", "is_focused": (F.col("turn") == 2), "is_reply": F.col("role") == "assistant",
        "promoted": bit(1, 12), "social_context": bit(2, 4), "has_article": bit(3, 8), "has_quote": bit(4, 5), "grok": bit(5, 15), "verified": F.when(bit(6, 3), "BLUE"),
        "screen_name": F.concat(F.lit("u"), (F.length("text") % 20).cast("string")), "heading": F.col("role") == "system", "heading_described": bit(7, 6), "cur_hidden": bit(8, 3),
    }
    rows = table(spark, sf_dir, "conversations")
    return rows.select(*[made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (f.split() for f in pages.FEATURES.split(", "))])


@query()
def thread_page(spark, sf_dir):
    """All rules of a post's page; tests hold them against a walk in order."""
    users = spark.range(20).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("screen_name"), (F.col("id") % 3 == 0).alias("following"), F.lit(False).alias("followed_by"), F.col("id").alias("followers_count"))
    done = pages.thread(page_items(spark, sf_dir), users, T.FilterConfig(hide_premium_replies=True), "u1", "u2")
    return _named(done, "kind", "hide", "changed")


@query()
def home_page(spark, sf_dir):
    return _named(pages.main_timeline(page_items(spark, sf_dir), CONFIG, "home"), "kind", "hide", "changed")
