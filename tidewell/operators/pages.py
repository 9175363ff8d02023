"""Whole pages: all rules of a main timeline and of a post's thread in their order, each as one pass of projections and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import timeline as T

#: What an item's markup shows; absent features are null.
FEATURES = (
    "timeline_id long, pos int, is_post boolean, is_focused boolean, is_reply boolean, promoted boolean, social_context boolean, icon_path string, has_article boolean, has_quote boolean, "
    "grok boolean, verified string, screen_name string, quoted_by string, quoted_user string, quoted_time string, button string, article_text string, more_link boolean, prompt boolean, upsell boolean, "
    "heading boolean, heading_described boolean, cur_hidden boolean"
)
SHOW_REPLIES = "Show more replies"


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def timeline_options(spark: SparkSession) -> DataFrame:
    """page, check_social, classify and hide_headings: how each kind of page handles its timeline."""
    return spark.createDataFrame([*T.TIMELINE_OPTIONS], "page string, check_social boolean, classify boolean, hide_headings boolean")


def outside_app(path: str | Column) -> Column:
    """Pages that no rule is for: embeds, legal texts, sign-in and the like."""
    return F.regexp_like(F.col(path) if isinstance(path, str) else path, F.lit(r"^/(?:i/(?:flow|oauth2|cards|videos)|login|logout|account|oauth|intent|tos|privacy)(?:/|$)"))


def main_timeline(items: DataFrame, config: T.FilterConfig, page: str, separated: bool = False, tab: int = 0) -> DataFrame:
    """items (FEATURES) of a page with kind, hide and changed.

    page: home, list or profile have rules of their own for posts, and replies there take over what was decided for the post above; notifications
    know their icons; any other page has the policy for the rest. An item that nothing identifies takes over the decision before it, but not on notifications.
    """
    own_rules, post = page in ("home", "list", "profile"), _yes("is_post")
    kind = F.when(post, T.tweet_type(check_social=page == "profile"))
    if page == "home":
        policy = T.home_policy("__k", config, F.lit(separated), F.lit(tab))
    elif page == "list":
        policy = T.list_policy("__k", config)
    elif page == "profile":
        policy = T.profile_policy("__k", config)
    else:
        policy = T.other_policy("__k") if page != "notifications" else F.lit(None).cast("boolean")
    rows = items.withColumn("__k", kind)
    note, prompt = T.notification("icon_path", config), T.prompt_or_heading("prompt", "upsell", "heading", config)
    if page == "notifications":
        rows = rows.withColumn("__k", F.when(~post, note["kind"]).otherwise(F.col("__k"))).withColumn("__own", F.when(~post, note["hide"]))
    elif own_rules:
        decided = T.overridden(policy, "__k", config, "grok", "quoted_by", "quoted_user", "quoted_time", page == "home")
        rows = rows.withColumn("__own", F.when(post, decided))
    else:
        rows = rows.withColumn("__k", F.when(F.col("__k").isNull() & _yes("has_article"), "UNAVAILABLE").otherwise(F.col("__k"))).withColumn("__own", policy)
    # what isn't hidden yet when a reply takes over a decision may still be hidden by links to chats and muted quotes
    late = T.overridden(F.lit(False), "__k", config, "grok", "quoted_by", "quoted_user", "quoted_time", False) if own_rules else F.lit(False)
    rows = rows.withColumn("__p", F.when(F.col("__k").isNull(), prompt["kind"])).withColumn("__own", F.when(F.col("__p").isNotNull(), prompt["hide"]).otherwise(F.col("__own")))
    rows = rows.withColumn("__k", F.coalesce("__k", "__p"))
    role = F.when(F.col("__k").isNull(), "U").when(F.lit(own_rules) & post & _yes("is_reply"), "R").when(F.col("__own").isNull(), "N").otherwise("T")
    named = rows.withColumn("own_hide", F.col("__own")).withColumn("override", post & late).withColumn("__kind", F.col("__k")).withColumn("kind", role)
    done = T.propagated(named, untyped_carry=page != "notifications")
    kind = F.coalesce("__kind", F.when(F.col("hide").isNotNull(), "SUBSEQUENT_ITEM"))
    return _finished(done, items, kind, F.col("hide").isNotNull() & (F.col("hide") != _yes("cur_hidden")))


def thread(items: DataFrame, users: DataFrame, config: T.FilterConfig, op: str, own: str) -> DataFrame:
    """items (FEATURES) of a post's page with kind, hide and changed.

    Nothing up to the focused post changes; what follows a described heading goes, if more posts are hidden; the posts between a heading and the link to
    more of their author go with the link; an item is a heading or has such a link, never both. users, op and own as premium_replies() takes them.
    """
    post, article, focused = _yes("is_post"), _yes("has_article"), _yes("is_post") & _yes("is_focused")
    button = F.coalesce("button", F.lit(""))
    unknown = T.unavailable("button", "article_text", config)
    shown = ~post & ~article & (button == SHOW_REPLIES)
    rows = items.withColumn("__head", ~post & ~article & ~shown & _yes("heading"))
    order = W.partitionBy("timeline_id").orderBy("pos")
    rows = rows.withColumn("__plain", F.col("__head") & ~_yes("heading_described") & ~_yes("more_link"))
    near = F.lit(False)
    for k in (2, 3, 4):
        near = near | F.coalesce(F.lag("__plain", k).over(order), F.lit(False))
    more = ~post & ~article & ~shown & _yes("more_link") & near
    described = F.col("__head") & _yes("heading_described") & ~F.col("__more")
    rows = rows.withColumn("__more", more)
    rows = rows.withColumn("__gone", T.sticky(rows, described) if config.hide_more else F.lit(False))
    gone = F.col("__gone")
    kind = (
        F.when(gone, "DISCOVER_MORE_TWEET").when(focused, "FOCUSED_TWEET").when(post, T.tweet_type()).when(article, unknown["kind"]).when(shown, "SHOW_MORE").when(F.col("__more"), "SEE_MORE")
        .when(described, "DISCOVER_MORE_HEADING").when(F.col("__head"), "HEADING")
    )
    rows = rows.withColumn("kind", kind)
    grok = F.lit(config.hide_grok) & _yes("grok")
    hide = (
        F.when(gone, True).when(focused, grok).when(post, T.thread_policy("kind", config) | grok).when(article, unknown["hide"]).when(F.col("__more"), config.hide_more_from_author)
        .when(described, config.hide_more)
    )
    rows = rows.withColumn("hide", hide).withColumn("verified", F.when(post & ~gone, F.col("verified")))
    rows = T.premium_replies(rows, users, config, op, own).withColumn("__kind", F.col("kind"))
    role = F.when(F.col("kind").isNull(), "U").when(post & ~gone & ~focused & _yes("is_reply"), "R").when(F.col("hide").isNull(), "N").otherwise("T")
    done = T.propagated(rows.withColumn("kind", role).withColumn("own_hide", F.col("hide")).withColumn("override", post & grok).drop("hide"))
    done = done.withColumn("kind", F.coalesce("__kind", F.when(F.col("hide").isNotNull(), "SUBSEQUENT_ITEM")))
    grouped = T.more_from_author(done, config)
    last = F.max(F.when(_yes("is_post") & _yes("is_focused") & ~F.col("__gone"), F.col("pos"))).over(W.partitionBy("timeline_id"))
    # a link to more before the focused post has its changes dropped like all others
    upto = F.coalesce(F.min(F.when((F.col("kind") == "SEE_MORE") & F.coalesce(F.col("pos") > F.col("__last"), F.lit(True)), F.col("pos"))).over(order.rowsBetween(1, 4)).isNotNull(), F.lit(False))
    final = grouped.withColumn("__last", last).withColumn("__wanted", upto)
    own_change = F.col("hide").isNotNull() & (F.col("hide") != _yes("cur_hidden")) & F.coalesce(F.col("pos") > F.col("__last"), F.lit(True))
    group_change = F.col("__wanted") & F.col("group_hide").isNotNull()
    return _finished(final, items, F.col("kind"), F.when(group_change, F.col("group_hide") != _yes("cur_hidden")).otherwise(own_change))


def _finished(done: DataFrame, items: DataFrame, kind: Column, changed: Column) -> DataFrame:
    return done.withColumn("__final", kind).withColumn("changed", changed).select(*[c for c in items.columns if c not in ("kind", "hide")], F.col("__final").alias("kind"), "hide", "changed")
