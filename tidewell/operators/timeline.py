"""Ordered timelines: what each item is, whether policy hides it, and how decisions carry over to the items after it.

Decisions are three-valued: true hides, false shows, null has no opinion. Null isn't false: an item without an opinion ends what is carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class FilterConfig:
    """The knobs that decisions read, with their defaults. shared settings are hide, ignore or separate."""

    retweets: str = "separate"
    quote_tweets: str = "ignore"
    list_retweets: str = "ignore"
    hide_unavailable_quotes: bool = True
    hide_profile_retweets: bool = False
    hide_notification_likes: bool = False
    hide_notification_retweets: bool = False
    hide_inline_prompts: bool = True
    hide_premium_upsells: bool = True
    hide_who_to_follow: bool = True
    hide_grok: bool = True
    hide_more: bool = True
    hide_more_from_author: bool = True
    mutable_quotes: bool = True
    hide_quotes_from: tuple[str, ...] = ()
    muted_quotes: tuple[tuple[str, str], ...] = ()
    hide_premium_replies: bool = False
    show_business: bool = True
    show_government: bool = True
    show_following: bool = True
    show_followed_by: bool = False
    show_followers: bool = False
    followers_at_least: int = 1_000_000
    hidden_metrics: tuple[str, ...] = field(default=())

    def merged(self, stored: dict[str, object]) -> FilterConfig:
        """These settings with stored ones over them; unknown names are ignored."""
        return replace(self, **{k: v for k, v in stored.items() if k in self.__dataclass_fields__})


# How the icons of social contexts and notifications begin.
COMMUNITY_ICON, PINNED_ICON = "M7.471 21H.472l.029-1.027c.184", "M13 21l-1 2-1-2v-5H4.5v-2.287l"
NOTIFICATION_ICONS = {
    "AD": "M18.766 2H7.323l-4.8 12h5.324l",
    "LIKE": "M20.884 13.19c-1.351 2.48-4.00",
    "FOLLOW": "M17.863 13.44c1.477 1.58 2.366",
    "RETWEET": "M4.75 3.79l4.603 4.3-1.706 1.8",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _true(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(False))


def tweet_type(promoted="promoted", social="social_context", icon="icon_path", article="has_article", quote="has_quote", check_social: bool = False) -> Column:
    """What a post in a timeline is, from what its markup shows."""
    out = F.when(_true(promoted), "PROMOTED_TWEET")
    if check_social:
        path = F.coalesce(_col(icon), F.lit(""))
        out = out.when(_true(social) & path.startswith(COMMUNITY_ICON), "COMMUNITY_TWEET").when(_true(social) & path.startswith(PINNED_ICON), "PINNED_TWEET")
    out = out.when(_true(social) & _true(article), "UNAVAILABLE_RETWEET").when(_true(social) & _true(quote), "RETWEETED_QUOTE_TWEET").when(_true(social), "RETWEET")
    return out.when(_true(quote), "QUOTE_TWEET").when(_true(article), "UNAVAILABLE_QUOTE_TWEET").otherwise("TWEET")


def shared_policy(setting: str, separated: Column) -> Column:
    """Whether a kind that a setting hides, ignores or separates is hidden on this page."""
    return {"hide": F.lit(True), "ignore": separated, "separate": ~separated}[setting]


def home_policy(kind: str | Column, config: FilterConfig, separated: str | Column, tab: str | Column) -> Column:
    """separated: the page shows what is separated; tab: number of the selected tab, pinned lists from 2 on. Other kinds are hidden."""
    kind, pinned, sep = _col(kind), _col(tab) >= 2, _true(separated)
    retweets, quotes, lists = shared_policy(config.retweets, sep), shared_policy(config.quote_tweets, sep), F.lit(config.list_retweets == "hide")
    return (
        F.when(kind.isin("TWEET", "COMMUNITY_TWEET"), sep)
        .when(kind == "QUOTE_TWEET", quotes)
        .when(kind == "RETWEET", F.when(pinned, lists).otherwise(retweets))
        .when(kind == "RETWEETED_QUOTE_TWEET", F.when(pinned, lists).otherwise(retweets | quotes))
        .when(kind == "UNAVAILABLE_QUOTE_TWEET", F.lit(config.hide_unavailable_quotes) | quotes)
        # the setting for unavailable posts chooses here between lists' and retweets' policy; it doesn't hide by itself
        .when(kind == "UNAVAILABLE_RETWEET", F.when(F.lit(config.hide_unavailable_quotes) | pinned, lists).otherwise(retweets))
        .otherwise(True)
    )


def _table_policy(kind: str | Column, by_kind: dict[str, bool], default: bool) -> Column:
    out = F.when(F.lit(False), default)
    for k, hide in by_kind.items():
        out = out.when(_col(kind) == k, hide)
    return out.otherwise(default)


def list_policy(kind: str | Column, config: FilterConfig) -> Column:
    """Other kinds are shown."""
    lists, gone = config.list_retweets == "hide", config.hide_unavailable_quotes
    return _table_policy(kind, {"RETWEET": lists, "RETWEETED_QUOTE_TWEET": lists, "UNAVAILABLE_QUOTE_TWEET": gone, "UNAVAILABLE_RETWEET": gone or lists}, False)


_SHOWN = ("TWEET", "QUOTE_TWEET")


def profile_policy(kind: str | Column, config: FilterConfig) -> Column:
    """Other kinds are hidden."""
    own = dict.fromkeys((*_SHOWN, "COMMUNITY_TWEET", "PINNED_TWEET"), False)
    return _table_policy(kind, own | dict.fromkeys(("RETWEET", "RETWEETED_QUOTE_TWEET"), config.hide_profile_retweets) | {"UNAVAILABLE_QUOTE_TWEET": config.hide_unavailable_quotes}, True)


def thread_policy(kind: str | Column, config: FilterConfig) -> Column:
    """Other kinds are hidden."""
    gone = config.hide_unavailable_quotes
    return _table_policy(kind, dict.fromkeys((*_SHOWN, "RETWEET", "RETWEETED_QUOTE_TWEET"), False) | {"UNAVAILABLE_QUOTE_TWEET": gone, "UNAVAILABLE_RETWEET": gone}, True)


def other_policy(kind: str | Column) -> Column:
    """Other kinds are hidden; what has no kind has no opinion."""
    shown = (*_SHOWN, "COMMUNITY_TWEET", "RETWEET", "RETWEETED_QUOTE_TWEET", "UNAVAILABLE", "UNAVAILABLE_QUOTE_TWEET", "UNAVAILABLE_RETWEET")
    return F.when(_col(kind).isNotNull(), ~_col(kind).isin(*shown))


def notification(icon: str | Column, config: FilterConfig) -> Column:
    """A struct of kind (null if unknown) and hide."""
    hide = {"AD": F.lit(True), "LIKE": F.lit(config.hide_notification_likes), "FOLLOW": F.lit(None).cast("boolean"), "RETWEET": F.lit(config.hide_notification_retweets)}
    kind, hidden = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, path in reversed(NOTIFICATION_ICONS.items()):
        begins = F.coalesce(_col(icon).startswith(path), F.lit(False))
        kind, hidden = F.when(begins, f"NOTIFICATION_{name}").otherwise(kind), F.when(begins, hide[name]).otherwise(hidden)
    return F.struct(kind.alias("kind"), hidden.alias("hide"))


def prompt_or_heading(prompt: str | Column, upsell: str | Column, heading: str | Column, config: FilterConfig, hide_headings: bool = True) -> Column:
    """A struct of kind and hide for items that are no posts."""
    hide_prompt = F.lit(config.hide_inline_prompts) | (F.lit(config.hide_premium_upsells) & _true(upsell))
    kind = F.when(_true(prompt), "INLINE_PROMPT").when(_true(heading), "HEADING")
    return F.struct(kind.alias("kind"), F.when(_true(prompt), hide_prompt).when(_true(heading), F.lit(hide_headings and config.hide_who_to_follow)).alias("hide"))


def overridden(hide: Column, kind: str | Column, config: FilterConfig, grok: str | Column, quoted_by: str | Column, quoted_user: str | Column, quoted_time: str | Column, home: bool) -> Column:
    """hide after the lists of users whose quotes are hidden, links to shared chats, and muted quotes, in this order; only what isn't hidden is looked at."""
    kind = _col(kind)
    if home and config.mutable_quotes and config.hide_quotes_from:
        hide = F.when(~_true(hide) & (kind == "QUOTE_TWEET") & _col(quoted_by).isNotNull(), _col(quoted_by).isin(*config.hide_quotes_from)).otherwise(hide)
    if config.hide_grok:
        hide = F.when(~_true(hide) & _true(grok), True).otherwise(hide)
    if config.mutable_quotes and config.muted_quotes:
        muted = F.exists(F.array(*[F.struct(F.lit(u).alias("user"), F.lit(t).alias("time")) for u, t in config.muted_quotes]), lambda m: (m["user"] == _col(quoted_user)) & (m["time"] == _col(quoted_time)))
        hide = F.when(~_true(hide) & kind.isin("QUOTE_TWEET", "RETWEETED_QUOTE_TWEET"), _true(muted)).otherwise(hide)
    return hide


def verified_type(verified="verified_type", blue="is_blue", label="affiliate_label", description="affiliate_description") -> Column:
    """BUSINESS, GOVERNMENT, BLUE or null; badges of the platform's own affiliates don't count."""
    own = _true((_col(label) == "BusinessLabel") & (_col(description) == "X"))
    return F.when(own, None).when(_col(verified) == "Business", "BUSINESS").when(_col(verified) == "Government", "GOVERNMENT").when(_true(blue), "BLUE")


def premium_replies(items: DataFrame, users: DataFrame, config: FilterConfig, op: str, own: str) -> DataFrame:
    """items (kind, hide, verified, screen_name, is_focused, is_reply) with kind and hide as the rule for premium replies leaves them.

    users (screen_name, following, followed_by, followers_count): unknown users are exempt from nothing. op is compared without case, own with it.
    """
    known = users.select(F.col("screen_name"), F.struct("following", "followed_by", "followers_count").alias("__user")).dropDuplicates(["screen_name"])
    name = F.col("screen_name")
    applies = ~_true("hide") & F.col("verified").isNotNull() & ~_true("is_focused") & ~_true("is_reply") & ~_true(F.lower(name) == op.lower()) & ~_true(name == own)
    user = F.col("__user")
    exempt = (F.lit(config.show_business) & (F.col("verified") == "BUSINESS")) | (F.lit(config.show_government) & (F.col("verified") == "GOVERNMENT"))
    exempt = exempt | (F.lit(config.show_following) & _true(user["following"])) | (F.lit(config.show_followed_by) & _true(user["followed_by"]))
    exempt = exempt | (F.lit(config.show_followers) & _true(user["followers_count"] >= config.followers_at_least))
    joined = items.join(known, "screen_name", "left").withColumn("__on", applies)
    hide = F.when(F.col("__on"), ~exempt).otherwise(F.col("hide")) if config.hide_premium_replies else F.col("hide")
    kind = F.when(F.col("__on"), F.concat("verified", F.lit("_REPLY"))).otherwise(F.col("kind"))
    return joined.withColumn("hide", hide).withColumn("kind", kind).select(*items.columns)


def unavailable(button: str | Column, text: str | Column, config: FilterConfig, show: str = "Show", view: str = "View", gone: str = "This post is unavailable.") -> Column:
    """A struct of kind and hide of an item that has an article and no post."""
    button, config_hides = _col(button), F.lit(config.hide_unavailable_quotes)
    kind = F.when(button == show, "SHOW_MORE").otherwise("UNAVAILABLE")
    return F.struct(kind.alias("kind"), F.when(button == view, config_hides).when(button.isNull() & (_col(text) == gone), config_hides).alias("hide"))


def propagated(items: DataFrame, timeline: str = "timeline_id", pos: str = "pos", untyped_carry: bool = True) -> DataFrame:
    """items with hide: own decisions, and those that replies and unidentified items take over from the item before.

    items: kind (T a post, R a reply to the post above, U unidentified, N identified without opinion), own_hide (of T and R), override (true hides what
    isn't hidden). A reply takes the item before's decision if that has one; else its own. U takes the item before's, if untyped_carry. Two windows do
    what a walk in order does: a row that decides for itself begins a segment, and a segment's decisions only turn from shown to hidden.
    """
    order = W.partitionBy(timeline).orderBy(pos)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    kinds = "TNU" if not untyped_carry else "TN"
    head = F.col("kind").isin(*kinds)
    seg = items.withColumn("__seg", F.sum(head.cast("int")).over(so_far))
    within = W.partitionBy(timeline, "__seg").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    replies = F.sum((F.col("kind") == "R").cast("int")).over(within)
    began = F.coalesce(F.first(F.when(head, F.col("kind"))).over(within), F.lit("-"))
    lead = seg.withColumn("__own", head | ((F.col("kind") == "R") & (replies == 1) & (began != "T")))
    anchored = lead.withColumn("__seg2", F.sum(F.col("__own").cast("int")).over(so_far))
    own = F.when(F.col("__own") & F.col("kind").isin("T", "R"), _true("own_hide") | _true("override")).when((F.col("kind") == "R") & _true("override"), True)
    carry = W.partitionBy(timeline, "__seg2").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return anchored.withColumn("hide", F.max(own).over(carry)).drop("__seg", "__own", "__seg2")


def sticky(items: DataFrame, heading: Column, timeline: str = "timeline_id", pos: str = "pos") -> Column:
    """True for the items after the first heading of their timeline; a window expression over items."""
    before = W.partitionBy(timeline).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.max(heading).over(before), F.lit(False))


def before_focus(focused: Column, timeline: str = "timeline_id", pos: str = "pos") -> Column:
    """True for the items up to the last focused one of their timeline, whose changes are dropped."""
    last = F.max(F.when(focused, F.col(pos))).over(W.partitionBy(timeline))
    return F.coalesce(F.col(pos) <= last, F.lit(False))


def more_from_author(items: DataFrame, config: FilterConfig, timeline: str = "timeline_id", pos: str = "pos") -> DataFrame:
    """items (kind, hide) with group_hide: for items from a HEADING 2 to 4 places before a SEE_MORE up to it, whether they are hidden; else null.

    The nearest such heading counts.
    """
    order = W.partitionBy(timeline).orderBy(pos)
    offset = F.lit(None).cast("int")
    for k in (4, 3, 2):
        offset = F.when(F.lag("kind", k).over(order) == "HEADING", k).otherwise(offset)
    marked = items.withColumn("__off", F.when(F.col("kind") == "SEE_MORE", offset))
    inside = F.lit(False)
    for k in range(1, 5):
        inside = inside | F.coalesce(F.lead("__off", k).over(order) >= k, F.lit(False))
    return marked.withColumn("__in", inside).withColumn("group_hide", F.when(F.col("__in"), F.lit(config.hide_more_from_author) | _true("hide"))).drop("__off", "__in")


def changes(items: DataFrame) -> DataFrame:
    """The items (hide, cur_hidden) whose decision differs from what they show now."""
    return items.where(F.col("hide").isNotNull() & (F.col("hide") != _true("cur_hidden")))


def counts(items: DataFrame, *by: str) -> DataFrame:
    """Items and hidden items by kind, within the columns `by`; items without a kind don't count."""
    return items.where("kind is not null").groupBy(*by, "kind").agg(F.count("*").alias("n"), F.count_if(_true("hide")).alias("n_hidden"))


# The paths of pages, as regular expressions over the whole path.
PAGES = (
    ("accessibility_settings", r"^/settings/accessibility$"),
    ("display_settings", r"^/settings/display$"),
    ("settings", r"^/settings"),
    ("chat", r"^/i/chat"),
    ("communities", r"^/[a-zA-Z\d_]{1,20}/communities(?:/explore)?/?$"),
    ("community", r"^/i/communities/\d+(?:/about)?/?$"),
    ("community_members", r"^/i/communities/\d+/(?:members|moderators)/?$"),
    ("discover_communities", r"^/i/communities/suggested/?"),
    ("explore", r"^/explore(?:/|$)"),
    ("follow_list", r"^/[a-zA-Z\d_]{1,20}/(?:verified_followers|follow(?:ing|ers|ers_you_follow)|creator-subscriptions/subscriptions)/?$"),
    ("grok", r"^/i/grok"),
    ("history", r"^/i/history"),
    ("mediaviewer", r"(?i)^/[a-zA-Z\d_]{1,20}/status/\d+/mediaviewer$"),
    ("thread", r"^/[a-zA-Z\d_]{1,20}/status/\d+/?$"),
    ("quotes", r"^/[a-zA-Z\d_]{1,20}/status/\d+/quotes/?$"),
    ("interactions", r"^/[a-zA-Z\d_]{1,20}/status/\d+/(?:retweets|reposts|likes)/?$"),
    ("list", r"/i/lists/\d+/?$"),
    ("lists", r"^/[a-zA-Z\d_]{1,20}/lists/?$"),
    ("home", r"^/home$"),
    ("messages", r"^/messages"),
    ("compose", r"^/compose/(?:tweet|post)"),
    ("notifications", r"^/notifications"),
    ("premium_signup", r"^/i/premium_sign_up"),
    ("search", r"^/(?:search|hashtag/)"),
    ("media", r"/(?:photo|video)/\d/?$"),
)
PROFILE = r"^/([a-zA-Z\d_]{1,20})(?:/(affiliates|with_replies|superfollows|highlights|articles|media|likes))?/?$"


def page_of(path: str | Column, title: str | Column | None = None) -> Column:
    """The name of the page that a path shows; a profile only if the title (where given) names its user. Null for none."""
    path = _col(path)
    out = F.when(F.lit(False), "")
    for name, regex in PAGES:
        out = out.when(F.regexp_like(path, F.lit(regex)), name)
    profile = F.regexp_like(path, F.lit(PROFILE))
    if title is not None:
        profile = profile & F.contains(F.lower(_col(title)), F.concat(F.lit("@"), F.lower(F.regexp_extract(path, PROFILE, 1))))
    return out.when(profile, "profile")


def own_post(path: str | Column, screen_name: str | Column) -> Column:
    return _true(F.regexp_extract(path, r"^/([a-zA-Z\d_]{1,20})/status/(\d+)", 1) == _col(screen_name))


# How the items of a page's timeline are handled: social context is told apart, posts are classified, headings are hidden.
TIMELINE_OPTIONS = (
    ("home", False, True, True),
    ("list", False, True, True),
    ("profile", True, True, True),
    ("community", True, False, True),
    ("search", False, False, True),
    ("explore", False, False, True),
    ("quotes", False, False, False),
    ("notifications", False, False, False),
)


def masked_metrics(config: FilterConfig, *metrics: str) -> list[Column]:
    """The columns named, null where the configuration hides them."""
    return [F.when(F.lit(m not in config.hidden_metrics), F.col(m)).alias(m) for m in metrics]
