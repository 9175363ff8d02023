import random

import pytest

from tidewell.operators import pages, timeline

NAMES = [f.split()[0] for f in pages.FEATURES.split(", ")]


def item(r, t, p):
    more = r.random() < 0.3
    return {
        "timeline_id": t, "pos": p, "is_post": r.random() < 0.55, "is_focused": r.random() < 0.08, "is_reply": r.random() < 0.4, "promoted": r.random() < 0.1, "social_context": r.random() < 0.3, "icon_path": r.choice([None, "M4.75 3.79l4.603 4.3-1.706 1.8z", "M18.766 2H7.323l-4.8 12h5.324lq", "z"]),
        "has_article": r.random() < 0.15, "has_quote": r.random() < 0.2, "grok": r.random() < 0.1, "verified": r.choice([None, None, "BLUE", "BUSINESS", "GOVERNMENT"]), "screen_name": r.choice([None, "a", "b", "OP", "me"]), "quoted_by": "q", "quoted_user": r.choice("uv"), "quoted_time": "1",
        "button": r.choice([None, None, "Show", "View", pages.SHOW_REPLIES]), "article_text": r.choice(["This post is unavailable.", "x"]), "more_link": more, "prompt": r.random() < 0.1, "upsell": r.random() < 0.5,
        "heading": not more and r.random() < 0.5, "heading_described": r.random() < 0.15, "cur_hidden": r.random() < 0.5,
    }


def kind_of(x):
    if x["promoted"]:
        return "PROMOTED_TWEET"
    if x["social_context"]:
        return "UNAVAILABLE_RETWEET" if x["has_article"] else "RETWEETED_QUOTE_TWEET" if x["has_quote"] else "RETWEET"
    return "QUOTE_TWEET" if x["has_quote"] else "UNAVAILABLE_QUOTE_TWEET" if x["has_article"] else "TWEET"


def thread_walk(items, users, c, op, own):
    """The rules one item after the other."""
    out, final, sticky, prev, pending = [], {}, False, None, {}
    for i, x in enumerate(items):
        kind = hide = None
        post, focus = x["is_post"], False
        if sticky:
            kind, hide = "DISCOVER_MORE_TWEET", True
        elif post:
            focus = x["is_focused"]
            if focus:
                kind, hide = "FOCUSED_TWEET", False
            else:
                kind = kind_of(x)
                hide = prev if x["is_reply"] and prev is not None else kind in ("PROMOTED_TWEET", "UNAVAILABLE_QUOTE_TWEET", "UNAVAILABLE_RETWEET")
            if not hide and c.hide_grok and x["grok"]:
                hide = True
            if not hide and x["verified"] and not focus and not x["is_reply"] and (x["screen_name"] or "").lower() != op and x["screen_name"] != own:
                kind, u = x["verified"] + "_REPLY", users.get(x["screen_name"])
                if c.hide_premium_replies:
                    hide = not ((c.show_business and x["verified"] == "BUSINESS") or (c.show_government and x["verified"] == "GOVERNMENT") or bool(u and ((c.show_following and u[0]) or (c.show_followed_by and u[1]) or (c.show_followers and u[2] >= c.followers_at_least))))
        elif x["has_article"]:
            kind = "SHOW_MORE" if x["button"] == "Show" else "UNAVAILABLE"
            if x["button"] == "View" or (x["button"] is None and x["article_text"] == "This post is unavailable."):
                hide = c.hide_unavailable_quotes
        elif x["button"] == pages.SHOW_REPLIES:
            kind = "SHOW_MORE"
        else:
            if x["more_link"]:
                off = next((k for k in (2, 3, 4) if i - k >= 0 and out[i - k][0] == "HEADING"), None)
                if off:
                    kind, hide = "SEE_MORE", c.hide_more_from_author
                    for j in range(i - off, i):
                        pending[j] = c.hide_more_from_author or out[j][1] is True
            if kind is None and x["heading"]:
                kind = "HEADING"
                if x["heading_described"]:
                    kind, hide = "DISCOVER_MORE_HEADING", c.hide_more
                    sticky = c.hide_more
        if kind is None and prev is not None:
            kind, hide = "SUBSEQUENT_ITEM", prev
        if focus:
            pending = {}
        elif hide is not None and hide != x["cur_hidden"]:
            pending[i] = hide
        prev = hide
        out.append((kind, hide))
    final = pending
    return [(k, h, i in final and final[i] != items[i]["cur_hidden"]) for i, (k, h) in enumerate(out)]


@pytest.mark.parametrize("config", [timeline.FilterConfig(), timeline.FilterConfig(hide_more=False, hide_more_from_author=False, hide_premium_replies=True, show_followers=True, followers_at_least=50), timeline.FilterConfig(hide_grok=False, hide_unavailable_quotes=True, hide_premium_replies=True, show_business=False)])
def test_thread_equals_a_walk(spark, config):
    r = random.Random(11)
    timelines = [[item(r, t, p) for p in range(r.randrange(1, 14))] for t in range(150)]
    users = {"a": (True, False, 10), "b": (False, True, 60)}
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for t in timelines for x in t], pages.FEATURES)
    known = spark.createDataFrame([(k, *v) for k, v in users.items()], "screen_name string, following boolean, followed_by boolean, followers_count long")
    found = [(x.kind, x.hide, x.changed) for x in pages.thread(df, known, config, "op", "me").orderBy("timeline_id", "pos").collect()]
    assert found == [x for t in timelines for x in thread_walk(t, users, config, "op", "me")]


def main_walk(items, c, page):
    out, prev = [], None
    for x in items:
        kind = hide = None
        if x["is_post"]:
            kind = kind_of(x)
            if page == "list":
                policy = kind in ("UNAVAILABLE_QUOTE_TWEET", "UNAVAILABLE_RETWEET")
                hide = prev if x["is_reply"] and prev is not None else policy
                if not hide and c.hide_grok and x["grok"]:
                    hide = True
                if not hide and kind in ("QUOTE_TWEET", "RETWEETED_QUOTE_TWEET") and c.muted_quotes:
                    hide = (x["quoted_user"], x["quoted_time"]) in c.muted_quotes
        elif page == "notifications":
            kind = {"M4": "NOTIFICATION_RETWEET", "M1": "NOTIFICATION_AD"}.get((x["icon_path"] or "")[:2])
            hide = {"NOTIFICATION_RETWEET": c.hide_notification_retweets, "NOTIFICATION_AD": True}.get(kind)
        elif page == "search" and x["has_article"]:
            kind = "UNAVAILABLE"
        if page == "search" and kind:
            hide = kind in ("PROMOTED_TWEET",)
        if kind is None:
            if x["prompt"]:
                kind, hide = "INLINE_PROMPT", c.hide_inline_prompts or (c.hide_premium_upsells and x["upsell"])
            elif x["heading"]:
                kind, hide = "HEADING", c.hide_who_to_follow
        if kind is None and prev is not None and page != "notifications":
            kind, hide = "SUBSEQUENT_ITEM", prev
        out.append((kind, hide, hide is not None and hide != x["cur_hidden"]))
        prev = hide
    return out


@pytest.mark.parametrize("page", ["list", "search", "notifications"])
def test_main_timelines_equal_a_walk(spark, page):
    r = random.Random(12)
    config = timeline.FilterConfig(muted_quotes=(("u", "1"),), hide_inline_prompts=False)
    timelines = [[item(r, t, p) for p in range(r.randrange(1, 14))] for t in range(150)]
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for t in timelines for x in t], pages.FEATURES)
    found = [(x.kind, x.hide, x.changed) for x in pages.main_timeline(df, config, page).orderBy("timeline_id", "pos").collect()]
    assert found == [x for t in timelines for x in main_walk(t, config, page)]


def test_home_and_profile_run(spark):
    r = random.Random(13)
    df = spark.createDataFrame([tuple(item(r, 0, p)[n] for n in NAMES) for p in range(30)], pages.FEATURES)
    for page in ("home", "profile"):
        assert pages.main_timeline(df, timeline.FilterConfig(), page).count() == 30
    assert pages.timeline_options(spark).count() == len(timeline.TIMELINE_OPTIONS)
    assert [x[0] for x in spark.createDataFrame([("/login",), ("/home",)], "p string").select(pages.outside_app("p")).collect()] == [True, False]


def test_only_changed_timelines_are_decided_anew(spark):
    from tidewell.operators.refresh import refreshed

    r = random.Random(14)
    users = spark.createDataFrame([("u1", True, False, 5)], "screen_name string, following boolean, followed_by boolean, followers_count long")
    config, seen = timeline.FilterConfig(), []

    def decide(df):
        seen.append(sorted(x[0] for x in df.select("timeline_id").distinct().collect()))
        return pages.thread(df, users, config, "u1", "u2").select("timeline_id", "pos", "kind", "hide", "changed")

    frame = lambda ts: spark.createDataFrame([tuple(x[n] for n in NAMES) for t in ts for x in t], pages.FEATURES)
    told = lambda df: {(x.timeline_id, x.pos, x.kind, x.hide, x.changed) for x in df.collect()}
    now = [[item(r, t, p) for p in range(8)] for t in range(12)]
    state = refreshed(frame(now), decide)
    assert state.redone == 12 and told(state.decisions) == told(pages.thread(frame(now), users, config, "u1", "u2"))
    for late, gone, new in ((3, None, 20), (5, 7, None), (None, None, None)):
        held = told(state.decisions)
        now = [t for t in now if gone is None or t[0]["timeline_id"] != now[gone][0]["timeline_id"]]
        if late is not None:  # a heading comes late, and what follows it goes
            now[late] = [x | {"is_post": False, "has_article": False, "heading": True, "heading_described": True, "button": None} if x["pos"] == 1 else x for x in now[late]]
        if new:
            now.append([item(r, new, p) for p in range(8)])
        random.Random(15).shuffle(now)
        state = refreshed(frame(now), decide, state)
        assert state.redone == (late is not None) + bool(new) == len(seen[-1])
        whole = told(pages.thread(frame(now), users, config, "u1", "u2"))
        assert told(state.decisions) == whole
        assert told(state.changes.where("op = '-'")) == held - whole and told(state.changes.where("op = '+'")) == whole - held
