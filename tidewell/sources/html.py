"""Posts and trends out of web pages, by Python's HTML parser on Arrow batches: scripts hold text that looks like markup, so patterns won't do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BREAKS = {"br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, alt: bool = False) -> str:
        """The text inside, with line breaks where blocks end; alt: images count as their alternative text."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                if alt and x.tag == "img":
                    out.append(x.attrs.get("alt", ""))
                elif x.tag == "br":
                    out.append("\n")
                stack += reversed([*x.children, *(["\n"] if x.tag in _BREAKS and x.children else [])])
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


# Links to posts, keys of images, and the application's own hosts.
_STATUS = re.compile(r"/([^/]+)/status/(\d+)")
_MEDIA = re.compile(r"/media/([A-Za-z0-9_-]+)")
_OWN = re.compile(r"^https?://(x|twitter)\.com")


def post_of(article: Node) -> dict | None:
    """The fields of a post; None without a dated link to itself."""
    nodes = list(article.walk())
    links = [n for n in nodes if n.tag == "a"]
    own = next(((a, t, m) for a in links if (m := _STATUS.search(a.attrs.get("href", ""))) for t in a.walk() if t.tag == "time"), None)
    if not own:
        return None
    _, time, m = own
    inner = [a for n in nodes if n.attrs.get("role") == "link" and n.tag == "div" for a in n.walk() if a.tag == "a"]
    quoted = (q.group(2) for a in inner if (q := _STATUS.search(a.attrs.get("href", ""))) and q.group(2) != m.group(2))
    body = next((n for n in nodes if n.attrs.get("data-testid") == "tweetText"), None)
    card = next((n for n in nodes if n.attrs.get("data-testid") == "card.wrapper"), None)
    target = card and (card if card.tag == "a" else next((n for n in card.walk() if n.tag == "a"), None))
    urls = [target.attrs["href"]] if target and target.attrs.get("href") else []
    urls += [h for a in links if (h := a.attrs.get("href", "")).startswith("http") and not _OWN.match(h)]
    images = [m2.group(1) for n in nodes if n.tag == "img" and (m2 := _MEDIA.search(n.attrs.get("src", "")))]
    return {
        "status_id": m.group(2), "author_id": m.group(1), "text": body.text().strip("\n") if body else "", "ts": time.attrs.get("datetime"), "quoted_id": next(quoted, None),
        "urls": list(dict.fromkeys(urls)), "media_keys": list(dict.fromkeys(images)), "is_repost": any(n.attrs.get("data-testid") == "socialContext" for n in nodes), "has_card": target is not None,
    }


EXTRACTED = "page_id bigint, status_id string, author_id string, text string, ts string, quoted_id string, urls array<string>, media_keys array<string>, is_repost boolean, has_card boolean"


def posts_in(pages: DataFrame) -> DataFrame:
    """EXTRACTED: the posts in pages (page_id, html). An article that can't be read loses itself only."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b.page_id, b.html, strict=True):
                for article in (n for n in parse(html).walk() if n.tag == "article"):
                    try:
                        found = post_of(article)
                    except (KeyError, AttributeError, ValueError):
                        continue
                    if found:
                        rows.append({"page_id": page} | found)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")])

    return pages.select("page_id", "html").mapInPandas(extract, EXTRACTED)


def outlines(pages: DataFrame) -> DataFrame:
    """page_id, n_articles, n_links and text_length of pages: what any page shows, whoever wrote it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b.page_id, b.html, strict=True):
                nodes = list(parse(html).walk())
                rows.append((page, sum(n.tag == "article" for n in nodes), sum(n.tag == "a" and "href" in n.attrs for n in nodes), len(nodes[0].text())))
            yield pd.DataFrame(rows, columns=["page_id", "n_articles", "n_links", "text_length"])

    return pages.select("page_id", "html").mapInPandas(count, "page_id bigint, n_articles bigint, n_links bigint, text_length bigint")


def quoted_text(html: str) -> str:
    """A quoted post's text, with the alternative texts of its images where they stand."""
    return parse(html).text(alt=True).strip("\n")


def quoted_texts(rows: DataFrame, key: str) -> DataFrame:
    """key (a long) and quoted, the quoted_text() of each of rows (key, html)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "quoted": [quoted_text(h) for h in b.html]})

    return rows.select(key, "html").mapInPandas(read, f"{key} bigint, quoted string")


def trend_of(cell: str | Column) -> Column:
    """The name in the text of a trend's cell; null for an advertisement or if no line is one."""
    # fixed values: what lines of a cell that are no name look like
    lines = F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_ad = F.exists(lines, lambda x: F.regexp_like(x, F.lit("(?i)Promoted by")))

    def is_name(x: Column) -> Column:
        return ~F.regexp_like(x, F.lit(r"^\d+$")) & (x != "·") & ~F.regexp_like(x, F.lit("(?i)Trending|Promoted|LIVE")) & ~F.regexp_like(x, F.lit(r"^\d[\d.,]*\s*(K|M)?\s+(posts|Posts|tweets)")) & F.length(x).between(2, 59)

    return F.when(~is_ad, F.get(F.filter(lines, is_name), 0))
