"""HTML without a browser: one Arrow-batched pass turns a page into ordered blocks, the rest is native.

A page becomes an array of structs (pos, tag, text, href, attrs) in document order; boilerplate containers
(script, style, nav, header, footer, aside, form) are left out of text.  Unclosed and misnested tags are
tolerated as the standard parser does.  NULL and empty pages give an empty array.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<pos:int,tag:string,text:string,href:string,attrs:map<string,string>>>"
_DROPPED = {"script", "style", "nav", "header", "footer", "aside", "form"}
_TAGS = {"title", "h1", "h2", "h3", "h4", "p", "li", "a", "td", "th", "tr", "time", "article", "main"}
_VOID = {"meta", "img", "link", "input", "br", "hr"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.open: list[dict] = []
        self.dropped = 0
        self.script: dict | None = None

    def _add(self, tag: str, attrs: list) -> dict:
        x = {"pos": len(self.out), "tag": tag, "text": "", "href": dict(attrs).get("href"), "attrs": {k: v or "" for k, v in attrs}}
        self.out.append(x)
        return x

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.script = self._add("ld+json", attrs)
        if tag in _DROPPED:
            self.dropped += 1
        elif not self.dropped or tag in ("meta",):
            if tag in _VOID:
                if tag in ("meta", "img"):
                    self._add(tag, attrs)
            elif tag in _TAGS:
                # A paragraph or list item that opens again was never closed.
                if tag in ("p", "li", "td", "th", "tr"):
                    self.open = [x for x in self.open if x["tag"] != tag]
                self.open.append(self._add(tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
            self.script = None if tag == "script" else self.script
            return
        # The end of a container ends what was left open inside it.
        inside = {"ul": ("li",), "ol": ("li",), "tr": ("td", "th"), "table": ("td", "th", "tr"), "div": ("p",), "section": ("p", "li"), "article": ("p", "li"), "main": ("p", "li"), "body": ("p", "li")}.get(tag, ())
        self.open = [x for x in self.open if x["tag"] not in inside]
        if any(x["tag"] == tag for x in self.open):
            while self.open and self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script["text"] += data
        elif not self.dropped:
            for x in self.open:
                x["text"] += data


def parse_blocks(page: str | None) -> list[dict]:
    if not page:
        return []
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    for x in parser.out:
        x["text"] = x["text"].strip() if x["tag"] == "ld+json" else " ".join(x["text"].split())
    return parser.out


def blocks(page: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(parse_blocks), BLOCKS)(page)


def _first(b: Column, keep) -> Column:
    return F.get(F.filter(b, keep), F.lit(0))


def page_title(b: Column) -> Column:
    return _first(b, lambda x: x["tag"] == "title")["text"]


def social_image(b: Column) -> Column:
    """The og:image of a page, NULL if it has none."""
    return F.nullif(_first(b, lambda x: (x["tag"] == "meta") & (x["attrs"]["property"] == "og:image"))["attrs"]["content"], F.lit(""))


def links(b: Column) -> Column:
    """(pos, text, href) of every link in document order."""
    return F.transform(F.filter(b, lambda x: (x["tag"] == "a") & x["href"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), x["href"].alias("href")))


def article_text(b: Column, least: int = 70, most_parts: int = 25, most: int = 4000) -> Column:
    """The paragraphs of more than ``least`` letters that are no notice, joined and cut at the stated sizes."""
    said = F.filter(b, lambda x: (x["tag"] == "p") & (F.length(x["text"]) > least) & ~x["text"].rlike(r"(?i)cookie|newsletter|suscr|subscribe|©|\bshare\b"))
    return F.substring(F.array_join(F.slice(F.transform(said, lambda x: x["text"]), 1, most_parts), " "), 1, most)


def structured_dates(b: Column) -> Column:
    """struct(start, end): ISO text from JSON-LD, else meta fields, else the first and last time elements."""
    data = F.filter(b, lambda x: x["tag"] == "ld+json")
    field = lambda name: F.coalesce(*[F.get_json_object(F.get(data, F.lit(0))["text"], p + name) for p in ("$.", "$[0].")])
    meta = lambda *names: _first(b, lambda x: (x["tag"] == "meta") & (x["attrs"]["property"].isin(*names) | x["attrs"]["itemprop"].isin(*names) | x["attrs"]["name"].isin(*names)))["attrs"]["content"]
    times = F.filter(b, lambda x: (x["tag"] == "time") & x["attrs"]["datetime"].isNotNull())
    last = F.when(F.size(times) > 1, F.element_at(times, -1)["attrs"]["datetime"])
    start, end = F.coalesce(field("startDate"), field("datePublished"), field("dateCreated")), field("endDate")
    m0, m1 = meta("event:start_time", "startDate"), meta("event:end_time", "endDate")
    return (
        F.when(start.isNotNull() | end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
        .when(m0.isNotNull() | m1.isNotNull(), F.struct(m0.alias("start"), m1.alias("end")))
        .otherwise(F.struct(F.get(times, F.lit(0))["attrs"]["datetime"].alias("start"), last.alias("end")))
    )
