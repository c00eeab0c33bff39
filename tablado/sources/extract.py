"""Rows out of page blocks, in the five shapes that listings take.

All work on exploded blocks (page, pos, tag, text, href) and are windows over one page: carry the last heading
forward, read what follows a heading, read tables by their header, and read cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.functions import html as H
from tablado.functions.dates import event_date
from tablado.operators.rank import carry_forward, sections


def page_blocks(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, pos, tag, text, href, attrs), one row a block."""
    return pages.select(F.col(page).alias("page"), F.explode(H.blocks(F.col(html))).alias("b")).select("page", "b.pos", "b.tag", "b.text", "b.href", "b.attrs")


def shouted(c: Column) -> Column:
    """A heading in capitals: letters, and none of them small."""
    return c.rlike(r"\p{Lu}") & (F.upper(c) == c)


def under_heading(blocks: DataFrame, heading: Column, item: Column) -> DataFrame:
    """(page, pos, heading, text, href): items with the last heading before them."""
    carried = carry_forward(blocks, "page", "pos", heading, F.col("text"), "heading")
    return carried.where(item & F.col("heading").isNotNull()).select("page", "pos", "heading", "text", "href")


def heading_sections(blocks: DataFrame, heading: Column, part: Column, most_parts: int = 6) -> DataFrame:
    """(page, section, heading, parts): each heading with the first parts up to the next heading."""
    numbered = sections(blocks, "page", "pos", heading)
    heads = numbered.where(heading).select("page", "section", F.col("text").alias("heading"))
    parts = numbered.where(part & ~heading).groupBy("page", "section").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), 1, most_parts).alias("parts"))
    return heads.join(parts, ["page", "section"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))


def table_rows(blocks: DataFrame) -> DataFrame:
    """(page, row, cells): tables as maps from folded header text to cell text; rows keep their order."""
    numbered = sections(blocks.where(F.col("tag").isin("tr", "th", "td")), "page", "pos", F.col("tag") == "tr", "row")
    lists = numbered.where("tag <> 'tr'").groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "text"))).alias("c"))
    texts = F.transform("c", lambda x: x["text"])
    heads = lists.where(F.forall("c", lambda x: x["tag"] == "th")).groupBy("page").agg(F.min_by(F.transform(texts, lambda t: F.lower(F.trim(t))), "row").alias("names"))
    body = lists.where(F.exists("c", lambda x: x["tag"] == "td")).select("page", "row", texts.alias("texts"))
    n = F.least(F.size("names"), F.size("texts"))
    return body.join(heads, "page").select("page", "row", F.map_from_arrays(F.array_distinct(F.slice("names", 1, n)), F.slice("texts", 1, F.size(F.array_distinct(F.slice("names", 1, n))))).alias("cells"))


def preferred_link(links: Column, hosts: list[str]) -> Column:
    """The first link to one of the hosts, else the first link at all."""
    listed = F.filter(links, lambda x: F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(x["href"], h)))
    return F.coalesce(F.get(listed, F.lit(0))["href"], F.get(links, F.lit(0))["href"])


def cards(blocks: DataFrame, card: Column, title: Column) -> DataFrame:
    """(page, card, title, time, text, links): one row a card, a card being a block for which ``card`` holds
    with all blocks up to the next one.

    ``time`` is the machine-readable time of the first time element, else NULL, so that it can go before a
    reading of the text.  Cards without a title keep NULL.
    """
    numbered = sections(blocks, "page", "pos", card, "card").where("card > 0")
    in_order = lambda what, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", what.alias("v"))))), lambda x: x["v"])
    grouped = numbered.groupBy("page", "card").agg(
        F.min_by(F.when(title, F.col("text")), F.when(title, F.col("pos"))).alias("title"),
        F.get(in_order(F.col("attrs")["datetime"], F.col("tag") == "time"), F.lit(0)).alias("time"),
        F.array_join(in_order(F.col("text"), F.col("tag").isin("h2", "h3", "p", "li", "time")), " ").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("href").isNotNull(), F.struct("pos", "text", "href")))).alias("links"),
    )
    return grouped


def first_day(candidates: list[Column], today: Column) -> Column:
    """The first of several texts that holds a real day, read in order."""
    return F.coalesce(*[event_date(c, today) for c in candidates])
