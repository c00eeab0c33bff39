"""Pages over HTTP or from a table, and the two-hop crawl from listing pages to the pages they link to.

``HttpPages`` is a Python data source (format ``pages``): option ``urls`` holds one address a line, partitions
hold ``per_task`` addresses each, and a page that cannot be read gives a row with its error.  Everything
after the fetch is native and works as well on a stored table of pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablado.functions import html as H
from tablado.functions import text as T
from tablado.operators.rank import limit_per_source


def decode_page(body: bytes, declared: str | None) -> str:
    """Bytes as text: the declared charset, unless it is missing or Latin-1, when UTF-8 is tried first."""
    if declared and declared.lower().replace("_", "-") not in ("iso-8859-1", "latin-1", "latin1"):
        try:
            return body.decode(declared, "replace")
        except LookupError:
            pass
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


class _Addresses(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in (options.get("urls") or "").split("\n") if u.strip()]
        self.per_task, self.timeout, self.agent = int(options.get("per_task", 50)), float(options.get("timeout", 25)), options.get("agent", "Mozilla/5.0")

    def partitions(self) -> list[InputPartition]:
        return [_Addresses(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        from urllib.request import Request, urlopen

        for u in partition.urls:
            try:
                with urlopen(Request(u, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:  # noqa: S310
                    charset = re.search(r"charset=([\w-]+)", r.headers.get("Content-Type", ""))
                    yield (u, decode_page(r.read(), charset.group(1) if charset else None), None)
            except Exception as e:
                yield (u, "", f"{type(e).__name__}: {e}"[:300])


class HttpPages(DataSource):
    """``spark.dataSource.register(HttpPages)``, then ``spark.read.format("pages").option("urls", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def first_readable(candidates: Column, least: int = 2000) -> Column:
    """The first of several fetched texts that is longer than ``least``, else ''."""
    return F.coalesce(F.get(F.filter(candidates, lambda x: F.length(x) > least), F.lit(0)), F.lit(""))


def failed(pages: DataFrame) -> DataFrame:
    """(url, error) of the pages that could not be read."""
    return pages.where("error is not null").select("url", "error")


def crawl_links(listing: DataFrame, default_most: int = 100) -> DataFrame:
    """(source, ord, url): the links to follow of listing pages (source, ord, page_url, html, max_links).

    Links are resolved and made distinct with the first one kept; links to the page itself are dropped; a
    link that an earlier source has is not followed again; each source has at most its ``max_links``.
    """
    found = listing.select("source", "ord", "page_url", "max_links", F.posexplode(H.links(H.blocks(F.col("html")))).alias("at", "a"))
    url = F.regexp_replace(T.absolute_url(F.col("a.href"), F.col("page_url")), "#.*$", "")
    rows = found.select("source", "ord", "page_url", "max_links", "at", url.alias("url")).where("url <> page_url and url rlike '^https?://'")
    first = rows.groupBy("url").agg(F.min(F.struct("ord", "at", "source", "max_links")).alias("f")).select("f.source", "f.ord", "f.at", "f.max_links", "url")
    return limit_per_source(first, "source", [F.col("at")], F.coalesce("max_links", F.lit(default_most))).select("source", "ord", "url")


def single_or_many(events: DataFrame, page: str = "url") -> DataFrame:
    """Events of pages read as many (``many`` true) if there is more than one, else the page read as one."""
    counts = events.where("many").groupBy(page).agg(F.count("*").alias("__n")).where("__n > 1").select(page)
    return events.where("many").join(counts, page, "left_semi").unionByName(events.where("not many").join(counts, page, "left_anti"))
