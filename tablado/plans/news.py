"""News: recency, order, fuzzy duplicates, keyword noise, volume cap, text choice, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.operators import dedup, filters
from tablado.operators.rank import numbered
from tablado.sinks.export import envelope


def select_news(articles: DataFrame, now: Column, noise: list[str], *, span: str = "30 HOURS", least: float = 0.72, most: int = 130) -> DataFrame:
    """Articles (title, url, description, source, lang, rss_image, pub_date, ord) worth reading, the newest first.

    Undated ones are kept and come last.  Of like titles the newest stays.  ``ord`` becomes the place.
    """
    fresh = articles.where(filters.filled(F.col("title"), F.col("url")) & filters.not_older(F.col("pub_date"), now, span))
    placed = numbered(fresh.withColumnRenamed("ord", "__was"), [F.col("pub_date").desc_nulls_last(), F.col("__was")], "ord").drop("__was")
    unique = dedup.dedup_by_title(placed, "ord", "title", least)
    return unique.where(filters.without_keywords(F.col("title"), F.col("description"), noise)).orderBy("ord").limit(most)


def with_text(articles: DataFrame, content: DataFrame) -> DataFrame:
    """Articles with the text to summarise (of ``content`` by url, else their description); others are dropped."""
    joined = articles.join(content.select("url", "content"), "url", "left")
    return joined.withColumn("text", filters.enough_text(F.coalesce("content", F.lit("")), F.coalesce("description", F.lit("")))).where("text is not null").drop("content")


def export_news(articles: DataFrame, now: Column, most: int = 130) -> DataFrame:
    fields = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "url", "source", "lang", "description")}
    return envelope(articles, fields, [F.col("ord")], {"generated": now.cast("string")}, "articles", most)
