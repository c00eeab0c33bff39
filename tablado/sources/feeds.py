"""Feeds, catalogs and JSON files as DataFrames.  A missing or broken file gives no rows, never a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_LINK = S.ArrayType(S.StructType([S.StructField("_VALUE", S.StringType()), S.StructField("_href", S.StringType()), S.StructField("_url", S.StringType()), S.StructField("_type", S.StringType())]))
#: What is read of an item or entry; absent parts are NULL.
ITEM = S.StructType(
    [
        S.StructField("title", S.StringType()), S.StructField("link", _LINK), S.StructField("pubDate", S.StringType()), S.StructField("published", S.StringType()), S.StructField("updated", S.StringType()),
        S.StructField("description", S.StringType()), S.StructField("summary", S.StringType()), S.StructField("content", S.StringType()), S.StructField("enclosure", _LINK),
        S.StructField("media:thumbnail", _LINK), S.StructField("media:content", _LINK),
    ]
)
ARTICLE = "title string, url string, description string, source string, lang string, rss_image string, pub_date string, ord bigint"


def read_feed(spark: SparkSession, path: str, source: str, lang: str) -> DataFrame:
    """The articles of saved RSS and Atom files of one source, newest form of each field first.

    A field counts by presence: an empty ``published`` hides ``updated``, and an empty thumbnail hides the
    other images, as feed readers do.
    """
    try:
        items = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(ITEM).load(path).unionByName(spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(ITEM).load(path))
    except Exception:  # no such path
        return spark.createDataFrame([], ARTICLE)
    present = lambda *cs: F.coalesce(*[F.col(f"`{c}`") for c in cs])
    first = lambda c: F.get(F.col(f"`{c}`"), F.lit(0))
    picture = F.get(F.filter("enclosure", lambda x: F.startswith(x["_type"], F.lit("image/"))), F.lit(0))["_url"]
    image = F.when(F.size("media:thumbnail") > 0, first("media:thumbnail")["_url"]).when(F.size("media:content") > 0, first("media:content")["_url"]).otherwise(picture)
    return items.select(
        F.trim("title").alias("title"), F.trim(F.coalesce(first("link")["_href"], first("link")["_VALUE"])).alias("url"), F.coalesce(present("summary", "description", "content"), F.lit("")).alias("description"),
        F.lit(source).alias("source"), F.lit(lang).alias("lang"), F.coalesce(image, F.lit("")).alias("rss_image"), present("pubDate", "published", "updated").alias("pub_date"), F.monotonically_increasing_id().alias("ord"),
    )


def read_feeds(spark: SparkSession, feeds: list[tuple[str, str, str]]) -> DataFrame:
    """All of (path, source, language) feeds; a broken one leaves the others untouched."""
    out = spark.createDataFrame([], ARTICLE)
    for path, source, lang in feeds:
        out = out.unionByName(read_feed(spark, path, source, lang))
    return out


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file (one value over many lines), without rows if it is missing."""
    reader = spark.read.option("multiLine", True)
    try:
        return (reader.schema(schema) if schema else reader).json(path)
    except Exception:
        return spark.createDataFrame([], schema or "value string")


CATALOG = "name string, url string, fetch_type string, link_selector string, max_links int, selectors map<string,string>"


def read_catalog(spark: SparkSession, path: str, most_links: int = 100) -> DataFrame:
    """A YAML list of sources with defaults filled in and their order kept as ``ord``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    rows = [(s.get("name"), s.get("url"), s.get("type", "static"), s.get("link_selector"), int(s.get("max_links") or most_links), {k: str(v) for k, v in (s.get("selectors") or {}).items()}, i) for i, s in enumerate(data.get("sources", data) if isinstance(data, dict) else data)]
    return spark.createDataFrame(rows, CATALOG + ", ord int")
