"""Concerts: union of sources, window, duplicates within days, home city, titles, genre tiers, order, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.functions import text as T
from tablado.functions.dates import card_date_es
from tablado.operators import dedup, filters
from tablado.sinks.export import export_lines

DEFAULTS = {"venue": "", "address": "", "price": "", "buy_link": "", "source": "", "notes": "", "image_url": "", "genre": ""}


def make(rows: DataFrame) -> DataFrame:
    """Concert rows with every field: defaults for missing ones, the artist as line-up where there is none."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in DEFAULTS.items()}
    out = rows.withColumns({**filled, "_artist_raw": F.col("artist")})
    lineup = F.coalesce(F.nullif(F.col("lineup"), F.lit("")), F.col("artist")) if "lineup" in rows.columns else F.col("artist")
    return out.withColumns({"lineup": lineup, "venue": T.strip_closing_date(F.col("venue")), "date_str": card_date_es(F.col("date_obj"))})


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources' rows, columns that a source lacks left NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def select_concerts(rows: DataFrame, today: Column, cities: list[str], home: str, *, days: int = 56, order: str = "ord") -> DataFrame:
    """Concerts in the window, one row each.  The home-city test comes after duplicates are merged, so that a
    representative elsewhere takes its group with it."""
    coming = rows.where(filters.within_days(F.col("date_obj"), today, days)).withColumn("__name", T.headliner(F.coalesce("artist", F.lit("")), cities))
    generic = F.lower(F.coalesce("venue", F.lit(""))).isin("", home)
    better = F.array(~generic, F.coalesce("buy_link", F.lit("")) != "")
    unique = dedup.dedup_in_band(coming, order, "__name", "date_obj", better)
    return unique.where(filters.not_in_cities(F.col("venue"), F.coalesce("_artist_raw", "artist"), cities, home)).drop("__name")


def finish(rows: DataFrame, tiers: list[tuple[int, list[str]]]) -> DataFrame:
    """Artists and line-ups in title case, and the tier of the genre."""
    return rows.withColumns({"artist": T.title_case(F.col("artist")), "lineup": T.title_case(F.col("lineup")), "taste_score": T.tiered(F.coalesce("genre", F.lit("")), tiers)})


def export_concerts(rows: DataFrame, now: Column, today: Column, days: int = 56, order: str = "ord") -> DataFrame:
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("artist", "lineup", "date_str", "venue", "address", "price", "buy_link", "genre", "notes", "image_url")} | {"date_iso": F.coalesce(F.col("date_obj").cast("string"), F.lit("")), "taste_score": F.col("taste_score")}
    extra = {"generated": now.cast("string"), "from_date": today.cast("string"), "to_date": F.date_add(today, days).cast("string")}
    return export_lines(rows.withColumn("__all", F.lit("concerts")), "__all", fields, [-F.col("taste_score"), F.col("date_obj"), F.col(order)], extra).withColumnRenamed("__all", "part")
