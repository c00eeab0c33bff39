"""Keyed history of listings: look-up in tiers, new or ongoing, filling from history, upsert with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.functions.similarity import indel_text
from tablado.operators.dedup import keep_first, similar_pairs


def match_history(df: DataFrame, history: DataFrame, order: str, key: str, url: str, title: str | None = None, *, hist_order: str = "hist_ord", least: float = 90.0, held_from: int = 10) -> DataFrame:
    """(order, hist_order, tier): the first history row that a row matches by key (1), else by page (2), else
    by a like title (3; only with ``title``).  Within a tier the earliest history row counts.

    NULL and '' keys and pages match nothing.  Every tier is an equi-join of what the tiers before left over.
    """
    h = lambda c: history.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("v")).agg(F.min(hist_order).alias(hist_order))
    rows = df.select(order, key, url, *([title] if title else []))
    by_key = rows.join(h(key), F.col(key) == F.col("v")).select(order, hist_order, F.lit(1).alias("tier"))
    rest = rows.join(by_key.select(order), order, "left_anti")
    by_url = rest.join(h(url), F.col(url) == F.col("v")).select(order, hist_order, F.lit(2).alias("tier"))
    out = by_key.unionByName(by_url)
    if title:

        def alike(a: str, b: str) -> bool:
            return indel_text(a, b) >= least or (len(a) > held_from and len(b) > held_from and (a in b or b in a))

        # Both sides in one key space: history rows get keys below zero, so that rows are always the later ones.
        low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
        left = rest.join(by_url.select(order), order, "left_anti").select(F.col(order).cast("bigint").alias("k"), low(title).alias("t"))
        past = history.select((-F.col(hist_order) - 1).cast("bigint").alias("k"), low(title).alias("t"))
        pairs = similar_pairs(left.unionByName(past), "k", "t", alike, least / 100, contained_from=held_from, later="k >= 0", earlier="k < 0").where("later >= 0 and earlier < 0")
        near = pairs.groupBy(F.col("later").alias(order)).agg((-F.max("earlier") - 1).alias(hist_order))
        out = out.unionByName(near.select(order, hist_order, F.lit(3).alias("tier")))
    return out


def with_status(df: DataFrame, history: DataFrame, matches: DataFrame, order: str, *, hist_order: str = "hist_ord", seen: str = "_extracted_at", fill: list[str] | None = None) -> DataFrame:
    """``df`` with is_new, status and first_seen, and the ``fill`` columns taken from history where missing."""
    fill = fill or []
    past = history.select(hist_order, F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("_first_seen", seen) if c in history.columns]).alias("__first"), *[F.col(c).alias(f"__{c}") for c in fill])
    out = df.join(matches.select(order, hist_order), order, "left").join(past, hist_order, "left")
    known = F.col(hist_order).isNotNull()
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in fill}
    out = out.withColumns({"is_new": ~known, "status": F.when(known, "ongoing").otherwise("new"), "first_seen": F.coalesce("__first", seen), **filled})
    return out.drop("__first", hist_order, *[f"__{c}" for c in fill])


def upsert(history: DataFrame, batch: DataFrame, key: str, at: Column, now: Column, keep_days: int = 180) -> DataFrame:
    """History with the batch's rows in place of those of the same key, without rows last seen more than
    ``keep_days`` before ``now``.  Rows without a readable time are kept; rows without a key are not stored.
    Of several batch rows of a key the last (by time) is stored."""
    both = history.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True).where(F.coalesce(F.col(key), F.lit("")) != "")
    both = both.withColumn("__at", at)
    last = keep_first(both, [F.col(key)], [-F.col("__new"), -F.coalesce(F.unix_micros(F.col("__at").cast("timestamp")), F.lit(0).cast("bigint")), F.hash(*[F.col(c) for c in history.columns])])
    return last.where(F.col("__at").isNull() | (F.col("__at") >= now - F.expr(f"INTERVAL {keep_days} DAYS"))).drop("__new", "__at")
