"""Buckets, ranks and ordered limits.  Every order ends with a unique column, so that results are certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablado.io import cut


def lifecycle(start: Column, end: Column, first_seen: Column, now: Column, *, soon: int = 7, fresh: int = 8, started: int = 21) -> Column:
    """``ending_soon`` if it ends within ``soon`` days; ``new`` if first seen at most ``fresh`` whole days ago
    and not started more than ``started`` days ago; else ``ongoing``."""
    today = F.to_date(now)
    ends = end.between(today, F.date_add(today, soon))
    seen = F.floor((F.unix_timestamp(now) - F.unix_timestamp(first_seen)) / 86_400) <= fresh
    recent = start.isNull() | (start.cast("timestamp") >= now - F.expr(f"INTERVAL {started} DAYS"))
    return F.when(ends, "ending_soon").when(F.coalesce(seen, F.lit(False)) & recent, "new").otherwise("ongoing")


def top_per_bucket(df: DataFrame, bucket: str, orders: dict[str, tuple[list[Column], int]]) -> DataFrame:
    """The first rows of each bucket, each bucket with its own order and limit; ``place`` counts from 1.

    One ordered limit a bucket instead of a window: a bucket with most rows is never sorted in one task.
    """
    out = None
    for name, (order, most) in orders.items():
        top = df.where(F.col(bucket) == name).orderBy(*order).limit(most)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
        out = top if out is None else out.unionByName(top)
    return out


def limit_per_source(df: DataFrame, source: str, order: list[Column], most: Column | int) -> DataFrame:
    """The first rows of each source up to its limit (a column or a number)."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def carry_forward(df: DataFrame, page: str, pos: str, is_heading: Column, text: Column, out: str) -> DataFrame:
    """The text of the last heading at or before each row of a page."""
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_heading, text), ignorenulls=True).over(w))


def sections(df: DataFrame, page: str, pos: str, is_heading: Column, out: str = "section") -> DataFrame:
    """The number of headings up to each row: rows between two headings share it."""
    w = Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(is_heading, 1).otherwise(0)).over(w))


def text_until(parts: Column, stop: int, most: int) -> Column:
    """Parts joined with blanks until the text is longer than ``stop``, cut at ``most``."""
    joined = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(F.length(acc) > stop, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x)))
    return F.substring(joined, 1, most)


def numbered(df: DataFrame, order: list[Column], out: str = "n") -> DataFrame:
    """Rows with their place in the whole order, from 0.

    Sorted ranges number their rows by themselves; the ranges' sizes (one number a range) give the offsets,
    so that there is no global window.
    """
    ranged = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("c"))
    offsets = sizes.withColumn("__o", F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    joined = ranged.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return joined.withColumn(out, F.coalesce("__o", F.lit(0)) + inside).drop("__id", "__p", "__o", "c")


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``batch`` and the 1-based ``slot`` in it, for rows in order."""
    rows = numbered(df, order, "__n")
    return rows.withColumn("batch", F.floor(F.col("__n") / size)).withColumn("slot", (F.col("__n") % size + 1).cast("int")).drop("__n")
