"""Connected components by large-star and small-star steps, without collecting any group or link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablado.io import cut, discard

MAX_ROUNDS = 60


def _counted(e: DataFrame) -> tuple[DataFrame, tuple]:
    """``e`` cut, with its size and a sum over its links, both taken while it is written."""
    seen = Observation()
    out = cut(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
    return out, (seen.get["n"], seen.get["s"])


def normal(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b, cut."""
    a, b = links.columns[:2]
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b"))
    return cut(e.distinct())


def components(links: DataFrame, *, is_normal: bool = False) -> DataFrame:
    """(node, root) for every node of ``links`` (two bigint columns) that is not its component's least node.

    Each round gives every node's larger neighbours the least node it knows, then every node's smaller ones;
    the number of rounds grows with the logarithm of a component's size, and the links left by a round that
    changes nothing are stars.  Minima are aggregated before they are joined back, so that a hot node's
    neighbours are never in one group, and adaptive joins split them.
    No links give no rows; self-links and NULLs are left out.  ``is_normal`` links come from ``normal``.
    """
    e, before = links if is_normal else normal(links), None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = e
        e, now = _counted(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
