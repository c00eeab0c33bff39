"""Enrichment from look-ups and pluggable providers, stage by stage: a provider sees only rows that still lack a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[DataFrame], DataFrame]  # distinct keys (one column) -> (key, value)


def fill_missing(df: DataFrame, other: DataFrame, on: str, fields: list[str], missing: dict[str, list[str]] | None = None) -> DataFrame:
    """Fields of ``df`` that are NULL, '' or a stated placeholder, taken from ``other`` where it has them."""
    missing = missing or {}
    extra = other.select(on, *[F.col(f).alias(f"__{f}") for f in fields])
    out = df.join(extra, on, "left")
    for f in fields:
        lacking = F.coalesce(F.col(f), F.lit("")).isin("", *missing.get(f, []))
        out = out.withColumn(f, F.when(lacking, F.coalesce(F.nullif(F.col(f"__{f}"), F.lit("")), F.col(f))).otherwise(F.col(f)))
    return out.drop(*[f"__{f}" for f in fields])


def cascade(df: DataFrame, key: str, providers: list[tuple[str, Provider]], out: str, default: Column, accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """The first accepted answer of the providers for each key, with its provenance in ``<out>_from``.

    Each key is asked for once, and later providers are asked only for keys without an answer.
    """
    accept = accept or (lambda c: F.coalesce(c, F.lit("")) != "")
    left = df.select(key).where(F.col(key).isNotNull()).distinct()
    found = None
    for name, ask in providers:
        got = ask(left).toDF(key, out).where(accept(F.col(out))).withColumn(f"{out}_from", F.lit(name))
        got = got.groupBy(key).agg(F.min_by(F.struct(out, f"{out}_from"), F.col(out)).alias("g")).select(key, f"g.{out}", f"g.{out}_from")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    joined = df.join(found, key, "left") if found is not None else df.withColumns({out: F.lit(None).cast("string"), f"{out}_from": F.lit(None).cast("string")})
    return joined.withColumns({out: F.coalesce(out, default), f"{out}_from": F.coalesce(f"{out}_from", F.lit("default"))})


def align_batches(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers joined to what was asked by (batch, slot).

    An answer's own ``index`` counts if the batch's answers have exactly the indices 1 to their number, and
    the batch was answered in full; else answers of full batches count by their position, others not at all.
    """
    sizes = asked.groupBy("batch").agg(F.count("*").alias("asked"))
    shape = answers.groupBy("batch").agg(F.count("*").alias("got"), F.countDistinct(F.when(F.col("index").between(1, 1_000_000), F.col("index"))).alias("different"), F.max("index").alias("top"))
    how = sizes.join(shape, "batch").where("got = asked").select("batch", ((F.col("different") == F.col("asked")) & (F.col("top") == F.col("asked"))).alias("by_index"))
    placed = answers.join(how, "batch").withColumn("slot", F.when(F.col("by_index"), F.col("index")).otherwise(F.col("position"))).select("batch", "slot", "answer")
    return asked.join(placed, ["batch", "slot"], "left")


def best_candidate(df: DataFrame, key: str, likeness: Column, position: str, value: str, least: float, most: int = 5) -> DataFrame:
    """(key, value): of the first ``most`` candidates of a key the likest, the earliest among equals, if it is at
    least ``least`` alike."""
    rows = df.where(F.col(position) < most).withColumn("__l", likeness).where(F.col("__l") >= least)
    return rows.groupBy(key).agg(F.max_by(value, F.struct(F.col("__l"), -F.col(position))).alias(value))
