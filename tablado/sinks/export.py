"""Exports: JSON envelopes, monthly snapshots, and pages of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(df: DataFrame, fields: dict[str, Column], order: list[Column], extra: dict[str, Column], name: str, most: int) -> DataFrame:
    """One row ``json``: an object with the extra values and the array ``name`` of the first ``most`` rows in order.

    The size of the array is a limit of the export's format, so that the object is of bounded size.
    """
    top = df.orderBy(*order).limit(most)
    rows = top.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*[c.alias(n) for n, c in fields.items()]).alias("v"))
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("o", "v"))).alias("all"))
    return listed.select(F.to_json(F.struct(*[c.alias(n) for n, c in extra.items()], F.size("all").alias("count"), F.transform("all", lambda x: x["v"]).alias(name))).alias("json"))


def export_lines(df: DataFrame, part: str, fields: dict[str, Column], order: list[Column], extra: dict[str, Column]) -> DataFrame:
    """(part, place, json): every row of a part as a JSON line in order, behind a head (place 0) with the extra
    values and the count.  Parts may be of any size: places are counted over sorted partitions.  Parts without
    rows have no head.
    """
    from tablado.operators.rank import numbered

    cols = {f"__o{i}": o for i, o in enumerate(order)} | {"__json": F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))}
    rows = numbered(df.withColumns(cols).select(part, *cols), [F.col(part), *[F.col(f"__o{i}") for i in range(len(order))]], "__n")
    heads = rows.groupBy(part).agg(F.min("__n").alias("__first"), F.count("*").alias("count"))
    items = rows.join(F.broadcast(heads), part).select(part, (F.col("__n") - F.col("__first") + 1).alias("place"), F.col("__json").alias("json"))
    head = heads.select(part, F.lit(0).cast("bigint").alias("place"), F.to_json(F.struct(*[c.alias(n) for n, c in extra.items()], "count")).alias("json"))
    return head.unionByName(items)


def write_json(envelope_row: DataFrame, path: str) -> None:
    """The envelope as one text file in a folder."""
    envelope_row.coalesce(1).write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, path: str, month: Column) -> None:
    """A snapshot a month: only the partitions that the rows belong to are replaced."""
    out = df.withColumn("month", month)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def escape(c: Column) -> Column:
    """Text for use inside HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cards(df: DataFrame, title: Column, lines: list[Column], out: str = "card") -> DataFrame:
    """A small HTML card a row, every value escaped."""
    body = F.concat(*[F.concat(F.lit("<p>"), escape(F.coalesce(c, F.lit(""))), F.lit("</p>")) for c in lines])
    return df.withColumn(out, F.concat(F.lit("<article><h3>"), escape(F.coalesce(title, F.lit(""))), F.lit("</h3>"), body, F.lit("</article>")))
