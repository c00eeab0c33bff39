"""Listings as a stream: keyed history with expiry, and an upsert of each micro-batch into a stored history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tablado.io import shared_dir
from tablado.operators.history import upsert

SIGHTING = "id string, first_seen timestamp, last_seen timestamp, times bigint, is_new boolean"


class Sightings(StatefulProcessor):
    """For each key the first and last sighting and their number; state expires ``ttl_ms`` after the last one."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "first timestamp, last timestamp, times long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = [t for pdf in rows for t in pdf["at"]]
        old = self.state.get() if self.state.exists() else None
        first = min([*at, old[0]] if old else at)
        last = max([*at, old[1]] if old else at)
        times = len(at) + (old[2] if old else 0)
        self.state.update((first, last, times))
        yield pd.DataFrame({"id": [key[0]], "first_seen": [first], "last_seen": [last], "times": [times], "is_new": [old is None]})

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, key: str, at: Column, lateness: str = "30 hours", ttl_days: int = 180) -> DataFrame:
    """A row for each key of each micro-batch: when it was first and last seen, how often, and whether it is new.

    Rows later than ``lateness`` are dropped by the watermark.  Rows without a key or time are left out.
    """
    rows = stream.select(F.col(key).cast("string").alias("id"), at.cast("timestamp").alias("at")).where("id is not null and at is not null").withWatermark("at", lateness)
    return rows.groupBy("id").transformWithStateInPandas(Sightings(ttl_days * 86_400_000), SIGHTING, "Update", "ProcessingTime")


def upsert_stream(stream: DataFrame, path: str, key: str, at: Column, now: Column, keep_days: int = 180) -> DataStreamWriter:
    """A writer that merges each micro-batch into the parquet history under ``path``.

    A batch writes the next version beside the last one and then its number, so that a reader or a retried
    batch never sees half of one.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
        fs = versions.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = spark.read.text(f"{path}/current").first()[0] if fs.exists(versions) else None
        if old is not None and old == f"v{batch_id}":
            return
        history = spark.read.parquet(f"{path}/{old}") if old else batch.limit(0)
        upsert(history, batch, key, at, now, keep_days).write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        spark.createDataFrame([(f"v{batch_id}",)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/current")

    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{shared_dir(spark)}/checkpoint").outputMode("append")


def windowed_counts(stream: DataFrame, at: Column, key: Column, width: str = "1 day", lateness: str = "30 hours") -> DataFrame:
    """Rows of each key and event-time window, late ones within ``lateness`` counted."""
    rows = stream.select(at.cast("timestamp").alias("at"), key.alias("key")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", width), "key").agg(F.count("*").alias("n")).select("window.start", "window.end", "key", "n")
