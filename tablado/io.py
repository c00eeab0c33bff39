"""Reading the parquet tables of a directory and cutting lineage safely."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of parquet tables (one file or one folder each)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors share, under ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) is a local temporary folder
    used, which is then set as the session's checkpoint folder as well; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="tablado-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tablado-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: short lineage that survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a table from ``cut`` that nothing reads any more."""
    if path := getattr(df, "_written_to", None):
        delete(df.sparkSession, path)


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of the cluster's storage that a path lies on."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there wholly or not at all: written beside its place and renamed."""
    fs, at = file_system(spark, path)
    _, beside = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, at):
        fs.delete(beside, False)
        raise FileExistsError(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
