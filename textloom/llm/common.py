"""Tables, shared scratch space and id helpers for the operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from textloom.sources.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, read by Spark alone, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, narrow: bool = False, files: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again: cuts the lineage and survives lost executors.

    ``narrow`` is for tables of small rows that come out of a shuffle: eight of its partitions share a file; ``files`` says how many there
    are at most, where the number of rows is known.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(files or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's default, if the session still has that: rows are whole texts here, and a batch is in memory several
    times, in the JVM and in Python.  Queries and stages ask for it; operators leave the caller's session as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)


def by_task(frames: Iterator[pd.DataFrame], marks: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each task, which stand together and are told by their marks, whole numbers; memory holds one task and one batch."""
    rest = None
    for frame in chain(frames, [None]):
        if frame is not None:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if rest is None or not len(rest):
            continue
        mark = rest[marks].to_numpy(np.int64)
        at = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1).tolist(), len(rest)]
        done = len(at) - 1 if frame is None else len(at) - 2
        for a, b in zip(at[:done], at[1:]):
            yield rest.iloc[a:b]
        rest = rest.iloc[at[done] :].reset_index(drop=True)
