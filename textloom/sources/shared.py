"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, as in tests, a folder of our own in local mode; on a cluster that would be another folder on
    each machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_from_task(path: str, data: bytes) -> None:
    """A file of a task's: under another name first, so readers see all of it or nothing, and an attempt that is made again replaces it.

    Tasks have no JVM at hand, so this goes through Arrow's file systems: a path of the machine or of a mount, or a URI of a store that Arrow knows
    (Hadoop's names for S3 are understood).
    """
    uri = re.sub("^s3[an]:", "s3:", path)
    files, at = fs.FileSystem.from_uri("file://" + re.sub("^file:/*", "/", uri) if re.match("(file:)?/", uri) else uri)
    part = f"{at}.{uuid.uuid4().hex}"
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, at)
