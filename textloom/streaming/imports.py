"""Streams: kit entries upserted into a state table batch by batch, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.kit import upsert_records


BUCKETS = 64


def _latest(spark: SparkSession, state_path: str, version: int) -> DataFrame:
    """The rows of each bucket's last version up to this one; a version has only the buckets that its batch touched."""
    rows = spark.read.option("basePath", state_path).parquet(state_path).where(F.col("v") <= version)
    last = rows.groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(last), ["bucket", "v"]).drop("v")  # a row for each of BUCKETS


def upsert_stream(entries: DataFrame, state_path: str, checkpoint: str, order: str = "ord") -> StreamingQuery:
    """Records of a stream into a state under ``state_path``, in buckets by a hash of the unit.

    Version n + 1 holds those buckets that batch n touches, with its records in; others stay where they were last written, so a batch costs what
    it touches.  A batch writes one version whole, so a batch that runs again after a failure writes the same again.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy("unit_id").orderBy(F.desc(order))
        new = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(BUCKETS)).cast("int"))
        old = new.limit(0)
        if n:
            touched = new.select("bucket").distinct()
            old = _latest(spark, state_path, n).join(F.broadcast(touched), "bucket", "left_semi").select(*new.columns)  # at most BUCKETS rows
        upsert_records(old, new).withColumn("v", F.lit(n + 1)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("v", "bucket").parquet(state_path)

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, state_path: str, batches: int) -> DataFrame:
    """The state after that many batches."""
    return _latest(spark, state_path, batches).drop("bucket")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; beyond parity, for streams of events (ts, event_type, value)."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
