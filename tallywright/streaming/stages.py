"""The stage log as a stream: windows of throughput, sessions, the latest state of each sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which asks for time stamps that have a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of each window; works on a table and, with a watermark, on a stream."""
    windows = _watched(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): events of a user less than the gap apart belong together."""
    windows = _watched(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return windows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def latest(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Of a stream's records (sample_id, seq, ts, ...) each once: what comes again within the watermark is dropped; state beyond it goes."""
    return _watched(events, late).dropDuplicatesWithinWatermark(["sample_id", "seq"]) if events.isStreaming else events.dropDuplicates(["sample_id", "seq"])


def ended(spark: SparkSession, source: str, schema: str, query: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs the query over all files that are there now, in micro-batches, and gives the table it leaves behind.

    Each batch replaces (complete) or extends (append) what the target holds, so a batch that is run again changes nothing.
    """
    frame = query(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{'all' if mode == 'complete' else f'batch={number:08d}'}")

    stream = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{target}/all") if mode == "complete" else spark.read.option("basePath", target).parquet(target)
