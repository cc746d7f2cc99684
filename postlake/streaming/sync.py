"""Incremental sync: new files of postings are merged into a versioned snapshot, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postlake.operators.merge import last_per_key
from postlake.sources.sinks import batches_done, read_snapshot, versions, write_snapshot


def upsert(existing: DataFrame | None, batch: DataFrame, key: str, *order: str) -> DataFrame:
    """Existing rows without those of the batch, and the last row of each key of the batch."""
    last = last_per_key(batch, key, *order)
    return last if existing is None else existing.join(last.select(key), key, "left_anti").unionByName(last)


def sync_available(spark: SparkSession, source: str, schema: T.StructType, snapshot: str, checkpoint: str, key: str, *order: str, max_files: int = 1000) -> None:
    """Processes all files that are there and not yet done, then ends. A batch that runs again after a failure
    finds its number among the versions and is skipped. Each batch writes a whole version, so a batch takes many files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        if number in batches_done(spark, snapshot):
            return
        write_snapshot(upsert(read_snapshot(spark, snapshot) if versions(spark, snapshot) else None, batch, key, *order), snapshot, number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and their value per window and type; works on streams, where it drops what comes later than ``late``."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause longer than ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def latest_status(changes: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The last status of each key and when it changed."""
    return changes.groupBy(key).agg(F.max_by(status, at).alias(status), F.max(at).alias("changed"))
