"""Writers: versioned snapshots, batches, dictionaries, logs. Nothing is overwritten in place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.operators.merge import batch_number, numbered


def _folders(spark: SparkSession, folder: str) -> dict[int, tuple[str, int | None]]:
    """Version to its folder's name and the number of the streaming batch that wrote it, of all that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return {}
    done = [s.getPath() for s in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    named = {p.getName(): re.fullmatch(r"v=(\d+)(?:\.batch=(\d+))?", p.getName()) for p in done}
    return {int(m[1]): (name, None if m[2] is None else int(m[2])) for name, m in named.items() if m}


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a snapshot that were written to their end."""
    return sorted(_folders(spark, folder))


def batches_done(spark: SparkSession, folder: str) -> set[int]:
    """Numbers of the streaming batches whose version was written to its end."""
    return {batch for _, batch in _folders(spark, folder).values() if batch is not None}


def write_snapshot(df: DataFrame, folder: str, batch: int | None = None) -> int:
    """Writes the next version; the ones before stay as backups. ``batch`` is kept in the version's name."""
    n = (versions(df.sparkSession, folder) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{folder}/v={n}" + ("" if batch is None else f".batch={batch}"))
    return n


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    found = _folders(spark, folder)
    if not found:
        raise FileNotFoundError(folder)
    return spark.read.parquet(f"{folder}/{found[max(found) if version is None else version][0]}")


def write_batches(df: DataFrame, folder: str, *order: str, size: int = 400) -> None:
    """Rows in files of at most ``size``, in a folder per batch."""
    batches = numbered(df, *order).withColumn("batch", batch_number(F.col("row_no"), size)).drop("row_no")
    batches.repartition("batch").write.mode("overwrite").partitionBy("batch").json(folder)


def write_dictionary(df: DataFrame, path: str, key: str) -> None:
    """A dictionary in the order of its keys, one JSON object per line; ``ingest.entries`` reads it back."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.select(F.current_timestamp().cast("string").alias("at"), F.to_json(F.struct("*")).alias("entry")).write.mode("append").json(path)
