"""Answers of remote services, kept by key: what was answered is not asked again, after a failure either."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.sources.providers import Provider, fresh

_SCHEMA = "key string, response string, asked_at timestamp"
_FILE = pa.schema([("key", pa.string()), ("response", pa.string()), ("asked_at", pa.timestamp("us", tz="UTC"))])


class AnswerStore:
    """Answers under ``folder``, which executors share. Each commit is a file of its own that is there or not; nothing is rewritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def answers(self, days: int | None = None) -> DataFrame:
        """key, response and asked_at: the last answer of each key, without those older than ``days``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(self.folder)
        last = rows.groupBy("key").agg(F.max_by("response", F.struct("asked_at", "response")).alias("response"), F.max("asked_at").alias("asked_at"))
        return last if days is None else last.where(fresh(F.col("asked_at"), F.current_timestamp(), days))

    def ask(self, keys: DataFrame, key: str, provider: Provider, every: int = 10, days: int | None = 30, tasks: int = 8, retries: int = 3, pause: float = 0.0) -> DataFrame:
        """Asks for the distinct keys that have no fresh answer; returns key, response and error of all keys (NULL ones left out).

        A task commits its answers after ``every`` keys, at its end, and before an error that stops it. A task that runs again finds what its first
        run committed, and a job that runs again what all tasks did: only answers of a machine that was lost since its last commit (fewer than ``every``
        for each task) are asked for again. A key that gives an error after ``retries`` is not stored, so that the next run asks for it.
        """
        wanted = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        todo = wanted.join(self.answers(days).select("key"), "key", "left_anti").repartition(tasks, "key")
        asked = todo.mapInPandas(_asker(f"{self.folder}/run={uuid.uuid4().hex}", provider, every, retries, pause), "key string, error string")
        errors = {r["key"]: r["error"] for r in asked.where("error is not null").limit(10_000).collect()}  # runs the job; a message for each of the first failures
        rows = wanted.join(self.answers(days), "key", "left")
        failed = self.spark.createDataFrame(list(errors.items()), "key string, error string")
        return rows.join(failed, "key", "left").select(F.col("key").alias(key), "response", F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))


def _asker(folder: str, provider: Provider, every: int, retries: int, pause: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(f"{folder}/task={TaskContext.get().partitionId()}")
        system.create_dir(path, recursive=True)
        done = {k for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet") for k in pq.read_table(f.path, filesystem=system, partitioning=None)["key"].to_pylist()}
        held: list[tuple] = []

        def commit() -> None:
            if held:
                name = uuid.uuid4().hex
                with system.open_output_stream(f"{path}/_{name}") as out:
                    pq.write_table(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _FILE)], schema=_FILE), out)
                system.move(f"{path}/_{name}", f"{path}/{name}.parquet")
                held.clear()

        try:
            for batch in batches:
                errors = []
                for k in batch["key"]:
                    if k in done:
                        continue
                    response, error = _asked(provider, k, retries, pause)
                    if error is None:
                        held.append((k, response, datetime.datetime.now(datetime.UTC)))
                    errors.append((k, error))
                    if len(held) >= every:
                        commit()
                yield pd.DataFrame(errors, columns=["key", "error"])
        finally:
            commit()

    return work


def _asked(provider: Provider, key: str, retries: int, pause: float) -> tuple[str | None, str | None]:
    error = None
    for attempt in range(retries):
        try:
            response = json.dumps(provider.ask(key), sort_keys=True)
            time.sleep(pause)
            return response, None
        except Exception as e:  # noqa: BLE001  the row tells
            error = f"{type(e).__name__}: {e}"
            time.sleep(pause * 2**attempt)
    return None, error
