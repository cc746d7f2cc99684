"""Tables that cut a job's lineage, in the folder that the cluster's machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Files of a small table for each core of the cluster.
FILES_PER_CORE = 4
#: Lets a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset (tests, one machine) a temporary one."""
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="postlake-")
        spark.conf.set("spark.checkpoint.dir", f"file://{_own_dir}")
    return f"file://{_own_dir}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one run. A table is Parquet, so lost executors need nothing recomputed that lies before it.

    The folder goes when the Python process ends, or earlier by ``drop``: results that a caller gets may read from it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Writes ``df`` once and reads it back. A ``small`` table, of ids or links without texts, gets ``FILES_PER_CORE`` files per core at most.

        Else tables of few rows would become as many files as there are shuffle partitions, in every round of an iteration.
        The shuffle files of the write go with its end: nothing else reads them.
        """
        path = f"{self.root}/{name}"
        if small:
            df = df.coalesce(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            delete(self.spark, self.root)
