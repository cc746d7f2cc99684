"""A snapshot in hash buckets: an upsert rewrites only the buckets that it touches.

Data folders are never changed; a manifest names the folder of each bucket, and a version is there once its manifest is. So a
run that breaks off leaves the version before it, two writers of one version can't both succeed, and older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postlake.operators.merge import last_per_key
from postlake.sources.scratch import delete

_BUCKET = "_bucket"


class BucketedSnapshot:
    """Rows by ``key`` under ``folder``. The number of buckets is fixed by the first write; a bucket is what one task rewrites."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        system, path = self._system(f"{self.folder}/manifests")
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """number, batch, buckets, schema and the folder of each bucket, of a version or the last one; an empty one if there is none."""
        found = self.versions()
        if not found:
            return {"number": 0, "batch": None, "buckets": self.buckets, "schema": None, "parts": {}}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{found[-1] if version is None else version:09d}.json").first()[0])

    def _commit(self, manifest: dict) -> None:
        # the name begins with a dot until all of it is written; a rename to a name that is taken fails
        text, name = json.dumps(manifest), f"{manifest['number']:09d}.json"
        system, hidden = self._system(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        _, shown = self._system(f"{self.folder}/manifests/{name}")
        out = system.create(hidden, False)
        out.write(text.encode())
        out.close()
        if system.exists(shown) or not system.rename(hidden, shown):
            system.delete(hidden, False)
            raise RuntimeError(f"version {manifest['number']} was written by another run")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(self.folder)
        return self._rows(m, m["parts"])

    def _rows(self, m: dict, buckets) -> DataFrame:
        schema, paths = T.StructType.fromJson(m["schema"]), [f"{self.folder}/{m['parts'][b]}" for b in sorted(buckets) if b in m["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, *order: str, batch: int | None = None) -> int:
        """The last row by ``order`` of each key of ``rows`` replaces the key's row; returns the version. A ``batch`` that was committed is skipped.

        New columns are NULL in old rows. NULL is a key of its own.
        """
        m = self.manifest()
        if batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return m["number"]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(m["buckets"])).cast("int")
        new = last_per_key(rows, self.key, *order).withColumn(_BUCKET, bucket)
        name = f"data/{m['number'] + 1:09d}-{uuid.uuid4().hex}"
        touched = [str(r[0]) for r in new.select(_BUCKET).distinct().collect()]  # at most as many as there are buckets
        if m["schema"] is not None and touched:
            old = self._rows(m, touched).withColumn(_BUCKET, bucket)
            same = old[self.key].eqNullSafe(new[self.key])
            new = old.join(new.select(self.key), same, "left_anti").unionByName(new, allowMissingColumns=True)
        schema = new.drop(_BUCKET).schema
        if touched:
            new.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        parts = m["parts"] | {b: f"{name}/{_BUCKET}={b}" for b in touched}
        self._commit({"number": m["number"] + 1, "batch": m["batch"] if batch is None else batch, "buckets": m["buckets"], "schema": json.loads(schema.json()), "parts": parts})
        return m["number"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests before the last ``keep`` and the data that none of these names. Not while another run writes."""
        found = self.versions()
        used = {p.split("/")[1] for v in found[-keep:] for p in self.manifest(v)["parts"].values()}
        for v in found[:-keep]:
            delete(self.spark, f"{self.folder}/manifests/{v:09d}.json")
        system, path = self._system(f"{self.folder}/data")
        for name in [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []:
            if name not in used:
                delete(self.spark, f"{self.folder}/data/{name}")


def sync_buckets(source: DataFrame, snapshot: BucketedSnapshot, checkpoint: str, *order: str) -> None:
    """Merges all that a stream has now into the snapshot, batch by batch, and ends. A batch that runs again after a failure finds its number in the manifest."""

    def merge(batch: DataFrame, number: int) -> None:
        snapshot.upsert(batch, *order, batch=number)

    source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
