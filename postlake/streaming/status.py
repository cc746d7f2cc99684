"""Lifecycle of a posting's status, from events that come late, repeated and out of order."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT, _CURRENT, _CHANGE = ["key", "at", "seq", "status"], ["key", "status", "last"], ["key", "status", "previous", "changed"]
#: Groups of keys by hash, each with a state of its own. A call of the state store takes as long as some hundred events, so keys don't make them one by one.
BUCKETS = 512
#: Rows of an entry of the state and of a frame of changes at most.
PACKED = 10_000
_NEVER = np.iinfo(np.int64).min


def _parts(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (rows.iloc[k : k + PACKED] for k in range(0, len(rows), PACKED))


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pydict({c: pa.array(rows[c], from_pandas=True) for c in rows.columns})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Lifecycle(StatefulProcessor):
    """Keeps the status of a bucket's keys, and when each was last heard of; events wait until the watermark has passed them.

    Then they are applied in their order, so the changes don't depend on the order of arrival. A key that isn't heard of for
    ``silence`` microseconds becomes ``gone`` at that time. Timers stand at the next waiting event of the bucket, or else at the first end of a silence.
    """

    def __init__(self, silence: int, gone: str = "removed"):
        self.silence, self.gone = silence, gone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, set()
        self.current = handle.getValueState("current", "keys binary")
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = []
        for batch in rows:
            self.waiting.appendList([(_packed(part[_EVENT]),) for part in _parts(batch)])
            least.append(int(batch["at"].min()))
        self._wake(min(least))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.done:  # by an earlier timer, up to the same watermark
            return
        self.done.add(key)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.concat([pd.DataFrame(columns=_EVENT).astype({"at": np.int64, "seq": np.int64}), *(_unpacked(data) for (data,) in self.waiting.get())], ignore_index=True)
        kept = self.current.get()
        current = _unpacked(kept[0]) if kept else pd.DataFrame(columns=_CURRENT).astype({"last": np.int64})
        is_ready = (waiting["at"] <= passed).to_numpy()
        rest = waiting[~is_ready]
        after, changes = self._apply(current, waiting[is_ready], passed)
        if is_ready.any():
            self.waiting.put([(_packed(part),) for part in _parts(rest)]) if len(rest) else self.waiting.clear()
        if len(changes) or is_ready.any():
            self.current.update((_packed(after),))
        # the next waiting event, or the first end of a silence that is still to come
        ends = after.loc[after["status"] != self.gone, "last"] + self.silence
        due = pd.concat([rest["at"], ends[ends > passed]])
        if len(due):
            self._wake(int(due.min()))
        yield from _parts(changes)

    def _apply(self, current: pd.DataFrame, ready: pd.DataFrame, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The keys' state after the events that are ready and the silences that have ended, and the changes."""
        keys, names = pd.factorize(pd.concat([current["key"], ready["key"]], ignore_index=True).astype(object), use_na_sentinel=False)
        status, kinds = pd.factorize(pd.concat([pd.Series([None, self.gone]), current["status"], ready["status"]], ignore_index=True).astype(object), use_na_sentinel=False)
        kinds = np.array([None if pd.isna(k) else k for k in kinds], dtype=object)
        rank = np.argsort(np.argsort(np.array([k or "" for k in kinds], dtype=object)))
        none, gone = status[:2]
        known, status = status[2 : 2 + len(current)], status[2 + len(current) :]
        now, last = np.full(len(names), none), np.full(len(names), _NEVER)
        now[keys[: len(current)]], last[keys[: len(current)]] = known, current["last"].to_numpy()

        key, at, seq = keys[len(current) :], ready["at"].to_numpy(dtype=np.int64), ready["seq"].to_numpy(dtype=np.int64)
        order = np.lexsort((rank[status], seq, at, key))
        key, at, status = key[order], at[order], status[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        before, heard = np.where(first, now[key], np.roll(status, 1)), np.where(first, last[key], np.roll(at, 1))
        silent = (heard != _NEVER) & (heard + self.silence < at)
        left = silent & (before != gone)
        previous = np.where(silent, gone, before)
        moved = status != previous
        ends = np.append(first[1:], True)[: len(key)]
        now[key[ends]], last[key[ends]] = status[ends], at[ends]
        ended = np.flatnonzero((last != _NEVER) & (last + self.silence <= passed) & (now != gone))
        found = [
            (key[left], np.full(left.sum(), gone), before[left], heard[left] + self.silence),
            (key[moved], status[moved], previous[moved], at[moved]),
            (ended, np.full(len(ended), gone), now[ended], last[ended] + self.silence),
        ]
        key, to, previous, changed = (np.concatenate(x) for x in zip(*found))
        now[ended] = gone
        changes = pd.DataFrame(dict(zip(_CHANGE, (names[key], kinds[to], kinds[previous], changed))))
        return pd.DataFrame(dict(zip(_CURRENT, (names, kinds[now], last)))), changes

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, key: str, status: str, at: str, seq: str, late: str = "10 minutes", silence_hours: int = 24 * 30, buckets: int = BUCKETS) -> DataFrame:
    """Each change of a key's status in a stream: key, status, previous and changed_at, as far as the watermark (``late`` behind the latest event) has come.

    Of events at one time the greater ``seq`` (a number) counts last. Repeated events change nothing; events behind the watermark or without a time are dropped.
    Run it with ``state_store``.

    Keys share the state of one of ``buckets`` groups, so a batch rewrites the groups that its keys are in, and a task holds one group at once: take more of
    them for many millions of keys. A checkpoint is bound to its number of groups.
    """
    time = F.col(at).cast("timestamp")
    stream = events.select(F.col(key).alias("key"), F.col(status).alias("status"), time.alias("ts"), F.unix_micros(time).alias("at"), F.col(seq).cast("long").alias("seq"))
    kind = stream.schema["key"].dataType.simpleString()
    plain = kind if kind == "binary" else "string"  # pandas would turn whole numbers beside nulls into floats
    stream = stream.where("ts is not null").withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"), "key": F.col("key").cast(plain)})
    moves = stream.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(Lifecycle(silence_hours * 3_600_000_000), f"key {plain}, status string, previous string, changed long", "Append", "EventTime")
    return moves.select(F.col("key").cast(kind).alias("key"), "status", "previous", F.timestamp_micros("changed").alias("changed_at"))


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk and in the checkpoint, not in the heap."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_available(changes: DataFrame, folder: str, checkpoint: str) -> None:
    """Appends the changes that follow from what is there now to ``folder``, and ends."""
    with state_store(changes.sparkSession):
        changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
