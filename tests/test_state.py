"""State that outlives a run: status lifecycles, bucketed snapshots, stored answers; and the SQLite source."""

import os
import random
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlake.sources.answers import AnswerStore
from postlake.sources.buckets import BucketedSnapshot, sync_buckets
from postlake.sources.ingest import scraped
from postlake.sources.sqlite import sqlite_table
from postlake.streaming.status import Lifecycle, run_available, status_changes

HOUR = 3600
EVENTS = "k string, status string, at long, seq long"


def lifecycle_by_hand(events, silence, passed):
    out = []
    for key in {e[0] for e in events}:
        status = last = None
        for _, to, at, _ in sorted((e for e in set(events) if e[0] == key and e[2] <= passed), key=lambda e: (e[2], e[3])):
            if last is not None and last + silence < at and status != "removed":
                out.append((key, "removed", status, last + silence))
                status = "removed"
            if to != status:
                out.append((key, to, status, at))
            status, last = to, at
        if last is not None and last + silence <= passed and status != "removed":
            out.append((key, "removed", status, last + silence))
    return sorted(out, key=str)


def test_status_lifecycle_with_late_and_repeated_events(spark, tmp_path):
    """Three runs over files whose events overlap in time: the changes are those of all events in order."""
    rng = random.Random(2)
    events = sorted(((f"k{rng.randrange(6)}", rng.choice(["active", "active", "paused", "removed"]), rng.randrange(0, 400 * HOUR, 60), n) for n in range(150)), key=lambda e: e[2])
    files = [[], [], []]
    for k, e in enumerate(events):
        at = min(k // 50, 2)
        files[at].append(e)
        if rng.random() < 0.2:
            files[at].append(e)  # repeated
    late = [e for e in files[0][-8:] if e[2] > files[0][-1][2] - 2 * HOUR]
    files[0], files[1] = [e for e in files[0] if e not in late], late + files[1]  # within the watermark's two hours
    dropped = ("k0", "paused", 0, 999)  # behind the watermark
    files[2].append(dropped)
    source, schema = str(tmp_path / "in"), EVENTS
    for k, part in enumerate(files):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
        run_available(status_changes(stream, "k", "status", "ts", "seq", "2 hours", 30), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "status", "previous", F.unix_seconds("changed_at")).collect()
    expected = lifecycle_by_hand(events, 30 * HOUR, events[-1][2] - 2 * HOUR)
    assert sorted(map(tuple, got), key=str) == expected
    assert {x[1] for x in expected} == {"active", "paused", "removed"}


class FakeState:
    """Values, lists and timers of one group in memory, and how often they were called."""

    def __init__(self):
        self.value, self.values, self.timers, self.calls, self.watermark = None, [], set(), 0, 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return FakeList(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getCurrentWatermarkInMs(self):
        return self.watermark


class FakeList:
    def __init__(self, state):
        self.state = state

    def get(self):
        self.state.calls += 1
        return iter(self.state.values)

    def appendList(self, values):
        self.put(self.state.values + list(values))

    def put(self, values):
        self.state.calls += 1
        self.state.values = list(values)

    def clear(self):
        self.put([])


@pytest.mark.parametrize("n_keys", [1, 7, 300])
def test_status_lifecycle_calls_the_state_by_groups_of_keys(n_keys):
    """The state is called as often for 300 keys as for one, over three watermarks; keys may be null, statuses of one time are tied by seq."""
    rng = random.Random(n_keys)
    keys, state, changes = [None, *(str(2**62 + k) for k in range(n_keys - 1))], FakeState(), []
    events = [(rng.choice(keys), rng.choice(["active", "paused", "removed"]), rng.randrange(0, 300 * HOUR, HOUR), n // 2) for n in range(8 * n_keys)]
    model, micros = Lifecycle(30 * HOUR * 10**6), 10**6
    for k, watermark in enumerate((100 * HOUR, 200 * HOUR, 290 * HOUR)):
        new = [e for e in events if e[2] // (100 * HOUR) == k] or [(keys[0], "active", watermark, 0)]
        events += [e for e in new if e not in events]
        model.init(state)
        frame = pd.DataFrame([(0, key, status, at * micros, seq) for key, status, at, seq in new + new[:3]], columns=["bucket", "key", "status", "at", "seq"])
        assert list(model.handleInputRows((0,), iter([frame]), state)) == []
        state.watermark = watermark * 1000
        for timer in sorted(t for t in state.timers if t <= state.watermark):
            changes += [x for frame in model.handleExpiredTimer((0,), state, timer) for x in frame.itertuples(index=False)]
            state.timers.discard(timer)
    got = [(None if pd.isna(key) else key, to, None if pd.isna(before) else before, at // micros) for key, to, before, at in changes]
    assert sorted(got, key=str) == lifecycle_by_hand(events, 30 * HOUR, 290 * HOUR)
    assert state.calls <= 21


def test_status_lifecycle_of_null_and_long_keys(spark, tmp_path):
    """Whole numbers beside nulls stay whole; events without a time are left out; several groups hold the keys."""
    rows = [(k, s, t, n) for n, (k, s, t) in enumerate([(2**53 + 1, "active", 10), (None, "paused", 60), (2**53, "active", 120), (2**53 + 1, "paused", 180), (5, "active", None), (5, "active", 9000)])]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, EVENTS.replace("k string", "k long")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(EVENTS.replace("k string", "k long")).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
    run_available(status_changes(stream, "k", "status", "ts", "seq", "1 hours", 30, buckets=2), out, str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(out).select("key", "status", "previous", F.unix_seconds("changed_at")).collect()}
    assert got == {(2**53 + 1, "active", None, 10), (None, "paused", None, 60), (2**53, "active", None, 120), (2**53 + 1, "paused", "active", 180)}


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_bucketed_snapshot_writes_what_changes(spark, tmp_path):
    folder = str(tmp_path / "snap")
    snap = BucketedSnapshot(spark, folder, "k", 32)
    with pytest.raises(FileNotFoundError):
        snap.read()
    wide = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).alias("n"))
    assert snap.upsert(wide, "n") == 1
    first = size_of(folder)
    few = spark.createDataFrame([(5, "new", 1, "x"), (5, "newer", 2, "y"), (None, "null", 1, "z"), (50_000, "more", 1, None)], "k long, v string, n int, extra string")
    assert snap.upsert(few, "n", batch=7) == 2 and snap.upsert(few.where("k = 5"), "n", batch=7) == 2  # the same batch again
    assert size_of(folder) - first < first / 4
    rows = {r["k"]: r for r in snap.read().collect()}
    assert len(rows) == 20_002 and rows[5]["v"] == "newer" and rows[None]["extra"] == "z" and rows[6]["extra"] is None
    assert snap.read(1).count() == 20_000 and snap.read(1).where("v = 'newer'").count() == 0
    assert snap.upsert(spark.createDataFrame([(None, "null again", 3, "z")], few.schema), "n") == 3 and snap.read().count() == 20_002
    assert snap.upsert(few.limit(0), "n") == 4 and snap.read().count() == 20_002
    snap.vacuum(1)
    assert snap.versions() == [4] and snap.read().count() == 20_002


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    snap = BucketedSnapshot(spark, str(tmp_path / "s"), "k", 4)
    old = snap.manifest()
    snap.upsert(spark.range(3).toDF("k"), "k")
    monkeypatch.setattr(snap, "manifest", lambda *a: old)
    with pytest.raises(RuntimeError):
        snap.upsert(spark.range(9).toDF("k"), "k")
    monkeypatch.undo()
    assert snap.read().count() == 3


def test_sync_into_buckets(spark, tmp_path):
    source, snap = str(tmp_path / "in"), BucketedSnapshot(spark, str(tmp_path / "snap"), "k", 8)
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)], []):
        spark.createDataFrame(rows, "k int, v string, n int").coalesce(1).write.mode("append").parquet(source)
        sync_buckets(spark.readStream.schema("k int, v string, n int").option("maxFilesPerTrigger", 1).parquet(source), snap, str(tmp_path / "check"), "n")
    assert {(r["k"], r["v"]) for r in snap.read().collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_answers_are_asked_for_once(spark, tmp_path):
    class Counting:
        """Notes each question in a file; after some questions it stops the task with an error that is no answer."""

        def __init__(self, log, after=1000):
            self.log, self.left = log, after

        def ask(self, key):
            self.left -= 1
            if self.left < 0:
                raise SystemExit(key)  # no Exception: the task dies in mid-batch
            with open(self.log, "a") as f:
                f.write(key + "\n")
            if key == "bad":
                raise ValueError("never")
            return {"k": key}

    log, store = str(tmp_path / "log"), AnswerStore(spark, str(tmp_path / "answers"))
    keys = spark.createDataFrame([(f"k{n % 60}",) for n in range(100)] + [("bad",), (None,)], "key string")
    with pytest.raises(Exception) as info:  # noqa: B017  whatever Spark makes of a dead task
        store.ask(keys, "key", Counting(log, 10), every=7, tasks=3, retries=1).count()
    assert "SystemExit" in str(info.value), str(info.value)
    before = open(log).read().split()
    assert 0 < store.answers().count() == len([k for k in before if k != "bad"])
    out = {r["key"]: r for r in store.ask(keys, "key", Counting(log), every=7, tasks=3, retries=2).collect()}
    asked = open(log).read().split()
    assert sorted(k for k in asked if k != "bad") == sorted(f"k{n}" for n in range(60))  # each once
    assert len(out) == 61 and out["bad"]["error"] == "ValueError: never" and out["k17"]["response"] == '{"k": "k17"}' and out["k17"]["error"] is None
    assert store.ask(keys, "key", Counting(log), retries=1).where("error is null").count() == 60
    assert [k for k in open(log).read().split()[len(asked) :]] == ["bad"]
    assert store.answers(days=0).count() == 0  # all are older than now
    store.ask(keys.limit(1), "key", Counting(log), days=0)
    assert open(log).read().split()[-1] == "k0" and store.answers().count() == 60


def test_sqlite_in_partitions_with_filters(spark, tmp_path):
    path = str(tmp_path / "jobs.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE scraped_jobs (url TEXT, company TEXT, title VARCHAR(80), status TEXT, first_seen TEXT, last_seen TEXT, status_changed_date TEXT, n INTEGER, x REAL)")
        db.executemany("INSERT INTO scraped_jobs VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", [(f"http://x/{k}", f"C{k % 3}", f"Job {k}" if k % 10 else None, None if k % 4 else "removed", "2024-01-01", f"2024-02-{k % 28 + 1:02d}", None, k, k / 2) for k in range(1000)])
        db.execute("CREATE TABLE none (a INTEGER)")
        db.execute("CREATE VIEW few AS SELECT n FROM scraped_jobs WHERE n < 5")
    df = sqlite_table(spark, path, "scraped_jobs", 6)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 1000 and dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["x"] == "double"
    some = df.where("n >= 990 and company in ('C0', 'C1') and title is not null and x < 499")
    assert sorted(r["n"] for r in some.collect()) == [n for n in range(991, 998) if n % 3 < 2]
    assert df.where("status <=> 'removed' and length(url) = 11").count() == len([k for k in range(100, 1000) if k % 4 == 0 and len(f"http://x/{k}") == 11]) + len([k for k in range(10, 100) if k % 4 == 0 and len(f"http://x/{k}") == 11])
    assert sqlite_table(spark, path, "scraped_jobs", 3, "n int, title string").where("n = 5").collect() == [(5, "Job 5")]
    assert sqlite_table(spark, path, "none").count() == 0 and sorted(r["n"] for r in sqlite_table(spark, path, "few").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="no table"):
        sqlite_table(spark, path, "missing").count()
    posts = scraped(df).collect()
    assert len(posts) == 900 and posts[0]["company"] == "C0" and {p["status"] for p in posts} == {"active", "removed"}
