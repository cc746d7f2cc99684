"""Streams and extensions that analytics needs beside the list pages: windows, sessions, rollups, ranks, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlake.functions import location as loc
from postlake.operators.facets import exploded, is_active
from postlake.plans.postings import PLACES, POSTINGS, postings
from postlake.sources.answers import AnswerStore
from postlake.sources.buckets import BucketedSnapshot, sync_buckets
from postlake.sources.providers import FakeGeocoder
from postlake.sources.scratch import Scratch
from postlake.sources.sinks import read_snapshot
from postlake.sources.tables import table
from postlake.streaming.status import run_available, status_changes
from postlake.streaming.sync import latest_status, sessions, sync_available, windowed_counts

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def incremental_sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "sync")
    source = f"{sf_dir}/events.parque[t]"  # a pattern may name a file as well as a folder
    schema = table(spark, sf_dir, "events").schema
    sync_available(spark, source, schema, f"{scratch.root}/snapshot", f"{scratch.root}/checkpoint", "user_id", "event_id")
    return read_snapshot(spark, f"{scratch.root}/snapshot").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def bucketed_sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into a bucketed snapshot: events come in three files, a batch each, and a batch rewrites the buckets of its users only."""
    scratch = Scratch(spark, "buckets")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    most = events.agg(F.max("event_id")).first()[0] or 0
    for third in range(3):
        events.where(F.floor(F.col("event_id") * 3 / (most + 1)) == third).coalesce(1).write.mode("append").parquet(f"{scratch.root}/in")
    snapshot = BucketedSnapshot(spark, f"{scratch.root}/snapshot", "user_id", 16)
    sync_buckets(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.root}/in"), snapshot, f"{scratch.root}/checkpoint", "event_id")
    return snapshot.read().select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'paused' WHEN 'purchase' THEN 'removed' ELSE 'active' END AS status FROM events),
    w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS passed FROM e),
    o AS (SELECT user_id, ts, status, lag(status) OVER p AS before, lag(ts) OVER p + INTERVAL 48 HOUR AS expires, lead(ts) OVER p AS next, passed FROM e, w WHERE ts <= passed WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT user_id, status, CASE WHEN expires < ts THEN 'removed' ELSE before END AS previous, ts AS changed_at FROM o),
    g AS (SELECT user_id, 'removed' AS status, status AS previous, ts + INTERVAL 48 HOUR AS changed_at FROM o WHERE status <> 'removed' AND ts + INTERVAL 48 HOUR <= passed AND (next IS NULL OR ts + INTERVAL 48 HOUR < next))
    SELECT * FROM m WHERE previous IS DISTINCT FROM status UNION ALL SELECT * FROM g"""
)
def status_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of users' status, from a stream of events; who isn't heard of for two days is removed."""
    scratch = Scratch(spark, "status")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    status = F.when(F.col("event_type") == "error", "paused").when(F.col("event_type") == "purchase", "removed").otherwise("active")
    run_available(status_changes(events.withColumn("status", status), "user_id", "status", "ts", "event_id", silence_hours=48), f"{scratch.root}/changes", f"{scratch.root}/checkpoint")
    changes = spark.read.schema("key long, status string, previous string, changed_at timestamp").parquet(f"{scratch.root}/changes")
    return changes.select(F.col("key").alias("user_id"), "status", "previous", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"))


@query(
    f"""WITH {POSTINGS}, {PLACES}, r AS (SELECT DISTINCT raw, string_split(replace(raw, '-', ','), ',') AS parts FROM places)
    SELECT raw, CASE WHEN parts[-1] LIKE 'NATION %' THEN 'Nation ' || split_part(parts[-1], ' ', 2) ELSE parts[-1] END AS city, CASE WHEN len(parts) > 1 THEN upper(parts[1][1:2]) ELSE 'NA' END AS country_code FROM r"""
)
def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places asked of a geocoder through a store of answers, half of them first; the second run asks for the rest only."""
    store = AnswerStore(spark, f"{Scratch(spark, 'answers').root}/store")
    raws = exploded(postings(spark, sf_dir).where(is_active()).withColumn("raws", loc.lines(F.col("location"))), "raws", "raw").select("raw").distinct()
    store.ask(raws.where(F.xxhash64("raw") % 2 == 0), "raw", FakeGeocoder())
    out = store.ask(raws, "raw", FakeGeocoder()).withColumn("r", F.from_json("response", "city string, countryCode string"))
    return out.select("raw", "r.city", F.col("r.countryCode").alias("country_code"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 3))


@query(
    """WITH w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start, event_type FROM events, (VALUES (0), (1)) AS s(k))
    SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "2 hours", slide="1 hour").select("window_start", "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS changed FROM events GROUP BY user_id")
def latest_status_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_status(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(
    """SELECT r_name, n_name, o_orderstatus, count(*) AS n, CAST(grouping(r_name) + 2 * grouping(n_name) + 4 * grouping(o_orderstatus) AS BIGINT) AS level
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderstatus)"""
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted per customer nation first: the rollup then expands a few rows instead of all orders
    per = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("c_nationkey", "o_orderstatus").agg(F.count("*").alias("c"))
    named = per.join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    level = F.grouping("r_name").cast("long") + 2 * F.grouping("n_name") + 4 * F.grouping("o_orderstatus")
    return named.rollup("r_name", "n_name", "o_orderstatus").agg(F.sum("c").alias("n"), level.alias("level"))


@query("SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, round(c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), 4) AS step FROM customer")
def ranked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("c_nationkey")
    step = F.col("c_acctbal") - F.lag("c_acctbal").over(by.orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.rank().over(by.orderBy(F.desc("c_acctbal"))).cast("long").alias("place"), F.round(step, 4).alias("step"))


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
    SELECT p.event_id, (SELECT max(c.ts) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts) AS last_click FROM p"""
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of the user before each purchase: both kinds in one order, the click carried forward."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    click = F.when(F.col("event_type") == "click", F.col("ts"))
    so_far = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("last_click", F.max(click).over(so_far)).where("event_type = 'purchase'").select("event_id", "last_click")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
