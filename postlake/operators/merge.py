"""Snapshots and side tables: deduplication, overlays, upserts, detection of new and changed rows, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.sources.scratch import Scratch


def last_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key, found by partial maxima: no window, so no task needs all rows of a hot key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def first_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def overlay(postings: DataFrame, enhanced: DataFrame, key: str, column: str) -> DataFrame:
    """Left join; the enhancement wins, and a flag tells where."""
    side = enhanced.select(key, F.col(column).alias("_new"), F.lit(True).alias("enhanced"))
    joined = postings.join(side, key, "left")
    own = F.col(column) if column in postings.columns else F.lit(None)
    return joined.withColumn(column, F.coalesce("_new", own)).withColumn("enhanced", F.coalesce("enhanced", F.lit(False))).drop("_new")


def merge_snapshot(fetched: DataFrame, existing: DataFrame, key: str, keep: list[str], *order: Column | str) -> DataFrame:
    """The fetched rows with the columns ``keep`` of the existing snapshot; rows that are no longer fetched go.
    Of several existing rows with one key the last counts."""
    return fetched.drop(*keep).join(last_per_key(existing.select(key, *keep, *[c for c in order if isinstance(c, str) and c not in (key, *keep)]), key, *order).select(key, *keep), key, "left")


def new_rows(fetched: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return fetched.join(existing.select(key), key, "left_anti")


def updated_rows(fetched: DataFrame, existing: DataFrame, key: str, missing: Column, text: str) -> DataFrame:
    """Known rows that lack a result and now have a text to get it from."""
    return fetched.where(F.coalesce(text, F.lit("")) != "").join(existing.where(missing).select(key), key, "left_semi")


def merge_batches(postings: DataFrame, batches: DataFrame, key: str, column: str, batch: str) -> DataFrame:
    """Results of batches put back; of several for one key that of the last batch counts."""
    last = batches.groupBy(key).agg(F.max_by(column, batch).alias("_result"))
    return postings.join(last, key, "left").withColumn(column, F.col("_result")).drop("_result")


def fallback_key(df: DataFrame) -> Column:
    """id, else url, else the whole row."""
    return F.coalesce(F.col("id").cast("string"), F.col("url"), F.to_json(F.struct(*df.columns)))


def missing_keys(values: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    return values.select(key).distinct().join(dictionary.select(key), key, "left_anti")


def numbered(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in a total order, without one task that sorts all rows.

    Rows are dealt by ranges of the order and written once, as both the ranges' sizes (a row per partition, which give each its first
    number) and the rows come from them: a range that is dealt again may have other bounds.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = Scratch(df.sparkSession, "numbered").table(dealt, "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_row", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


def batch_number(row_no: Column, size: int = 400) -> Column:
    return F.floor((row_no - 1) / size) + 1
