"""Rows by membership of their id, without shuffling the texts of rows that surely differ; columns added in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Rows in an Arrow batch at most: a task holds a batch of texts in the JVM and in Python, each more than once.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``, unless it is lower already."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


#: Bits that stand for ids in a broadcast: ``SPARE`` for each id, at most ``BITS`` (16 MB), whatever the tables' sizes; one page of them in a row.
BITS, SPARE = 1 << 27, 64
_PAGE_BITS = 1 << 15


def _bits(n: int) -> int:
    """A power of two."""
    return min(BITS, max(_PAGE_BITS, 1 << (SPARE * n - 1).bit_length()))


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``docs`` among which are all whose ``key`` is in ``ids``, and the rest. ``ids`` should be a written table: it is read twice.

    Up to ``BITS / 4`` ids a broadcast bitmap of their hashes tells them apart with few mistakes (at most one row in ``SPARE`` up to ``BITS / SPARE`` ids), and
    without moving a text; with more ids, which are counted first, it would tell little: then all rows come first, and there is no rest.
    """
    n = ids.count()
    if n > BITS // 4:
        return docs, None
    bit = F.pmod(F.xxhash64(key), F.lit(_bits(n)))
    page, place = F.floor(bit / _PAGE_BITS).cast("int"), bit % _PAGE_BITS
    free = "_" * max(map(len, docs.columns))  # longer names than any other
    pages = F.broadcast(ids.groupBy(page.alias(f"{free}page")).agg(F.bitmap_construct_agg(place).alias(f"{free}marks")))
    byte = F.conv(F.hex(F.substring(F.col(f"{free}marks"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))
    joined = docs.join(pages, page == F.col(f"{free}page"), "left")
    return joined.where(marked).select(*docs.columns), joined.where(~marked).select(*docs.columns)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``."""
    maybe, _ = split_by_ids(docs, ids)
    return maybe.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids``, those without doc_id included."""
    maybe, sure = split_by_ids(docs, ids)
    maybe = maybe.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    return maybe if sure is None else sure.unionByName(maybe)


def add_columns(docs: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """``docs`` with new columns computed from ``text``; other columns pass through tasks untouched.

    ``make`` is called once per task and gives a function from a batch's texts to the new columns. A column of ``docs``
    with the name of a new one is replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*(f.name for f in fields))
    schema = T.StructType([*docs.schema.fields, *fields])
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = [pa.array(values) for values in compute(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(work, schema)
