"""Tables of SQLite files as a Spark source: ranges of row numbers as partitions, filters in the scan."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Spark's type of a column by what its declared type holds, as SQLite's affinity rules have it; else text.
AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_AS = {"long": int, "integer": int, "double": float, "string": str, "binary": bytes}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


@dataclass
class Rows(InputPartition):
    """Row numbers from ``low`` up to before ``high``; all rows without a bound."""

    low: int | None
    high: int | None


class SqliteTable(DataSource):
    """Options: path (a file that all executors see), dbtable, numPartitions. A schema of the reader's own selects and casts columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        kind = lambda declared: next((to for part, to in AFFINITY if part in declared.upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.table, self.parts = options["path"], options["dbtable"], int(options.get("numpartitions", options.get("numPartitions", 8)))
        self.columns, self.tests = columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons, lists and NULL tests of single columns; Spark keeps the others."""
        for f in filters:
            test = self._test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def _test(self, f: Filter) -> tuple[str, list] | None:
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in dict(self.columns):
            return None
        column, plain = _name(f.attribute[0]), lambda x: isinstance(x, (int, str, float)) and not isinstance(x, bool)
        if type(f) in _COMPARE and plain(f.value):
            return f"{column} {_COMPARE[type(f)]} ?", [f.value]
        if isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
            return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, (IsNotNull, IsNull)):
            return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        return None

    def partitions(self) -> list[Rows]:
        """Even ranges between the least and the greatest row number; one for views and tables without row numbers."""
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Rows(None, None)]
        if low is None or not isinstance(low, int):
            return [Rows(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        tests, values = [t for t, _ in self.tests], [v for _, given in self.tests for v in given]
        if partition.low is not None:
            tests, values = ["rowid >= ?", "rowid < ?", *tests], [partition.low, partition.high, *values]
        casts = [_AS.get({"bigint": "long", "int": "integer"}.get(kind, kind), str) for _, kind in self.columns]
        with _open(self.path) as db:
            query = f"SELECT {', '.join(_name(c) for c, _ in self.columns)} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
            for row in db.execute(query, values):
                yield tuple(None if v is None else v if isinstance(v, cast) else cast(v) for v, cast in zip(row, casts))


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8, schema: str | None = None) -> DataFrame:
    """The rows of a table, read in ``partitions`` tasks; filters on single columns run in SQLite."""
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", path).option("dbtable", table).option("numPartitions", partitions)
    return (reader.schema(schema) if schema else reader).load()
