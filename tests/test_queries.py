"""Every registered query with a SQL statement gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from postlake.plans.registry import ORACLE_SQL, QUERIES
from postlake.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(x):
    if x is None or pd.isna(x):
        return None
    if isinstance(x, bool) or str(x) in ("True", "False"):
        return str(x)
    try:
        return round(float(x), 5)
    except (TypeError, ValueError):
        return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(cell(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_chunks_join_to_the_text(spark):
    out = QUERIES["chunk_text"](spark, DATA).toPandas().sort_values(["doc_id", "chunk_no"])
    assert out["chunk"].str.len().max() <= 450
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    squeeze = lambda s: "".join(s.split())
    for doc_id, part in out.groupby("doc_id"):
        assert squeeze("".join(part["chunk"])) == squeeze(texts[doc_id])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
