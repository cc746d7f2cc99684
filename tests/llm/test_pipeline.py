"""The whole pipeline on the smallest tables."""

import os
import random

import pandas as pd
import pytest

import corpus_pipeline
from postlake.llm.near_duplicates import near_duplicates
from postlake.llm.queries import ORACLE_SQL, QUERIES
from postlake.sources.tables import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, DATA).count() == before


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    text = lambda f: sorted(tuple(str(None if pd.isna(x) else x).removesuffix(".0") for x in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert text(ours) == text(theirs)


def test_near_copies_of_the_pipeline(spark):
    """Jaccard 0.82: one document for the pipeline's stage, two for op4."""
    words = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{k}" for k in range(10))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, docs, "").collect()] == [1]
    assert near_duplicates(docs).where("kept").count() == 2


def test_planted_rows(spark, tmp_path):
    """Copies, near copies, a repeated passage and a benchmark item are caught by their stages; clean documents, null and empty texts stay."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    lines = lambda n: [" ".join(word() for _ in range(12)) for _ in range(n)]
    item = " ".join(word() for _ in range(25))
    texts = {k: lines(12) for k in range(20)}
    passage = lines(5)
    texts[30], texts[31] = lines(6) + passage + lines(3), lines(2) + passage + lines(7)
    texts[50] = [" ".join(texts[1]).replace(texts[1][5].split()[0], "changed", 1)]
    texts[60] = lines(4) + [item] + lines(4)
    rows = [(k, "\n".join(t), "clash") for k, t in texts.items()] + [(40, " ".join(texts[0]), ""), (70, None, ""), (71, "", ""), (None, "no id", ""), (5, "\n".join(texts[5]), "clash")]
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), c) for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string")
    shorter = corpus_pipeline.without_repeated_lines(spark, docs.drop("removed"), str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in shorter.collect()}
    assert got == {i: t for i, t, _ in rows} | {31: "\n".join(texts[31][:2] + texts[31][7:])}
    ids = lambda df: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())
    first = corpus_pipeline.one_of_near_duplicates(spark, docs, str(tmp_path))
    assert ids(first) == sorted(-1 if i is None else i for i, _, _ in rows if i not in (40, 50))
    assert first.columns == docs.columns
    clean = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert ids(clean) == sorted(-1 if i is None else i for i, _, _ in rows if i != 60) and clean.columns == docs.columns
