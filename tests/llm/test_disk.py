"""What near duplicates and memberships move and keep on disk."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import near_duplicates
from postlake.llm.rows import split_by_ids, with_ids, without_ids
from postlake.llm.words import hash_cache, shingle_set
from postlake.sources.scratch import Scratch


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]


def test_a_line_of_many_short_texts_makes_no_family(spark):
    """Short texts with a line in common and nothing else: no blocks of them are compared, and near copies among them are found."""
    rng = random.Random(2)
    line, rows = " ".join(words_of(rng, 14)), []
    for k in range(0, 600, 2):
        own = words_of(rng, 40)
        other = own[:-1] + words_of(rng, 1) if k % 20 == 0 else words_of(rng, 40)
        rows += [(k, f"{line} {' '.join(own)}"), (k + 1, f"{line} {' '.join(other)}")]
    scratch = Scratch(spark, "line")
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    cache = hash_cache()
    sets = {k: set(shingle_set(t, cache).tolist()) for k, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {(r["component_id"], r["doc_id"]) for r in out if not r["kept"]} == linked and len(linked) == 30
    count = lambda name: spark.read.parquet(f"{scratch.root}/{name}").count()
    assert count("mixed") > 500 and count("members") == 0 and count("rare-near") < 600


def test_pairs_met_by_a_rare_shingle_only(spark, monkeypatch):
    """Without pairs in small buckets and with hubs that lead elsewhere the links still come from the rarest shingles."""
    rng = random.Random(5)
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    base, rows = words_of(rng, 120), []
    for k in range(80):
        own = base[: 40 + rng.randint(0, 50)] + words_of(rng, rng.randint(4, 30))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "x"]))]
    rows.append((3, rows[8][1]))  # an id with two texts
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cache, label = hash_cache(), {k: k for k, _ in rows}
    sets = [(k, set(shingle_set(t, cache).tolist())) for k, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 85 * len(x | y)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert out == label and len(set(label.values())) < len(label)


def test_sparse_bands_differ():
    """Bands of one hash are equal only if that hash is: registers of 16 bits would be equal by chance."""
    rng = np.random.default_rng(6)
    keys = [near_duplicates.band_keys(np.unique(rng.integers(0, 2**63, 40).astype(np.uint64) << np.uint64(1))) for _ in range(1000)]
    full = np.concatenate([k[k != 0] for k in keys])
    assert len(np.unique(full)) == len(full) > 20_000
    a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
    assert (near_duplicates.band_keys(a) == near_duplicates.band_keys(a)).all() and not near_duplicates.band_keys(a[:0]).any()
    assert ((near_duplicates.band_keys(a) == 0) == (near_duplicates.registers(a).view(np.int64) == 0)).all()


def test_many_ids_move_few_rows(spark):
    """300 000 ids, more than the 2^18 beyond which all texts were shuffled."""
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("_page")).unionByName(spark.createDataFrame([(None, "n", 1)], "doc_id long, text string, _page int"))
    ids = spark.range(300_000).select((F.col("id") * 3).alias("doc_id"))
    maybe, rest = split_by_ids(docs, ids)
    assert rest is not None and rest.columns == docs.columns == maybe.columns
    assert 300_000 <= maybe.count() < 320_000 and maybe.count() + rest.count() == 1_000_001
    assert with_ids(docs, ids).count() == 300_000 and without_ids(docs, ids).count() == 700_001


def test_shuffle_files_of_a_table_go(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in str(manager.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    before, conf = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(conf, None)
    table = Scratch(spark, "files").table(spark.range(100_000).groupBy(F.xxhash64("id").alias("h")).count(), "t")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(conf, None) == kept and table.count() == 100_000


def test_the_pipelines_stage_compares_no_family_of_one_line(spark, monkeypatch):
    """The same with the pipeline's limit and its own tables."""
    import corpus_pipeline

    rng, made = random.Random(3), []
    monkeypatch.setattr(corpus_pipeline, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    line = " ".join(words_of(rng, 14))
    rows = [(k, f"{line} {' '.join(words_of(rng, 40))}") for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " x" * 5) for k in range(0, 400, 40)] + [(None, rows[0][1]), (2000, None)]
    out = corpus_pipeline.one_of_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [*range(400), 2000] and len(out) == 402
    assert spark.read.parquet(f"{made[0].root}/mixed").count() > 300 and spark.read.parquet(f"{made[0].root}/members").count() == 0
