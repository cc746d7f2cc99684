"""How far the sources of each language differ in their words, and by which words.

One CountVectorizer is fitted to the terms of all documents; it sees each term of a document once, as only the number of documents matters there.
Its model makes the exact sparse document vectors, which are summed per group by partial aggregation, entry by entry, together
with the number of their documents: so a language keeps the terms that its own documents reach, which are among the fitted ones. Two sources
are compared over blocks of terms and blocks of sources: a task holds at most ``SOURCES`` times two sources and ``TERMS`` terms, and
terms that no source of a block has are added by their number.

CountVectorizer keeps its vocabulary on the driver and broadcasts it: the terms that at least ``min_docs`` documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm.rows import bounded_batches
from postlake.sources.scratch import Scratch

MIN_DOCS = 30
TOP_TERMS = 50
ADDED = 5
UNIT = 1_000_000_000
#: Bytes of UTF-8: letters in lower case, those of characters outside ASCII as they are, a space for all others.
_TERM_BYTES = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 128 else 32 for k in range(256))
TERMS, SOURCES = 512, 256
_PART = "lang string, a int, b int, seen long, value long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All texts of a batch have their bytes replaced at once, which keeps their lengths, and are then cut at spaces."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        _, ends, data = texts.buffers()
        plain = pa.Array.from_buffers(texts.type, len(texts), [None, ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(_TERM_BYTES))], offset=texts.offset)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source")), pc.ascii_split_whitespace(plain)], names=["lang", "source", "tokens"])


def tokenised(documents: DataFrame) -> DataFrame:
    """lang, source and tokens of ``documents`` without nulls: runs of letters A-Z and characters outside ASCII, with A-Z lower-cased; and maybe empty ones."""
    bounded_batches(documents.sparkSession)
    return documents.select("lang", "source", "text").mapInArrow(_cut, "lang string, source string, tokens array<string>")


def scaled(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in exact arithmetic."""
    whole = lambda c: c.cast("decimal(20,0)")
    top, below = (whole(count) + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), whole(total) + whole(kept) * ADDED
    return 1 + F.call_function("div", top, below)


def group_counts(documents: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, term_no, n) of the kept terms of every group, and the vocabulary (lang, term_no, term)."""
    spark = documents.sparkSession
    docs = tokenised(documents)  # cutting twice is cheaper than a table of tokens
    fitted = CountVectorizer(inputCol="tokens", outputCol="counts", minDF=min_docs, vocabSize=2**31 - 1).fit(docs.select(F.array_distinct("tokens").alias("tokens")))
    terms = pd.DataFrame({"term": fitted.vocabulary}).rename_axis("term_no").reset_index().astype({"term_no": np.int32})
    terms = terms[terms["term"] != ""]  # what stands before a first term or behind the last
    if not len(terms):
        return spark.createDataFrame([], "lang string, source string, term_no int, n long"), spark.createDataFrame([], "lang string, term_no int, term string")
    entries = fitted.transform(docs).select("lang", "source", F.unwrap_udt("counts").alias("v")).select("lang", "source", F.inline(F.arrays_zip("v.indices", "v.values")).alias("term_no", "n"))
    sums = scratch.table(entries.groupBy("lang", "source", "term_no").agg(F.sum(F.col("n").cast("long")).alias("n"), F.count("*").alias("docs")), "sums")
    kept = sums.groupBy("lang", "term_no").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    vocabulary = scratch.table(kept.join(spark.createDataFrame(terms, "term_no int, term string"), "term_no").select("lang", "term_no", "term"), "vocabulary", small=True)
    counts = sums.drop("docs").join(vocabulary.select("lang", "term_no"), ["lang", "term_no"], "left_semi").select("lang", "source", "term_no", "n")
    return scratch.table(counts, "counts", small=True), vocabulary


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of a block that any of its sources has, for pairs of a left and a right source."""
    lang, low, high, _ = key
    no, term_no, p = (rows[c].to_numpy() for c in ("no", "term_no", "p"))
    names, at = np.unique(no, return_inverse=True)
    zero, block = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    zero[at], block[at] = rows["zero"].to_numpy(), rows["block"].to_numpy()
    counted = term_no >= 0
    numbers, term = np.unique(term_no[counted], return_inverse=True)
    weight = np.repeat(zero[:, None], len(numbers), axis=1)
    weight[at[counted], term] = p[counted]
    left, right, sums = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for k in np.flatnonzero(block == low):
        others = np.flatnonzero((block == high) & (names > names[k]))
        left.append(np.full(len(others), k))
        right.append(others)
        sums.append(np.abs(weight[others] - weight[k]).sum(axis=1))
    a, b = (names[np.concatenate(x)] for x in (left, right))
    return pd.DataFrame({"lang": np.full(len(a), lang, dtype=object), "a": a, "b": b, "seen": len(numbers), "value": np.concatenate(sums)})


def pair_values(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for both orders of each pair of sources of a language.

    ``weights`` (lang, source, term_no, p) has the counted terms; ``groups`` (lang, source, no, zero, kept) every group, numbered within its language,
    ``zero`` being the p of a term that it lacks. Every group also has a row without a term in each block of terms of its language, so that it is
    compared there, and in a block -1. Each row goes to every block of sources once, so it is copied as often as a language has ``SOURCES`` sources.
    """
    bounded_batches(weights.sparkSession)
    size, terms_at_once = F.lit(SOURCES), F.lit(TERMS)
    weights = weights.withColumn("part", F.floor(F.col("term_no") / terms_at_once).cast("int"))
    parts = weights.select("lang", "part").distinct().unionByName(groups.select("lang", F.lit(-1).alias("part")).distinct())
    last = groups.groupBy("lang").agg(F.floor(F.max("no") / size).cast("int").alias("last"))
    known = groups.join(last, "lang").select("lang", "source", "no", "zero", "last", F.floor(F.col("no") / size).cast("int").alias("block"))
    none = known.join(parts, "lang").withColumns({"term_no": F.lit(-1), "p": F.lit(0).cast("long")})
    rows = weights.join(known, ["lang", "source"]).unionByName(none)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", "no", "block", "zero", "term_no", "p")
    pairs = rows.groupBy("lang", "low", "high", "part").applyInPandas(_compare, _PART).groupBy("lang", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("value").alias("value"))
    side = lambda name: groups.select("lang", F.col("no").alias(name), F.col("source").alias(f"source_{name}"), F.col("zero").alias(f"zero_{name}"), "kept")
    pairs = pairs.join(side("a"), ["lang", "a"]).join(side("b").drop("kept"), ["lang", "b"])
    found = pairs.withColumn("value", F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("zero_a") - F.col("zero_b")))
    both = lambda x, y: F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item"), "value")
    return found.select("lang", F.inline(F.array(both("a", "b"), both("b", "a"))))


def source_divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value and rank of ``documents`` (text, lang, source; nulls are empty, other columns are ignored).

    Part ``pair`` has every other source of the language with the sum of |p - q| over all kept terms, part ``term`` the ``top_terms`` terms
    by which a source most exceeds its language; ranks go by value, then by the item's bytes. A group without terms has p of count 0
    for each kept term, and value 0 if its language keeps none. Texts are taken whole, repeated rows count each. An empty table gives no rows; a
    language with one source has no pairs.
    """
    scratch = scratch or Scratch(documents.sparkSession, "divergence")
    given = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts, vocabulary = group_counts(given, min_docs, scratch)
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = scratch.table(given.select("lang", "source").distinct(), "found", small=True)
    groups = found.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    zero = F.when(F.col("kept") > 0, scaled(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # of sources, whose pairs are rows of the result
    groups = scratch.table(groups.withColumns({"zero": zero, "no": number}), "groups", small=True)
    of_lang = counts.groupBy("lang", "term_no").agg(F.sum("n").alias("n")).join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept")), "lang")
    of_lang = of_lang.select("lang", "term_no", scaled(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    weights = counts.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
    weights = scratch.table(weights.select("lang", "source", "term_no", scaled(F.col("n"), F.col("total"), F.col("kept")).alias("p")), "weights", small=True)

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = weights.join(of_lang, ["lang", "term_no"]).where("p > q").join(vocabulary, ["lang", "term_no"])
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)
    pairs = pair_values(weights, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(over)
