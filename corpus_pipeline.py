"""From raw documents to a weighted training mix. Each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.llm.decontamination import find_leaks
from postlake.llm.line_dedup import dedupe_lines
from postlake.llm.mixing import mix
from postlake.llm.near_duplicates import near_duplicates
from postlake.llm.quality_classifier import classify_quality
from postlake.llm.rows import without_ids
from postlake.sources.scratch import Scratch
from postlake.sources.tables import table

#: After the quality stage junk has gone, so the mix is between clean and toxic text.
MIX = (("clean", "toxic = 0", 0.97), ("toxic", "toxic = 1", 0.03))
#: Near copies are those whose sets of five-word shingles have at least this Jaccard similarity, in hundredths.
SIMILAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from all labels.

    Null and empty texts are scored as the zero vector and stay or go by that. Repeated rows are judged alike, ties (a score
    of exactly 0.5) stay, long texts are read whole. Without labels of both classes all rows get one score and stay. An empty table
    gives none. Other columns, of whatever name, are kept; score and predicted are left out.
    """
    return classify_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; a document of which no word is left goes.

    Rows without doc_id, with a null or with a blank text stay as they are, as nothing was removed from them. Of equal runs the one with the
    smallest doc_id, then line, stays. Repeated rows are shortened alike. n_chars follows the text where it changed. Long texts are read
    whole. An empty table gives none; other columns are kept.
    """
    out = dedupe_lines(docs).where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without doc_id and null, empty or blank texts are in no group and stay; repeated rows stay together. Long texts are read
    whole. An empty table gives none; other columns are kept.
    """
    scratch = Scratch(spark, "one")
    return without_ids(docs, scratch.table(near_duplicates(docs, scratch, SIMILAR).where("not kept").select("doc_id"), "others"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.

    Rows without doc_id and null or empty texts stay; a benchmark without items leaves all. Repeated rows go together. Long texts are read
    whole. An empty table gives none; other columns are kept.
    """
    scratch = Scratch(spark, "clean")
    return without_ids(docs, scratch.table(find_leaks(docs, table(spark, sf_dir, "benchmark"), scratch).select("doc_id"), "leaks"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate and number of copies that give the target mix.

    Null and empty texts have no tokens and the prior's rate; repeated rows get the same rate each; long texts are read whole. An
    empty table gives none. Columns named tokens, rate or copies are replaced, others kept.
    """
    return mix(docs, table(spark, sf_dir, "labels"), domains=MIX).select(*(c for c in docs.columns if c not in ("tokens", "rate", "copies")), "tokens", "rate", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near duplicates", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

#: A network, iterations to convergence: no SQL statement gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
