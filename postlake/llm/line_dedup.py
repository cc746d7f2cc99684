"""Removes later copies of repeated runs of lines, found by winnowing over line hashes. DataFrame functions only.

Lines with at least one word count; blank ones stay where they are. A gram is the shortest run of lines, from some
line on, that holds ``GRAM`` words; of every stretch of grams that starts within ``RUN - GRAM`` words the smallest hash
is selected. So any run of whole lines with ``RUN`` words or more has a selected gram, and the same one wherever
the run stands: documents are first joined on the places of their selected grams, and only stretches around a gram that
occurs twice go on.

There each match is extended both ways: a line's runs are the shortest stretch of lines with ``RUN`` words that begins with it and
the shortest that ends with it. Any longer match is the union of such runs, so equal runs (by hash of their lines) give every
match, with whatever place it is shared. The first place of a run (by doc_id, then line) is the source of all others, found by a
partial minimum and never by pairs; the later places are removed. Every removed line has an equal one at an earlier place that is not
removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.llm.rows import split_by_ids
from postlake.sources.scratch import Scratch

RUN = 50
GRAM = 25
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\x0b\x0c\r"


def line_parts(text: Column) -> Column:
    """For each line with a word: its index among all lines, the hash of the line without outer blanks, its words."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(F.btrim(x, F.lit(BLANKS))).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return F.filter(every, lambda x: x["words"] > 0)


def _lines(parts: DataFrame, *others: str) -> DataFrame:
    """A row per line with words: pos, line, hash, and the document's words before it (start), with it (end) and in all (total)."""
    lines = parts.select("doc_id", "version", *others, F.posexplode("parts").alias("pos", "part"))
    doc = Window.partitionBy("doc_id", "version")
    words = F.col("part.words").cast("long")
    end = F.sum(words).over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("end", end).withColumn("total", F.sum(words).over(doc))
    return lines.select("doc_id", "version", *others, "pos", F.col("part.line").alias("line"), F.col("part.hash").alias("hash"), (F.col("end") - words).alias("start"), "end", "total")


def fingerprints(parts: DataFrame) -> DataFrame:
    """Selected grams: doc_id, version, pos (among the lines with words), gram."""
    lines = _lines(parts)
    ahead = Window.partitionBy("doc_id", "version").orderBy("start")
    grams = lines.withColumn("gram", F.xxhash64(F.collect_list("hash").over(ahead.rangeBetween(0, GRAM - 1))))
    # the least gram, and of equal ones the last: bits are turned, as the least long has no negative
    best = F.max(F.struct(F.bitwise_not("gram").alias("low"), "pos")).over(ahead.rangeBetween(0, RUN - GRAM - 1))
    chosen = grams.withColumn("best", best).where(F.col("total") - F.col("start") >= RUN)
    return chosen.select("doc_id", "version", F.col("best.pos").alias("pos"), F.bitwise_not("best.low").alias("gram")).distinct()


def runs(parts: DataFrame, places: DataFrame) -> DataFrame:
    """For each line the shortest runs of ``RUN`` words that begin and end with it: key, doc_id, version, pos, lines.

    ``places`` (doc_id, version, low, high) names the documents to look at and the first and last gram there that occurs twice.
    """
    lines = _lines(parts.join(places.hint("merge"), ["doc_id", "version"]), "low", "high")
    doc = Window.partitionBy("doc_id", "version")

    def run(stretch, whole: Column) -> Column:
        hashes, numbers = F.collect_list("hash").over(stretch), F.collect_list("line").over(stretch)
        return F.struct(F.xxhash64(hashes).alias("key"), F.min("pos").over(stretch).alias("pos"), numbers.alias("lines"), whole.alias("whole"))

    ahead = run(doc.orderBy("start").rangeBetween(0, RUN - 1), F.col("total") - F.col("start") >= RUN)
    behind = run(doc.orderBy("end").rangeBetween(1 - RUN, 0), F.col("end") >= RUN)
    lines = lines.select("doc_id", "version", "low", "high", ahead.alias("ahead"), behind.alias("behind"))
    found = lines.select("doc_id", "version", "low", "high", F.explode(F.array("ahead", "behind")).alias("run")).where("run.whole")
    # a run holds lines one after the other, so its last one is known from their number
    found = found.where((F.col("run.pos") <= F.col("high")) & (F.col("run.pos") + F.size("run.lines") > F.col("low")))
    return found.select("run.key", "doc_id", "version", "run.pos", "run.lines")


def removed_lines(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, version, removed: the sorted indexes of the lines to remove. Documents that keep all aren't listed."""
    prints = scratch.table(fingerprints(parts), "fingerprints")
    twice = prints.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    places = prints.join(twice, "gram").groupBy("doc_id", "version").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    found = scratch.table(runs(parts, places), "runs")
    place = F.struct("doc_id", "version", "pos")
    firsts = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("key", "first")
    gone = found.join(firsts, "key").where(place > F.col("first")).select("doc_id", "version", F.explode("lines").alias("line")).distinct()
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("line")).alias("removed"))  # at most a document's lines


def dedupe_lines(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` with shortened ``text``, and n_lines (all lines) and removed (array of indexes from 0).

    A row without doc_id or without words stays as it is and is no source; a null text stays null, with no lines.
    Rows that repeat a doc_id and its text count as one document and are shortened alike; one doc_id with
    several texts counts as several documents, in the order of their hashes. Ties can't occur: places are ordered by document and line.
    The joins with documents are merge joins at every size, as the other side grows with the corpus. Long texts are taken whole; a window holds one document's lines, which may spill. An empty table gives none. Columns of the
    input stay, whatever their names; any named n_lines or removed are replaced.
    """
    scratch = scratch or Scratch(documents.sparkSession, "lines")
    documents = documents.drop("n_lines", "removed")
    versions = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), line_parts(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    parts = scratch.table(versions.dropDuplicates(["doc_id", "version"]), "parts")
    gone = scratch.table(removed_lines(parts, scratch).withColumnRenamed("doc_id", "gone id").withColumnRenamed("version", "gone version").withColumnRenamed("removed", "gone lines"), "gone")
    lines, none = F.split("text", "\n"), F.array().cast("array<int>")
    own = [F.col(f"`{c}`") for c in documents.columns]
    counted = F.coalesce(F.size(lines), F.lit(0)).alias("n_lines")
    maybe, untouched = split_by_ids(documents, gone.select(F.col("gone id").alias("doc_id")))
    joined = maybe.join(gone.hint("merge"), (F.col("doc_id") == F.col("gone id")) & (F.xxhash64("text") == F.col("gone version")), "left")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone lines", i)), "\n")
    text = F.when(F.col("gone lines").isNull(), F.col("text")).otherwise(rest).alias("text")
    out = joined.select(*(text if c == "text" else x for c, x in zip(documents.columns, own)), counted, F.coalesce("gone lines", none).alias("removed"))
    return out if untouched is None else untouched.select(*own, counted, none.alias("removed")).unionByName(out)
