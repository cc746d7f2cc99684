"""Descriptions as typed blocks, and other tables of text parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postlake.functions.text import clean_bullet, clean_header, is_bullet, is_section_header, trim


def text_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, block_no, type, content, items): headers, lists and paragraphs.

    Lines are numbered, and a running count of starts makes the blocks. A blank line ends a list, but not a
    paragraph: the next plain line goes on with it.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", trim(F.col("line")))
    kind = F.when(F.col("line") == "", "blank").when(is_section_header(F.col("line")), "header").when(is_bullet(F.col("line")), "list").otherwise("paragraph")
    lines = lines.withColumn("kind", kind)
    in_text = Window.partitionBy(key).orderBy("line_no")
    before = F.lag("kind").over(in_text)
    filled = lines.withColumn("before", before).where("kind <> 'blank'").withColumn("last", F.lag("kind").over(in_text))
    starts = (F.col("kind") == "header") | F.col("last").isNull() | (F.col("last") != F.col("kind")) | ((F.col("kind") == "list") & (F.col("before") == "blank"))
    numbered = filled.withColumn("block_no", F.sum(starts.cast("int")).over(in_text))
    content = F.when(F.col("kind") == "list", clean_bullet(F.col("line"))).when(F.col("kind") == "header", clean_header(F.col("line"))).otherwise(F.col("line"))
    parts = numbered.select(key, "block_no", "kind", F.struct("line_no", content.alias("content")).alias("part"))
    blocks = parts.groupBy(key, "block_no", F.col("kind").alias("type")).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    texts_of = F.col("parts.content")
    return blocks.select(key, F.col("block_no").cast("int").alias("block_no"), "type", F.when(F.col("type") != "list", F.array_join(texts_of, " ")).alias("content"), F.when(F.col("type") == "list", texts_of).alias("items"))


def _cut(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut behind a sentence or line where one ends late enough."""
    out = []
    while len(text) > most:
        end = max(text.rfind(x, 0, most) for x in (". ", "! ", "? ", "\n"))
        at = end + 1 if end > most * 0.3 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def chunks(texts: DataFrame, key: str, text: str, most: int = 450) -> DataFrame:
    """Rows (key, chunk_no, chunk). Each cut depends on the one before, so tasks walk through their texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text]) for i, c in enumerate(_cut(t or "", most))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return texts.select(key, text).mapInPandas(work, f"{key} {dict(texts.dtypes)[key]}, chunk_no int, chunk string")
