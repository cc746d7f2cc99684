"""Remote enrichment behind one protocol: keys in, JSON out, errors as a column. Tests use the offline providers."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlake.sources.schemas import SECTION


class Provider(Protocol):
    """Answers one key; a raised error becomes the row's error."""

    def ask(self, key: str) -> dict: ...


class FakeGeocoder:
    """Places made up from the words of the key, always the same for one key."""

    def ask(self, key: str) -> dict:
        parts = [p.strip().title() for p in key.replace("-", ",").split(",") if p.strip()]
        if not parts:
            raise ValueError("nothing to look up")
        return {"original": key, "city": parts[-1], "country": parts[0], "countryCode": parts[0][:2].upper(), "confidence": 0.5}


class FakeClassifier:
    """A role by a hash of the title."""

    def __init__(self, roles: list[str]):
        self.roles = roles

    def ask(self, key: str) -> dict:
        n = int(hashlib.sha1(key.encode()).hexdigest(), 16)
        return {"roleId": self.roles[n % len(self.roles)] if self.roles else None, "confidence": ("high", "medium", "low")[n % 3], "reasoning": f"hash {n % 1000}"}


class FakeStructurer:
    """A paragraph section of each line of the text."""

    def ask(self, key: str) -> dict:
        return {"sections": [{"title": f"Part {k + 1}", "type": "paragraph", "content": x} for k, x in enumerate(key.split("\n")) if x.strip()], "extractedSkills": []}


def enrich(keys: DataFrame, key: str, provider: Provider, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """Rows (key, response, error) for the distinct keys: each is asked once, ``retries`` times at most, with growing pauses.

    ``pause`` seconds pass between questions of a task; the number of partitions bounds how many are asked at once.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch[key]:
                response, error = None, None
                for attempt in range(retries):
                    try:
                        response, error = json.dumps(provider.ask(k), sort_keys=True), None
                        break
                    except Exception as e:  # noqa: BLE001  the row tells
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**attempt)
                rows.append((k, response, error))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[key, "response", "error"])

    return keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct().mapInPandas(work, f"{key} string, response string, error string")


def json_of_answer(text: Column) -> Column:
    """The object in a model's answer, without code fences and talk around it."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def sections_of_answer(text: Column) -> Column:
    """Valid sections: title and content given, type paragraph with text or list with items."""
    raw = T.StructType([T.StructField("sections", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content", T.StringType())])))])
    parsed = F.from_json(json_of_answer(text), raw)["sections"]
    items = lambda s: F.from_json(s["content"], T.ArrayType(T.StringType()))
    valid = lambda s: F.coalesce((s["title"] != "") & (s["content"] != "") & ((s["type"] == "paragraph") | ((s["type"] == "list") & items(s).isNotNull())), F.lit(False))
    shape = lambda s: F.struct(s["title"].alias("title"), s["type"].alias("type"), F.when(s["type"] == "paragraph", s["content"]).alias("content_text"), F.when(s["type"] == "list", items(s)).alias("content_items")).cast(SECTION)
    return F.transform(F.filter(parsed, valid), shape)


def sections_text(sections: Column) -> Column:
    return F.array_join(F.flatten(F.transform(sections, lambda s: F.coalesce(s["content_items"], F.array(s["content_text"])))), "\n")


def fresh(fetched_at: Column, now: Column, days: int = 30) -> Column:
    """Whether a cached answer may still be used."""
    return fetched_at > now - F.make_interval(days=F.lit(days))
