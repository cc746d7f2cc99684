"""Bounded numeric features of texts: hashed words, hashed shapes of words, random-indexing vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlake.llm.rows import bounded_batches
from postlake.llm.words import WordTable, each

BUCKETS = 1 << 14
#: The upper quarter of the buckets is for shapes, so words and shapes never share one.
WORD_BUCKETS = BUCKETS * 3 // 4
DIMENSIONS = 32
_NONZERO = 4
_BLOCK = 256
_KINDS = bytes(ord("A") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else ord("a") if c >= 97 and c <= 122 or c >= 128 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_EDGES = bytes(set(range(33, 127)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _buckets(word: bytes) -> tuple[int, int]:
    """Of the bare lower-case word and of its shape, such as Aa, a, or AA! with runs of one kind cut to one."""
    core = word.strip(_EDGES).lower() or word
    shape = _RUN.sub(rb"\1", word.translate(_KINDS))[:8]
    return xxhash.xxh32_intdigest(core) % WORD_BUCKETS, WORD_BUCKETS + xxhash.xxh32_intdigest(shape, seed=1) % (BUCKETS - WORD_BUCKETS)


def bucket_cache() -> WordTable:
    return WordTable(each(_buckets), (np.int64, np.int64))


def token_buckets(text: str | None, cache: WordTable) -> np.ndarray:
    """A row (word's bucket, shape's bucket) for each word of the whole text."""
    tokens = text.encode("utf-8", "surrogatepass").split() if text else []
    return np.stack(cache.rows(tokens), axis=1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The few positions and signs in which a bucket's index vector isn't zero."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMENSIONS, (BUCKETS, _NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, _NONZERO))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, sign = index_vectors()
    cache, total = bucket_cache(), np.zeros(BUCKETS * DIMENSIONS)

    def flush(rows: list[np.ndarray]) -> None:
        b = np.concatenate(rows)  # an empty row (-1) stands between texts
        for near, of in ((b[1:], b[:-1]), (b[:-1], b[1:])):
            ok = (near[:, 0] >= 0) & (of[:, 0] >= 0)
            for column in (0, 1):
                n, o = near[ok, 0], of[ok, column]
                np.add(total, np.bincount((o[:, None] * DIMENSIONS + at[n]).ravel(), sign[n].ravel(), minlength=len(total)), out=total)

    gap = np.full((1, 2), -1, dtype=np.int64)
    pending, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            rows = token_buckets(text, cache)
            if len(rows):
                pending += [rows, gap]
                size += len(rows)
            if size > 500_000:
                flush(pending)
                pending, size = [], 0
    if pending:
        flush(pending)
    blocks = total.astype(np.float32).reshape(-1, _BLOCK * DIMENSIONS)
    yield pd.DataFrame({"block": np.arange(len(blocks)), "sums": [x.tobytes() for x in blocks]})


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch["block"], batch["sums"]):
            x = np.frombuffer(data, dtype=np.float32).astype(np.float64)
            sums[block] = sums[block] + x if block in sums else x
    yield pd.DataFrame({"block": list(sums), "sums": [x.astype(np.float32).tobytes() for x in sums.values()]})


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all buckets, from the neighbours of every word of every text.

    A task adds up the index vectors of the words before and after each word; tasks send 2 MB each, and the sums of a
    block of buckets are added as they stream by. The result has a fixed size, whatever the corpus.
    """
    bounded_batches(documents.sparkSession)
    parts = documents.select("text").mapInPandas(_contexts, "block int, sums binary")
    sums = parts.repartition(BUCKETS // _BLOCK, "block").mapInPandas(_add, "block int, sums binary").toArrow().to_pandas().sort_values("block")
    vectors = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    if len(sums):
        vectors = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in sums["sums"]]).reshape(BUCKETS, DIMENSIONS)
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    return vectors - vectors.mean(axis=0)


def pooler(vectors: np.ndarray):
    """A function from texts to one column: the mean vector of a text's words and that of their shapes; zeros without words."""
    cache = bucket_cache()

    def pool(texts: list) -> list[list]:
        rows = []
        for text in texts:
            b = token_buckets(text, cache)
            rows.append(np.concatenate([vectors[b[:, 0]].mean(axis=0), vectors[b[:, 1]].mean(axis=0)]) if len(b) else np.zeros(2 * DIMENSIONS, dtype=np.float32))
        return [rows]

    return pool


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
