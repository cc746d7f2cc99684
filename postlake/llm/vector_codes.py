"""Vectors compressed to codes: a codebook per part of the vector, fitted in rounds with adaptive distance bounds.

Each part of each vector keeps its entry with an upper bound of the distance to it, the b next entries with ordered
lower bounds, and one lower bound for all others (Drake and Hamerly). When entries move, the bounds give way by as much. A part whose
upper bound stays below its lower bounds keeps its entry unseen; else the entries whose bounds don't rule them out are measured in
integers, ties included, and where the outer bound fails, all of them. b follows what was needed: it grows if many parts had to
measure all entries, and else shrinks to the deepest place that was looked at.

The bounds are written as a table each round; the sums of the parts of each entry come in one row per task, and only they and
the codebooks (parts times entries times length) go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from postlake.llm.rows import bounded_batches
from postlake.sources.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers of this size and more are left out like non-finite ones, as their squares' sums would not fit 64 bits.
LIMIT = 1 << 27
FIRST_B, LEAST_B = ENTRIES // 4, ENTRIES // 8
#: If more than this share of the parts had to measure every entry, b doubles.
MANY = 1 / 8
#: No entry: fills the list of a part that has fewer than b bounds.
NONE = 255
#: Bounds are widened by this share, which is more than the rounding of roots and of their sums.
_WIDER = 2.0**-40
_TYPES = {"short": T.ShortType(), "float": T.FloatType()}
_BOUNDS = {"entry": "short", "upper": "float", "near": "short", "lower": "float", "outer": "float", "looked": "short"}


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - _WIDER), 0)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + _WIDER)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances: x (..., d), entries (..., d)."""
    d = x.astype(np.int64) - entries
    return (d * d).sum(axis=-1)


def measured(x: np.ndarray, book: np.ndarray, b: int) -> tuple:
    """Of parts x (n, d) and one codebook (k, d): entry, upper, near (n, b), lower (n, b), outer, from all distances."""
    n, k = len(x), len(book)
    every = squares(x[:, None, :], book[None])
    order = np.argsort(every, axis=1, kind="stable")  # ties to the lower index
    far = np.sqrt(np.take_along_axis(every, order, axis=1).astype(np.float64))
    near, lower = np.full((n, b), NONE, dtype=np.int16), np.full((n, b), np.inf)
    width = min(b, k - 1)
    near[:, :width], lower[:, :width] = order[:, 1 : width + 1], _down(far[:, 1 : width + 1])
    outer = _down(far[:, width + 1]) if k > width + 1 else np.full(n, np.inf)
    return order[:, 0].astype(np.int16), _up(far[:, 0]), near, lower, outer


def renewed(x: np.ndarray, book: np.ndarray, drift: np.ndarray, entry: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, b: int) -> tuple:
    """The same after the entries moved by ``drift`` (k), and how deep each part was looked at: 0 not at all, z: z entries of its list, -1: all."""
    n = len(x)
    moved = np.append(drift, 0.0)  # of no entry
    upper, lower = upper + drift[entry], np.maximum(lower - moved[np.where(near == NONE, len(book), near)], 0)
    outer = np.maximum(outer - drift.max(initial=0.0), 0)
    looked = np.zeros(n, dtype=np.int16)
    closest = np.minimum(lower.min(axis=1, initial=np.inf), outer)
    unsure = np.flatnonzero(upper >= closest)
    upper[unsure] = _up(np.sqrt(squares(x[unsure], book[entry[unsure]]).astype(np.float64)))
    unsure = unsure[upper[unsure] >= closest[unsure]]

    every = unsure[upper[unsure] >= outer[unsure]]
    listed = unsure[upper[unsure] < outer[unsure]]
    if len(listed):
        # the entry itself comes first; those whose bound rules them out keep their bound
        names = np.concatenate([entry[listed, None], near[listed]], axis=1)
        open_ = np.concatenate([np.ones((len(listed), 1), dtype=bool), (lower[listed] <= upper[listed, None]) & (near[listed] != NONE)], axis=1)
        exact = squares(x[listed][:, None, :], book[np.where(names == NONE, 0, names)])
        order = np.lexsort((names, np.where(open_, exact, np.iinfo(np.int64).max)))
        best = order[:, 0]
        at = np.arange(len(listed))
        bounds = np.where(open_, _down(np.sqrt(exact.astype(np.float64))), np.concatenate([np.full((len(listed), 1), np.inf), lower[listed]], axis=1))
        looked[listed] = np.max(np.where(open_[:, 1:], np.arange(1, near.shape[1] + 1), 0), axis=1, initial=0)
        entry[listed], upper[listed] = names[at, best], _up(np.sqrt(exact[at, best].astype(np.float64)))
        bounds[at, best] = -1.0  # first, and then left out
        order = np.argsort(bounds, axis=1, kind="stable")[:, 1:]
        near[listed], lower[listed] = np.take_along_axis(names, order, axis=1), np.take_along_axis(bounds, order, axis=1)

    settled = np.setdiff1d(np.arange(n), np.concatenate([every, listed]), assume_unique=True)
    if len(settled):  # kept, but moved bounds may be out of order
        order = np.argsort(lower[settled], axis=1, kind="stable")
        near[settled], lower[settled] = np.take_along_axis(near[settled], order, axis=1), np.take_along_axis(lower[settled], order, axis=1)
    if near.shape[1] > b:
        outer = np.minimum(outer, lower[:, b:].min(axis=1))
        near, lower = near[:, :b].copy(), lower[:, :b].copy()
    elif near.shape[1] < b:
        near = np.concatenate([near, np.full((n, b - near.shape[1]), NONE, dtype=np.int16)], axis=1)
        lower = np.concatenate([lower, np.full((n, b - lower.shape[1]), np.inf)], axis=1)
    if len(every):
        entry[every], upper[every], near[every], lower[every], outer[every] = measured(x[every], book, b)
        looked[every] = -1
    return entry, upper, near, lower, outer, looked


def _single(bounds: np.ndarray, toward: float) -> np.ndarray:
    """Bounds as 32-bit numbers that lie on the safe side of them."""
    return np.nextafter(bounds.astype(np.float32), np.float32(toward))


def _lists(values: np.ndarray, dtype) -> pa.Array:
    """Rows of a two-dimensional array as lists."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel().astype(dtype)))


def _array(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS, -1)


def _assign(books: np.ndarray, drift: np.ndarray | None, b: int):
    """A task that renews the state of its rows, or makes it where ``drift`` is missing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            x = _array(get["x"], n)
            parts = []
            for k in range(PARTS):
                if drift is None:
                    parts.append((*measured(x[:, k], books[k], b), np.full(n, -1, dtype=np.int16)))
                else:
                    of = {c: _array(get[c], n)[:, k] for c in ("entry", "upper", "near", "lower", "outer")}
                    wide = lambda c: of[c].astype(np.float64)  # noqa: B023, E731
                    parts.append(renewed(x[:, k], books[k], drift[k], of["entry"][:, 0].copy(), wide("upper")[:, 0], of["near"].copy(), wide("lower"), wide("outer")[:, 0], b))
            entry, upper, near, lower, outer, looked = (np.stack([p[c] for p in parts], axis=1).reshape(n, -1) for c in range(6))
            columns = [get["vec_id"], get["label"], get["x"], _lists(entry, np.int16), _lists(_single(upper, np.inf), np.float32), _lists(near, np.int16)]
            columns += [_lists(_single(lower, -np.inf), np.float32), _lists(_single(outer, -np.inf), np.float32), _lists(looked, np.int16)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", *_BOUNDS])

    return work


def _sums(width: int):
    """A task's sums: of each entry's parts, position by position, their numbers, and how deep parts were looked at (0 .. ENTRIES - 1, all)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, width), dtype=np.int64)
        number, depth = np.zeros((PARTS, ENTRIES), dtype=np.int64), np.zeros(ENTRIES + 1, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if n:
                x, entry, looked = (_array(batch.column(k), n) for k in range(3))
                for k in range(PARTS):
                    np.add.at(total[k], entry[:, k, 0], x[:, k])
                    number[k] += np.bincount(entry[:, k, 0], minlength=ENTRIES)
                depth += np.bincount(np.where(looked < 0, ENTRIES, looked).ravel(), minlength=ENTRIES + 1)
        yield pa.RecordBatch.from_arrays([_lists(np.concatenate([total.ravel(), number.ravel(), depth])[None], np.int64)], names=["sums"])

    return work


def _errors(books: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x, entry = _array(batch.column(2), n), _array(batch.column(3), n)[:, :, 0]
                error = sum(squares(x[:, k], books[k][entry[:, k]]) for k in range(PARTS))
                code = ["".join(f"{e:02x}" for e in row) for row in entry]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return work


def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and x, the components as integers, of the rows whose vector is whole."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE))
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LIMIT / SCALE)
    whole = embeddings.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: F.coalesce(fits(v), F.lit(False))))
    return whole.select("vec_id", "label", x.cast("array<int>").alias("x"))


def _next_b(b: int, depth: list[int]) -> int:
    if depth[ENTRIES] > MANY * sum(depth):
        return min(2 * b, ENTRIES - 1)
    return max(LEAST_B, max((k for k in range(ENTRIES) if depth[k]), default=0))


def vector_codes(embeddings: DataFrame, vector: str = "embedding", rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept row of ``embeddings`` (vec_id, label, a vector; others ignored).

    Rows go whose vector is null, holds a null, a non-finite component or one beyond 2^15 (its squares would not fit), and those whose length
    isn't that of the first vec_id's vector or no multiple of 8. Vectors without components are alike, with entry 0 in every part. Fewer than 16 rows make smaller codebooks, an empty table none and no rows. A null
    vec_id comes last among the starting vectors, equal vec_ids go by their vectors; repeated rows count each. Null labels are one label.
    """
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark, "codes")
    bounded_batches(spark)
    kept = integers(embeddings, vector)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).collect()
    size = len(first[0]["x"]) if first else 0
    kept = kept.where((F.size("x") == size) & (F.lit(size) % PARTS == 0))
    start = [r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()]
    width = size // PARTS
    if not start or not width:
        none = kept.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    books = np.array(start, dtype=np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()

    b, drift = FIRST_B, None
    state, schema = kept, T.StructType([*kept.schema.fields, *(T.StructField(c, T.ArrayType(_TYPES[t])) for c, t in _BOUNDS.items())])
    for k in range(rounds + 1):
        state = scratch.table(state.mapInArrow(_assign(books, drift, b), schema), f"bounds-{k}")
        if k:
            scratch.drop(f"bounds-{k - 1}")
        if k == rounds:
            break
        tasks = state.select("x", "entry", "looked").mapInArrow(_sums(width), "sums array<long>")
        found = tasks.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # a bounded number of sums
        sums = [0] * (PARTS * ENTRIES * (width + 1) + ENTRIES + 1)
        for row in found:
            sums[row["at"]] = int(row["n"])
        old, split = books.copy(), PARTS * ENTRIES * width
        for part in range(PARTS):
            for entry in range(books.shape[1]):
                n, at = sums[split + part * ENTRIES + entry], (part * ENTRIES + entry) * width
                if n:
                    books[part, entry] = [s // n for s in sums[at : at + width]]
        drift = _up(np.sqrt(squares(books, old).astype(np.float64)))
        b = _next_b(b, sums[-ENTRIES - 1 :])

    coded = scratch.table(state.select("vec_id", "label", "x", "entry").mapInArrow(_errors(books), T.StructType([*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "codes", small=True)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    digest = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
