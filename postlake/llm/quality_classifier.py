"""Quality scores: random-indexing vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlake.llm.features import DIMENSIONS, pooler, remainder, word_vectors
from postlake.llm.rows import add_columns

#: Labelled rows for the fit at most, those with the smallest hashes of their ids. All else covers every row.
SAMPLE = 20_000
HIDDEN = 24
EPOCHS = 60
_X = T.StructField("x", T.ArrayType(T.FloatType()))


class Network:
    """Standardised inputs, one layer of tanh units, one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        n, d = x.shape if len(x) else (0, 2 * DIMENSIONS)
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-4) if n else (np.zeros(d), np.ones(d))
        self.w1, self.b1 = rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2, self.temperature = np.zeros(HIDDEN), 0.0, 1.0
        if not n or y.min() == y.max():  # nothing to tell apart
            self.b2 = float(np.clip(2 * y.mean() - 1, -1, 1)) if n else 0.0
            return
        held = rng.random(n) < 0.2
        held[:2] = False
        self._fit(x[~held], y[~held], rng)
        self._calibrate(x[held], y[held])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; both classes weigh the same."""
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        self.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        z = (x - self.mean) / self.scale
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for part in np.array_split(order, max(1, len(z) // 128)):
                h = np.tanh(z[part] @ self.w1 + self.b1)
                error = weight[part] * (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[part]) / len(part)
                back = np.outer(error, self.w2) * (1 - h * h)
                slopes = {"w1": z[part].T @ back + 1e-4 * self.w1, "b1": back.sum(axis=0), "w2": h.T @ error + 1e-4 * self.w2, "b2": error.sum()}
                t += 1
                for k in names:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * slopes[k], 0.999 * v[k] + 0.001 * slopes[k] ** 2
                    setattr(self, k, getattr(self, k) - 0.01 * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least cross entropy on rows that the weights haven't seen."""
        if not len(y):
            return
        z, grid = self.logits(x), np.geomspace(0.2, 20, 60)
        loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_quality(documents: DataFrame, labels: DataFrame, train: Column | None = None) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and the network from labelled ones; ``train`` says which ids may be learnt from."""
    vectors = word_vectors(documents)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    if train is not None:
        known = known.where(train)
    chosen = known.join(documents.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = add_columns(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), [_X], lambda: pooler(vectors)).select("doc_id", "x", "quality").toArrow().to_pandas()
    sample = sample.sort_values("doc_id", kind="stable")
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, 2 * DIMENSIONS)
    return vectors, Network(x, sample["quality"].to_numpy(dtype=np.float64))


def classify_quality(documents: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """``documents`` (doc_id, text and any others) with score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    ``labels`` has doc_id and quality; ``train`` is a condition on doc_id that says which rows may be learnt from (all by
    default). A document with several labels counts with the rounded mean; null labels don't count. Texts that are null or
    have no words get the score of the zero vector. Without labels of both classes every row gets the same score. Columns named
    score or predicted are replaced. Inputs of a score are the text's words alone. Long texts are pooled whole, repeated rows are scored alike, an empty table
    gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(fit_quality(documents, labels, train))

    def scorer():
        vectors, network = sent.value
        pool = pooler(vectors)

        def score(texts: list) -> list[list]:
            values = network.score(np.array(pool(texts)[0], dtype=np.float64).reshape(-1, 2 * DIMENSIONS))
            return [values, (values >= 0.5).astype(np.int32)]

        return score

    return add_columns(documents, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], scorer)


def held_out_ids() -> Column:
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``classify_quality`` that learns from ids whose crc32 modulo 3 is not 1; adds held_out for those where it is."""
    return classify_quality(documents, labels, ~held_out_ids()).withColumn("held_out", held_out_ids())
