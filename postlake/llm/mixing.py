"""Rates per document that give each domain its target share of tokens, with soft membership in domains.

Domains are the values of a labelled table. A multinomial logistic model on hashed words and their shapes, fitted to a
bounded sample of labelled rows, gives each document posterior probabilities. The rates r >= 0 closest to 1 (by tokens)
are sought whose expected tokens per domain, the sum of tokens * posterior * r, equal the targets in least squares.

The projected gradient is distributed: the gradient of a document's rate is its posterior times one number per domain, so
the state is that handful of numbers y and a rate is max(0, 1 - posterior . y). A round sums the domains' tokens at the
projected rates in one aggregation, and steps along the gradient, scaled by the
Gram matrix of the domains over documents with positive rates, which comes from the same aggregation.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlake.llm.features import BUCKETS, bucket_cache, token_buckets
from postlake.llm.rows import add_columns
from postlake.sources.scratch import Scratch

#: Labelled rows for the fit at most, those with the smallest hashes of their ids.
SAMPLE = 10_000
EPOCHS = 8
ROUNDS = 40
#: Relative distance of a domain's tokens from its target beyond which a warning says so.
FAR = 0.01
#: What the mean squared distance of rates from 1 weighs against squared distances of shares; it decides where targets can't be met.
CLOSE = 1e-4
#: Domain, the condition on the labels that makes it, and its target share of the tokens.
DOMAINS = (("clean", "quality = 1 and toxic = 0", 0.85), ("toxic", "quality = 1 and toxic = 1", 0.03), ("junk", "quality = 0", 0.12))


class Softmax:
    """Multinomial logistic regression on sets of buckets; inputs are scaled to unit length."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, classes: int, seed: int = 5):
        self.w, self.b = np.zeros((BUCKETS, classes)), np.zeros(classes)
        rng = np.random.default_rng(seed)
        if len(y):
            self.b = np.log((np.bincount(y, minlength=classes) + 1.0) / (len(y) + classes))
        for epoch in range(EPOCHS if len(y) else 0):
            rate = 2.0 / (1 + epoch)
            for k in rng.permutation(len(y)):
                terms = rows[k]
                if len(terms):
                    scale = len(terms) ** -0.5
                    error = self._soft(self.w[terms].sum(axis=0) * scale + self.b)
                    error[y[k]] -= 1
                    self.w[terms] -= rate * scale * error
                    self.b -= 0.05 * rate * error

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def posterior(self, terms: np.ndarray) -> np.ndarray:
        return self._soft(self.w[terms].sum(axis=0) * len(terms) ** -0.5 + self.b) if len(terms) else self._soft(self.b)


def fit_domains(documents: DataFrame, labels: DataFrame, domains=DOMAINS) -> Softmax:
    domain = F.coalesce(*(F.when(F.expr(condition), k) for k, (_, condition, _) in enumerate(domains)))
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.join(documents.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def terms():
        cache = bucket_cache()
        return lambda texts: [[np.unique(token_buckets(x, cache)).astype(np.int32) for x in texts]]

    rows = add_columns(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), [T.StructField("terms", T.ArrayType(T.IntegerType()))], terms)
    sample = rows.select("doc_id", "domain", "terms").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    return Softmax([np.array(x, dtype=np.int64) for x in sample["terms"]], sample["domain"].to_numpy(dtype=np.int64), len(domains))


def with_posteriors(documents: DataFrame, model) -> DataFrame:
    """``documents`` with tokens (words of the whole text) and posterior, one per domain; ``model``: a broadcast Softmax."""

    def judge():
        cache, softmax = bucket_cache(), model.value

        def work(texts: list) -> list[list]:
            found = [token_buckets(x, cache) for x in texts]
            return [[len(b) for b in found], [softmax.posterior(np.unique(b)) for b in found]]

        return work

    return add_columns(documents, [T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))], judge)


def _rate(y: np.ndarray) -> Column:
    dot = sum((F.get("posterior", k) * float(v) for k, v in enumerate(y)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - dot)


def fit_rates(judged: DataFrame, shares: list[float], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """The numbers y of the rates, and the largest relative distance of a domain's tokens from its target.

    Targets are shares of all tokens; they are scaled to sum to 1. Without tokens y is 0.
    """
    d = len(shares)
    p = [F.get("posterior", k) for k in range(d)]
    total = float(judged.agg(F.sum("tokens").alias("all")).first()["all"] or 0)
    y = best_y = np.zeros(d)
    if not total:
        return y, 0.0
    target, best, best_size, step, last = np.array(shares) / sum(shares), np.inf, np.inf, 1.0, np.inf
    for _ in range(rounds):
        rate = _rate(y)
        some = F.when(rate > 0, F.col("tokens")).otherwise(0)
        sums = [F.sum(F.col("tokens") * (rate - 1) * (rate - 1)).alias("spread")] + [F.sum(F.col("tokens") * p[k] * rate).alias(f"d{k}") for k in range(d)] + [F.sum(some * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
        row = judged.agg(*sums).first()
        gap = np.array([row[f"d{k}"] / total for k in range(d)]) - target
        size = float(np.abs(gap / target).max())
        loss = float(gap @ gap) + CLOSE * row["spread"] / total
        if loss < best:
            best, best_y, best_size = loss, y, size
        if size < 1e-4:
            break
        step = step * 0.5 if np.linalg.norm(gap) > last else min(1.0, step * 1.5)
        last = float(np.linalg.norm(gap))
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] / total for j in range(d)] for i in range(d)])
        y = y + step * np.linalg.solve(gram + 1e-7 * np.eye(d), gap)
    if best_size > FAR:
        warnings.warn(f"no rates found within {rounds} rounds that bring every domain within {FAR:.0%} of its target: the farthest is {best_size:.2%} off", stacklevel=2)
    return best_y, best_size


def _with_rates(judged: DataFrame, y: np.ndarray) -> DataFrame:
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_003)) / 1_000_003.0
    out = judged.withColumn("rate", _rate(y))
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix_rates(documents: DataFrame, labels: DataFrame, scratch: Scratch | None = None, domains=DOMAINS) -> DataFrame:
    """doc_id, tokens, posterior, rate and copies for each row of ``documents`` (doc_id, text; others ignored).

    ``copies`` is rate rounded up or down by a hash of the id, so its mean is the rate. A null or empty text has
    no tokens; its posterior is the prior. Repeated rows get the same rate each. An empty table gives no rows; without labels
    the posteriors are even. Long texts are taken whole, within their row; documents of equal words get equal rates, and their copies differ by the hash of
    their ids alone. Columns other than doc_id and text are ignored, whatever their names.
    """
    scratch = scratch or Scratch(documents.sparkSession, "mix")
    model = documents.sparkSession.sparkContext.broadcast(fit_domains(documents, labels, domains))
    judged = scratch.table(with_posteriors(documents.select("doc_id", "text"), model).drop("text"), "judged")
    y, _ = fit_rates(judged, [share for _, _, share in domains])
    return _with_rates(judged, y)


def mix(documents: DataFrame, labels: DataFrame, scratch: Scratch | None = None, domains=DOMAINS) -> DataFrame:
    """All columns of ``documents`` with those of ``mix_rates``; columns of these names are replaced.

    Texts are judged twice, as the rates depend on all posteriors; they are neither copied nor shuffled.
    """
    scratch = scratch or Scratch(documents.sparkSession, "mix")
    model = documents.sparkSession.sparkContext.broadcast(fit_domains(documents, labels, domains))
    y, _ = fit_rates(scratch.table(with_posteriors(documents.select("text"), model).drop("text"), "judged"), [share for _, _, share in domains])
    return _with_rates(with_posteriors(documents, model), y)
