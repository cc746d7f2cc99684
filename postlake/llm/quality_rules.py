"""Quality rules that vote or abstain, weighed by expectation-maximisation. DataFrame functions only.

Each rule reads one property of a text and votes good (1), bad (-1) or abstains (0). No labels are used: a
model of good texts and kinds of junk, with one rate per rule and class, is fitted to the counts of vote patterns. There are at most
3 ** number of rules patterns whatever the corpus, so the fit is arithmetic on a few thousand counts; the texts are read once. A text is kept if its posterior probability of good reaches one half.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from postlake.sources.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Change of every posterior of every pattern from round to round below which the fit has converged.
STILL = 1e-6
#: Rates are never surer than this, nor than its opposite.
MOST_RATE = 0.998

#: name: (value above which a rule votes bad, value up to which it votes good); between them it abstains.
HIGH_IS_BAD = {
    "symbols": (0.10, 0.01),
    "repeats": (0.30, 0.05),
    "dup_lines": (0.50, 0.0),
    "capitals": (0.50, 0.20),
    "shouts": (0.10, 0.02),
    "long_words": (12.0, 9.0),
    "digits": (0.20, 0.03),
}
#: name: (value below which it votes bad, value from which it votes good).
LOW_IS_BAD = {"length": (20.0, 80.0), "letters": (0.60, 0.80)}
RULES = (*HIGH_IS_BAD, *LOW_IS_BAD)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_array(text: Column) -> Column:
    """Runs of characters other than space and the control characters 9 to 13."""
    return F.array_remove(F.split(text, SPACE), "")


def text_counts(documents: DataFrame) -> DataFrame:
    """Adds the counted properties of ``text`` (null counts as empty) to doc_id.

    Repeated three-word windows are found within the row: each window is a long of its position, in as many bits as the text
    needs, and hash bits above; the array is sorted, and neighbours with equal hash bits are compared word by word. A text of 1000
    words leaves 54 bits for the hash, one of 16 million still 40.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("words", word_array(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0))
    docs = docs.withColumn("bits", F.floor(F.log2(F.greatest(F.size("words"), F.lit(1)))).cast("int") + 1)
    up, down = (lambda x, name=name: F.call_function(name, x, F.col("bits")) for name in ("shiftleft", "shiftright"))
    low = up(F.lit(1).cast("long")) - 1
    word = lambda i: F.get("words", i)
    window = lambda i: up(F.xxhash64(word(i), word(i + 1), word(i + 2))).bitwiseOR(i.cast("long"))
    docs = docs.withColumn("sorted", F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))))

    def same(a: Column, b: Column) -> Column:
        i, j = (a.bitwiseAND(low)).cast("int"), (b.bitwiseAND(low)).cast("int")
        return F.coalesce((down(a) == down(b)) & (word(i) == word(j)) & (word(i + 1) == word(j + 1)) & (word(i + 2) == word(j + 2)), F.lit(False))

    twice = F.filter("sorted", lambda x, k: same(x, F.get("sorted", k - 1)) | same(x, F.get("sorted", k + 1)))
    docs = docs.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low))))
    covered = F.aggregate("twice", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")), lambda s: s["n"])
    n_chars = F.length("text")
    return docs.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (n_chars - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (n_chars - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_shouts"),
        (n_chars - F.length(_without(F.col("text"), "0123456789"))).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def votes(counts: DataFrame) -> DataFrame:
    """Adds one vote per rule, as vote_<rule>; a text without words gets no votes but that of its length."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    value = {
        "symbols": per("n_symbols", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "capitals": per("n_capitals", "n_letters"),
        "shouts": per("n_shouts", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "digits": per("n_digits", "word_chars"),
        "length": F.col("n_words").cast("double"),
        "letters": per("n_letters", "word_chars"),
    }
    out = {}
    for name, (bad, good) in HIGH_IS_BAD.items():
        out[f"vote_{name}"] = F.when(value[name] > bad, -1).when(value[name] <= good, 1).otherwise(0)
    for name, (bad, good) in LOW_IS_BAD.items():
        out[f"vote_{name}"] = F.when(value[name] < bad, -1).when(value[name] >= good, 1).otherwise(0)
    return counts.withColumns(out)


def cells() -> Column:
    """The votes that were cast, as indexes: 2 r for a good vote of rule r, 2 r + 1 for a bad one."""
    cast = [F.when(F.col(f"vote_{x}") == 1, 2 * r).when(F.col(f"vote_{x}") == -1, 2 * r + 1) for r, x in enumerate(RULES)]
    return F.array_compact(F.array(*cast))


def responsibilities(model: dict) -> Column:
    """P(class | votes) for each class: good first, then one kind of junk per rule. Needs a column ``cells``.

    The model's numbers are array literals, so every round of the fit runs the same compiled code.
    """
    width = 2 * len(RULES)
    prior, rates = F.lit([float(x) for x in model["prior"]]), F.lit([float(x) for row in model["rates"] for x in row])
    logs = F.transform(F.sequence(F.lit(0), F.lit(len(RULES))), lambda k: F.aggregate("cells", F.get(prior, k), lambda s, c: s + F.get(rates, k * width + c)))
    powers = _once(logs, lambda x: _once(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most))))
    return _once(powers, lambda x: _once(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(x, lambda v: v / total)))


def _once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` as a bound variable, computed one time."""
    return F.transform(F.array(c), use)[0]


def fit(patterns: DataFrame) -> dict:
    """Expectation-maximisation on vote patterns (cells, n): log prior of each class and log rates of its votes.

    Junk comes in kinds that break one rule and keep the others, so a single class of bad texts would not do: there is a
    class of good texts and one of junk for each rule. It starts from the belief that a text without a bad vote is good with
    probability 0.95, and that else its bad votes share 0.9. The rates are the rules' accuracies: how often a rule's vote
    is good on good texts, and bad on each kind of junk. They are smoothed and never certain.

    The patterns with their counts are all that the fit needs, and at most 3 ** number of rules, so they are collected; rounds go on until
    no posterior moves by ``STILL``; between plain rounds, steps are drawn out along their course.
    """
    rows = sorted((tuple(r["cells"]), r["n"]) for r in patterns.collect())
    kinds, width = len(RULES) + 1, 2 * len(RULES)
    if not rows:
        return {"prior": [0.0] * kinds, "rates": [[0.0] * width for _ in range(kinds)]}
    cast, n = np.zeros((len(rows), width)), np.array([r[1] for r in rows], dtype=np.float64)
    for k, (cells, _) in enumerate(rows):
        cast[k, list(cells)] = 1
    bad = cast[:, 1::2]
    of_bad = bad.sum(axis=1, keepdims=True)
    junk = np.where(of_bad > 0, 0.9 * bad / np.maximum(of_bad, 1), 0.05 / len(RULES))
    weights = np.concatenate([np.where(of_bad > 0, 0.1, 0.95), junk], axis=1)
    numbers, seen = _from_weights(weights, cast, n), weights
    while True:
        # two plain rounds give a direction and its change; a longer step along them is taken if it doesn't lower the objective
        one, worth, now = _round(numbers, cast, n)
        if np.abs(now - seen).max() < STILL:
            break
        two, _, seen = _round(one, cast, n)
        step, bend = one - numbers, two - 2 * one + numbers
        far = max(1.0, float(np.linalg.norm(step) / max(np.linalg.norm(bend), 1e-300)))
        numbers = two
        while far > 1.01:
            tried = _tidy(one - step + 2 * far * step + far * far * bend)
            new, reached, seen_there = _round(tried, cast, n)
            if reached >= worth:
                numbers, seen = new, seen_there
                break
            far = (far + 1) / 2 if far < 4 else far / 4
    prior, good, bad = _split(numbers)
    return {"prior": prior.tolist(), "rates": np.stack([good, bad], axis=2).reshape(kinds, width).tolist()}


def _split(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log priors, and log rates of good and of bad votes, of log priors followed by the rates' logits."""
    kinds = len(RULES) + 1
    logit = numbers[kinds:].reshape(kinds, -1)
    return numbers[:kinds], -np.logaddexp(0, -logit), -np.logaddexp(0, logit)


def _tidy(numbers: np.ndarray) -> np.ndarray:
    """Priors that sum to one, rates within their bounds."""
    kinds, most = len(RULES) + 1, math.log(MOST_RATE / (1 - MOST_RATE))
    return np.concatenate([numbers[:kinds] - np.logaddexp.reduce(numbers[:kinds]), np.clip(numbers[kinds:], -most, most)])


def _from_weights(weights: np.ndarray, cast: np.ndarray, n: np.ndarray) -> np.ndarray:
    mass = weights * n[:, None]
    prior = np.log((mass.sum(axis=0) + 0.01) / (mass.sum() + 0.01 * mass.shape[1]))
    votes = mass.T @ cast
    rate = np.clip((votes[:, 0::2] + 0.05) / (votes[:, 0::2] + votes[:, 1::2] + 0.1), 1 - MOST_RATE, MOST_RATE)
    return np.concatenate([prior, np.log(rate / (1 - rate)).ravel()])


def _round(numbers: np.ndarray, cast: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The next numbers, and of the given ones the objective (log likelihood with the smoothing's weight) and the posteriors."""
    prior, good, bad = _split(numbers)
    logs = prior + cast[:, 0::2] @ good.T + cast[:, 1::2] @ bad.T
    most = logs.max(axis=1, keepdims=True)
    powers = np.exp(logs - most)
    total = powers.sum(axis=1, keepdims=True)
    worth = float(n @ (np.log(total) + most)[:, 0]) + 0.01 * prior.sum() + 0.05 * (good.sum() + bad.sum())
    return _from_weights(powers / total, cast, n), worth, powers / total


def base_failed() -> Column:
    """Under 50 words, or over half of them in three-word windows that come again."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Counts, votes, ``posterior`` and ``verdict`` for each row of ``documents`` (doc_id, text; others ignored).

    Null texts count as empty ones: every count is 0. Long texts are taken whole, within their row. Repeated rows give repeated results; an
    empty table none. A posterior of exactly one half keeps. A null doc_id stays null; other columns are ignored, whatever their names.
    ``base_failed`` marks texts under 50 words, or with over half of their words in repeated three-word windows;
    ``kept`` is the verdict, and false for those.
    """
    scratch = scratch or Scratch(documents.sparkSession, "rules")
    counted = scratch.table(votes(text_counts(documents)).withColumn("cells", cells()), "votes")
    model = fit(scratch.table(counted.groupBy("cells").agg(F.count("*").alias("n")).coalesce(1), "patterns"))
    out = counted.withColumn("posterior", F.get(responsibilities(model), F.lit(0))).withColumn("base_failed", base_failed()).drop("cells")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
