"""Log-likelihoods of documents under a gated recurrent model with a class-factored softmax.

A word's probability is P(class | what came before) * P(word | class, what came before), both learnt. Classes are the end of a
text, the ``HEAD`` most frequent words on their own, and ``TAILS`` classes by a word's last letters. A tail class has a softmax
of its own over its ``SLOTS - 1`` most frequent words and one slot for all others, which share it by add-one counts. The state
sees the same codes: end, head word, or class and slot. So the counts of rare words, which no machine could
hold, are only needed in a join: a scoring task sums what it knows and passes on (row, word, times) for words outside the
``KNOWN`` most frequent ones.

The weights are fitted by truncated backpropagation in numpy: every task runs over its own training texts with the
state carried from window to window within ``SEGMENT`` tokens, then the tasks' weights are averaged, weighted by tokens. Each of
``ROUNDS`` rounds uses its share of the training texts, so the weights learn from each text once; the counts use all of them too.
A score carries the state through the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm.features import remainder
from postlake.llm.rows import bounded_batches
from postlake.llm.words import WordCache, words
from postlake.sources.scratch import Scratch

HEAD, TAILS, SLOTS, HIDDEN = 31, 32, 32, 16
SINGLE = 1 + HEAD  # classes of one code: the end and the head words
CLASSES, CODES = SINGLE + TAILS, SINGLE + TAILS * SLOTS
#: Steps of backpropagation and segments side by side in training; steps and texts side by side in scoring.
TRAIN_WINDOW, TRAIN_LANES, WINDOW, LANES = 16, 512, 32, 2048
SEGMENT = 1024
#: Rows of states whose outputs are computed at once, so that arrays stay in the cache.
BLOCK = 512
ROUNDS = 2
#: Tokens, two bytes each, that a task holds at once.
GATHERED = 1 << 22
#: Words of texts that are looked up at once.
CODED = 1 << 17
#: Distinct words, some 150 bytes each, that a task counts before it passes their counts on.
COUNTED = 1 << 18
#: Words whose counts go to every task, 24 bytes each.
KNOWN = 1 << 18
END = 0
END_HASH = 0x454E44
_ONES, _COUNT = np.ones(max(WINDOW * LANES, TRAIN_WINDOW * TRAIN_LANES), dtype=np.float32), np.arange(max(WINDOW * LANES, TRAIN_WINDOW * TRAIN_LANES))
_PUNCTUATION = b".,;:!?'\"()[]{}<>|#*$%&+-_=/\\~`^@"
_MARKS = frozenset(_PUNCTUATION)


_CLASS = np.concatenate([np.arange(SINGLE), SINGLE + np.arange(CODES - SINGLE) // SLOTS])


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found)).view(np.int64)


def tail(word: bytes) -> int:
    """By the last two bytes without outer punctuation, and the character that ends the word if it is punctuation."""
    core = word.strip(_PUNCTUATION)
    key = core[-2:] + (b"\x00" + word[-1:] if core and not word.endswith(core) else b"" if core else word[:1])
    return xxhash.xxh32_intdigest(key) % TAILS


def _tail_of_end(end: bytes) -> int:
    """The tail of all words with these last three bytes (or of the word, if it has less); -1 if that needs more of the word."""
    told = len(end) < 3 or _MARKS.isdisjoint(end[1:]) or (end[2] in _MARKS and _MARKS.isdisjoint(end[:2]))
    return tail(end) if told else -1


_TAIL_OF_END = WordCache(_tail_of_end)


def tails(found: list[bytes]) -> np.ndarray:
    """``tail`` of each word."""
    out = np.fromiter(map(_TAIL_OF_END.__getitem__, [w[-3:] for w in found]), dtype=np.int32, count=len(found))
    for i in np.flatnonzero(out < 0).tolist():
        out[i] = tail(found[i])
    return out


def class_of(codes: np.ndarray) -> np.ndarray:
    return _CLASS[codes]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, tail, n) sums over a task's texts, in parts of about ``COUNTED`` words; the end of each text counts as a word, of tail -1."""

    def counted(times: Counter) -> pd.DataFrame:
        found = list(times)
        return pd.DataFrame({"word": word_hashes(found), "tail": tails(found), "n": np.fromiter(times.values(), dtype=np.int64, count=len(found))})

    times, ends = Counter(), 0
    for batch in batches:
        ends += len(batch)
        for text in batch["text"]:
            times.update(words(text))
            if len(times) >= COUNTED:
                yield counted(times)
                times.clear()
    if times:
        yield counted(times)
    yield pd.DataFrame({"word": [END_HASH], "tail": np.array([-1], dtype=np.int32), "n": [ends]})


class Vocabulary:
    """What tasks know of the counts: the most frequent words with their codes and counts, and sums per code."""

    def __init__(self, top: pd.DataFrame, by_tail: pd.DataFrame, n: int, v: int):
        self.n, self.v = n, v
        top = top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
        is_end = (top["tail"] == -1).to_numpy()
        top["code"] = SINGLE + SLOTS * top["tail"].to_numpy(dtype=np.int64)
        top.loc[is_end, "code"] = END
        rest = np.flatnonzero(~is_end)
        top.loc[rest[:HEAD], "code"] = 1 + np.arange(len(rest[:HEAD]))
        rank = top.loc[rest[HEAD:]].groupby("tail").cumcount().to_numpy() + 1
        inside = rank < SLOTS
        top.loc[rest[HEAD:][inside], "code"] += rank[inside]
        order = np.argsort(top["word"].to_numpy())
        self.words, self.counts, self.codes = (top[k].to_numpy(dtype=np.int64)[order] for k in ("word", "n", "code"))
        # what each code counts for: words with a code of their own by themselves, the others of a tail together
        self.ends = int(by_tail.loc[by_tail["tail"] == -1, "n"].sum())
        self.size = np.zeros(CODES)
        others = SINGLE + SLOTS * np.arange(TAILS)
        known_n, known_v = np.zeros(TAILS), np.zeros(TAILS)
        own = top[~is_end & ~top["code"].isin(others)]
        np.add.at(known_n, own["tail"].to_numpy(), own["n"].to_numpy())
        np.add.at(known_v, own["tail"].to_numpy(), 1)
        self.size[own["code"].to_numpy()] = own["n"].to_numpy() + 1
        self.size[END] = self.ends + 1
        sums = by_tail[by_tail["tail"] >= 0].set_index("tail").reindex(range(TAILS), fill_value=0)
        self.size[others] = (sums["n"].to_numpy() - known_n) + (sums["v"].to_numpy() - known_v) + 1

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the classes' shares and of the slots' shares in their tails, so that an unfitted model equals add-one counts."""
        slots = self.size[SINGLE:].reshape(TAILS, SLOTS)
        classes = np.concatenate([self.size[:SINGLE], slots.sum(axis=1)])
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(classes / classes.sum()), -30), np.maximum(np.log(slots / slots.sum(axis=1, keepdims=True)), -30)

    def describe(self, hashes: np.ndarray, tokens: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the words ``at`` these places of ``tokens``, by their hashes; a count is -1 if the word isn't among the known ones."""
        k = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[k] == hashes if len(self.words) else np.zeros(len(hashes), dtype=bool)
        codes, counts = np.empty(len(hashes), dtype=np.int64), np.full(len(hashes), -1)
        codes[known], counts[known] = self.codes[k[known]], self.counts[k[known]]
        codes[~known] = SINGLE + SLOTS * tails([tokens[i] for i in at[~known].tolist()])
        return codes, counts


class WordLookup:
    """Hash, code and count of words, each distinct one described once. Sorting hashes takes less time than a dictionary of so many words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def rows(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = word_hashes(tokens)
        order = np.argsort(hashes)
        in_order = hashes[order]
        new = np.ones(len(hashes), dtype=bool)
        np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
        inverse = np.empty(len(hashes), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        codes, counts = self.vocabulary.describe(in_order[new], tokens, order[new])
        return hashes, codes[inverse], counts[inverse]


def word_table(vocabulary: Vocabulary) -> WordLookup:
    return WordLookup(vocabulary)


class GatedModel:
    """A gated unit and two softmaxes.

    With a = x[code] + h u in three parts: z = 1 / (1 + exp(a_z)), r = 1 / (1 + exp(a_r)), the candidate is
    tanh(-(x_n + r * (h u)_n) / 2) and the next state z h + (1 - z) candidate. Class logits are h w + c, slot logits in tail k are h v[k] + d[k].
    """

    SHAPES = {"x": (CODES, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "w": (HIDDEN, CLASSES), "c": (CLASSES,), "v": (TAILS, HIDDEN, SLOTS), "d": (TAILS, SLOTS)}

    def __init__(self, logs: tuple[np.ndarray, np.ndarray] | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 0.02 if k in "wv" else 0.2, s).astype(np.float32) for k, s in self.SHAPES.items()}
        if logs:
            self.p["c"], self.p["d"] = (x.astype(np.float32) for x in logs)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t, self.spaces = 0, {}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array to compute in, kept under its name until the next call: new memory for each would take more time than what is computed."""
        size = math.prod(shape)
        if name not in self.spaces or len(self.spaces[name]) < size:
            self.spaces[name] = np.empty(size, dtype=np.float32)
        return self.spaces[name][:size].reshape(shape)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[k] = values[at : at + size].reshape(shape).astype(np.float32)
            at += size

    def run(self, inputs: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of the inputs (steps x units x lanes), and what backpropagation needs if ``keep``.

        Within a step, units come first and lanes second, so that the parts of a gate are whole blocks of memory.
        All that is returned lies in the model's own arrays and holds until the next call; ``h`` must not.
        """
        n, lanes, u, x = HIDDEN, h.shape[1], np.ascontiguousarray(self.p["u"].T), np.ascontiguousarray(self.p["x"].T)
        states, parts, held = self._space("states", len(inputs), n, lanes), [], len(inputs) if keep else 1
        inner = [self._space(k, held, size, lanes) for k, size in (("inputs", 3 * n), ("before", 3 * n), ("new", n))]
        for t, ids in enumerate(inputs):
            a, g, new = (s[t % held] for s in inner)
            x.take(ids, axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            gates = a[: 2 * n]
            gates += g[: 2 * n]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:n], gates[n:]
            np.multiply(r, g[2 * n :], out=new)
            new += a[2 * n :]
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            if keep:
                parts.append((h, z, r, new, g[2 * n :]))
            h = np.subtract(h, new, out=states[t])
            h *= z
            h += new
        return states, parts

    def _bounded(self) -> bool:
        """Whether no logit can come near 60, as states lie within -1 and 1."""
        p = self.p
        return max((np.abs(p["w"]).sum(axis=0) + p["c"]).max(), (np.abs(p["v"]).sum(axis=1) + p["d"]).max()) < 59

    def _exp(self, states: np.ndarray, weights: np.ndarray, bias: np.ndarray, picked: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exponentials of the logits (until the next call), their sums, and the logit of ``picked``. Logits are cut at 60 unless they are ``bounded``."""
        logits = np.matmul(states, weights, out=self._space("logits", len(states), weights.shape[1]))
        logits += bias
        if not bounded:
            np.minimum(logits, 60, out=logits)
        own = logits[_COUNT[: len(picked)], picked]
        np.exp(logits, out=logits)
        return logits, logits @ _ONES[: logits.shape[1]] + np.float32(1e-30), own

    def _by_tail(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Positions of the codes that have a slot, by tail; their slots; each tail's stretch of both."""
        at = np.flatnonzero(codes >= SINGLE)
        k, slots = np.divmod(codes[at].astype(np.int32) - SINGLE, SLOTS)
        order = np.argsort(k.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(k, minlength=TAILS)).tolist()
        return at[order], slots[order], [(j, slice(lo, hi)) for j, (lo, hi) in enumerate(zip([0, *ends], ends)) if lo < hi]

    def log_probabilities(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Natural logs of P(code), a row of states each."""
        p, out, bounded = self.p, np.empty(len(codes)), self._bounded()
        for lo in range(0, len(codes), BLOCK):
            _, total, own = self._exp(states[lo : lo + BLOCK], p["w"], p["c"], class_of(codes[lo : lo + BLOCK]), bounded)
            out[lo : lo + BLOCK] = own - np.log(total)
        at, slots, stretches = self._by_tail(codes)
        inside, logs = states.take(at, axis=0, out=self._space("inside", len(at), HIDDEN), mode="clip"), np.empty(len(at))
        for k, part in stretches:
            _, total, own = self._exp(inside[part], p["v"][k], p["d"][k], slots[part], bounded)
            logs[part] = own - np.log(total)
        out[at] += logs
        return out

    def learn(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One step of Adam on a window (steps x lanes); returns the last state, for the next window."""
        n, p = HIDDEN, self.p
        states, parts = self.run(inputs, h, keep=True)
        steps, _, lanes = states.shape
        flat, codes, weight = _rows(states, self._space("flat", steps, lanes, n)), targets.ravel(), mask.ravel() / np.float32(max(1, mask.sum()))
        slopes, from_output, bounded = {k: np.zeros_like(p[k]) for k in "wcuvd"}, self._space("from_output", len(flat), n), self._bounded()
        for lo in range(0, len(codes), BLOCK):
            some, share, picked = flat[lo : lo + BLOCK], weight[lo : lo + BLOCK], class_of(codes[lo : lo + BLOCK])
            e, total, _ = self._exp(some, p["w"], p["c"], picked, bounded)
            e *= (share / total)[:, None]
            e[_COUNT[: len(e)], picked] -= share
            slopes["w"] += some.T @ e
            slopes["c"] += _ONES[: len(e)] @ e
            np.matmul(e, p["w"].T, out=from_output[lo : lo + BLOCK])
        at, slots, stretches = self._by_tail(codes)
        inside, back_inside, weight = flat.take(at, axis=0, out=self._space("inside", len(at), n), mode="clip"), self._space("back_inside", len(at), n), weight[at]
        for k, part in stretches:
            e, total, _ = self._exp(inside[part], p["v"][k], p["d"][k], slots[part], bounded)
            e *= (weight[part] / total)[:, None]
            e[_COUNT[: len(e)], slots[part]] -= weight[part]
            slopes["v"][k], slopes["d"][k] = inside[part].T @ e, _ONES[: len(e)] @ e
            np.matmul(e, p["v"][k].T, out=back_inside[part])
        from_output[at] += back_inside
        by_step = self._space("by_step", steps, n, lanes)
        by_step[:] = from_output.reshape(steps, lanes, n).transpose(0, 2, 1)
        back, d_state, d_input = np.zeros_like(h), self._space("d_state", 3 * n, lanes), self._space("d_input", steps, 3 * n, lanes)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, g = parts[t]
            back += by_step[t]
            d_new = (z - 1) * (1 - new * new)
            d_new *= back
            d_new *= 0.5
            da = d_input[t]
            np.multiply((new - before) * back, z * (1 - z), out=da[:n])
            np.multiply(d_new * g, r * (r - 1), out=da[n : 2 * n])
            da[2 * n :] = d_new
            d_state[: 2 * n] = da[: 2 * n]
            np.multiply(d_new, r, out=d_state[2 * n :])
            slopes["u"] += before @ d_state.T
            back *= z
            back += p["u"] @ d_state
        self.t += 1
        for k, s in slopes.items():
            self._adam(k, slice(None), s, rate)
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        by_token = _rows(d_input, self._space("by_token", steps, lanes, 3 * n))
        in_order = by_token.take(order, axis=0, out=self._space("in_order", len(order), 3 * n), mode="clip")
        self._adam("x", ids[first], np.add.reduceat(in_order, first, axis=0), rate)
        return states[-1].copy()

    def _adam(self, name: str, rows, slope: np.ndarray, rate: float) -> None:
        """Only the rows of codes that occur are moved, and their means with them."""
        slope, m, s = np.clip(slope, -1, 1, out=slope), self.m[name][rows], self.s[name][rows]
        m *= np.float32(0.9)
        step = np.float32(0.1) * slope
        m += step
        s *= np.float32(0.99)
        np.multiply(slope, slope, out=step)
        step *= np.float32(0.01)
        s += step
        np.divide(s, np.float32(1 - 0.99**self.t), out=step)
        np.sqrt(step, out=step)
        step += np.float32(1e-6)
        np.divide(m, step, out=step)
        step *= np.float32(rate / (1 - 0.9**self.t))
        self.m[name][rows], self.s[name][rows] = m, s
        self.p[name][rows] -= step

    def totals(self, sequences: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """log10 of the probability of each whole sequence of codes, its end included.

        Sequences of like length run side by side, window by window, each with its own state carried on.
        """
        out = np.zeros(len(sequences))
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        for at in range(0, len(order), lanes):
            group = order[at : at + lanes]
            lengths = np.array([len(sequences[i]) for i in group])
            h, last = np.zeros((HIDDEN, len(group)), dtype=np.float32), np.full((1, len(group)), END)
            for start in range(0, int(lengths.max(initial=0)), WINDOW):
                live = int(np.count_nonzero(lengths > start))
                targets = _grid([sequences[i] for i in group[:live]], start, min(WINDOW, int(lengths[0]) - start))
                states, _ = self.run(np.concatenate([last[:, :live], targets[:-1]]), h[:, :live])
                rows = _rows(states, self._space("flat", len(targets), live, HIDDEN))
                kept = np.arange(start, start + len(targets))[:, None] < lengths[:live]
                if kept.all():
                    out[group[:live]] += self.log_probabilities(rows, targets.ravel()).reshape(kept.shape).sum(axis=0)
                else:
                    lane = np.broadcast_to(np.arange(live), kept.shape)[kept]
                    out[group[:live]] += np.bincount(lane, self.log_probabilities(rows[kept.ravel()], targets[kept]), minlength=live)
                h, last = states[-1].copy(), targets[-1:]
        return out / np.log(10)


def _rows(states: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A row for each step and lane; in ``out`` (steps x lanes x units) if given."""
    rows = states.transpose(0, 2, 1)
    if out is not None:
        out[:] = rows
        rows = out
    return rows.reshape(-1, states.shape[1])


def _grid(sequences: list[np.ndarray], start: int, steps: int) -> np.ndarray:
    """Steps x lanes of the sequences from ``start`` on; beyond a sequence's end there are ends."""
    out = np.full((len(sequences), steps), END)
    for row, s in zip(out, sequences):
        part = s[start : start + steps]
        row[: len(part)] = part
    return np.ascontiguousarray(out.T)


def train_on(model: GatedModel, sequences: list[np.ndarray], rate: float, rng: np.random.Generator) -> None:
    """One pass over the sequences, in segments of like length side by side."""
    full = [np.concatenate([[np.int16(END)], s]) for s in sequences]
    segments = sorted((x[k : k + SEGMENT + 1] for x in full for k in range(0, len(x) - 1, SEGMENT)), key=len, reverse=True)
    for g in rng.permutation(-(-len(segments) // TRAIN_LANES)).tolist():
        group = segments[g * TRAIN_LANES : (g + 1) * TRAIN_LANES]
        lengths = np.array([len(x) - 1 for x in group])
        h = np.zeros((HIDDEN, len(group)), dtype=np.float32)
        for start in range(0, int(lengths[0]), TRAIN_WINDOW):
            live, steps = int(np.count_nonzero(lengths > start)), min(TRAIN_WINDOW, int(lengths[0]) - start)
            codes = _grid(group[:live], start, steps + 1)
            mask = (np.arange(start, start + steps)[:, None] < lengths[:live]).astype(np.float32)
            h = model.learn(codes[:-1], codes[1:], mask, h[:, :live], rate)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Batches joined up to ``GATHERED`` tokens, so that texts of like length find each other; with their sequences."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += sum(map(len, batch["codes"])) // 2
        if size >= GATHERED:
            rows = pd.concat(some, ignore_index=True)
            yield rows, [np.frombuffer(x, dtype=np.int16) for x in rows["codes"]]
            some, size = [], 0
    if size:
        rows = pd.concat(some, ignore_index=True)
        yield rows, [np.frombuffer(x, dtype=np.int16) for x in rows["codes"]]


def _trainer(weights, rate: float):
    """Trains on this task's texts; yields the sum of its weights times its tokens, and the tokens."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        model, tokens, rng = GatedModel(), 0, np.random.default_rng(17)
        model.set_flat(weights.value)
        for _, sequences in _gathered(batches):
            train_on(model, sequences, rate, rng)
            tokens += sum(map(len, sequences))
        if tokens:
            yield pd.DataFrame({"weights": [(model.flat().astype(np.float64) * tokens).tobytes()], "tokens": [tokens]})

    return train


def _sum_weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, tokens = None, 0
    for batch in batches:
        for data, n in zip(batch["weights"], batch["tokens"]):
            x = np.frombuffer(data)
            total, tokens = x if total is None else total + x, tokens + int(n)
    if total is not None:
        yield pd.DataFrame({"weights": [total.tobytes()], "tokens": [tokens]})


def fit_weights(train: DataFrame, logs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rounds of training in all tasks and averaging. The tasks' weights (about 600 kB) are summed by 16 tasks."""
    context = train.sparkSession.sparkContext
    flat = GatedModel(logs).flat()
    for k in range(ROUNDS):
        trained = train.where(F.col("part") == k).select("codes").mapInPandas(_trainer(context.broadcast(flat), 0.01 / (1 + k)), "weights binary, tokens long")
        rows = trained.repartition(16).mapInPandas(_sum_weights, "weights binary, tokens long").collect()
        if rows:
            flat = (sum(np.frombuffer(r["weights"]) for r in rows) / sum(r["tokens"] for r in rows)).astype(np.float32)
    return flat


_CODED = ["row", "doc_id", "part", "n_tokens", "n_known", "base", "within", "codes", "word", "code", "times"]
_CODED_TYPES = "row long, doc_id long, part int, n_tokens long, n_known long, base double, within double, codes binary, word long, code int, times long"


def _coder(vocabulary):
    """For each text its codes and what the known words add to its scores; and (row, word, code, times) of words that aren't known."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary.value
        table, end_code = word_table(vocab), np.int16(END).tobytes()
        all_words, in_code, end = np.log10(vocab.n + vocab.v + 1), np.log10(np.maximum(vocab.size, 1)), np.log10(vocab.ends + 1.0)

        def coded(some: list[tuple], texts: list[list[bytes]]) -> Iterator[pd.DataFrame]:
            row, doc_id, part = zip(*some)
            lengths = np.array([len(x) for x in texts])
            hashes, codes, counts = table.rows(list(chain.from_iterable(texts)))
            at, known = np.repeat(np.arange(len(texts)), lengths), counts >= 0
            n = np.bincount(at[known], minlength=len(texts))
            logs = np.bincount(at[known], np.log10(counts[known] + 1.0), minlength=len(texts))
            within = logs - np.bincount(at[known], in_code[codes[known]], minlength=len(texts))
            data, ends = codes.astype(np.int16).tobytes(), 2 * np.cumsum(lengths)
            sequences = [data[lo:hi] + end_code for lo, hi in zip((ends - 2 * lengths).tolist(), ends.tolist())]
            out = pd.DataFrame(dict(zip(_CODED[:8], (row, doc_id, part, lengths + 1, n + (vocab.ends > 0), logs + end - all_words * (n + 1), within, sequences)))).reindex(columns=_CODED)
            yield out.astype({k: "Int64" for k in _CODED if k not in ("base", "within", "codes")})
            if len(data) // 2 > n.sum():  # a frame of its own: beside missing values whole numbers would turn into floats
                at, hashes, codes = at[~known], hashes[~known], codes[~known]
                order = np.lexsort((hashes, at))
                at, hashes, codes = at[order], hashes[order], codes[order]
                first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])))
                rare = (np.array(row)[at[first]], hashes[first], codes[first], np.diff(first, append=len(at)))
                yield pd.DataFrame(dict(zip(("row", "word", "code", "times"), rare)), dtype="Int64").reindex(columns=_CODED)

        for batch in batches:
            some, texts, size = [], [], 0
            for row, doc_id, part, text in zip(batch["row"], batch["doc_id"], batch["part"], batch["text"]):
                some.append((row, doc_id, part))
                texts.append(words(text))
                size += len(texts[-1])
                if size >= CODED:
                    yield from coded(some, texts)
                    some, texts, size = [], [], 0
            if some:
                yield from coded(some, texts)

    return code


def _scorer(weights):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        model = GatedModel()
        model.set_flat(weights.value)
        for rows, sequences in _gathered(batches):
            yield rows.drop(columns="codes").assign(model=rows["within"] + model.totals(sequences))

    return score


def most_frequent(counts: DataFrame, limit: int) -> pd.DataFrame:
    """The words of ``counts`` above the lowest count that at most ``limit`` words reach."""
    most = 1 << 12
    sizes = sorted(((r["least"], r["count"]) for r in counts.groupBy(F.least("n", F.lit(most)).alias("least")).count().collect()), reverse=True)
    total, least = 0, most + 1
    for n, size in sizes:
        if total + size > limit:
            break
        total, least = total + size, n
    if least > most:  # more than the limit have the highest count that is told apart
        return counts.orderBy(F.desc("n"), "word").limit(limit).toArrow().to_pandas()
    return counts.where(F.col("n") >= least).toArrow().to_pandas()


def score_documents(documents: DataFrame, train: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score and score.

    ``train`` is a condition on doc_id that says which rows are learnt from (all by default; not those where it is null). Tokens are the text's words and
    one end; null and empty texts have the end alone. n_known counts tokens that occur in training texts. base_score is the
    log10 probability under add-one counts of single tokens, score that under the model. Repeated rows are scored alike.
    An empty table gives no rows; without training rows nothing is known. Texts are scored whole, however long, with the state carried on; columns other than
    doc_id and text are ignored, whatever their names. Weights are averaged over the tasks that learn, so scores vary with how the input is split.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    bounded_batches(spark)
    learn = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    counted = documents.where(learn).select("text").mapInPandas(_count, "word long, tail int, n long")
    counts = scratch.table(counted.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")).where("n > 0"), "counts")
    by_tail = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # a row per tail
    n, v = int(by_tail["n"].sum()), int(by_tail["v"].sum())
    vocabulary = Vocabulary(most_frequent(counts, KNOWN), by_tail, n, v)
    part = F.when(learn, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).cast("int")).otherwise(-1)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", part.alias("part"), "text")
    coded = scratch.table(docs.mapInPandas(_coder(spark.sparkContext.broadcast(vocabulary)), _CODED_TYPES), "coded")
    texts = coded.where("word is null").select("row", "doc_id", "n_tokens", "n_known", "base", "within", "codes", "part")
    weights = spark.sparkContext.broadcast(fit_weights(texts, vocabulary.logs()))

    scored = texts.drop("part").mapInPandas(_scorer(weights), "row long, doc_id long, n_tokens long, n_known long, base double, within double, model double")
    c = F.coalesce("n", F.lit(0)) + 1
    # words outside the known ones share the first slot of their tail
    in_code = F.get(F.lit([float(x) for x in vocabulary.size[SINGLE::SLOTS]]), F.floor((F.col("code") - SINGLE) / SLOTS).cast("int"))
    rare = coded.where("word is not null").select("row", "word", "code", "times").join(counts.select("word", "n"), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(c / float(n + v + 1))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(c / in_code)).alias("rare_model"),
    )
    whole = scored.join(rare, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select(
        "doc_id",
        "n_tokens",
        add("n_known", "rare_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        add("base", "rare_base").alias("base_score"),
        add("model", "rare_model").alias("score"),
    )


def language_scores(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``score_documents`` that learns from ids whose crc32 modulo 7 is not 2; adds held_out for the others."""
    out = score_documents(documents, remainder("doc_id", 7) != 2, scratch)
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
