"""Finds benchmark items in documents, also with other numbers, names or units, by template windows.

A text becomes a template: numbers, names and units turn into typed placeholders, other words are lower-cased and
lose their outer punctuation. Windows of five template words are joined on their hashes. Within a document, the hits on an
item are aligned: an occurrence is a chain of hits that go on in both texts, best on one diagonal (place in the document
less place in the item), with a step to another one where words were put in or left out. It counts if its windows cover at
least 0.8 of the item's words and its placeholders are filled consistently: equal values of the item stand for equal values of
the document and the other way round. An exact copy fills each with itself; a re-parameterised question fills them with others.
What is a name rests on capitals, so windows of the plain lower-case words are joined in the same way and add the copies whose case differs.
An item that is mostly placeholders counts only so, with its own numbers and names, as any list of numbers would fit its template.
An item of fewer than five words is too little to be found inside a text: it counts where a line of the document consists of its words.

The hash join is one against a table of windows that every task holds: benchmark items are cut into parts of about ``PART`` words
(some 60 bytes each), counted first, and each part takes a pass over the documents. Windows that many items share, such as the
phrases of a prompt, don't multiply documents by items: an item is looked at only if a document holds one of its anchors, its
rarest windows, chosen so that the others cover less than 0.8 of it. So an occurrence always has one, and nothing is shuffled.
Words of many texts are described at once, and only texts with an anchor are aligned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlake.llm.rows import bounded_batches
from postlake.llm.words import WordTable, windows
from postlake.sources.scratch import Scratch

WINDOW = 5
COVERED = 0.8
#: Least share of plain words of an item for which other fillings of its placeholders count; other items count with their own only.
LITERAL = 0.25
#: Share of placeholder fillings that may contradict others, as a word may be misspelt.
CONTRADICTIONS = 0.1
#: Words of benchmark items that a task holds at once.
PART = 1_000_000
#: Words of documents that are looked up at once; few enough that the arrays stay in the cache.
GROUP = 1 << 13
#: Places for each anchor, and at most, in a table that tells by a window's last bits that it is no anchor.
SPREAD, PLACES = 16, 1 << 24
# Number words and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset("mm cm m km inch inches in foot feet ft yard yards yd mile miles mi mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons ml l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kph hz w kw watt watts v volt volts a amp amps j joule joules n pa bar percent dollar dollars euro euros cent cents usd eur degree degrees".split())
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*%?")
_STRIP = "\"'“”‘’«»()[]{}<>|#*$%&!?.,;:…—–-_~`^/\\+="
NUMBER, NAME, UNIT = 1, 2, 3
_KIND = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F], dtype=np.uint64)


_KINDS = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUMBER)
_CLOSING, _ENDS = "\"'”’»)]", (".", "!", "?", ":")


def _describe(found: list[str]) -> tuple[np.ndarray, list[bool], list[bool], list[int]]:
    """For each token: hash of the bare lower-case word, 0 if nothing is left; whether it may be a name; whether it ends a sentence; number or unit."""
    cores = [x.strip(_STRIP) for x in found]
    low = [x.lower() for x in cores]
    value = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in low), dtype=np.uint64, count=len(low))
    value[value == 0] = 1
    value[[k for k, x in enumerate(cores) if not x]] = 0
    capital = [x[:1].isupper() and x[1:].islower() for x in cores]
    # only what was stripped can end a sentence, as a word ends in none of these marks
    ends = [x is not core and x.rstrip(_CLOSING).endswith(_ENDS) for x, core in zip(found, cores)]
    kind = [0 if x.isalpha() and x not in _KINDS else _kind(core, x) for core, x in zip(cores, low)]
    return value, capital, ends, kind


def _kind(core: str, low: str) -> int:
    return NUMBER if core and _NUMBER.fullmatch(core) else _KINDS.get(low, 0)


def template(text: str | None, cache: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hashes, value hashes and kinds (0: plain word) of a text's words, without those of punctuation only."""
    return templates([text], cache)[:3]


def templates(texts: list[str | None], cache: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``template`` gives, of many texts one after the other; and where each text ends."""
    tokens = [text.split() if text else [] for text in texts]
    upto = np.cumsum([len(x) for x in tokens])
    value, capital, ends, kind = cache.rows(list(chain.from_iterable(tokens)))
    after_end, word = np.ones(len(value) + 1, dtype=bool), value != 0
    after_end[1:] = ends
    after_end[upto] = True  # a text's first token
    value, capital, kind, after_end = value[word], capital[word], kind[word], after_end[:-1][word]
    upto = np.append(0, np.cumsum(word))[upto]
    number = np.zeros(len(value) + 1, dtype=bool)
    number[1:] = kind == NUMBER
    before = number.copy()
    before[upto] = False  # a text's first word
    unit = (kind == UNIT) & before[:-1]
    kinds = np.where(number[1:], NUMBER, np.where(unit, UNIT, np.where(capital & ~after_end, NAME, 0)))
    return np.where(kinds > 0, _KIND[kinds], value), value, kinds, upto


def _words_of(benchmark: DataFrame) -> DataFrame:
    """item_id, shape and slots (0: a plain word) of each distinct item with a word."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _cache()
        for batch in batches:
            rows = []
            for key, text in zip(batch["item_id"], batch["text"]):
                shape, value, kinds = template(text, cache)
                if len(shape):
                    rows.append((key, shape.tobytes(), value.tobytes(), np.where(kinds > 0, value, 0).astype(np.uint64).tobytes(), len(shape)))
            yield pd.DataFrame(rows, columns=["item_id", "shape", "value", "slots", "n"])

    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    return items.mapInPandas(describe, "item_id long, shape binary, value binary, slots binary, n int")


class View:
    """Windows by item, and anchors by hash, over one reading of the items: their templates, or their plain words."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], slots: list[np.ndarray]):
        self.ids, self.slots, self.words = ids, slots, np.array([len(x) for x in texts], dtype=np.int64)
        self.hashes = [windows(x, WINDOW) for x in texts]
        self.anchors, self.begin, self.of = self._anchors()
        self.last_bits = np.uint64(min(PLACES, 1 << (SPREAD * len(self.anchors)).bit_length()) - 1)
        self.maybe = np.zeros(int(self.last_bits) + 1, dtype=bool)
        self.maybe[self.anchors & self.last_bits] = True

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the anchors, and for each where its items begin in the list of items.

        A window is an anchor of an item if at most as many items share it as an item-wise limit says: the least power of two for which
        the windows above it cover too little of the item.
        """
        n = len(self.ids)
        of = np.repeat(np.arange(n), [len(x) for x in self.hashes])
        pos = np.concatenate([np.arange(len(x)) for x in self.hashes]) if n else np.empty(0, dtype=np.int64)
        names, place = np.unique(np.concatenate(self.hashes) if n else np.empty(0, dtype=np.uint64), return_inverse=True)
        pairs = np.unique(place * max(n, 1) + of)
        shared = np.bincount(pairs // max(n, 1), minlength=len(names))[place]
        limit, most = np.zeros(n, dtype=np.int64), 1
        while (limit == 0).any():
            above = shared > most
            at, item = pos[above], of[above]
            new = np.ones(len(at), dtype=bool)
            new[1:] = item[1:] != item[:-1]
            step = np.where(new, WINDOW, np.minimum(np.diff(at, prepend=0), WINDOW))
            covered = np.bincount(item, step, minlength=n)
            limit[(limit == 0) & (covered < COVERED * self.words)] = most
            most *= 2
        anchor = shared <= limit[of]
        pairs = np.unique(place[anchor] * max(n, 1) + of[anchor])
        k, begin = np.unique(pairs // max(n, 1), return_index=True)
        return names[k], np.append(begin, len(pairs)), pairs % max(n, 1)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those windows that are anchors, and the anchors' numbers."""
        at = np.flatnonzero(self.maybe[h & self.last_bits])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.anchors, h[at]), len(self.anchors) - 1)
        same = self.anchors[k] == h[at]
        return at[same], k[same]

    def near(self, h: np.ndarray) -> np.ndarray:
        """The items of which the windows hold an anchor."""
        k = np.unique(self.hits(h)[1])
        return np.unique(np.concatenate([self.of[self.begin[x] : self.begin[x + 1]] for x in k])) if len(k) else np.empty(0, dtype=np.int64)

    def occurrences(self, text: np.ndarray, given: np.ndarray, literal: bool) -> Iterator[tuple]:
        """item_id, start, covered, n_slots, exact and the item's words, of each occurrence in the words ``text``; ``given`` fills the slots."""
        h, offsets = windows(text, WINDOW), np.arange(WINDOW)
        found = self.near(h)
        if not len(found):
            return
        order = np.argsort(h, kind="stable")
        in_order = h[order]
        for k in found.tolist():
            wanted = self.hashes[k]
            lo, hi = np.searchsorted(in_order, wanted), np.searchsorted(in_order, wanted, side="right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit) or WINDOW + np.minimum(np.diff(hit), WINDOW).sum() < COVERED * self.words[k]:
                continue
            times = (hi - lo)[hit]
            i = np.repeat(hit, times)
            d = order[np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]
            asked = self.slots[k][i[:, None] + offsets]
            if literal:
                near = near_words(d, asked, int(self.words[k]))
                d, i, asked = d[near], i[near], asked[near]
            for x in _alignments(d, i, given[d[:, None] + offsets], asked, int(self.words[k])):
                yield (self.ids[k], *x, int(self.words[k]))


class Items:
    """A part of the benchmark: both readings of its long items, and short items by the hash of their words."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["item_id", "value"], kind="stable")
        read = lambda k: [np.frombuffer(x, dtype=np.uint64) for x in rows[k]]
        shapes, values, slots, ids = read("shape"), read("value"), read("slots"), rows["item_id"].tolist()
        long = [k for k, x in enumerate(shapes) if len(x) >= WINDOW]
        told = [k for k in long if has_words(slots[k])]
        view = lambda of, texts: View([ids[k] for k in of], [texts[k] for k in of], [slots[k].view(np.int64) for k in of])
        self.templates, self.plain = view(told, shapes), view(long, values)
        self.short: dict[int, list[tuple[int, int, int]]] = {}
        for k, x in enumerate(values):
            if len(x) < WINDOW:
                self.short.setdefault(int(windows(x, len(x))[0]) ^ len(x), []).append((ids[k], len(x), int(np.count_nonzero(slots[k]))))


def has_words(slots: np.ndarray) -> bool:
    """Whether enough of an item are plain words for its template to tell it from others."""
    return np.count_nonzero(slots == 0) >= LITERAL * len(slots)


def near_words(d: np.ndarray, asked: np.ndarray, item_words: int) -> np.ndarray:
    """Of hits at the places ``d``, those within two lengths of the item from a hit on a window with a plain word."""
    told = np.sort(d[(asked == 0).any(axis=1)])
    if not len(told):
        return np.zeros(len(d), dtype=bool)
    k = np.searchsorted(told, d)
    return np.minimum(np.abs(told[np.minimum(k, len(told) - 1)] - d), np.abs(d - told[np.maximum(k - 1, 0)])) <= 2 * item_words


def _cache() -> WordTable:
    return WordTable(_describe, (np.uint64, np.bool_, np.bool_, np.int8))


def _short_lines(text: str, items: Items, cache: WordTable) -> Iterator[tuple[int, int, float, int, bool]]:
    """Lines that are a short item, word for word."""
    start = 0
    for line in text.split("\n"):
        value = cache.rows(line.split())[0]
        value = value[value != 0]
        if 0 < len(value) < WINDOW:
            for item, n, n_slots in items.short.get(int(windows(value, len(value))[0]) ^ len(value), ()):
                if n == len(value):
                    yield item, start, 1.0, n_slots, True
        start += len(value)


def _in_words(shape: np.ndarray, value: np.ndarray, kinds: np.ndarray, items: Items) -> Iterator[tuple]:
    """item_id, start, covered, n_slots and exact of each occurrence in a text's words. Plain words add what the templates don't have at that place."""
    slots = np.where(kinds > 0, value, 0).astype(np.uint64).view(np.int64)
    places: dict[int, list[int]] = {}
    for *x, _ in items.templates.occurrences(shape, slots, True):
        places.setdefault(x[0], []).append(x[1])
        yield tuple(x)
    for *x, n in items.plain.occurrences(value, value.view(np.int64), False):
        if all(abs(x[1] - start) >= n for start in places.get(x[0], ())):
            yield tuple(x)


def _in_texts(texts: list[str], items: Items, cache: WordTable) -> Iterator[tuple]:
    """The number of the text, and item_id, start, covered, n_slots and exact of each occurrence in it.

    Texts are read one after the other as one: a window that two of them share only costs a second look at these. Only texts with an anchor are looked at.
    """
    if items.short:
        for k, text in enumerate(texts):
            for x in _short_lines(text, items, cache):
                yield (k, *x)
    shape, value, kinds, upto = templates(texts, cache)
    at = np.concatenate([items.templates.hits(windows(shape, WINDOW))[0], items.plain.hits(windows(value, WINDOW))[0]])
    for k in np.unique(np.searchsorted(upto, at, side="right")).tolist():
        part = slice(upto[k - 1] if k else 0, upto[k])
        for x in _in_words(shape[part], value[part], kinds[part], items):
            yield (k, *x)


def _groups(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of a batch, without null and empty texts, in groups of about ``GROUP`` words."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch["doc_id"], batch["text"]):
        if text:
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= 6 * GROUP:
                yield docs, texts
                docs, texts, size = [], [], 0
    if texts:
        yield docs, texts


def _finder(sent):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, cache = sent.value, _cache()
        for batch in batches:
            out = [(docs[k], *x) for docs, texts in _groups(batch) for k, *x in _in_texts(texts, items, cache)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "start", "covered", "n_slots", "exact"])

    return find


def _chains(d: np.ndarray, i: np.ndarray, item_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hit (in order of d, then i) the best chain that ends there: words covered, its worth, the hit before (or -1).

    A chain's worth is the words that it covers less one for each change of the diagonal.
    """
    words, worth, before = np.full(len(d), WINDOW), np.full(len(d), WINDOW), np.full(len(d), -1)
    begin, end = np.searchsorted(d, d - item_words), np.searchsorted(d, d)
    shift = d - i
    for k in range(len(d)):
        lo, hi = begin[k], end[k]
        if lo < hi:
            new = np.minimum(i[k] - i[lo:hi], WINDOW)
            gain = np.where(new > 0, worth[lo:hi] + new - (shift[lo:hi] != shift[k]), 0)
            best = int(gain.argmax())
            if gain[best] > WINDOW:
                words[k], worth[k], before[k] = words[lo + best] + new[best], gain[best], lo + best
    return words, worth, before


def _filling(asked: np.ndarray, given: np.ndarray, i: np.ndarray) -> tuple[int, bool, bool]:
    """Number of slots that the hits of an alignment fill; whether each is filled with itself; whether that is consistent."""
    at, of = i[:, None] + np.arange(WINDOW), asked != 0
    slots = set(zip(at[of].tolist(), asked[of].tolist(), given[of].tolist()))
    pairs = {x[1:] for x in slots}
    exact = all(a == g for a, g in pairs)
    contradictions = 2 * len(pairs) - len({a for a, _ in pairs}) - len({g for _, g in pairs})
    return len(slots), exact, exact or contradictions <= CONTRADICTIONS * len(slots)


def _alignments(d: np.ndarray, i: np.ndarray, given: np.ndarray, asked: np.ndarray, item_words: int) -> Iterator[tuple[int, float, int, bool]]:
    """start, covered, n_slots and exact of each occurrence of an item in a document, from all its hits there."""
    order = np.lexsort((i, d))
    d, i, given, asked = d[order], i[order], given[order], asked[order]
    while len(d):
        words, worth, before = _chains(d, i, item_words)
        enough = np.flatnonzero(words >= COVERED * item_words)
        if not len(enough):
            return
        used = np.zeros(len(d), dtype=bool)
        for k in enough[np.argsort(-worth[enough], kind="stable")].tolist():
            chain = []
            while k >= 0 and not used[k]:
                chain.append(k)
                k = before[k]
            if k >= 0:
                continue
            chain = np.array(chain[::-1])
            shift = d[chain] - i[chain]
            kinds, sizes = np.unique(shift, return_counts=True)
            used[chain] = True
            # a step to another diagonal may bring wrong fillings; then its longest diagonal alone
            for part in (chain, chain[shift == kinds[sizes.argmax()]]):
                covered = WINDOW + int(np.minimum(np.diff(i[part]), WINDOW).sum())
                n, exact, consistent = _filling(asked[part], given[part], i[part])
                if covered >= COVERED * item_words and consistent:
                    yield int(d[part[0]]), round(covered / item_words, 4), n, exact
                    used |= (d >= d[part[0]]) & (d <= d[part[-1]])
                    break
        d, i, given, asked = d[~used], i[~used], given[~used], asked[~used]


def find_leaks(documents: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, start (word among the document's), covered, n_slots, exact: one row per occurrence found.

    ``documents`` needs doc_id and text, ``benchmark`` item_id and text; others are ignored, whatever their names. Null and empty texts
    have no words, rows without an id are skipped. Long texts are read whole. Repeated rows count once, and so do ties of equal alignments. No
    rows if either table is empty.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    bounded_batches(spark)
    items = scratch.table(_words_of(benchmark), "items")
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    schema, parts = "doc_id long, item_id long, start int, covered double, n_slots int, exact boolean", -(-total // PART)
    found = []
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "value"), F.lit(parts)) == k).toArrow().to_pandas()  # about PART words
        found.append(docs.mapInPandas(_finder(spark.sparkContext.broadcast(Items(part))), schema))
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], schema)
