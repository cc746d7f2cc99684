"""Operators on texts against brute force, with odd rows: nulls, empty and long texts, ties, repeats, extra columns, no rows."""

import math
import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlake.llm import decontamination, html_text, license_scan, near_duplicates, words
from postlake.llm.decontamination import find_leaks
from postlake.llm.line_dedup import RUN, dedupe_lines
from postlake.llm.quality_rules import RULES, quality_rules

SCHEMA = "doc_id long, text string, n_lines string, score string"


def docs_of(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = made_words(rng, 200)
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \n"), (6, "two Words"), (7, "Two  words"), (None, " ".join(base)), (8, " ".join(made_words(rng, 30_000)))]
    for k in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(200)] = rng.choice(base)
        rows.append((10 + k, "\t".join(w)))
    rows += [(200 + k, " ".join(made_words(rng, rng.randint(1, 40)))) for k in range(30)] + [(10, rows[9][1])]
    # a chain: each links with the next only
    chain = made_words(rng, 120)
    rows += [(300 + k, " ".join(chain[4 * k : 4 * k + 80])) for k in range(10)]
    out = near_duplicates.near_duplicates(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    assert near_duplicates.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_in_a_family(spark, monkeypatch):
    """Texts of one template, too unlike to link, with one pair of near copies among them: all buckets are large."""
    monkeypatch.setattr(near_duplicates, "CHUNK", 20)
    rng = random.Random(9)
    base = made_words(rng, 276)
    rows = [(k, " ".join([*base, *(f"{k}x{j}" for j in range(24 if k < 2 else 25))])) for k in range(60)]
    sets = {i: shingles(t) for i, t in rows}
    assert [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])] == [(0, 1)]
    out = near_duplicates.near_duplicates(docs_of(spark, rows)).collect()
    assert [(r["doc_id"], r["component_id"]) for r in out if not r["kept"]] == [(1, 0)]


def test_pairs_in_a_family_of_like_texts(spark, monkeypatch):
    """150 pairs of Jaccard 0.88 in one family whose other pairs have 0.83: every link is found, in one chunk or many."""
    rng = random.Random(4)
    common = made_words(rng, 1000)
    rows = [(2 * k + half, " ".join([*common, *(f"p{k}x{j}" for j in range(34)), *(f"d{k}y{half}z{j}" for j in range(62))])) for k in range(150) for half in (0, 1)]
    sets = {i: shingles(t) for i, t in rows[:4]}
    assert 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 85 * len(sets[0] | sets[2])
    for chunk in (2048, 40):
        monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
        out = near_duplicates.near_duplicates(docs_of(spark, rows), percent=85).collect()
        assert {(r["doc_id"], r["component_id"]) for r in out} == {(i, i - i % 2) for i, _ in rows}


def test_blocks_without_near_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64) << np.uint64(1)) for _ in range(4)]
    rows = pd.DataFrame({"id": range(4), "component": [0, 1, 2, 2], "bands": [near_duplicates.registers(x).view(np.int64) for x in sets], "shingles": [x.tobytes() for x in sets]})
    assert len(near_duplicates.block_links(rows, None, 85)) == 0 and len(near_duplicates.block_links(rows[:2], rows[2:], 85)) == 0
    rows["shingles"], rows["bands"] = [sets[0].tobytes()] * 4, [rows["bands"][0]] * 4
    assert sorted(map(tuple, near_duplicates.block_links(rows, None, 85).to_numpy())) == [(0, 1), (0, 2), (1, 2)]  # one for two components


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near_duplicates, "_PAIRS", 50)
    monkeypatch.setattr(near_duplicates, "_COLUMNS", 7)
    rng = np.random.default_rng(8)
    for size in (3, 40, 400):
        left, right = ([np.unique(rng.zipf(1.3, size) % 1000).astype(np.uint64) for _ in range(n)] for n in (23, 31))
        counts = near_duplicates.shared_counts(left, right)
        assert all(counts[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(left) for j, b in enumerate(right))


def test_sketches():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    b = np.unique(np.concatenate([a[300:], rng.integers(0, 2**63, 300).astype(np.uint64)]))
    j, n = near_duplicates.estimate(near_duplicates.registers(a)[None], near_duplicates.registers(b)[None])
    assert n[0] == 128 and abs(j[0] - 2700 / 3300) < 0.15
    c = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    assert near_duplicates.estimate(near_duplicates.registers(a)[None], near_duplicates.registers(np.unique(c))[None])[0][0] < 0.05
    assert words.words("A B c\x0bD\x1ce") == ["a".encode(), "b c".encode(), b"d\x1ce"]


def removed_by_brute_force(rows):
    """Lines that an earlier place has as well, within a run of RUN words or more; every pair of places is tried."""
    lines = {}
    for i, t in sorted(rows):
        lines[i] = [(k, x.strip(" \t\x0b\x0c\r"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t.split("\n"))]
        lines[i] = [x for x in lines[i] if x[2]]
    gone = {i: set() for i in lines}
    for i in lines:
        for j in lines:
            if j > i:
                continue
            for p in range(len(lines[i])):
                for q in range(len(lines[j])):
                    if (j, q) < (i, p) and (p == 0 or q == 0 or lines[i][p - 1][1] != lines[j][q - 1][1]):
                        n = 0
                        while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n][1] == lines[j][q + n][1]:
                            n += 1
                        if sum(x[2] for x in lines[i][p : p + n]) >= RUN:
                            gone[i] |= {x[0] for x in lines[i][p : p + n]}
    return gone


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda n: " ".join(made_words(rng, n))
    passage, common, small = [line(20), line(18), line(25)], line(9), [line(10), line(12)]
    rows = [
        (1, "\n".join([line(5), *passage, line(7)])),
        (2, "\n".join([common, *passage, "", line(6)])),
        (3, "\n".join([common, line(60), *small])),
        (4, "\n".join([line(8), "", passage[0], "", passage[1], passage[2], *small])),
        (5, "\n".join(["a b"] * 60)),
        (6, line(70)),
        (8, ""),
        (9, "\n".join([common, line(30)])),
    ]
    rows += [(7, rows[5][1] + "\n" + line(3)), (10, rows[0][1])]
    out = {r["doc_id"]: r for r in dedupe_lines(docs_of(spark, rows + [(None, rows[0][1]), (11, None)])).collect()}
    expected = removed_by_brute_force(rows)
    for i, t in rows:
        lines = t.split("\n")
        assert set(out[i]["removed"]) == expected[i], i
        assert out[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in expected[i]) and out[i]["n_lines"] == len(lines)
    assert out[None]["removed"] == [] and out[11]["text"] is None and out[11]["n_lines"] == 0
    assert dedupe_lines(docs_of(spark, [])).count() == 0
    twice = dedupe_lines(docs_of(spark, [(1, line(60)), (2, rows[5][1]), (2, rows[5][1])])).collect()
    assert len(twice) == 3 and all(r["removed"] == [] for r in twice)


def test_line_dedup_of_long_texts(spark):
    """Texts of very many lines, one of them repeated within itself, and one of a single very long line."""
    rng = random.Random(13)
    lines = [" ".join(made_words(rng, 6)) for _ in range(6000)]
    passage = [" ".join(made_words(rng, 30)) for _ in range(4)]
    rows = [(1, "\n".join(lines[:3000] + passage + lines[3000:])), (2, "\n".join([*passage, "tail"])), (3, "\n".join(lines[:200] * 2)), (4, " ".join(made_words(rng, 60_000)))]
    out = {r["doc_id"]: r for r in dedupe_lines(docs_of(spark, rows)).collect()}
    assert out[1]["removed"] == [] and out[2]["removed"] == [0, 1, 2, 3] and out[2]["text"] == "tail" and out[4]["removed"] == []
    assert out[3]["removed"] == list(range(400)) and out[3]["text"] == ""  # both halves stand in the first text


def test_rules_of_long_texts(spark):
    rng = random.Random(14)
    word = made_words(rng, 400)
    rows = [(1, " ".join(rng.choice(word) for _ in range(150_000))), (2, "x\n" * 50_000), (3, "y" * 400_000), (4, " ".join(made_words(rng, 3000)) + " a b c d a b c")]
    for r in quality_rules(docs_of(spark, rows)).collect():
        counts = base_counts(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts


def test_decontamination(spark):
    rng = random.Random(4)
    item = "A train leaves Paris at 9 pm and travels 300 km to Berlin at 120 mph while Anna waits in Paris for 3 hours to see Berlin again".split()
    other = made_words(rng, 30)
    swapped = " ".join(item).replace("Paris", "Madrid").replace("Berlin", "Lisbon").replace("300", "450").replace("9", "7").replace("120", "80").replace("Anna", "Peter").replace(" 3 ", " 5 ")
    mixed = " ".join(item).replace("Paris", "Madrid", 1).replace("Berlin", "Rome", 1).replace("300", "5")
    fill = lambda n: " ".join(made_words(rng, n))
    rows = [(1, f"{fill(50)} {' '.join(item)} {fill(50)}"), (2, f"{fill(20)}. {swapped} {fill(9)}"), (3, f"{fill(20)}. {mixed} {fill(9)}"), (4, fill(2000)), (5, None), (6, ""), (7, " ".join(x + "%%%" for x in other)), (8, f"{fill(9)} {' '.join(item[:9])}"), (None, " ".join(item)), (1, f"{fill(50)} {' '.join(other)}")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (2, " ".join(other)), (3, None), (4, "too short"), (None, "x")], "item_id long, text string")
    out = find_leaks(docs_of(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact"]) for r in out) == [(1, 1, True), (1, 2, True), (2, 1, False), (7, 2, True)]
    assert find_leaks(docs_of(spark, []), bench).count() == 0 and find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_against_all_pairs(spark, monkeypatch):
    """Every window of every item against every window of every document, in one part and in many."""
    rng = random.Random(12)
    prompt = "please answer the following question with one word only".split()
    vocabulary = [*made_words(rng, 30), "Paris", "London", "Ada", "3", "17", "42", "kg", "km"]
    items = [(k, " ".join([*(prompt if k % 2 else []), *(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))])) for k in range(60)]
    items += [(100, "x " * 5 + "3 4 5 6 7 8 9 10"), (101, "only three words"), (102, "1"), (103, ""), (104, None), (100, "x " * 5 + "3 4 5 6 7 8 9 10")]
    docs = []
    for k in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            copied = (rng.choice(items)[1] or "").split()
            for j in range(len(copied)):
                if rng.random() < 0.03:
                    copied[j] = rng.choice(vocabulary)
            w += copied + rng.choices(vocabulary, k=3)
        docs.append((k, " ".join(w)))
    docs += [(500, "first line\nOnly three words.\nlast"), (501, "not only three words"), (502, "word " * 60_000 + items[0][1] + " word" * 60_000), (503, None)]
    cache, wanted = decontamination._cache(), set()
    for d, text in docs:
        shape, value, kinds = decontamination.template(text, cache)
        slots = np.where(kinds > 0, value, 0).astype(np.uint64).view(np.int64)
        if not 5 <= len(shape) < 1000:
            continue
        for i, item in items:
            other, v, k2 = decontamination.template(item, cache)
            if len(other) < 5:
                continue
            asked, n = np.where(k2 > 0, v, 0).astype(np.uint64).view(np.int64), len(other)

            def occurrences(ours, theirs, given, literal):
                pairs = [(a, b) for a, x in enumerate(words.windows(ours, 5).tolist()) for b, y in enumerate(words.windows(theirs, 5).tolist()) if x == y]
                if literal:
                    told = [a for a, b in pairs if (asked[b : b + 5] == 0).any()]  # noqa: B023
                    pairs = [(a, b) for a, b in pairs if any(abs(a - x) <= 2 * n for x in told)]  # noqa: B023
                if not pairs:
                    return []
                at, of = np.array(pairs).T
                return list(decontamination._alignments(at, of, given[at[:, None] + np.arange(5)], asked[of[:, None] + np.arange(5)], n))  # noqa: B023

            by_template = occurrences(shape, other, slots, True) if 4 * np.count_nonzero(asked == 0) >= n else []
            by_words = [x for x in occurrences(value, v, value.view(np.int64), False) if all(abs(x[0] - y[0]) >= n for y in by_template)]
            wanted |= {(d, i, *x) for x in by_template + by_words}
    wanted |= {(500, 101, 2, 1.0, 1, True)}  # three is a number
    bench = spark.createDataFrame([(i, t, "clash", 0) for i, t in items] + [(None, "a b c d e f", "", 0)], "item_id long, text string, start string, n int")
    for part in (1_000_000, 60):
        monkeypatch.setattr(decontamination, "PART", part)
        found = {tuple(r) for r in find_leaks(docs_of(spark, docs + docs[:5]), bench).collect()}
        assert {x for x in found if x[0] == 502} and {x for x in found if x[0] != 502} == wanted
    assert len(wanted) > 100


def test_decontamination_whatever_the_case(spark):
    """Copies in capitals, small letters, title case and random case are found as exact ones; other fillings by their template only."""
    rng = random.Random(8)
    item = "Last year the baker Tom Reed of North Hill sold 30 loaves and Ada Moss bought 12 of them for 4 dollars each while the mill in Old Ford stood still".split()
    other = "every word of this item is small and it has no number or name at all as some questions do not".split()
    cases = [str.upper, str.lower, str.title, str.swapcase, lambda x: "".join(rng.choice((c.upper(), c.lower())) for c in x), str]
    fill = lambda n: " ".join(made_words(rng, n))
    rows = [(10 * j + k, f"{fill(40)}. {' '.join(f(x) for x in words)} {fill(20)}") for j, words in enumerate((item, other)) for k, f in enumerate(cases)]
    rows += [(100, f"{fill(9)}. {' '.join(item).replace('Tom Reed', 'Bob Lane').replace('30', '50')} {fill(9)}"), (101, f"{fill(9)} {' '.join(item).replace('Tom Reed', 'Bob Lane').lower().replace('30', '50').replace('baker', 'cook')} {fill(9)}")]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other))], "item_id long, text string")
    out = {(r["doc_id"], r["item_id"], r["start"], r["exact"]) for r in find_leaks(docs_of(spark, rows), bench).collect()}
    assert out == {(10 * j + k, j, 40, True) for j in (0, 1) for k in range(6)} | {(100, 0, 9, False)}


def test_texts_are_read_many_at_once(monkeypatch):
    """Words of many texts are described at once; each text has the template that it has by itself, and its occurrences, wherever texts meet."""
    rng = random.Random(9)
    odd = ["Paris", "PARIS", "pARIS", "P", "\U0001d400bc", "\u01c5ab", "\u00c9t\u00e9", "\u0130x", "3", "-3.5%", "\u20ac5", "\u0663", "three", "Three.", "kg", "KG,", "--", "...", "(x)", "end.", "end.\u201d", "what?)", "a:b", "m", "\u00b2", "x\u00b2"]

    def plain(token):
        core = token.strip(decontamination._STRIP)
        low, number = core.lower(), bool(decontamination._NUMBER.fullmatch(core))
        kind = 1 if number or low in decontamination.NUMBER_WORDS else 3 if low in decontamination.UNITS else 0
        return bool(core), len(core) > 1 and core[0].isupper() and core[1:].islower(), token.rstrip("\"'\u201d\u2019\u00bb)]")[-1:] in (".", "!", "?", ":"), kind

    value, *others = decontamination._describe(odd)
    assert list(zip((value != 0).tolist(), *others)) == [plain(x) for x in odd]
    item = [rng.choice(odd) + rng.choice(("", "k")) for _ in range(12)] + made_words(rng, 12)
    texts = [" ".join(rng.choices(odd + item, k=rng.randint(1, 12))) for _ in range(200)] + [None, "", "...", " ".join(item[:13]), " ".join(item[13:]), "3", "kg 4 5", "kg", " ".join(item)]
    cache = decontamination._cache()
    *together, upto = decontamination.templates(texts, cache)
    alone = [decontamination.template(t, decontamination._cache()) for t in texts]
    assert np.diff(upto, prepend=0).tolist() == [len(x[0]) for x in alone]
    assert all(np.array_equal(a, np.concatenate([x[k] for x in alone])) for k, a in enumerate(together))
    shape, words_of, kinds = decontamination.template(" ".join(item), cache)
    rows = [(7, shape.tobytes(), words_of.tobytes(), np.where(kinds > 0, words_of, 0).astype(np.uint64).tobytes(), len(shape))]
    items = decontamination.Items(pd.DataFrame(rows, columns=["item_id", "shape", "value", "slots", "n"]))
    batch, found = pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), []
    for size in (1 << 13, 0):
        monkeypatch.setattr(decontamination, "GROUP", size)
        found.append(sorted(tuple(r) for f in decontamination._finder(SimpleNamespace(value=items))(iter([batch])) for r in f.itertuples(index=False)))
    assert found[0] == found[1] and [x[0] for x in found[0]] == [len(texts) - 1]


def test_items_of_placeholders_only(spark):
    """A list of numbers is found where it stands, and not wherever numbers stand; long texts of numbers take no time."""
    rng = random.Random(6)
    numbers = [str(rng.randrange(1000)) for _ in range(100_000)]
    item = [str(rng.randrange(1000)) for _ in range(30)]
    mixed = "of these find the sum".split() + item[:6] + "and name the greatest".split()
    placed = numbers[:50_000] + item + numbers[50_000:] + mixed + numbers[:100]
    rows = [(0, " ".join(numbers)), (1, " ".join(placed)), (2, " ".join(numbers[:6000]))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(mixed))], "item_id long, text string")
    began = time.perf_counter()
    out = {(r["doc_id"], r["item_id"], r["start"], r["exact"]) for r in find_leaks(docs_of(spark, rows), bench).collect()}
    assert out == {(1, 0, 50_000, True), (1, 1, 100_030, True)}
    assert time.perf_counter() - began < 25


def test_decontamination_of_items_with_equal_windows(spark):
    """A run of numbers and a repeated phrase: windows of a document hit several places of the item."""
    rng = random.Random(7)
    fill = lambda n: " ".join(made_words(rng, n))
    w = made_words(rng, 40)
    run = [*w[:12], *"11 22 33 44 55 66".split(), *w[12:24]]
    phrase = [*w[24:29], *w[29:33], *w[24:29], *w[33:38], *w[24:29]]
    numbers = "7 8 9 10 11 12 13 14".split()
    other = [*w[:12], *"12 23 34 45 56 67".split(), *w[12:24]]
    longer = [*run[:20], "inserted", "twice", *run[20:]]
    rows = [(k, f"{fill(30)} {' '.join(x)} {fill(20)}") for k, x in enumerate((run, other, longer, phrase, [*phrase, *fill(3).split(), *phrase], numbers))]
    bench = spark.createDataFrame([(1, " ".join(run)), (2, " ".join(phrase)), (3, " ".join(numbers))], "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["start"], r["covered"], r["exact"]) for r in find_leaks(docs_of(spark, rows), bench).collect())
    assert out == [(0, 1, 30, 1.0, True), (1, 1, 30, 1.0, False), (2, 1, 30, 1.0, True), (3, 2, 30, 1.0, True), (4, 2, 30, 1.0, True), (4, 2, 57, 1.0, True), (5, 3, 30, 1.0, True)]


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def posteriors_by_hand(votes):
    """Expectation-maximisation over single rows until it stands still, as its definition says; no grouping of patterns, no arrays of logs."""
    kinds, rules = len(RULES) + 1, len(RULES)
    weights = []
    for row in votes:
        bad = [r for r, v in enumerate(row) if v == -1]
        weights.append([0.1 if bad else 0.95, *((0.9 / len(bad) if r in bad else 0.0) if bad else 0.05 / rules for r in range(rules))])
    before = None
    while True:
        mass = [sum(w[k] for w in weights) for k in range(kinds)]
        prior = [(m + 0.01) / (sum(mass) + 0.01 * kinds) for m in mass]
        rates = [[min(max((sum(w[k] for w, v in zip(weights, votes) if v[r] == 1) + 0.05) / (sum(w[k] for w, v in zip(weights, votes) if v[r]) + 0.1), 0.002), 0.998) for r in range(rules)] for k in range(kinds)]
        weights = []
        for row in votes:
            like = [prior[k] * math.prod(rates[k][r] if v == 1 else 1 - rates[k][r] for r, v in enumerate(row) if v) for k in range(kinds)]
            weights.append([x / sum(like) for x in like])
        now = [math.log(x) for k in range(kinds) for x in (prior[k], *rates[k], *(1 - y for y in rates[k]))]
        if before and max(abs(x - y) for x, y in zip(before, now)) < 1e-8:
            break
        before = now
    return [w[0] for w in weights]


def test_posteriors(spark):
    rng = random.Random(21)
    texts = [" ".join(made_words(rng, rng.choice((10, 60, 120)))) for _ in range(40)]
    texts += [" ".join(x + rng.choice(("%", "!", "9", "")) for x in made_words(rng, 90)) for _ in range(20)] + ["Same words here. " * rng.randint(3, 60) for _ in range(8)] + [None, "", "x"]
    # texts between the kinds, whose posterior is not sure
    texts += [" ".join((x.upper() if rng.random() < caps else x) + ("!" if rng.random() < 0.06 else "9" if rng.random() < digits else "") for x in made_words(rng, n)) for caps in (0, 0.3, 0.6) for digits in (0, 0.2, 0.6) for n in (15, 40, 100, 200)]
    out = quality_rules(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    expected = posteriors_by_hand([[r[f"vote_{x}"] for x in RULES] for r in out])
    for r, p in zip(out, expected):
        assert abs(r["posterior"] - p) < 1e-3
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert len({round(p, 2) for p in expected}) > 3


def test_quality_rules(spark):
    rng = random.Random(5)
    good = [" ".join(made_words(rng, 120)).capitalize() + "." for _ in range(60)]
    symbols = [" ".join(x + "%%" for x in made_words(rng, 90)) for _ in range(8)]
    shouts = [" ".join(x.upper() + "!!" for x in made_words(rng, 90)) for _ in range(8)]
    repeats = ["the same old words again " * 30 for _ in range(3)]
    odd = [None, "", " \n\n", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n\nx", "é b #\t|", "a b " * 200]
    rows = [*enumerate(good + symbols + shouts + repeats + odd), (0, good[0]), (None, good[1])]
    out = quality_rules(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        n, chars, n_symbols, dup, rep = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, n_symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        if r["doc_id"] is not None and r["doc_id"] < 79:
            assert r["kept"] == (r["doc_id"] < 60), r
    assert quality_rules(docs_of(spark, [])).count() == 0


PAGES = [
    ("<html><body><div id=menu><a href=x>Home</a></div><div class='content'><h2>Title here</h2><p>First para with some words &amp; more &eacute;t&eacute;.<br>line two</p><ul><li>one item</li></ul><p>Be.</p></div><div class=comments><p>Nice post! This is a very long comment with many words in it.</p></div><form><p>Subscribe now</p></form><footer>c 2020</footer></body></html>", "Title here First para with some words & more été. line two one item Be."),
    ("<article><h1>T</h1><p>Of.</p><aside>side bar text here</aside><div class='ad-slot'>Buy now</div><p>Last <a href=x>link</a>\n  para", "T Of. Last link para"),
    ("<script>var x='<p>no</p>'</script><style>p{}</style><p>Yes, this is the text of my page.<!-- <p>no</p> -->", "Yes, this is the text of my page."),
    ("<header><h1>Site</h1></header><main><article><header><h1>Real</h1></header><p>Body text.</p><section class=\"comments\"><article><p>comment one two three</p></article></section></article></main>", "Real Body text."),
    ("", ""),
    (None, ""),
    ("<nav><a href='/'>a</a></nav>", ""),
]


LONG = " ".join(f"word{k}" for k in range(40))
SHORT = "one two three four five six"
#: Layouts that the labelled table doesn't hold.
OTHER_PAGES = [
    ("<h1>Hello World</h1><p>" + LONG, "Hello World " + LONG),
    ("<article><h1>Hello World</h1><p>" + LONG + "</article>", "Hello World " + LONG),
    (f"<nav><a href=x>Menu</a></nav><div class=author-story><h1>My days</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p></div><footer>c</footer>", f"My days {LONG} {SHORT} {LONG}"),
    (f"<article class='post status-publish'><p>{LONG}</p></article>", LONG),
    (f"<section class=search-result><p>{LONG}</p><p>x y</p></section>", LONG + " x y"),
    (f"<div><a href=x>{SHORT}</a> <a href=y>{LONG}</a></div><p>{LONG}</p><p>{LONG}</p>", f"{LONG} {LONG}"),
    (f"<main><p>{LONG}</p><div class='social share'><a href=x>tell others</a></div><p>{SHORT}</p><div class=widget><p>{SHORT}</p></div></main>", f"{LONG} {SHORT}"),
    (f"<div class=col-right><p>{LONG}</p><p>{SHORT}</p></div><article><h1>My days</h1><p>{LONG}</p><p>{SHORT}</p></article><div><p>{LONG}</p></div>", f"My days {LONG} {SHORT}"),
    (f"<div class=col-left><p>{LONG}</p></div><div><h1>My days</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p></div>", f"My days {LONG} {SHORT} {LONG}"),
    (f"<p>{LONG}</p><p>{LONG}</p><p>{SHORT}</p><h2>More to say</h2><p>{SHORT}</p>", f"{LONG} {LONG} {SHORT} More to say {SHORT}"),
    (f"<article><p>{SHORT}</p><h2>More to say</h2><p>{LONG}</p><p>{LONG}</p></article>", f"{SHORT} More to say {LONG} {LONG}"),
    (f"<p data-x='{'>' * 12_000}'>{LONG}", LONG),
    ("<p " + " ".join(f'a{k}=">"' for k in range(900)) + f">{LONG}", LONG),
    (f"<p>{LONG}<svg><svg>no</svg>no</svg><object><object></object>no</object></p><p title='unclosed>{LONG}</p>", f"{LONG} {LONG}"),
]


def test_html(spark):
    pages = [*PAGES, *OTHER_PAGES]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    out = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    for i, (_, expected) in enumerate(pages):
        assert out[i]["text"] == expected and out[i]["n_chars"] == len(expected), i
    assert html_text.extract_text(df.limit(0)).count() == 0
    table = html_text.labelled()
    tree = html_text.grow(table)
    assert ((html_text.judge(tree, table) >= 0.5) == table[:, -1]).mean() > 0.97
    right = []
    for k, layout in enumerate(html_text.LAYOUTS):  # each judged by a tree that has seen none of its blocks
        unseen, others = html_text.labelled((layout,)), html_text.grow(html_text.labelled(html_text.LAYOUTS[:k] + html_text.LAYOUTS[k + 1 :]))
        right.extend((html_text.judge(others, unseen) >= 0.5) == unseen[:, -1])
    assert sum(right) > 0.88 * len(right)
    odd = "<a '" * 20_000 + "<p>" * 20_000
    html_text.page_text(odd, tree)
    html_text.page_text("<p>" * 20_000 + "<" * 5000 + "x" * 200_000, tree)


def best_stretches(templates, words, limit):
    """Every stretch against every template, then greedily those with most in common."""
    found = []
    for name, given in templates.items():
        for text in given:
            t = license_scan.terms(text)
            want = Counter(zip(t, t[1:]))
            for i in range(len(words)):
                for j in range(i + 2, len(words) + 1):
                    have = Counter(zip(words[i:j], words[i + 1 : j]))
                    shared, total = (want & have).total(), want.total() + have.total()
                    if 200 * shared >= limit * total:
                        found.append((-shared, -2 * shared / total, i, name, j - i))
    taken = []
    for shared, dice, i, name, n in sorted(found):
        if all(i >= s + m or s >= i + n for s, m, *_ in taken):
            taken.append((i, n, name, -shared, -dice))
    return sorted(taken)


def test_stretches_like_templates():
    rng = random.Random(11)
    templates = {"A": ("a b c d e", "x y x y x z x y"), "B": ("b c d a", "q r s t u v w q r a b"), "C": ("one",)}
    t = license_scan.Templates(templates)
    hits = 0
    for _ in range(200):
        words = []
        while len(words) < 30:
            words += license_scan.terms(rng.choice(templates[rng.choice("AB")])) if rng.random() < 0.5 else [rng.choice("abcdexyzqrstuvw")]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "other"
        assert t.find(words) == best_stretches(templates, words, license_scan.LIMIT)
        hits += len(t.find(words))
    assert hits > 200


def test_time_of_many_notices():
    """A text's notices cost their number, not its square: 1600 among filler."""
    mit = license_scan.TEMPLATES["MIT"][0]
    text = "\n".join(f"{mit}\n{'filler words here ' * 6}" for _ in range(1600))
    began = time.perf_counter()
    out = pd.concat(license_scan._scan(iter([pd.DataFrame({"doc_id": [1], "text": [text]})])))
    assert time.perf_counter() - began < 20
    assert out["line"].tolist() == list(range(0, 3200, 2)) and set(out["license"]) == {"MIT"}


def test_licenses(spark):
    mit, apache = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["Apache-2.0"][1]
    wrapped = "code\n" + "\n".join(f" * {' '.join(apache.split()[k : k + 7])}" for k in range(0, len(apache.split()), 7)) + "\nmore code " * 50
    texts = [
        ("Some text.\nReleased under the MIT License.\nMore.", [("MIT", 1)]),
        ("This program is free", []),
        (None, []),
        ("", []),
        (license_scan.TEMPLATES["ISC"][0].upper(), [("ISC", 0)]),
        ("licensed under the apache license version 2.0", [("Apache-2.0", 0)]),
        ("Released under the BSD 2-Clause.", [("BSD-2-Clause", 0)]),
        (wrapped, [("Apache-2.0", 1)]),  # over many lines, inside a longer text
        ("word " * 50_000 + "\n" + mit + "\n" + "word " * 50_000 + mit, [("MIT", 1), ("MIT", 2)]),
        (mit + " Released under the MIT License.", [("MIT", 0), ("MIT", 0)]),
    ]
    df = spark.createDataFrame([(k, x, "clash") for k, (x, _) in enumerate(texts)] + [(None, texts[0][0], ""), (0, texts[0][0], "")], "doc_id long, text string, license string")
    found = {}
    for r in license_scan.scan_licenses(df).collect():
        found.setdefault(r["doc_id"], []).append((r["license"], r["line"]))
    assert found.pop(None) == [("MIT", 1)] and found[0] == [("MIT", 1)] * 2
    assert {k: found.get(k, []) for k in range(1, len(texts))} == {k: v for k, (_, v) in enumerate(texts) if k}
    for name, given in license_scan.TEMPLATES.items():  # each template is found as itself
        for unit in given:
            assert license_scan.Templates().find(license_scan.terms(unit))[0][4] == 1.0, name
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
