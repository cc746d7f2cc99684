"""URL rules, divergence of sources and vector codes against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from postlake.llm import source_divergence as divergence
from postlake.llm.source_divergence import source_divergence
from postlake.llm.url_filter import Automaton, glob_pattern, judge_urls, rule_pattern
from postlake.llm.vector_codes import ENTRIES, _next_b, measured, renewed, squares, vector_codes

# ---- URL rules ----


def as_regex(glob: str) -> str:
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?s)" + re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: parts.get(m[0]) or re.escape(m[0]), glob)


def test_automaton_like_regular_expressions():
    rng = random.Random(5)
    word = lambda n, letters="ab/é.": "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    globs = ["".join(rng.choice(["*", "**", "?", word(4), "a", "/"]) for _ in range(rng.randrange(1, 7))) for _ in range(120)] + ["", "*", "**", "a" * 200 + "*b"]
    texts = [word(14) for _ in range(400)] + ["", "a" * 200 + "b", "a" * 200 + "/b", "/" * 90]
    automaton = Automaton.of([glob_pattern(g) for g in globs])
    assert len(automaton.first) > 5  # several words, so patterns straddle them
    found = automaton.matches([t.encode() for t in texts])
    for (i, t), (j, g) in itertools.product(enumerate(texts), enumerate(globs)):
        assert found[i, j] == bool(re.fullmatch(as_regex(g), t)), (t, g)


def test_rules_fit_hosts_and_their_subdomains():
    automaton = Automaton.of([rule_pattern("b.net", "/x"), rule_pattern("", "")])
    texts = [".b.net/x", ".a.b.net/xy/z", ".ab.net/x", ".b.net.org/x", ".c.org/b.net/x", ".b.net/y", ".b.net", "."]
    assert automaton.matches([t.encode() for t in texts])[:, 0].tolist() == [True, True, False, False, False, False, False, False]


def test_urls_of_every_kind(spark):
    long = "http://x.net/" + "a" * 50_000
    urls = [None, "", "no scheme", "http://A.NET/q", "http://a.net?x=1", "http://www.Example.net/en/1", "http://example.net/EN/1", "https://m.example.com/de/", "https://m.example.com/DE/", "x://y.org/fr/é#top", "http://t.ads-x.info/a", "http://t.info/setup.exe", "http://É.net/", "a://b://c.net/", long, long]
    rows = [Row(page_id=k, url=u, host="old", extra=k) for k, u in enumerate(urls)] + [Row(page_id=None, url="http://a.net/", host="old", extra=None)]
    out = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, extra long")).collect()}
    assert out[0].asDict().keys() == {"page_id", "url", "host", "extra", "path", "rule", "verdict"}
    got = [(out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) for k in range(14)]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/q", "net/", "block"), ("a.net", "", None, "allow"), ("www.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/EN/1", "net/", "block"), ("m.example.com", "/de/", "example.com/de/", "block"), ("m.example.com", "/DE/", None, "allow"), ("y.org", "/fr/é", "org/fr/", "allow"),
        ("t.ads-x.info", "/a", None, "block"), ("t.info", "/setup.exe", None, "block"), ("É.net", "/", "net/", "block"), ("b:", "//c.net/", None, "allow"),
    ]
    assert out[14]["rule"] == out[15]["rule"] == "net/" and len(out[14]["path"]) == 50_001
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_ties_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://b.net/aa")], "page_id long, url string")
    rules = (("allow", "b.net", "/"), ("block", "net", "/aa"), ("allow", "net", "/a"))
    assert judge_urls(pages, rules=rules).first()[-2:] == ("net/aa", "block")
    assert judge_urls(pages, rules=(), blocked=()).first()[-2:] == (None, "allow")


# ---- divergence of sources ----


def divergences(rows, least: int, top: int):
    docs = [(lang or "", source or "", Counter(re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= least)
        groups = {s: sum((d[2] for d in docs if d[:2] == (lang, s)), Counter()) for s in {d[1] for d in docs if d[0] == lang}}
        scale = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = scale(sum(groups.values(), Counter()))
        for s, c in groups.items():
            p = scale(c)
            pairs = sorted((-sum(abs(p[t] - x) for t, x in scale(groups[o]).items()), o.encode(), o) for o in groups if o != s)
            over = sorted((q[t] - p[t], t.encode(), t) for t in kept if c[t] and p[t] > q[t])[:top]
            out |= {(lang, s, part, name, -v, k + 1) for part, found in (("pair", pairs), ("term", over)) for k, (v, _, name) in enumerate(found)}
    return out


@pytest.mark.parametrize(("terms", "sources"), [(256, 256), (3, 2)])
def test_divergence_like_brute_force(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rng = random.Random(terms)
    words = ["the", "Über", "ÜBER", "ß", "rare", "x1y", "日本", "don't", "zz"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "", None, "z z", "odd\x00one"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("1 2 3", "fr", "a"), ("1 2", "fr", "b"), ("solo", "it", "only")] + [("again and again", "en", "a")] * 40 + [("long " * 30_000, "de", "a")]
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value string")
    got = {tuple(r) for r in source_divergence(df, min_docs=9, top_terms=4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == divergences(rows, 9, 4)


def test_terms_are_cut_by_bytes(spark):
    """Whole batches at once, in slices too: any characters, capitals outside ASCII, empty and blank texts."""
    rng = random.Random(5)
    rows = [("en", "s", "".join(rng.choice("aZé ÉÜß1.\n\t\u00a0\u2028ſİ漢🙂\x00\x7f@[`{") for _ in range(rng.randrange(12)))) for _ in range(300)]
    pattern = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [pattern.findall(text.translate(lower)) for _, _, text in rows]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    assert [[t for t in r["tokens"] if t] for r in divergence.tokenised(df).collect()] == expected
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "source", "text"])
    for part, at in ((batch.slice(7, 90), 7), (batch.slice(3, 0), 3)):
        (out,) = divergence._cut(iter([part]))
        assert [[t for t in x if t] for x in out.column(2).to_pylist()] == expected[at : at + len(part)]


def test_divergence_keeps_terms_by_language(spark):
    """A term in enough documents of all languages together, but of none alone, is fitted and not kept."""
    rows = [(lang, source, f"both {lang}{source} own{lang}") for lang in ("de", "en") for source in "st" for _ in range(2)] + [("de", "s", "both"), ("en", "t", "")]
    df = spark.createDataFrame([(lang, source, text) for lang, source, text in rows], "lang string, source string, text string")
    for least in (2, 4, 5, 6):
        got = {tuple(r) for r in source_divergence(df, min_docs=least).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == divergences([(text, lang, source) for lang, source, text in rows], least, 50), least


def test_divergence_without_terms_or_rows(spark):
    df = spark.createDataFrame([("a", "en", "s"), ("b", "en", "t")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergence(df).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert source_divergence(df.limit(0)).count() == 0


# ---- vector codes ----


def codes(vectors: list, rounds: int = 6):
    """Plain rounds of all distances over rows (vec_id, label, integers) in order."""
    x = np.array([v[2] for v in vectors], dtype=np.int64).reshape(len(vectors), 8, -1)
    books = [[x[e, k].copy() for e in range(min(16, len(x)))] for k in range(8)]
    nearest = lambda: [[min(range(len(b)), key=lambda e: (int(((x[i, k] - b[e]) ** 2).sum()), e)) for k, b in enumerate(books)] for i in range(len(x))]
    for _ in range(rounds):
        found = nearest()
        for k in range(8):
            for e in range(len(books[k])):
                if (own := [i for i in range(len(x)) if found[i][k] == e]):
                    books[k][e] = np.array([sum(int(v) for v in x[own, k, p]) // len(own) for p in range(x.shape[2])])
    found = nearest()
    error = [sum(int(((x[i, k] - books[k][found[i][k]]) ** 2).sum()) for k in range(8)) for i in range(len(x))]
    labels = Counter()
    for v, e in zip(vectors, error):
        labels[v[1]] += e
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((v[0], "".join(f"{e:02x}" for e in f), e, labels[v[1]], digest) for v, f, e in zip(vectors, found, error)), key=str)


def vector_rows(spark, rows, columns="vec_id long, embedding array<float>, label int, code string"):
    out = vector_codes(spark.createDataFrame(rows, columns)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_codes_like_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    rows = [(int(v), (centres[v % 5] * (v % 3) + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), None if v % 4 == 0 else int(v % 3), "old") for v in rng.permutation(400)]
    rows += [(1000 + k, rows[k % 3][1], 1, "old") for k in range(100)]  # exact copies, ties
    rows += [(-5, None, 1, "x"), (-4, [None] * 16, 1, "x"), (-3, [math.nan] * 16, 1, "x"), (-2, [math.inf] + [0.0] * 15, 1, "x"), (-1, [1e30] + [0.0] * 15, 1, "x"), (2000, [0.5] * 8, 1, "x"), (7, rows[0][1], 2, "twice")]
    kept = [(v, label, [math.floor(4096 * float(c)) for c in e]) for v, e, label, _ in rows if v >= 0 and v != 2000]
    assert vector_rows(spark, rows) == codes(sorted(kept, key=lambda r: (r[0], r[2])))


def test_codes_of_few_vectors(spark):
    rows = [(3, [0.5, -0.5, 0.25, 0.0] * 2, None, ""), (None, [0.0] * 8, None, ""), (1, [0.1] * 8, 4, "")]
    kept = [(v, label, [math.floor(4096 * float(np.float32(c))) for c in e]) for v, e, label, _ in (rows[2], rows[0], rows[1])]
    assert vector_rows(spark, rows) == codes(kept)
    assert vector_rows(spark, []) == [] == vector_rows(spark, [(1, [1.0], 1, "")])
    assert vector_rows(spark, [(1, [], 1, ""), (2, [1.0], 1, "")]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_bounds_hold_while_entries_move_and_b_changes():
    rng = np.random.default_rng(11)
    x, book, b = rng.integers(-9, 9, (600, 2)), rng.integers(-9, 9, (ENTRIES, 2)), 3
    entry, upper, near, lower, outer = measured(x, book, b)
    for k in range(12):
        new = book + rng.integers(-2, 3, book.shape) * (k % 3 > 0)
        b = (5, 2, 15, 3)[k % 4]
        entry, upper, near, lower, outer, _ = renewed(x, new, np.sqrt(squares(new, book).astype(float)), entry, upper, near, lower, outer, b)
        book = new
        every = squares(x[:, None], book[None])
        assert (entry == every.argmin(axis=1)).all()
        far = np.sqrt(every)
        assert (upper >= far[np.arange(600), entry] * (1 - 1e-12)).all() and near.shape == (600, b)
        for i in range(600):
            listed = [e for e in near[i] if e != 255]
            assert all(lower[i, z] <= far[i, e] for z, e in enumerate(near[i]) if e != 255) and len({*listed, entry[i]}) == len(listed) + 1
            assert all(outer[i] <= far[i, e] for e in range(ENTRIES) if e != entry[i] and e not in listed)


def test_b_follows_need():
    depth = [0] * (ENTRIES + 1)
    depth[0], depth[ENTRIES] = 50, 50
    assert _next_b(4, depth) == 8 and _next_b(12, depth) == ENTRIES - 1
    depth[3], depth[ENTRIES] = 1, 2
    assert _next_b(8, depth) == 3
