"""Models: held-out accuracy, exact base scores, targets; and archives."""

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postlake.llm import language_model, mixing, quality_classifier, warc
from postlake.llm.rows import with_ids, without_ids
from postlake.sources.scratch import Scratch


def sentence(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(5, 60), "abc" if i % 3 else "xyz"), "clash") for i in range(n)]
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, "never seen", ""), (0, rows[0][1], ""), (None, "ab", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), rows


def held(i, divisor, rest):
    return i is not None and zlib.crc32(str(i).encode()) % divisor == rest


def test_language_scores(spark, monkeypatch):
    df, rows = corpus(spark)
    monkeypatch.setattr(language_model, "KNOWN", 40)  # so that most words take the way of the join
    out = language_model.language_scores(df).collect()
    assert len(out) == len(rows)
    train, ends = Counter(), 0
    for i, t, _ in rows:
        if i is None or held(i, 7, 2):
            continue
        train.update((t or "").split())
        train["<end>"] += 1
    n, v = sum(train.values()), len(train)
    texts = {i: t for i, t, _ in rows}
    better = []
    for r in out:
        w = (texts[r["doc_id"]] or "").split() + ["<end>"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(train[x] > 0 for x in w), n, held(r["doc_id"], 7, 2))
        assert abs(r["base_score"] - sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        if r["held_out"]:
            better.append(r["score"] - r["base_score"])
    assert np.mean(better) > 0
    assert language_model.language_scores(df.limit(0)).count() == 0


def test_weights_learn_from_all_training_texts(spark, monkeypatch, tmp_path):
    """Each training row reaches one round's training, the others none."""
    size, folder = len(language_model.GatedModel().flat()), str(tmp_path)

    def trainer(weights, rate):
        def train(batches):
            for batch in batches:
                for codes in batch["codes"]:
                    with open(f"{folder}/{bytes(codes).decode()}", "a") as f:
                        f.write("x")
                yield pd.DataFrame({"weights": [np.zeros(size).tobytes()], "tokens": [len(batch)]})

        return train

    monkeypatch.setattr(language_model, "_trainer", trainer)
    rows = [(bytearray(f"t{k}", "ascii"), k % (language_model.ROUNDS + 1) - 1) for k in range(60)]
    language_model.fit_weights(spark.createDataFrame(rows, "codes binary, part int"), None)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {bytes(c).decode(): "x" for c, part in rows if part >= 0}


def random_model(seed=2):
    m, rng = language_model.GatedModel(), np.random.default_rng(seed)
    m.p = {k: rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in m.p.items()}
    return m


def plain_log10(m, codes):
    """One word at a time, straight from the definition."""
    n, p = language_model.HIDDEN, {k: v.astype(float) for k, v in m.p.items()}
    h, before, total = np.zeros(n), language_model.END, 0.0
    for code in codes:
        a, g = p["x"][before], h @ p["u"]
        z, r = 1 / (1 + np.exp(a[:n] + g[:n])), 1 / (1 + np.exp(a[n : 2 * n] + g[n : 2 * n]))
        h = z * h + (1 - z) * np.tanh(-(a[2 * n :] + r * g[2 * n :]) / 2)
        k = int(language_model.class_of(np.array([code]))[0])
        e = np.exp(h @ p["w"] + p["c"])
        total += math.log10(e[k] / e.sum())
        if code >= language_model.SINGLE:
            t, slot = divmod(code - language_model.SINGLE, language_model.SLOTS)
            e = np.exp(h @ p["v"][t] + p["d"][t])
            total += math.log10(e[slot] / e.sum())
        before = code
    return total


def test_gated_model_scores():
    m, rng = random_model(), np.random.default_rng(5)
    seqs = [rng.integers(0, language_model.CODES, k).astype(np.int16) for k in (1, 5, 70, 33, 2200)]
    plain = [plain_log10(m, s.tolist()) for s in seqs]
    assert np.allclose(m.totals(seqs), plain, rtol=1e-3)
    assert np.allclose(m.totals(seqs, lanes=2), plain, rtol=1e-3)  # neither windows nor lanes nor order change anything
    states, _ = m.run(np.zeros((1, 1), dtype=int), np.zeros((language_model.HIDDEN, 1), dtype=np.float32))
    rows = np.repeat(language_model._rows(states), language_model.CODES, axis=0)
    assert abs(np.exp(m.log_probabilities(rows, np.arange(language_model.CODES))).sum() - 1) < 1e-3


def test_gated_model_slopes(monkeypatch):
    m, rng = random_model(), np.random.default_rng(6)
    inputs, targets = rng.integers(0, language_model.CODES, (4, 3)), rng.integers(0, language_model.CODES, (4, 3))
    mask, h = np.ones((4, 3), dtype=np.float32), np.zeros((language_model.HIDDEN, 3), dtype=np.float32)
    mask[3, 2] = 0

    def loss():
        states, _ = m.run(inputs, h)
        return -(m.log_probabilities(language_model._rows(states), targets.ravel()) * mask.ravel()).sum() / mask.sum()

    slopes = {}
    monkeypatch.setattr(m, "_adam", lambda name, rows, slope, rate: slopes.__setitem__(name, (rows, slope)))
    m.learn(inputs, targets, mask, h, 0.1)
    for name, (rows, slope) in slopes.items():
        whole = np.zeros_like(m.p[name])
        whole[rows] = slope
        for cell in [np.unravel_index(k, whole.shape) for k in np.argsort(-np.abs(whole), axis=None)[:5]]:
            kept = m.p[name][cell]
            m.p[name][cell] = kept + 1e-2
            up = loss()
            m.p[name][cell] = kept - 1e-2
            down = loss()
            m.p[name][cell] = kept
            assert abs((up - down) / 2e-2 - whole[cell]) < 0.02 * abs(whole[cell]) + 2e-4, name


def test_language_scores_of_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, 0), (2, "w1 w2", 0), (2, "w1 w2", 0), (3, "w3", 0)], "doc_id long, text string, word int")
    out = {r["doc_id"]: r for r in language_model.score_documents(df).collect()}
    assert out[1]["n_tokens"] == 200_001 and out[1]["score"] > out[1]["base_score"]  # a cycle is easy to learn
    assert out[2]["n_tokens"] == 3


def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = sentence(rng, 40, "abcdefg") + "."
        rows.append((i, text if good else " ".join(x + "###" for x in text.split()), "clash"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good), int(i % 10 == 0)))
    rows += [(1000, None, ""), (1001, "", ""), (None, "abc", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string"), spark.createDataFrame(labels + [(None, 1, 0), (2000, None, None)], "doc_id long, quality int, toxic int")


def test_quality_scores(spark):
    df, labels = labelled(spark)
    out = quality_classifier.quality_scores(df, labels).collect()
    assert len(out) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    checked = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in checked) and len(checked) > 50
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in checked]) > 0.97
    assert quality_classifier.quality_scores(df.limit(0), labels).count() == 0
    assert quality_classifier.quality_scores(df, labels.limit(0)).count() == 403


def test_mixing(spark):
    df, labels = labelled(spark)
    domains = (("good", "quality = 1", 0.5), ("junk", "quality = 0", 0.5))
    out = mixing.mix_rates(df, labels, domains=domains)
    both = [{(r["doc_id"], round(r["rate"], 5)) for r in x.select("doc_id", "rate").collect()} for x in (out, mixing.mix(df, labels, domains=domains))]
    assert both[0] == both[1]
    total = out.agg(F.sum("tokens")).first()[0]
    sums = out.agg(*(F.sum(F.col("tokens") * F.get("posterior", k) * F.col("rate")) for k in range(2)), F.min("rate")).first()
    assert abs(sums[0] / total - 0.5) < 1e-3 and abs(sums[1] / total - 0.5) < 1e-3 and sums[2] >= 0
    rows = out.collect()
    assert len(rows) == 403 and all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert mixing.mix(df.limit(0), labels).count() == 0 and mixing.mix(df, labels.limit(0)).count() == 403


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    long = "<p>" + "ä long text " * 200
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, "short"), (4, "http://a/4", "short"), (5, "http://a/\r\n5", None), (6, "u", ""), (7, "u", long), (7, "u", long), (None, "u", "x" * 1500), (None, "u", long), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    out = warc.archived_pages(df).collect()
    assert len(out) == len(rows)
    import hashlib

    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        head = max((j for j, _, g in rows if g == h and j is not None), default=None) if len(data) >= 1000 else None
        revisit = head is not None and head != i
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted(expected, key=key)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_index_reads_single_records(spark):
    scratch = Scratch(spark, "t")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * (i + 1)) for i in range(40)], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"{scratch.root}/w", scratch)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(index.where("page_id % 13 = 0"), f"{scratch.root}/w").collect()}
    assert got == {i: f"page {i} " * (i + 1) for i in (0, 13, 26, 39)}


def test_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(50), None]], "doc_id long, text string")
    ids = spark.createDataFrame([(3,), (3,), (77,)], "doc_id long")
    assert [r["doc_id"] for r in with_ids(docs, ids).collect()] == [3]
    left = [r["doc_id"] for r in without_ids(docs, ids).collect()]
    assert len(left) == 50 and 3 not in left and None in left


def test_odd_rows(spark):
    """Null, empty and very long texts, repeated rows and columns with the names of results; every row comes back, and equal rows are judged alike."""
    long = " ".join(f"word{k % 5000}" for k in range(150_000))
    rows = [(1, None), (2, ""), (3, long), (4, "a b c."), (4, "a b c."), (None, "x y z"), (5, "a b c."), (6, "### %%%"), (7, long)]
    names = ("score", "predicted", "tokens", "posterior", "rate", "copies", "x", "terms", "slot of ids", "domain", "quality")
    docs = spark.createDataFrame([(i, t, *["clash"] * len(names)) for i, t in rows], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (4, 1, 0), (4, 1, 0), (4, 0, 0), (9, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    judged = quality_classifier.classify_quality(docs, labels).collect()
    assert len(judged) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["rate"] == "clash" for r in judged)
    assert len({r["score"] for r in judged if r["text"] == "a b c."}) == 1 and len({r["score"] for r in judged if not r["text"]}) == 1
    for out in (mixing.mix(docs, labels, domains=(("good", "quality = 1", 0.5), ("junk", "quality = 0", 0.5))).collect(), mixing.mix_rates(docs, labels).collect()):
        assert sorted(r["tokens"] for r in out) == sorted(len((t or "").split()) for _, t in rows)
        assert len({r["rate"] for r in out if r["doc_id"] in (4, 5)}) == 1 and all(r["rate"] >= 0 for r in out)
    assert quality_classifier.classify_quality(docs.limit(0), labels).count() == 0


def test_archives_of_odd_pages(spark):
    long = "<p>é</p>" * 400_000
    rows = [(1, "u", long), (2, "u", long), (3, None, None), (4, "u\r\nX: y", ""), (None, "u", "x" * 1000), (5, "u", "x" * 1000), (5, "u", "x" * 1000), (6, "u", "x" * 999), (7, "u", "x" * 999)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    out = warc.archived_pages(pages).collect()
    assert len(out) == len(rows)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out)
    size = len(long.encode())
    assert got == [(0, 1000, "revisit", 5), (1, size, "revisit", 2), (2, size, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 1000, "response", None), (5, 1000, "response", None), (6, 999, "response", None), (7, 999, "response", None)]


def test_texts_are_coded_many_at_once(monkeypatch):
    """The words of many texts are looked up at once; how many makes no difference, nor do null and empty texts and repeated rare words."""
    rng = np.random.default_rng(3)
    texts = [None, "", " ", *(" ".join(f"w{k}" for k in rng.integers(0, 60, n)) for n in rng.integers(1, 40, 50))]
    batch = pd.DataFrame({"row": np.arange(len(texts)) + 2**60, "doc_id": np.arange(len(texts)), "part": 0, "text": texts})
    counts = pd.concat(language_model._count(iter([batch])))
    by_tail = counts.groupby("tail").agg(n=("n", "sum"), v=("n", "size")).reset_index()
    vocabulary = language_model.Vocabulary(counts.sort_values("n").tail(30), by_tail, int(counts["n"].sum()), len(counts))
    table, calls = language_model.word_table(vocabulary), []
    look_up = table.rows
    table.rows = lambda tokens: calls.append(len(tokens)) or look_up(tokens)
    monkeypatch.setattr(language_model, "word_table", lambda _: table)
    out = []
    for at_once in (1 << 17, 1):
        monkeypatch.setattr(language_model, "CODED", at_once, raising=False)
        frames = list(language_model._coder(SimpleNamespace(value=vocabulary))(iter([batch])))
        rows = pd.concat([x for f in frames if len(x := f[f["word"].isna()].iloc[:, :8])], ignore_index=True)
        rare = pd.concat([x for f in frames if len(x := f.loc[f["word"].notna(), ["row", "word", "code", "times"]])], ignore_index=True).sort_values(["row", "word"], ignore_index=True)
        out.append((len(calls), rows, rare))
        calls.clear()
    (once, rows, rare), (often, rows_2, rare_2) = out
    assert once == 1 < often
    pd.testing.assert_frame_equal(rows, rows_2)
    pd.testing.assert_frame_equal(rare, rare_2)
    assert rows["n_tokens"].tolist() == [1 + len((t or "").split()) for t in texts]
    assert rare["times"].sum() + rows["n_known"].sum() == rows["n_tokens"].sum() and (rare["times"] > 1).any()


def test_words_are_counted_over_batches(monkeypatch):
    """A task passes a word on once for many batches, or in parts if there are many words; sums and tails are those of single words."""
    rng = np.random.default_rng(4)
    letters = [*"abcdefgh", *".,!-'", "\u00e9", "\u2019"]
    texts = [None, "", *(" ".join("".join(rng.choice(letters, rng.integers(1, 7))) for _ in range(rng.integers(1, 60))) for _ in range(60))]
    batches = [pd.DataFrame({"text": texts[k : k + 10]}) for k in range(0, len(texts), 10)]
    found = Counter(w for t in texts for w in (t or "").encode().split())
    hashes = language_model.word_hashes(list(found)).tolist()
    wanted = {h: (language_model.tail(w), n) for h, (w, n) in zip(hashes, found.items())} | {language_model.END_HASH: (-1, len(texts))}
    frames = list(language_model._count(iter(batches)))
    once = pd.concat(frames)
    assert {r.word: (r.tail, r.n) for r in once.itertuples()} == wanted and len(once) == len(wanted)
    monkeypatch.setattr(language_model, "COUNTED", 50)
    parts = list(language_model._count(iter(batches)))
    assert len(parts) > len(frames) and all(len(x) < 150 for x in parts)
    assert {w: (t, n) for w, t, n in pd.concat(parts).groupby("word", as_index=False).agg({"tail": "min", "n": "sum"}).itertuples(index=False)} == wanted


def test_model_computes_in_its_own_arrays():
    """A model keeps its arrays from window to window, and what it gave before or computes in another order doesn't show in what it gives."""
    m, rng = random_model(), np.random.default_rng(7)
    long, short = ([rng.integers(0, language_model.CODES, k).astype(np.int16) for k in sizes] for sizes in ((90, 64, 64, 10), (3, 40)))
    first = m.totals(long).tolist()
    kept = {k: id(v) for k, v in m.spaces.items()}
    assert m.totals(short).tolist() == random_model().totals(short).tolist()
    assert m.totals(long).tolist() == first and {k: id(v) for k, v in m.spaces.items()} == kept
    m.p["w"][0, 0] = 100  # logits beyond the bound
    assert np.isfinite(m.totals(long)).all()


def test_distinct_words_are_described_once(monkeypatch):
    """Hash, code and count of each token, from one description of each distinct word among them."""
    rng = np.random.default_rng(8)
    tokens = [f"w{k}.".encode() for k in rng.integers(0, 40, 500)]
    batch = pd.DataFrame({"text": [b" ".join(tokens[:400]).decode()]})
    counts = pd.concat(language_model._count(iter([batch])))
    by_tail = counts.groupby("tail").agg(n=("n", "sum"), v=("n", "size")).reset_index()
    vocabulary = language_model.Vocabulary(counts.sort_values("n").tail(20), by_tail, int(counts["n"].sum()), len(counts))
    known, asked = dict(zip(vocabulary.words.tolist(), zip(vocabulary.codes.tolist(), vocabulary.counts.tolist()))), []
    tails = language_model.tails
    monkeypatch.setattr(language_model, "tails", lambda found: asked.append(list(found)) or tails(found))
    rows = language_model.word_table(vocabulary).rows(tokens)
    hashes = language_model.word_hashes(tokens).tolist()
    wanted = [(h, *known.get(h, (language_model.SINGLE + language_model.SLOTS * language_model.tail(w), -1))) for h, w in zip(hashes, tokens)]
    assert list(zip(*(x.tolist() for x in rows))) == wanted
    assert [sorted(x) for x in asked] == [sorted({w for h, w in zip(hashes, tokens) if h not in known})]
    assert [len(x) for x in language_model.word_table(vocabulary).rows([])] == [0, 0, 0]
