"""Similarity joins, reference scans and certificates' prefilter against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.functions.certification import CERTIFICATIONS, literal, named_in, pattern
from postlake.functions.region import REGIONS, belongs
from postlake.operators import regions, similar
from postlake.operators.skills import canonical
from postlake.sources.scratch import Scratch


def words(text):
    return [w for w in re.split(r"[\s\-/]+", text.lower()) if len(w) >= 2 and w not in similar.STOP_WORDS]


def fuzzy_by_hand(values, reference, least):
    out = {}
    for v in set(values) - {None}:
        best = None
        for ord_, name in reference:
            a, b = words(v), words(name or "")
            o = sum(w in b for w in a)
            if o and name is not None:
                score = 2.0 if v.lower() == name.lower() else (o / len(a) + o / len(b)) / 2
                if score >= least - 1e-12 and (best is None or (score, -ord_) > best[0]):
                    best = ((score, -ord_), name)
        if best:
            out[v] = (best[1], round(min(best[0][0], 1.0), 9))
    return out


@pytest.mark.parametrize("least", [0.6, 0.45, 0.85])
def test_fuzzy_match_like_brute_force(spark, least):
    rng = random.Random(int(least * 100))
    rare = [f"w{k}" for k in range(40)]
    # "hot" is in a quarter of the names
    name = lambda n: rng.choice(["-", " ", "/"]).join(rng.choices(["hot", "warm", "a", "and", *rare], [12, 6, 2, 2, *[1] * 40], k=n))
    reference = [(k, name(rng.randint(1, 6))) for k in range(200)] + [(200, ""), (201, "and"), (202, None), (203, "hot hot hot"), (204, " ".join(rare[:30])), (205, "Equal Name"), (206, "equal name")]
    values = [name(rng.randint(1, 7)) for _ in range(300)] + ["", None, "hot", "HOT hot", "hot hot warm", "and", "EQUAL NAME", " ".join(rare[:20]), "w1 " * 30] + [reference[k][1] for k in range(20)]
    got = similar.fuzzy_match(spark.createDataFrame([(v,) for v in values], "v string"), spark.createDataFrame(reference, "ref_ord int, name string"), "v", least).collect()
    assert {r["v"]: (r["name"], round(r["score"], 9)) for r in got} == fuzzy_by_hand(values, reference, least)
    none = spark.createDataFrame([], "ref_ord int, name string")
    assert similar.fuzzy_match(spark.createDataFrame([("x",)], "v string"), none, "v").count() == 0


def test_canonical_prefers_known_and_equal_names(spark):
    reference = spark.createDataFrame([(0, "Time Management"), (1, "time-management"), (2, "Welding"), (3, "Pipe Welding")], "ref_ord int, name string")
    prepared = spark.createDataFrame([("welding", "WELD")], "key string, known string")
    values = spark.createDataFrame([("Welding",), ("Time-Management",), ("time/management",), ("Pipe",), ("zzz",)], "skill string")
    assert {r["skill"]: r["canonical"] for r in canonical(values, reference, prepared).collect()} == {"Welding": "WELD", "Time-Management": "time-management", "time/management": "Time Management", "Pipe": "Pipe Welding", "zzz": None}


def similar_by_hand(rows, queries, n):
    out = set()
    for q in queries:
        found = []
        for r in rows:
            if r[0] != q[0]:
                same = r[2] is not None and r[2] == q[2]
                score = 0 if same else 2 * bool(set(r[4] or ()) & set(q[4] or ())) + sum(s in (q[3] or ()) for s in r[3] or ())
                if same or score:
                    found.append((0 if same else 1, -score, r[1], r[0]))
        out |= {(q[0], i, tier, -score) for tier, score, _, i in sorted(found)[:n]}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_most_similar_like_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(similar, "MOST_PAIRED", (32, 2, 32, 32, 0)[seed])
    skills, places = [f"s{k}" for k in range((3, 12, 40, 6, 9)[seed])], [f"p{k}" for k in range((2, 6, 30, 1, 3)[seed])]
    draw = lambda xs, k: rng.sample(xs, min(len(xs), rng.randint(0, k)))
    rows = []
    for k in range(400):
        s, p = draw(skills, 5), draw(places, 3)
        if seed == 3 and rng.random() < 0.2:
            s = s + s[:1]  # repeated skills count each time
        rows.append((k, (k * 7) % 400, rng.choice([None, *(f"c{j}" for j in range((400, 60, 100, 30, 200)[seed]))]), rng.choice([s, s, s, None]), p))
    schema = "id int, ord int, company string, skills array<string>, places array<string>"
    queries = [r for r in rows if r[0] % 5 == 0]
    got = similar.most_similar(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), 4)
    assert {tuple(r) for r in got.collect()} == similar_by_hand(rows, queries, 4)


def test_hot_places_and_skills_make_no_pairs(spark):
    """A place and a skill that every posting has: rows made are linear in the queries."""
    rows = [(k, k, f"c{k}", ["hot", f"s{k % 400}"], ["everywhere"]) for k in range(2000)]
    schema = "id int, ord int, company string, skills array<string>, places array<string>"
    df, scratch = spark.createDataFrame(rows, schema), Scratch(spark, "test")
    queries = [r for r in rows if r[0] % 20 == 0]
    got = {tuple(r) for r in similar.most_similar(df, df.where("id % 20 = 0"), 5, scratch).collect()}
    assert got == similar_by_hand(rows, queries, 5)
    made = sum(spark.read.parquet(f"{scratch.root}/{t}").count() for t in ("listed", "rest"))
    assert made < 40 * len(queries)  # against 2000 for each


def test_hot_sets_of_skills_make_no_pairs(spark, monkeypatch):
    """Two skills that every posting has together, and one company with most of the first postings."""
    rows = [(k, k, "main" if k < 40 and k % 20 else f"c{k}", ["hot", "warm", f"s{k % 400}"], ["everywhere"] if k % 3 else []) for k in range(2000)]
    schema = "id int, ord int, company string, skills array<string>, places array<string>"
    df, scratch = spark.createDataFrame(rows, schema), Scratch(spark, "test")
    queries = [r for r in rows if r[0] % 20 == 0]
    expected = similar_by_hand(rows, queries, 5)
    assert {tuple(r) for r in similar.most_similar(df, df.where("id % 20 = 0"), 5, scratch).collect()} == expected
    made = sum(spark.read.parquet(f"{scratch.root}/{t}").count() for t in ("listed", "rest"))
    assert made < 60 * len(queries)  # against 2000 for each
    monkeypatch.setattr(similar, "MOST_SKILLS", 2)  # so the queries meet all that share a skill
    assert {tuple(r) for r in similar.most_similar(df, df.where("id % 20 = 0"), 5).collect()} == expected


LIST = ["Welding", "Non-Destructive Testing", "R", "C++", "C#", "Power BI", "NX", "Health & Safety", "Power", "power  bi", "Welding", "R&D", ".NET", "Testing"]


def test_scan_like_regular_expressions(spark):
    rng = random.Random(3)
    bits = [*LIST, "x", "-", " ", ", ", "welder", "non", "destructive", "++", "C", "#", "é", "_", "9", ".", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "", "."]) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "", "power bi", "POWER BI and r", "rand C++17, C#9 R&D", "word " * 20_000 + "NON-destructive testing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for least in (0, 12):
        got = {tuple(r) for r in similar.scan_terms(rows, "t", "k", LIST, least).collect()}
        assert got == {(k, term) for k, t in enumerate(texts) if t is not None and len(t) >= least for term in LIST if re.search(rf"(?ai)\b{re.escape(term)}\b", t)}
    assert similar.scan_terms(rows, "t", "k", []).count() == 0


def test_regions_by_keys_like_patterns(spark):
    """Equal keys give what the patterns of each region give."""
    rng = random.Random(7)
    bits = [*(x for r in REGIONS for x in r.locations), *(k for r in REGIONS for k in r.keywords), *(x.split(",")[0] for r in REGIONS for x in r.locations), "GB-", "NO-Oslo", "CA-AB-x", "-SK-", ", AB, Canada", "US-TX-", "x", "-", ",", " ", "Eagle Fords", "xhouston", "offshore-gulf", "São Paulo"]
    places = ["".join(rng.choice(["", "", "x", " ", "-", ", "]) + rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(500)] + [None, "", "gb-x", "HOUSTON, tx"]
    df = spark.createDataFrame([(p,) for p in places], "place string")
    tagged = F.array_compact(F.array(*(F.when(belongs(F.col("place"), r), r.id) for r in REGIONS)))
    expected = {tuple(r) for r in df.distinct().select(F.explode(tagged).alias("region"), "place").collect()}
    assert {tuple(r) for r in regions.members(df, "place", regions.region_keys(spark)).collect()} == expected and len(expected) > 300
    assert regions.members(df, "place", spark.createDataFrame([], regions.KEYS)).count() == 0


def test_literals_are_in_every_match():
    rng = random.Random(1)
    for _, _, alternatives in CERTIFICATIONS:
        for a in alternatives:
            text = re.sub(r"\[\\s[^\]]*\]\*", lambda m: rng.choice(["", " "]), a).replace(r"\b", "").replace(r"[\w\s]*", "").replace("'?", "").replace("s?", "s").replace(r"\.", ".")
            text = re.sub(r"\[(\w)[^\]]*\]\??", r"\1", text)
            found = re.search(pattern((a,)), text)
            assert found and literal(a) and literal(a) in found[0].lower(), a


def test_certificates_like_plain_patterns(spark):
    names = ["API 510", "iwcf", "First Aid Certification", "Class B CDL", "P.E. License", "USCG 100 ton License", "Lean Six Sigma", "capital", "AED certif", "commercial drivers license", "T-BOSIET"]
    rng = random.Random(9)
    texts = [". ".join(rng.choice(["Holds ", "You will manage ", "Needs a bachelor degree and ", "é", ""]) + rng.choice(names) for _ in range(rng.randint(1, 3))) for _ in range(80)] + [None, "", "nothing here"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["n"] for r in df.select("k", named_in(F.col("t")).alias("n")).collect()}
    duty, degree = re.compile(r"(?i)\bmanage\b"), re.compile(r"(?i)\bbachelor\s+degree\b")
    for k, t in enumerate(texts):
        usable = "\n".join(s.strip() for s in re.split(r"(?<=\.)|[\n\r]", re.sub(r"[^\x00-\x7f]", "§", t or "")) if s.strip() and not duty.search(s) and not degree.search(s))
        assert got[k] == sorted(n for n, _, a in CERTIFICATIONS if re.search("(?a)" + pattern(a), usable)), t
    assert Counter(len(x) for x in got.values())[0] < 70
