"""Operators on small tables."""

import json

from pyspark.sql import functions as F

from postlake.operators import blocks, facets, merge, similar
from postlake.operators.filters import FilterSpec, company_page, is_active, page
from postlake.sources import ingest, providers, sinks
from postlake.sources.schemas import GEO
from postlake.streaming.sync import sessions, sync_available, upsert, windowed_counts

POSTS = [
    (1, 1, "Welder", "Acme Oil", None, "FT", ["Houston, TX"], ["Welding", "Python"], ["BOSIET"], "welder"),
    (2, 2, "Welder II", "Acme Oil", "removed", "FT", ["Houston, TX"], ["Welding"], [], "welder"),
    (3, 3, "Driller", "Drill Co", "active", None, ["Midland, TX", "Houston, TX"], ["welding"], ["H2S"], None),
    (4, 4, "Clerk", "Drill Co", "paused", "PT", [], [], [], None),
    (5, 5, "Cook", "Cater", "odd", "PT", ["Aberdeen, United Kingdom"], ["Cooking"], [], "other"),
]


def posts(spark):
    return spark.createDataFrame(POSTS, "id int, ord int, title string, company string, status string, employment_type string, location_names array<string>, skill_names array<string>, certification_names array<string>, role_id string")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_filters(spark):
    df = posts(spark)
    assert ids(FilterSpec().apply(df)) == [1, 3, 5]
    assert ids(FilterSpec(show_inactive=True).apply(df)) == [1, 2, 3, 4, 5]
    assert ids(FilterSpec(skills=["WELDING"]).apply(df)) == [1, 3]
    assert ids(FilterSpec(locations=["Houston, TX"], companies=["Drill Co"]).apply(df)) == [3]
    assert ids(FilterSpec(regions=["permian-basin"]).apply(df)) == [3]
    assert ids(FilterSpec(employment_types=["FT"], roles=["welder"], certifications=["BOSIET"]).apply(df)) == [1]
    assert ids(company_page(df, "acme-oil")) == [1, 2]
    assert ids(page(df.where(is_active()), 1, 2)) == [1, 3]


def test_skills_without_canonical_names(spark):
    """A posting whose canonical skills are missing is found by its raw ones; one that has none isn't."""
    df = spark.createDataFrame([(1, None, ["NDT", "Welding"], ["Welding"]), (2, None, ["welding"], None), (3, None, ["welding"], []), (4, None, None, None)], "id int, status string, skills array<string>, skill_names array<string>")
    out = FilterSpec(skills=["Welding"]).apply(df)
    assert ids(out) == [1, 2] and out.columns == df.columns and {r["id"]: r["skill_names"] for r in out.collect()} == {1: ["Welding"], 2: None}
    assert ids(FilterSpec(skills=["ndt"]).apply(df)) == []


def test_rates_and_checks(spark):
    none = spark.createDataFrame([], "role string")
    assert facets.match_rate(none, "role").first() == (0, 0, 0, "NaN%")
    assert facets.match_rate(spark.createDataFrame([("a",), (None,), ("b",)], "role string"), "role").first() == (3, 2, 1, "66.7%")
    rows = [(1, None, ["Welding", "5 yrs welding", "Must weld"]), (2, "active", None), (3, "removed", ["a degree"]), (4, None, ["Skill (x)", "Welding", "Degrees"])]
    df = spark.createDataFrame(rows, "id int, status string, skills array<string>")
    out = {r["check"]: (r["rows"], r["broken"]) for r in facets.skill_checks(df, "skills", spark.createDataFrame([("Welding",), ("Diving",)], "skill string")).collect()}
    assert out == {"years": (5, 1), "education": (5, 1), "parentheses": (5, 1), "generic start": (5, 1), "options without postings": (2, 1), "postings without skills": (3, 1)}


def test_filter_links():
    spec = FilterSpec(companies=["A, Inc", "B"], locations=["Houston, TX"], show_inactive=True)
    assert FilterSpec.from_query(spec.to_query()) == spec
    assert FilterSpec.from_query("companies=A,B", comma=True).companies == ["A", "B"]
    assert FilterSpec().to_query() == ""


def test_facets(spark):
    df = posts(spark)
    assert [tuple(r) for r in facets.top_companies(df).collect()] == [("Acme Oil", 1), ("Drill Co", 1), ("Cater", 1)]
    assert sorted(r[0] for r in facets.distinct_ignoring_case(df, "skill_names", "s").collect()) == ["Cooking", "Python", "Welding"]
    terms = spark.createDataFrame([("Welding",), ("Diving",)], "s string")
    assert {tuple(r) for r in facets.zero_filled(terms, facets.exploded(df, "skill_names", "s"), "s").collect()} == {("Welding", 2), ("Diving", 0)}


def test_merges(spark):
    fetched = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    old = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "id int, result string, n int")
    assert sorted(map(tuple, merge.merge_snapshot(fetched, old, "id", ["result"], "n").select("id", "result").collect())) == [(1, "y"), (2, None), (3, None)]
    assert ids(merge.new_rows(fetched, old, "id")) == [2, 3]
    assert ids(merge.updated_rows(fetched, old, "id", F.lit(True), "text")) == [1]
    assert sorted(map(tuple, merge.overlay(fetched, old.where("n = 2"), "id", "result").select("id", "result", "enhanced").collect())) == [(1, "y", True), (2, None, False), (3, None, False)]
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["row_no"] - 1 for r in merge.numbered(many, "k").orderBy("k").collect()] == list(range(1000))
    assert upsert(None, old, "id", "n").count() == 2 and upsert(fetched, fetched.limit(1), "id", "text").count() == 3


def test_similar(spark):
    df = posts(spark).withColumn("skills", F.col("skill_names"))
    assert [tuple(r) for r in similar.similar_to(df, 1, 5).collect()] == [(2, 0, 0), (3, 1, 2)]
    ref = spark.createDataFrame([(0, "Welding and Cutting"), (1, "Welding"), (2, "Project Management")], "ref_ord int, name string")
    vals = spark.createDataFrame([("welding",), ("project",), ("nothing",)], "v string")
    assert {(r["v"], r["name"]) for r in similar.fuzzy_match(vals, ref, "v").collect()} == {("welding", "Welding"), ("project", "Project Management")}
    texts = spark.createDataFrame([(1, "MIT License, v2 and mit"), (2, "Smith"), (3, None)], "k int, t string")
    assert sorted(map(tuple, similar.scan_terms(texts, "t", "k", ["MIT", "MIT License"]).collect())) == [(1, "MIT"), (1, "MIT License")]


def test_blocks(spark):
    df = spark.createDataFrame([(1, "Job Overview\n\n• First\n• Second\n• Third"), (2, "RESPONSIBILITIES:\nDo work\n\nQUALIFICATIONS:\nHave skills"), (3, "First\n\n\nSecond"), (4, ""), (5, None)], "k int, t string")
    out = {k: [] for k in range(1, 6)}
    for r in blocks.text_blocks(df, "k", "t").orderBy("k", "block_no").collect():
        out[r["k"]].append((r["type"], r["content"] or r["items"]))
    assert out == {
        1: [("paragraph", "Job Overview"), ("list", ["First", "Second", "Third"])],
        2: [("header", "Responsibilities"), ("paragraph", "Do work"), ("header", "Qualifications"), ("paragraph", "Have skills")],
        3: [("paragraph", "First Second")],
        4: [],
        5: [],
    }


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,Company,URL,Skills,Status\nWelder,,http://x/1,"a; b;",\n,Nobody,http://x/2,,\nCook,Cater,http://x/3,,paused\n')
    (tmp_path / "b.csv").write_text("Name\nx\n")
    rows = {r["title"]: r for r in ingest.sheets(spark, {"Acme": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}).collect()}
    assert {*rows} == {"Welder", "Cook"} and rows["Welder"]["company"] == "Acme" and rows["Welder"]["status"] == "active" and rows["Welder"]["skills"] == ["a", "b"] and rows["Welder"]["id"] == "acme-http---x-1"
    (tmp_path / "geo.json").write_text(json.dumps({"US-TX": {"city": "Houston", "countryCode": "US"}}))
    assert ingest.dictionary(spark, str(tmp_path / "geo.json"), GEO).first()["city"] == "Houston"
    assert ingest.dictionary(spark, str(tmp_path / "none.json"), GEO).count() == 0
    df = spark.range(5)
    assert [sinks.write_snapshot(df, str(tmp_path / "snap")), sinks.write_snapshot(df.limit(2), str(tmp_path / "snap"))] == [1, 2]
    assert sinks.read_snapshot(spark, str(tmp_path / "snap")).count() == 2 and sinks.read_snapshot(spark, str(tmp_path / "snap"), 1).count() == 5
    sinks.write_batches(spark.range(950), str(tmp_path / "batches"), "id")
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "batches")).groupBy("batch").count().collect()) == [150, 400, 400]


def test_providers(spark):
    class Flaky:
        def ask(self, key):
            if key == "bad":
                raise ValueError("no")
            return {"k": key}

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "k string")
    out = {r["k"]: (r["response"], r["error"]) for r in providers.enrich(keys, "k", Flaky(), 2).collect()}
    assert out == {"a": ('{"k": "a"}', None), "bad": (None, "ValueError: no")}
    answer = 'Sure:\n```json\n{"sections": [{"title": "A", "type": "list", "content": "[\\"x\\", \\"y\\"]"}, {"title": "", "type": "paragraph", "content": "z"}]}\n```'
    got = spark.createDataFrame([(answer,), ("no json",)], "a string").select(providers.sections_text(providers.sections_of_answer(F.col("a"))).alias("t")).collect()
    assert [r["t"] for r in got] == ["x\ny", None]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int").coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    run = lambda: sync_available(spark, source, schema, str(tmp_path / "snap"), str(tmp_path / "check"), "k", "n")
    run()
    spark.createDataFrame([(1, "c", 2), (3, "d", 2)], "k int, v string, n int").coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    assert {(r["k"], r["v"]) for r in sinks.read_snapshot(spark, str(tmp_path / "snap")).collect()} == {(1, "c"), (2, "b"), (3, "d")}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x", 1.0), (1, "2024-01-01 00:10:00", "x", 2.0), (1, "2024-01-01 02:00:00", "x", 3.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sessions(events).count() == 2 and windowed_counts(events).count() == 2
