"""Readers, writers, providers and the functions that no query reaches."""

import datetime
import json

from pyspark.sql import functions as F

from postlake.functions import location as loc, role, text as tx
from postlake.functions.certification import named_in_posting
from postlake.functions.region import REGIONS, option_belongs
from postlake.operators import facets, filters, merge, skills
from postlake.sources import ingest, providers, sinks
from postlake.sources.schemas import OCCUPATION
from postlake.sources.tables import register_views
from postlake.streaming.sync import sync_available


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_postings_of_json(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": "a", "title": "Welder", "skills": ["x"], "structuredDescription": {"sections": []}}, {"id": "b", "status": "removed"}]))
    rows = ingest.json_postings(spark, str(tmp_path / "jobs.json")).orderBy("id").collect()
    assert [(r["id"], r["title"], r["skills"], r["status"]) for r in rows] == [("a", "Welder", ["x"], None), ("b", None, None, "removed")]
    assert [r["id"] for r in filters.unprocessed(ingest.json_postings(spark, str(tmp_path / "jobs.json")), "structuredDescription").collect()] == ["b"]


def test_batches_by_file_name(spark, tmp_path):
    for k, name in ((2, "batch-2-processed.json"), (10, "batch-10-processed.json")):
        (tmp_path / name).write_text(json.dumps([{"id": "a", "title": f"t{k}"}, {"url": f"u{k}"}]))
    batches = ingest.batch_files(spark, str(tmp_path)).withColumn("key", merge.fallback_key(spark.createDataFrame([], "id string, url string")))
    assert sorted((r["key"], r["batch"]) for r in batches.collect()) == [("a", 2), ("a", 10), ("u10", 10), ("u2", 2)]
    last = merge.merge_batches(spark.createDataFrame([("a",), ("c",)], "key string"), batches.select("key", "batch", "title"), "key", "title", "batch")
    assert sorted((r["key"], r["title"]) for r in last.collect()) == [("a", "t10"), ("c", None)]


def test_scraped_rows(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([("http://x/1", "C", "T", None, at, at, None), ("", "C", "T", "active", at, at, None), ("u", "C", None, "active", at, at, None)], "url string, company string, title string, status string, first_seen timestamp, last_seen timestamp, status_changed_date timestamp")
    assert [(r["id"], r["status"], r["postedDate"]) for r in ingest.scraped(rows).collect()] == [("http---x-1", "active", at)]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "geo.json").write_text(json.dumps({"US-TX-Houston": {"city": "Houston", "stateCode": "TX", "countryCode": "US"}}))
    assert [(r["key"], r["city"]) for r in ingest.places(spark, str(tmp_path / "geo.json")).collect()] == [("US-TX-Houston", "Houston")]
    (tmp_path / "skills.json").write_text(json.dumps({"welding": {"normalized": "Welding", "onet": {"name": "Welding and Brazing"}}, "x": {"normalized": "X", "onet": None}}))
    known = ingest.known_skills(spark, str(tmp_path / "skills.json"))
    assert sorted((r["key"], r["name"]) for r in known.select("key", "onet.name").collect()) == [("welding", "Welding and Brazing"), ("x", None)]
    assert ingest.places(spark, str(tmp_path / "none.json")).count() == 0
    table = spark.createDataFrame([(k, k * 2) for k in (3, 1, 2)], "key int, value int")
    sinks.write_dictionary(table, str(tmp_path / "d"), "key")
    assert sorted(map(tuple, ingest.entries(spark, str(tmp_path / "d"), "key int, value int").collect())) == [(1, 2), (2, 4), (3, 6)]
    for _ in range(2):
        sinks.append_log(table, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_dictionary_reports_broken_entries(spark, tmp_path):
    """Each entry stands for itself: a broken one doesn't take the others with it."""
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"1": {"match_type": "ai", "role_id": "welder", "is_priority": True, "match_count": 3, "more": [1]}, "2": {"match_type": "onet_fallback"}, "3": "text", "4": None, "5": {"is_priority": "maybe"}, "6": {"match_type": {"no": "text"}, "match_count": []}, "": {}}))
    rows = {r["key"]: r for r in ingest.occupations(spark, str(path)).collect()}
    assert rows["1"]["match_count"] == 3 and rows["1"]["is_priority"] is True and rows["2"]["match_type"] == "onet_fallback" and rows["2"]["role_id"] is None
    assert {"1", "2", ""} <= {*rows} and not {"3", "4"} & {*rows}
    broken = {r["key"]: r["entry"] for r in ingest.dictionary(spark, str(path), OCCUPATION, broken=True).collect()}
    assert {"3", "4"} <= {*broken} and {*rows} | {*broken} == {"", *"123456"} and not {*rows} & {*broken}
    for odd in ("[1, 2]", "not json", "", "7", "null"):
        path.write_text(odd)
        assert ingest.occupations(spark, str(path)).count() == 0


def test_metadata_of_places(spark):
    geo = "city string, state string, stateCode string, country string, countryCode string, coordinates struct<longitude: double, latitude: double>"
    rows = [("locations\nUS-TX-Houston", None), ("SG-x", ("Singapore River", "Singapore", None, None, None, None)), ("somewhere", ("Oslo", None, None, None, "no", (10.7, 59.9))), ("Houston, TX", None), ("12 Main St.", None), ("GLOBAL", ("X", None, None, None, "ZZ", None)), ("Paris, FR", None)]
    df = spark.createDataFrame(rows, f"raw string, geo struct<{geo}>")
    out = [r["m"] for r in df.select(loc.metadata(F.col("raw"), F.col("geo")).alias("m")).collect()]
    assert [(m["original"], m["country"], m["country_code"], m["source"]) for m in out] == [
        ("US-TX-Houston", "United States", "US", "fallback"), ("SG-x", "Singapore", "SG", "geocoded"), ("somewhere", "Norway", "no", "geocoded"), ("Houston, TX", "United States", "US", "fallback"),
        ("12 Main St.", "Other", None, "fallback"), ("GLOBAL", "Other", "ZZ", "geocoded"), ("Paris, FR", "France", "FR", "fallback"),
    ]
    assert out[1]["state"] is None and out[2]["latitude"] == 59.9 and out[0]["formatted"] == "Houston, TX"
    shown = spark.createDataFrame([("a\nb\nlocations", ("Oslo", None, None, "Norway", "NO", None)), ("US-TX-Houston\nx", None), (None, None), ("", ("Oslo", None, None, "Norway", "NO", None))], f"cell string, geo struct<{geo}>")
    assert [r["d"] for r in shown.select(loc.display_from(F.col("cell"), F.col("geo")).alias("d")).collect()] == ["Oslo, Norway +1 more", "Houston, TX +1 more", None, None]


def test_sync_survives_other_writers_and_failures(spark, tmp_path):
    source, snapshot, checks = str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "check")
    sinks.write_snapshot(spark.createDataFrame([(9, 0)], "k int, n int"), snapshot)  # of another writer
    schema = spark.createDataFrame([], "k int, n int").schema
    run = lambda: sync_available(spark, source, schema, snapshot, checks, "k", "n")
    spark.createDataFrame([(1, 1), (1, 2)], "k int, n int").write.parquet(source)
    run()
    spark.createDataFrame([(1, 3), (2, 1)], "k int, n int").write.mode("append").parquet(source)
    run()
    assert sorted(map(tuple, sinks.read_snapshot(spark, snapshot).collect())) == [(1, 3), (2, 1), (9, 0)]
    assert sinks.batches_done(spark, snapshot) == {0, 1} and sinks.versions(spark, snapshot) == [1, 2, 3]
    # the batch was written, but the stream stopped before it said so: it runs again and changes nothing
    for path in (tmp_path / "check" / "commits").iterdir():
        if path.name in ("1", ".1.crc"):
            path.unlink()
    run()
    assert sinks.versions(spark, snapshot) == [1, 2, 3]


def test_providers_offline(spark):
    class Flaky:
        def __init__(self):
            self.asked = 0

        def ask(self, key):
            self.asked += 1
            if key == "bad" or self.asked == 1:
                raise ValueError("no")
            return {"key": key}

    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "k string").coalesce(1)
    rows = {r["k"]: (r["response"], r["error"]) for r in providers.enrich(keys, "k", Flaky()).collect()}
    assert rows == {"a": ('{"key": "a"}', None), "bad": (None, "ValueError: no")}
    assert providers.FakeGeocoder().ask("US-TX")["countryCode"] == "US" and providers.FakeClassifier(["w"]).ask("t")["roleId"] == "w"
    assert len(providers.FakeStructurer().ask("a\n\nb")["sections"]) == 2
    now = F.lit("2024-02-01").cast("timestamp")
    assert [one(spark, providers.fresh(F.lit(x).cast("timestamp"), now)) for x in ("2024-01-20", "2023-12-01")] == [True, False]


def test_lookups(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "id int, ord int, v string")
    assert filters.by_id(df, 1).first()["v"] == "a"
    assert sorted(map(tuple, merge.first_per_key(df, "id", "ord").select("id", "v").collect())) == [(1, "a"), (2, "c")]
    assert one(spark, loc.search_query(F.lit("12 US-TX-Houston +2 more"))) == "Houston, US"
    gulf = next(r for r in REGIONS if r.id == "gulf-of-mexico")
    assert one(spark, option_belongs(F.lit("Houston, TX"), F.lit("US"), F.lit("TX"), gulf)) and not one(spark, option_belongs(F.lit("Oslo"), F.lit("NO"), F.lit(None).cast("string"), gulf))
    assert one(spark, named_in_posting(F.lit("Needs BOSIET. You will manage HUET people."), F.array(F.lit("PMP")))) == ["BOSIET", "PMP"]
    assert one(spark, tx.slug_to_company(F.lit("acme-drill-co"))) == "Acme Drill Co"
    assert [one(spark, tx.token_budget(F.lit("x" * n))) for n in (10, 6000, 90_000)] == [2048, 3000, 4096]
    assert [one(spark, tx.percent(F.lit(a), F.lit(b), d)) for a, b, d in ((49, 80, 1), (1, 3, 1), (0, 0, 1), (1, 2, 0), (1, 400, 2))] == ["61.3%", "33.3%", "NaN%", "50%", "0.25%"]


def test_roles_as_known(spark):
    """Rows whose results are known from reading."""
    known = {
        ("47-5013.00", "x"): "drilling-operations", ("17-2141.00", ""): "engineering-mechanical", ("11-9032.00", "Principal"): "other",
        (None, "Senior Toolpusher"): "drilling-operations", (None, "Accountant"): "other", ("15-1252.00", "driller"): "software-developers",
    }
    df = spark.createDataFrame(list(known), "code string, title string")
    assert {(r["code"], r["title"]): r["role"] for r in df.select("code", "title", role.of_code(F.col("code"), F.col("title")).alias("role")).collect()} == known
    m = {t: one(spark, role.match(F.lit(t))) for t in ("Lead ROV Supervisor", "Geosteering Geologist", "Ingeniero de Perforación Direccional", "", "Clerk")}
    assert m["Lead ROV Supervisor"]["keyword"] == "ROV Supervisor" and m["Geosteering Geologist"]["role_id"] == "directional-drilling"
    assert m["Ingeniero de Perforación Direccional"]["role_id"] == "directional-drilling" and m[""] is None and m["Clerk"] is None
    assert one(spark, role.validated(F.lit("nope"), F.lit("high")))["confidence"] == "none"


def test_skills_as_known(spark):
    reference = spark.createDataFrame([(0, "Non-Destructive Testing"), (1, "Welding"), (2, "Health and Safety"), (3, "Crane Operation")], "ref_ord int, name string")
    prepared = spark.createDataFrame([("rigging", "Rigging Work")], "key string, known string")
    values = spark.createDataFrame([(x,) for x in ("Rigging", "welding", "Non Destructive Testing", "Crane Operation Safety", "Poetry", "Safety")], "skill string")
    found = {r["skill"]: r["canonical"] for r in skills.canonical(values, reference, prepared).collect()}
    assert found == {"Rigging": "Rigging Work", "welding": "Welding", "Non Destructive Testing": "Non-Destructive Testing", "Crane Operation Safety": "Crane Operation", "Poetry": None, "Safety": "Health and Safety"}
    raws = spark.createDataFrame([(1, 0, "Welding and Rigging"), (1, 1, "strong WELDING skills"), (2, 0, "Poetry")], "id int, place int, raw string")
    assert {r["id"]: r["skills"] for r in skills.processed(raws, reference, prepared).collect()} == {1: ["Welding", "Rigging Work"]}
    answers = spark.createDataFrame([("Welding", "Welding and Brazing"), ("Rigging", "Something else")], "skill string, answer string")
    assert {r["id"]: r["skills"] for r in skills.processed_remotely(raws, answers).collect()} == {1: ["Welding and Brazing"], 2: ["Poetry"]}  # a gerund that is no known field is no skill
    assert [one(spark, skills.is_reference(F.lit(x))) for x in ("Welding", "Manage people", "a b c d e f", "x" * 41)] == [True, False, False, False]
    assert one(spark, skills.searchable(F.array(F.lit("Raw")), F.lit(None).cast("array<string>"))) == ["raw"]


def test_places_as_known(spark):
    known = {"Houston, Texas": "Houston, TX", "Houston": "Houston, TX", "london": "london, United Kingdom", "Noble BlackLion": "Noble BlackLion", " ": None, "Oslo, Norway": "Oslo, Norway", "X": "X"}
    assert {x: one(spark, loc.normalized(F.lit(x))) for x in known} == known
    assert one(spark, loc.filter_option(F.lit("Calgary, AB, Canada"))).asDict() == {"label": "Canada: Calgary, AB", "value": "Calgary, AB, Canada", "country": "Canada", "search_text": "canada calgary ab"}
    assert [one(spark, facets.page_title(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) for a, b in ((("r", "s", "t"), ("l",)), ((), ("l",)))] == ["r, s - l Jobs", "l Jobs"]


def test_views(spark):
    register_views(spark, "/root/testdata/sf0.001", ("region",))
    assert spark.sql("select count(*) from region").first()[0] == 5
