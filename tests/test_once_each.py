"""What is costly is computed for distinct values, not for rows, and gives the same."""

import os

import pytest
from pyspark.sql import functions as F

from postlake.functions import location as loc
from postlake.operators import facets
from postlake.operators.filters import FilterSpec
from postlake.operators.skills import processed
from postlake.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
CELLS = [
    (0, "active", "Locations\nUS-TX-HOUSTON\nGB-ABERDEEN"),
    (1, None, "Location:\nUS-TX-HOUSTON"),
    (2, None, "Location:\n \n"),
    (3, "removed", "US-TX-HOUSTON"),
    (4, "active", None),
    (5, "active", "AE-DUBAI\nlocations GB-ABERDEEN\nUS-TX-HOUSTON"),
]


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(CELLS, "ord long, status string, location string").withColumn("id", F.col("ord"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def below_first_grouping(df):
    """The plan's deepest part: all below the last Aggregate, which is the one over the rows."""
    return plan(df).rsplit("aggregate [", 1)[1].split("\n", 1)[1]


def test_filters_on_names_stay_above_the_count(posts):
    counted = facets.place_counts(posts)
    named = counted.groupBy("name").agg(F.sum("n").alias("n")).where(loc.in_region(F.col("name"), "United States", "TX"))
    assert [tuple(r) for r in named.collect()] == [("Houston, TX", 3)]
    assert "initcap" in plan(named) and "initcap" not in below_first_grouping(named)
    assert {(r["name"], r["n"], r["first_ord"]) for r in counted.collect()} == {("Houston, TX", 3, 0), ("Aberdeen, United Kingdom", 1, 0), ("Dubai, United Arab Emirates", 1, 5), ("Aberdeen, United Kingdom", 1, 5)}


@pytest.mark.parametrize("name", ["location_option_counts", "faceted_filter_all", "location_display"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_names_come_from_a_written_table(spark, name):
    assert "initcap" not in plan(QUERIES[name](spark, DATA))


def test_filter_on_raw_places(posts):
    posts = posts.withColumn("company", F.lit("A"))
    named = posts.withColumn("location_names", loc.all_formatted(F.col("location")))
    for spec in (FilterSpec(locations=["Aberdeen, United Kingdom"]), FilterSpec(locations=["Houston, TX"], show_inactive=True), FilterSpec(regions=["north-sea", "gulf-coast"]), FilterSpec(companies=["B"], locations=["Houston, TX"]), FilterSpec()):
        ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
        assert ids(spec.apply_to_raw(posts)) == ids(spec.apply(named))


def test_display_parses_one_place(posts):
    shown = {r["id"]: r["d"] for r in posts.select("id", loc.display(F.col("location")).alias("d")).collect()}
    assert shown == {0: "Houston, TX +1 more", 1: "Houston, TX", 2: None, 3: "Houston, TX", 4: None, 5: "Dubai, United Arab Emirates +2 more"}
    names = {r["id"]: r["n"] for r in posts.select("id", loc.all_formatted(F.col("location")).alias("n")).collect()}
    assert all((n[0] + (f" +{len(n) - 1} more" if len(n) > 1 else "") if n else None) == shown[k] for k, n in names.items())


def test_skills_are_normalised_once(spark):
    raws = spark.createDataFrame([(k, 0, x) for k, x in enumerate(["Welding Skills", "Welding Skills", "5 years Safety", None])], "id long, place int, raw string")
    each = facets.once_each(raws, "raw")
    assert sorted(str(r["raw"]) for r in each.collect()) == ["5 years Safety", "None", "Welding Skills"]
    assert "initcap" not in below_first_grouping(each.where(F.initcap("raw") == "Welding Skills"))
    reference, prepared = spark.createDataFrame([(0, "Welding")], "ref_ord int, name string"), spark.createDataFrame([("x", "y")], "key string, known string")
    out = processed(raws, reference, prepared, split=False)
    assert {r["id"]: r["skills"] for r in out.collect()} == {0: ["Welding"], 1: ["Welding"]}
