"""Functions on small rows with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from postlake.functions import certification, location, region, role, skill, text


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


PLACES = {
    "locations\nIT-FI-FLORENCE-VIA FELICE MATTEUCCI 2": ["Florence, Italy"],
    "locations\nUS-TX-HOUSTON-2001 RANKIN ROAD": ["Houston, TX"],
    "locations\nCA-AB-CALGARY-4839 90TH AVENUE SE": ["Calgary, AB, Canada"],
    "locations\nAE-ABU DHABI-AL GHAITH HOLDING TOWER, AIRPORT ROAD": ["Abu Dhabi, United Arab Emirates"],
    "locations\nHouston": ["Houston"],
    "locations\nGulf of Mexico": ["Gulf of Mexico"],
    "locations\nUS-TX-OTHER TEXAS": ["Texas"],
    "locations\nUS-TX-OTHER TEXAS\nUS-NM-OTHER NEW MEXICO\nUS-MS-OTHER MISSISSIPPI": ["Texas", "New Mexico", "Mississippi"],
    "BR-RJ-RIO DE JANEIRO-VENTURA-AV REPUBLICA DO CHILE 330": ["Rio De Janeiro, Brazil"],
    "Houston, TX": ["Houston, TX"],
    "QA-DOHA-WEST BAY": ["West Bay, Qatar"],
    "": [],
    "locations": [],
}


def test_locations(spark):
    assert values(spark, PLACES, location.all_formatted) == [*PLACES.values()]
    assert values(spark, [[*PLACES][7], None], location.display) == ["Texas +2 more", None]
    assert values(spark, ["Houston, TX"], lambda c: location.formatted(c, strict=True)) == ["Houston, Tx"]


def test_group_keys(spark):
    out = values(spark, ["Houston, TX", "Calgary, AB, Canada", "Florence, Italy", "Aberdeen", "Gulf of Mexico"], location.group_keys)
    assert [(r["country"], r["region"]) for r in out] == [("United States", "TX"), ("Canada", "AB"), ("Italy", None), ("Unknown", None), ("Other", "Other")]


ROLES = {
    "Field Professional - MWD, II": "mwd-lwd",
    "Wireline Field Operator": "wireline-operator",
    "Aberdeen - Svc Operator I-Cementing": "cementing-services",
    "Ingeniero de Fracturamiento / Fracturing Engineer": "fracturing-stimulation",
    "Reforma, Chiapas - Especialista de Surface Well Testing.": "well-testing",
    "Senior Completion Engineer (2-year contract)": "completions",
    "Field Professional - Geosteering, II": "directional-drilling",
    "Commuter - Managed Pressure Drilling": "drilling-engineer",
    "Geoscientist (Advisor) Wireline and Perforating": "wireline-operator",
    "Diesel Mechanic Technician (I - III)": "rig-mechanic",
    "Coordenadora(or) de Operações Offshore": "offshore-operations",
    "Ingeniero de Perforación Direccional": "directional-drilling",
    "Administrative Specialist": None,
    "Chemical Engineer I": None,
    "": None,
}


def test_roles(spark):
    assert [r and r["role_id"] for r in values(spark, ROLES, role.match)] == [*ROLES.values()]


@pytest.mark.parametrize("good", [True, False])
def test_valid_skills(spark, good):
    yes = ["JavaScript", "Python", "SQL", "Project Management", "Welding", "Electrical Engineering", "HVAC", "Quality Assurance", "Welding Techniques", "Networking"]
    no = ["basic compensation:", "career path", "key", "excellent", "Must have 5 years experience.", "Bachelor degree required", "$50,000 salary", "100k compensation", "Skills Which Are Required", "Perform Tasks", "Accuracy In Work", "Managing Projects Daily", "Ability To Work Under Pressure", None, "", "a"]
    given = yes if good else no
    assert values(spark, given, skill.is_valid) == [good] * len(given)


def test_normal_skills(spark):
    given = ["JavaScript", "Python", "Welding", "key", "SQL", "Communication Skills", "Strong Financial Analysis", "5 years experience", "written", "Our team", "Technical Operations", "X thinking", None, ""]
    expected = ["Javascript", "Python", "Welding", None, None, "Communication", "Finance Analysis", None, "Written Communication", None, "Technical Operations", None, None, None]
    assert values(spark, given, skill.normalize) == expected
    assert values(spark, ["Communication and Presentation Skills", "Welding", "Oil & Gas", None], skill.split_compound) == [["Communication Skills", "Presentation Skills"], ["Welding"], ["Oil", "Gas"], []]


def test_certifications(spark):
    given = ["BOSIET required. API-510 preferred.", "Manage the API 510 inspection programme.", "Manage work.\nCDL required.", "Manage CDL. CDL needed.", None, ""]
    assert values(spark, given, certification.named_in) == [["API 510", "BOSIET"], [], ["CDL"], ["CDL"], [], []]


def test_sentences_of_matches(spark):
    far, near = "x" * 250, "y" * 150
    given = [f"You will manage {far} BOSIET {far}, a, b, c", f"You will manage {near} BOSIET {near}", "CDL, CDL\rneeded. API-510 é", f"{'z' * 201}CDL", f"a.{'-' * 201}CDL{'-' * 200}.b", "no match", None, ""]
    df = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(given)], "k int, t string, name string")
    out = certification.cited(df, "t", ["k"]).orderBy("k", "name", "nth").collect()
    got = [(r["k"], r["name"], r["nth"], r["sentence"], r["usable"]) for r in out]
    assert got == [
        (0, "BOSIET", 1, f"{'x' * 200} BOSIET {'x' * 200}", True),
        (1, "BOSIET", 1, given[1], False),
        (2, "API 510", 1, "API-510 é", True),
        (2, "CDL", 1, "CDL, CDL", True),
        (2, "CDL", 2, "CDL, CDL", True),
        (4, "CDL", 1, f"{'-' * 201}CDL{'-' * 200}.", True),
    ]
    assert certification.cited(df.limit(0), "t", ["k"]).count() == 0


def test_regions(spark):
    assert len(region.TOP) == 5 and len(region.REGIONS) == 13
    given = ["Houston, TX", "Midland, TX", "Odessa, TX", "Carlsbad, NM", "Singapore", "Dubai, United Arab Emirates", "Aberdeen, United Kingdom", "Calgary, AB, Canada"]
    found = dict(zip(given, values(spark, given, region.regions_of)))
    assert all("permian-basin" in found[x] for x in given[1:4]) and "permian-basin" not in found["Houston, TX"]
    assert "gulf-of-mexico" in found["Houston, TX"] and "middle-east" in found[given[5]] and "north-sea" in found[given[6]] and "asia-pacific" in found["Singapore"] and "western-canada" in found[given[7]]


def test_text(spark):
    now = F.lit(datetime.datetime(2024, 3, 2, 1, 0))
    ago = lambda c: text.time_ago(c.cast("timestamp"), now)
    assert values(spark, ["2024-03-01 23:00:00", "2024-03-01 01:00:00", "2024-02-20 01:00:00", "2023-12-01 00:00:00", "2021-01-01 00:00:00", None], ago) == ["Today", "1 day ago", "1 weeks ago", "3 months ago", "3 years ago", None]
    assert values(spark, ["2024-01-05", "nonsense", "", None], text.format_date) == ["Jan 5, 2024", "Invalid Date", None, None]
    assert values(spark, ["\ta b\n", None], text.trim) == ["a b", None]
    assert values(spark, ["a; b;;c ", "", None], text.split_compact) == [["a", "b", "c"], [], None]
    assert values(spark, ["a\n\n\n\nb", "a\n\n\n\n\nb", "", None], text.well_formatted) == [True, False, False, False]
    assert values(spark, ["hola señor ñandú", "plain text here", "текст", None], text.non_english) == [True, False, True, False]
    assert values(spark, ["<b>a</b>", "a < b", None], text.contains_html) == [True, False, False]
    assert values(spark, ["<p>a &amp; b</p><p> c<br/>d</p>", "plain"], text.clean_text) == ["a & b\nc\nd", "plain"]
    assert values(spark, ["<a href=\"x\">'&'</a>"], text.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&#039;&amp;&#039;&lt;/a&gt;"]
