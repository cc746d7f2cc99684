"""Regions as a table: places meet them by equal keys, so any table of regions works and none is code.

A region's row has a kind and a key: ``name`` (a city or a one-word keyword, between blanks, hyphens, a comma and the ends), ``phrase`` (anywhere), ``country``
(a code at the start) or ``state`` (a province between hyphens or commas). A place gives the keys that it holds, and an equi-join does the rest: the cost
follows the places and their matches, not places times regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.region import REGIONS, Region

KEYS = "region string, kind string, key string"


def region_keys(spark: SparkSession, regions: tuple[Region, ...] = REGIONS) -> DataFrame:
    """The keys of regions. Those with countries take no keywords; provinces count in Canada's only."""
    rows = []
    for r in regions:
        rows += [(r.id, "name", x.split(",")[0].strip().lower()) for x in r.locations]
        if r.countries:
            rows += [(r.id, "country", x) for x in r.countries] + [(r.id, "state", x) for x in r.states if "CA" in r.countries]
        else:
            rows += [(r.id, "phrase" if " " in k else "name", k.lower()) for k in r.keywords]
    return spark.createDataFrame(list(dict.fromkeys(rows)), KEYS)


def _names(place: Column, words: int) -> Column:
    """Runs of so many words, also overlapping ones, that begin after a blank or hyphen and end before one of these or a comma."""
    more = rf"(?:[\s,-][^\s,-]+){{{words - 1}}}"
    return F.regexp_extract_all(place, F.lit(rf"(?:^|(?<=[\s-]))(?=([^\s,-]+{more})(?:[\s,-]|$))"), F.lit(1))


def _parts(place: Column, length: int) -> Column:
    """All runs of so many characters."""
    return F.when(F.length(place) >= length, F.transform(F.sequence(F.lit(1), F.length(place) - length + 1), lambda k: F.substring(place, k, F.lit(length)))).otherwise(F.array().cast("array<string>"))


def place_keys(place: Column, words: list[int], lengths: list[int]) -> Column:
    """An array of (kind, key): names of ``words`` words, phrases of ``lengths`` characters, codes of country and province."""
    low = F.lower(place)
    kind = lambda name, keys: F.transform(keys, lambda k: F.struct(F.lit(name).alias("kind"), k.alias("key")))
    code = F.upper(F.regexp_extract(place, "(?i)^([a-z]{2})-", 1))
    provinces = F.concat(F.regexp_extract_all(place, F.lit("(?i)-(?=([a-z]{2,3})-)"), F.lit(1)), F.regexp_extract_all(place, F.lit("(?i), (?=([a-z]{2,3}),)"), F.lit(1)))
    names, phrases = [kind("name", _names(low, n)) for n in words], [kind("phrase", _parts(low, n)) for n in lengths]
    return F.array_distinct(F.concat(*names, *phrases, kind("country", F.array(code)), kind("state", F.transform(provinces, F.upper))))


def members(places: DataFrame, place: str, keys: DataFrame) -> DataFrame:
    """region and place of each distinct place that a region of ``keys`` (region, kind, key) takes; NULL is in none.

    How many words its names have and how long its phrases are is read off the table first: as many numbers as the longest has words or characters.
    """
    names, phrases = keys.where("kind = 'name'"), keys.where("kind = 'phrase'")
    words = sorted(r[0] for r in names.select(F.size(F.split("key", r"[\s,-]"))).distinct().collect())
    lengths = sorted(r[0] for r in phrases.select(F.length("key")).distinct().collect())
    distinct = places.select(place).where(F.col(place).isNotNull()).distinct()
    held = distinct.select(place, F.inline(place_keys(F.col(place), words, lengths)))
    return held.join(keys, ["kind", "key"]).select("region", place).distinct()
