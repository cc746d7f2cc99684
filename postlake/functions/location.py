"""Locations: raw multi-line text to formatted names, metadata and grouping keys, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, functions as F

from postlake.functions.geography import COMMA_COUNTRIES, COUNTRIES, SPECIAL_PLACES, US_STATES
from postlake.functions.text import trim

CODED = r"(?i)^([A-Z]{2})-([A-Z]{2,4})-([^-]+?)(?:-(.+))?$"
CODED_CITY = r"(?i)^([A-Z]{2})-([^-]+?)(?:-(.+))?$"
CITY_WORDS = r"^([^,]+),\s*([A-Za-z\s]+)$"
CITY_CODE = r"^([^,]+),\s*([A-Z]{2})$"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, or NULL."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def lines(c: Column) -> Column:
    """The raw locations of a cell: one per line, without the heading line and blank ones."""
    return F.filter(F.transform(F.split(c, "\n"), trim), lambda x: (x != "") & (F.lower(x) != "locations"))


def title_case(c: Column) -> Column:
    """Capitalised words; hyphens become blanks."""
    return F.initcap(F.regexp_replace(F.lower(c), r"[\s-]+", " "))


def clean_city(c: Column) -> Column:
    for pattern in (r"\s*\([^)]*\)", r"(?i)^OTHER\s+", r"(?i)\s*-\s*(VENTURA|RETIC|OTHER).*$"):
        c = F.regexp_replace(c, pattern, "")
    return title_case(trim(c))


def clean(c: Column) -> Column:
    return F.nullif(trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^locations\s*", ""), r"(?i)^Location:\s*", "")), F.lit(""))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` as a bound variable, so that it is planned and computed one time however often it is used."""
    return F.transform(F.array(c), use)[0]


def parse(raw: Column, strict: bool = False) -> Column:
    """A raw location as struct(formatted, country_code, country, state_code, state, city, parsed, source).

    ``strict`` takes two capitals after a comma for words (``Houston, Tx``) instead of a code (``Houston, TX``).
    """
    return once(clean(raw), lambda c: _parse(c, strict))


def _parse(c: Column, strict: bool) -> Column:
    special = F.coalesce(*(F.when(F.lower(c).contains(x.lower()), x) for x in SPECIAL_PLACES))
    with_state, with_city = c.rlike(CODED), c.rlike(CODED_CITY)
    code = F.upper(F.regexp_extract(c, CODED_CITY, 1))
    state = F.upper(F.when(with_state, F.regexp_extract(c, CODED, 2)))
    city = clean_city(F.when(with_state, F.regexp_extract(c, CODED, 3)).otherwise(F.regexp_extract(c, CODED_CITY, 2)))
    country, state_name = lookup(COUNTRIES, code), lookup(US_STATES, state)
    whole_state = F.coalesce(F.lower(city) == F.lower(state_name), F.lit(False))
    coded = (
        F.when(whole_state & (code == "US"), city)
        .when((code == "US") & state.isNotNull(), F.concat_ws(", ", city, state))
        .when((code == "CA") & state.isNotNull(), F.concat(city, F.lit(", "), state, F.lit(", Canada")))
        .when(country.isNotNull(), F.concat_ws(", ", city, country))
        .otherwise(city)
    )
    first, second = title_case(trim(F.regexp_extract(c, CITY_WORDS, 1))), title_case(trim(F.regexp_extract(c, CITY_WORDS, 2)))
    by_name = lookup({name: k for k, name in US_STATES.items()}, second)
    abbreviation = F.regexp_extract(c, CITY_CODE, 2)
    us_code = F.when(lookup(US_STATES, abbreviation).isNotNull(), abbreviation)
    comma_country = lookup({k: COUNTRIES[k] for k in COMMA_COUNTRIES}, abbreviation)
    after_code = F.concat_ws(", ", first, F.coalesce(us_code, comma_country, abbreviation))
    after_words = F.concat_ws(", ", first, F.coalesce(by_name, second))
    is_code, is_words = c.rlike(CITY_CODE) & F.lit(not strict), c.rlike(CITY_WORDS)
    plain = c.rlike(r"^[A-Za-z\s]+$")

    def choose(special_, coded_, code_, words_, plain_, else_) -> Column:
        return F.when(c.isNull(), None).when(special.isNotNull(), special_).when(with_city, coded_).when(is_code, code_).when(is_words, words_).when(plain, plain_).otherwise(else_)

    none = F.lit(None).cast("string")
    known_code = us_code.isNotNull() | comma_country.isNotNull()
    return F.struct(
        choose(special, coded, after_code, after_words, title_case(c), c).alias("formatted"),
        choose(none, code, F.when(us_code.isNotNull(), "US").when(comma_country.isNotNull(), abbreviation), F.when(by_name.isNotNull(), "US"), none, none).alias("country_code"),
        choose(none, country, F.when(us_code.isNotNull(), "United States").otherwise(comma_country), F.when(by_name.isNotNull(), "United States"), none, none).alias("country"),
        choose(none, state, us_code, by_name, none, none).alias("state_code"),
        choose(none, state_name, none, F.when(by_name.isNotNull(), second), none, none).alias("state"),
        choose(none, F.when(~whole_state, city), first, first, title_case(c), none).alias("city"),
        choose(F.lit(True), F.lit(True), known_code, by_name.isNotNull(), F.lit(False), F.lit(False)).alias("parsed"),
        F.when(c.isNotNull(), "fallback").alias("source"),
    )


def formatted(raw: Column, strict: bool = False) -> Column:
    return parse(raw, strict)["formatted"]


def all_formatted(cell: Column, strict: bool = False) -> Column:
    """The formatted names of a cell's locations, in order."""
    return F.filter(F.transform(lines(cell), lambda x: formatted(x, strict)), lambda x: x.isNotNull())


def display(cell: Column, strict: bool = False) -> Column:
    """The first location, and how many more there are. Only the first is parsed: a location has a name unless nothing is left of it by ``clean``."""
    return once(named_lines(cell), lambda raws: shown(formatted(F.get(raws, F.lit(0)), strict), F.size(raws) - 1))


def named_lines(cell: Column) -> Column:
    """The raw locations of a cell that have a name."""
    return F.filter(lines(cell), lambda x: clean(x).isNotNull())


def shown(name: Column, more: Column) -> Column:
    """A name with the number of others."""
    return F.when(more > 0, F.concat(name, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(name)


def from_geocode(geo: Column) -> Column:
    """The name of a geocoded place, by the conventions of its country."""
    city, state, code, country = geo["city"], geo["state"], geo["stateCode"], geo["country"]
    cc = F.upper(geo["countryCode"])
    return (
        F.when(city.isNull(), F.coalesce(state, country))
        .when((cc == "US") & code.isNotNull(), F.concat_ws(", ", city, code))
        .when((cc == "CA") & code.isNotNull(), F.concat(city, F.lit(", "), code, F.lit(", Canada")))
        .when(cc.isin("BR", "IN") & state.isNotNull() & (state != city), F.concat_ws(", ", city, state, country))
        .when(city == country, city)
        .otherwise(F.concat_ws(", ", city, country))
    )


def metadata(raw: Column, geo: Column) -> Column:
    """struct(original, formatted, city, state, state_code, country, country_code, longitude, latitude, source) of a raw place.

    ``geo`` (city, state, stateCode, country, countryCode, coordinates) is the dictionary's entry or NULL; without one the parser decides, and what it can't
    place is in ``Other``. An entry without country takes that of its code; Singapore's entries, which have none, are a state's.
    """
    original = trim(F.regexp_replace(raw, r"(?i)^locations\s*", ""))

    def of(x: Column) -> Column:
        g, parsed = x["geo"], x["parsed"]
        city_state = g["country"].isNull() & F.coalesce(g["state"].contains("Singapore"), F.lit(False))
        code = F.when(city_state, "SG").otherwise(g["countryCode"])
        named = F.struct(*(g[k].alias(k) for k in ("city", "state", "stateCode", "country", "countryCode")), F.lit(None).cast("string").alias("placeName"))
        known = F.struct(
            x["original"].alias("original"),
            with_states(named, x["original"], True).alias("formatted"),
            g["city"].alias("city"),
            F.when(~city_state, g["state"]).alias("state"),
            F.when(~city_state, g["stateCode"]).alias("state_code"),
            F.coalesce(g["country"], F.when(city_state, "Singapore").otherwise(lookup(COUNTRIES, F.upper(code))), F.lit("Other")).alias("country"),
            code.alias("country_code"),
            g["coordinates"]["longitude"].alias("longitude"),
            g["coordinates"]["latitude"].alias("latitude"),
            F.lit("geocoded").alias("source"),
        )
        none = F.lit(None).cast("double")
        guessed = F.struct(
            x["original"].alias("original"),
            F.coalesce(parsed["formatted"], x["original"]).alias("formatted"),
            parsed["city"].alias("city"),
            parsed["state"].alias("state"),
            parsed["state_code"].alias("state_code"),
            F.coalesce(parsed["country"], F.lit("Other")).alias("country"),
            parsed["country_code"].alias("country_code"),
            none.alias("longitude"),
            none.alias("latitude"),
            F.lit("fallback").alias("source"),
        )
        return F.when(g.isNotNull(), known).otherwise(guessed)

    return once(F.struct(original.alias("original"), geo.alias("geo"), parse(raw).alias("parsed")), of)


def display_from(cell: Column, geo: Column) -> Column:
    """As ``display``, but the first location's name comes from its dictionary entry ``geo`` where it has one."""
    more = F.size(lines(cell)) - 1
    return F.when(geo.isNotNull() & (more >= 0), shown(from_geocode(geo), more)).otherwise(display(cell))


def in_region(name: Column, country: str, region: str) -> Column:
    """Whether a formatted name lies in a country's region, as the two-level list groups it."""
    return once(group_keys(name), lambda k: F.coalesce((k["country"] == country) & (k["region"] == region), F.lit(False)))


def group_keys(name: Column) -> Column:
    """struct(country, region, city) of a formatted name, for the two-level list."""
    us, canada, brazil, other = r"^([^,]+),\s*([A-Z]{2})$", r"^([^,]+),\s*([A-Z]{2}),\s*Canada$", r"^([^,]+),\s*([^,]+),\s*Brazil$", r"^([^,]+),\s*(.+)$"
    part = lambda p, k: trim(F.regexp_extract(name, p, k))
    is_special = name.isin(*SPECIAL_PLACES)
    country = F.when(is_special, "Other").when(name.rlike(us), "United States").when(name.rlike(canada), "Canada").when(name.rlike(brazil), "Brazil").when(name.rlike(other), part(other, 2)).otherwise("Unknown")
    region = F.when(is_special, "Other").when(name.rlike(us), part(us, 2)).when(name.rlike(canada), part(canada, 2)).when(name.rlike(brazil), part(brazil, 2))
    city = F.when(is_special, name).when(name.rlike(other), part(other, 1)).otherwise(trim(name))
    return F.struct(country.alias("country"), region.alias("region"), city.alias("city"))


def search_query(raw: Column) -> Column:
    """What a geocoder is asked for a raw location."""
    c = trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)\s*\+\d+\s+more$", ""), r"^\d+\s+", ""))
    return F.when(c.rlike(CODED), F.concat_ws(", ", title_case(F.regexp_extract(c, CODED, 3)), F.upper(F.regexp_extract(c, CODED, 1)))).otherwise(c)


# Places that stay as they are, and well-known cities that stand alone.
KEPT_PLACES = ("Global Recruiting", "Gulf of Mexico", "Noble Interceptor", "Noble BlackLion", "Noble BlackHawk", "Noble BlackHornet", "Noble Faye Kozack")
US_CITIES = {
    "houston": "TX", "dallas": "TX", "austin": "TX", "san antonio": "TX", "chicago": "IL", "new york": "NY", "los angeles": "CA", "san francisco": "CA",
    "seattle": "WA", "boston": "MA", "miami": "FL", "denver": "CO", "phoenix": "AZ", "atlanta": "GA", "philadelphia": "PA",
}
OTHER_CITIES = {"aberdeen": "United Kingdom", "london": "United Kingdom", "florence": "Italy", "rome": "Italy", "paris": "France", "tokyo": "Japan", "singapore": "Singapore"}


def normalized(c: Column) -> Column:
    """A place as ``City, ST`` or ``City, Country`` where that is known."""

    def of(x: Column) -> Column:
        city, rest = trim(F.regexp_extract(x, r"^([^,]+),\s*([A-Za-z\s]+)$", 1)), trim(F.regexp_extract(x, r"^([^,]+),\s*([A-Za-z\s]+)$", 2))
        state = lookup({name.lower(): code for code, name in US_STATES.items()}, F.lower(rest))
        alone = F.coalesce(lookup(US_CITIES, F.lower(x)), lookup(OTHER_CITIES, F.lower(x)))
        return (
            F.when(x == "", None)
            .when(x.isin(*KEPT_PLACES), x)
            .when(x.rlike(r"^[^,]+,\s*[A-Za-z\s]+$"), F.concat_ws(", ", city, F.coalesce(state, rest)))
            .when(x.rlike(r"^[A-Za-z\s]+$"), F.concat_ws(", ", x, alone))
            .otherwise(x)
        )

    return once(trim(c), of)


def filter_option(name: Column) -> Column:
    """struct(label, value, country, search_text) of a normalised place, for a list to choose from."""

    def of(parts: Column) -> Column:
        n, one, two, three = F.size(parts), parts[0], F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        kept, state = name.isin(*KEPT_PLACES), two.isin(*US_STATES)
        country = F.when(kept, "Other").when(n == 1, "Unknown").when((n == 2) & state, "United States").when(n == 2, two).when(n == 3, three).otherwise("Other")
        place = F.when(kept | (n == 1), name).when((n == 2) & state, F.concat_ws(", ", one, two)).when(n == 2, one).when(n == 3, F.concat_ws(", ", one, two))
        words = F.when(kept | (n == 1), name).when((n == 2) & state, F.concat_ws(" ", country, one, two)).when(n == 2, F.concat_ws(" ", two, one)).when(n == 3, F.concat_ws(" ", three, one, two)).otherwise(name)
        return F.struct(F.coalesce(F.concat_ws(": ", country, place), name).alias("label"), name.alias("value"), country.alias("country"), F.lower(words).alias("search_text"))

    option = once(F.transform(F.split(name, ","), trim), of)
    whole = F.struct(name.alias("label"), name.alias("value"), F.lit("Other").alias("country"), F.lower(name).alias("search_text"))
    return F.when(F.size(F.split(name, ",")) > 3, whole).otherwise(option)


def country_rank(country: Column) -> Column:
    """United States first, Unknown and Other last."""
    return F.when(country == "United States", 0).when(country == "Unknown", 2).when(country == "Other", 3).otherwise(1)


_FEATURE = "place_name string, text string, place_type array<string>, center array<double>, relevance double, properties struct<short_code: string>, context array<struct<id: string, text: string, short_code: string>>"


def geocoded(answer: Column) -> Column:
    """A geocoder's JSON feature as a flat struct: place name, city, state, country, their codes, coordinates, confidence."""

    def of(f: Column) -> Column:
        part = lambda kind: F.get(F.filter(F.coalesce(f["context"], F.array()), lambda x: x["id"].startswith(kind)), F.lit(0))
        after = lambda code: F.upper(F.get(F.split(code, "-"), F.lit(1)))
        has = lambda *kinds: F.arrays_overlap(f["place_type"], F.array(*(F.lit(k) for k in kinds)))
        region, country, own = part("region."), part("country."), f["properties"]["short_code"]
        return F.struct(
            f["place_name"].alias("placeName"),
            F.coalesce(F.when(has("place", "locality"), f["text"]), part("place.")["text"]).alias("city"),
            F.coalesce(region["text"], F.when(has("region"), f["text"])).alias("state"),
            F.when(region.isNotNull(), after(region["short_code"])).when(has("region"), after(own)).alias("stateCode"),
            F.coalesce(country["text"], F.when(has("country"), f["text"])).alias("country"),
            F.when(country.isNotNull(), F.upper(country["short_code"])).when(has("country"), F.upper(own)).alias("countryCode"),
            f["center"][0].alias("longitude"),
            f["center"][1].alias("latitude"),
            F.coalesce(f["relevance"], F.lit(1.0)).alias("confidence"),
        )

    return once(F.from_json(answer, _FEATURE), of)


def with_states(geo: Column, original: Column, city_state: bool = False) -> Column:
    """The name of a geocoded place with its state wherever there is one; else ``original``.

    ``city_state`` mends answers for Singapore and falls back to the geocoder's own name first.
    """
    country = F.when(geo["country"].isNull() & geo["state"].contains("Singapore"), "Singapore").otherwise(geo["country"]) if city_state else geo["country"]
    fixed = geo["country"].isNull() & F.coalesce(geo["state"].contains("Singapore"), F.lit(False)) if city_state else F.lit(False)
    code, state, short, city = F.when(fixed, "SG").otherwise(geo["countryCode"]), F.when(~fixed, geo["state"]), F.when(~fixed, geo["stateCode"]), geo["city"]
    out = F.when(F.lit(False), original)
    if city_state:
        out = out.when((code == "SG") & F.lower(city).isin("singapore", "singapore river"), "Singapore").when((code == "SG") & city.isNotNull(), F.concat(city, F.lit(", Singapore")))
    out = out.when((code == "US") & city.isNotNull() & short.isNotNull(), F.concat_ws(", ", city, short))
    out = out.when((code == "CA") & city.isNotNull() & short.isNotNull(), F.concat(city, F.lit(", "), short, F.lit(", Canada")))
    if city_state:
        for cc, name in (("BR", "Brazil"), ("IN", "India")):
            out = out.when((code == cc) & city.isNotNull() & state.isNotNull(), F.concat_ws(", ", city, state, F.lit(name)))
        out = out.when((code == "GB") & city.isNotNull(), F.concat(city, F.lit(", United Kingdom")))
    out = out.when(city.isNotNull() & country.isNotNull(), F.concat_ws(", ", city, state, country))
    return F.coalesce(out, geo["placeName"] if city_state else F.lit(None), original)
