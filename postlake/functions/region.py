"""Energy regions and the places that belong to them. The table holds fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Region:
    id: str
    name: str
    locations: tuple[str, ...]
    keywords: tuple[str, ...]
    states: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    offshore: bool = False


# The five regions shown first.
TOP = (
    Region("gulf-of-mexico", "Gulf of Mexico", ("Houston, TX", "New Orleans, LA", "Lafayette, LA", "Beaumont, TX", "Port Arthur, TX", "Corpus Christi, TX", "Galveston, TX", "Baton Rouge, LA", "Lake Charles, LA", "Houma, LA", "Morgan City, LA", "Freeport, TX", "Texas City, TX", "Pasadena, TX", "Baytown, TX", "Channelview, TX", "Deer Park, TX", "Gulf of Mexico"), ("gulf", "houston", "offshore", "new orleans", "lafayette"), offshore=True),
    Region("permian-basin", "Permian Basin", ("Midland, TX", "Odessa, TX", "Carlsbad, NM", "Pecos, TX", "Andrews, TX", "Big Spring, TX", "Monahans, TX", "Fort Stockton, TX", "Kermit, TX", "Seminole, TX", "Hobbs, NM", "Lovington, NM"), ("permian", "midland", "odessa", "carlsbad")),
    Region("north-sea", "North Sea", ("Aberdeen, United Kingdom", "Stavanger, Norway", "Edinburgh, United Kingdom", "Bergen, Norway", "Great Yarmouth, United Kingdom"), ("north sea", "aberdeen", "stavanger", "norway", "scotland"), countries=("GB", "NO"), offshore=True),
    Region("appalachia", "Appalachia", ("Pittsburgh, PA", "Canonsburg, PA", "Morgantown, WV", "Wheeling, WV", "Charleston, WV", "Washington, PA", "Waynesburg, PA", "Clarksburg, WV", "Bridgeport, WV"), ("appalachia", "marcellus", "utica", "pittsburgh", "pennsylvania")),
    Region("alaska", "Alaska", ("Anchorage, AK", "Prudhoe Bay, AK", "Fairbanks, AK", "Kenai, AK", "Valdez, AK", "North Slope, AK", "Deadhorse, AK", "Barrow, AK", "Homer, AK", "Palmer, AK", "Wasilla, AK", "Juneau, AK"), ("alaska", "anchorage", "prudhoe", "fairbanks"), states=("AK",)),
)
# The eight further regions.
FURTHER = (
    Region("middle-east", "Middle East", ("Dubai, United Arab Emirates", "Abu Dhabi, United Arab Emirates", "Doha, Qatar", "Riyadh, Saudi Arabia", "Kuwait City, Kuwait", "Manama, Bahrain", "Muscat, Oman"), ("dubai", "abu dhabi", "saudi", "qatar", "kuwait", "middle east"), countries=("AE", "SA", "QA", "KW", "BH", "OM")),
    Region("asia-pacific", "Asia Pacific", ("Singapore", "Kuala Lumpur, Malaysia", "Perth, Australia", "Jakarta, Indonesia", "Mumbai, India", "Brisbane, Australia", "Bangkok, Thailand", "Manila, Philippines"), ("singapore", "malaysia", "australia", "asia", "perth"), countries=("SG", "MY", "AU", "ID", "IN", "TH", "PH")),
    Region("rockies", "Rockies", ("Denver, CO", "Casper, WY", "Cheyenne, WY", "Grand Junction, CO", "Pinedale, WY", "Rock Springs, WY", "Vernal, UT", "Rangely, CO", "Rifle, CO"), ("rockies", "denver", "colorado", "wyoming", "casper")),
    Region("bakken", "Bakken", ("Williston, ND", "Dickinson, ND", "Watford City, ND", "Sidney, MT", "Tioga, ND", "Stanley, ND"), ("bakken", "williston", "north dakota")),
    Region("eagle-ford", "Eagle Ford", ("San Antonio, TX", "Laredo, TX", "Pleasanton, TX", "Cotulla, TX", "Karnes City, TX", "Gonzales, TX", "Cuero, TX", "Victoria, TX"), ("eagle ford",)),
    Region("dj-basin", "DJ Basin", ("Greeley, CO", "Weld County, CO", "Brighton, CO", "Fort Lupton, CO", "Frederick, CO"), ("dj basin", "denver-julesburg", "wattenberg")),
    Region("western-canada", "Western Canada", ("Calgary, AB, Canada", "Edmonton, AB, Canada", "Fort McMurray, AB, Canada", "Regina, SK, Canada"), ("calgary", "alberta", "canada", "edmonton"), states=("AB", "SK"), countries=("CA",)),
    Region("latin-america", "Latin America", ("Rio de Janeiro, Brazil", "São Paulo, Brazil", "Mexico City, Mexico", "Bogotá, Colombia", "Buenos Aires, Argentina"), ("brazil", "mexico", "colombia", "latin", "rio"), countries=("BR", "MX", "CO", "AR")),
)
REGIONS = TOP + FURTHER


def name_pattern(names) -> str:
    """Any of the names between blanks, hyphens, a comma and the ends."""
    return rf"(?iu)(?:^|[\s-])(?:{'|'.join(names)})(?:[\s,-]|$)"


def city_pattern(region: Region) -> str:
    return name_pattern(dict.fromkeys(x.split(",")[0].strip().lower() for x in region.locations))


def keyword_pattern(region: Region) -> str:
    """One-word keywords stand alone, longer ones anywhere."""
    single, longer = [k for k in region.keywords if " " not in k], [k for k in region.keywords if " " in k]
    return "|".join([*([name_pattern(single)] if single else []), *(f"(?iu){k}" for k in longer)])


def country_pattern(region: Region) -> str:
    """A country's code at the start; for Canada also a province."""
    out = [f"(?i)^(?:{'|'.join(region.countries)})-"]
    if "CA" in region.countries and region.states:
        provinces = "|".join(region.states)
        out += [f"(?i)-(?:{provinces})-", f"(?i), (?:{provinces}),"]
    return "|".join(out)


def belongs(location: Column, region: Region) -> Column:
    """By city, or by keyword or country; a region with countries takes keywords only within them."""
    by_city = location.rlike(city_pattern(region))
    if region.countries:
        return by_city | location.rlike(country_pattern(region))
    return by_city | location.rlike(keyword_pattern(region))


def regions_of(location: Column) -> Column:
    """The ids of a location's regions, in the table's order."""
    return F.array_compact(F.array(*(F.when(belongs(location, r), r.id) for r in REGIONS)))


def option_belongs(value: Column, country_code: Column, state_code: Column, region: Region) -> Column:
    """As ``belongs``, but trusts known codes first."""
    code, state = F.upper(country_code), F.upper(F.coalesce(state_code, F.lit("")))
    text = value.rlike(city_pattern(region)) | (value.rlike(keyword_pattern(region)) & (value.rlike(country_pattern(region)) if region.countries else F.lit(True)))
    out = F.when(F.lit(False), F.lit(False))
    if region.states and not region.countries:
        out = out.when((code == "US") & state.isin(*region.states), True)
    if region.countries:
        if "CA" in region.countries and region.states:
            out = out.when(code == "CA", state.isin(*region.states))
        out = out.when(code.isin(*region.countries), True)
    return F.coalesce(out.otherwise(text), F.lit(False))
