"""Facet values and counts. Ties of counts go to the value that appears first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.functions import location as loc
from postlake.functions.text import percent
from postlake.operators.filters import is_active

# Employment types in the order of display.
EMPLOYMENT_ORDER = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def exploded(postings: DataFrame, array: str, name: str) -> DataFrame:
    """A row per element, with the posting's order and the element's place."""
    return postings.select("ord", F.posexplode(array).alias("place", name))


def once_each(values: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key``, to be parsed once each. Spark moves a filter on a grouping's key below the grouping, where it would be computed for
    every row, whatever it costs; a key that reads the group's count keeps it above."""
    return values.groupBy(key).agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.col(key)).alias(key))


def distinct_values(postings: DataFrame, column: str) -> DataFrame:
    return postings.where(is_active()).select(column).where(F.col(column).isNotNull()).distinct()


def distinct_elements(postings: DataFrame, array: str, name: str) -> DataFrame:
    return exploded(postings.where(is_active()), array, name).select(name).distinct()


def distinct_ignoring_case(postings: DataFrame, array: str, name: str) -> DataFrame:
    """Per lower-case value the spelling that appears first."""
    first = F.min_by(name, F.struct("ord", "place")).alias(name)
    return exploded(postings.where(is_active()), array, name).groupBy(F.lower(name).alias("key")).agg(first).select(name)


def counts(values: DataFrame, *keys: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def top(values: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values; a heap per task, never a full sort."""
    return counts(values, key).orderBy(F.desc("n"), "first_ord", key).limit(n).select(key, "n")


def top_companies(postings: DataFrame, n: int = 10) -> DataFrame:
    return top(postings.where(is_active()).select("ord", "company"), "company", n)


def top_elements(postings: DataFrame, array: str, name: str, n: int = 10) -> DataFrame:
    return top(exploded(postings.where(is_active()), array, name), name, n)


def zero_filled(terms: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every term of a dictionary with its count, zero included."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    return terms.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def conditional_counts(postings: DataFrame, key: str, column: str, values: tuple[str, ...]) -> DataFrame:
    return postings.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def ordinal(column: Column, order: tuple[str, ...]) -> Column:
    """The place in a fixed order; unknown values come last."""
    return F.coalesce(*(F.when(column == v, k) for k, v in enumerate(order)), F.lit(len(order)))


def grouped_labels(names: DataFrame, key: Column, label: str) -> DataFrame:
    """Distinct labels per group, sorted, as one array."""
    return names.groupBy(key.alias("group_label")).agg(F.sort_array(F.collect_set(label)).alias("labels"))


def group_rank(label: Column) -> Column:
    """United States first, special groups last, others between."""
    return F.when(label.startswith("United States"), 0).when(label.isin("Offshore", "Remote", "Other", "Unknown"), 2).otherwise(1)


def match_statistics(matched: DataFrame, role: str, level: str, times: str | None = None) -> DataFrame:
    """Rows (kind, value, n, n_matched): counts by role, by confidence and over all rows; ``times`` is a column that says how often a row counts.

    Rows are counted per pair first; the groupings then work on a few rows.
    """
    pairs = matched.groupBy(role, level).agg((F.sum(times) if times else F.count("*")).alias("c"))
    hit = F.when(F.col(role).isNotNull(), F.col("c")).otherwise(0)
    sums = [F.sum("c").alias("n"), F.sum(hit).alias("n_matched")]
    parts = pairs.groupingSets([[F.col(role)], [F.col(level)]], F.col(role), F.col(level)).agg(*sums, F.grouping(role).alias("by_level"))
    parts = parts.select(F.when(F.col("by_level") == 1, "confidence").otherwise("role").alias("kind"), F.coalesce(role, level).alias("value"), "n", "n_matched").where("value is not null")
    every = pairs.agg(*sums).select(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"))
    return every.unionByName(parts)


def expectations(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """For each named check, the rows of its table and those that break it."""
    rows = [df.agg(F.lit(name).alias("check"), F.count("*").alias("rows"), F.count_if(bad).alias("broken")) for name, (df, bad) in checks.items()]
    return reduce(DataFrame.unionByName, rows)


# What no clean skill holds.
INVALID_SKILLS = {
    "years": r"(?i)\d+\s*(?:years?|yrs?)",
    "education": r"(?i)bachelor|degree|diploma|certification required",
    "parentheses": r"\([^)]+\)",
    "generic start": r"(?i)^(?:with|be|show|demonstrate|must|should|will|can)\s",
}


def skill_checks(postings: DataFrame, array: str, options: DataFrame) -> DataFrame:
    """check, rows and broken of the quality checks: each kind of invalid skill among the active postings' distinct skills, options (skill) that no active
    posting has, and active postings without skills (which are reported, not wrong)."""
    active = postings.where(is_active())
    skills = active.select(F.explode(array).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    unused = options.select("skill").distinct().join(skills, "skill", "left")
    bare = F.coalesce(F.size(array), F.lit(0)) <= 0
    checks = {name: (skills, F.coalesce(F.col("skill").rlike(pattern), F.lit(False))) for name, pattern in INVALID_SKILLS.items()}
    return expectations(checks | {"options without postings": (unused, F.col("n").isNull()), "postings without skills": (active, bare)})


def match_rate(matched: DataFrame, role: str, times: str | None = None) -> DataFrame:
    """total, matched, unmatched and match_rate (one decimal; ``NaN%`` without rows) of rows with a role or without."""
    weight = F.col(times) if times else F.lit(1)
    sums = matched.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col(role).isNotNull(), weight)), F.lit(0)).cast("long").alias("matched"))
    return sums.select("total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), percent(F.col("matched"), F.col("total")).alias("match_rate"))


def place_counts(postings: DataFrame) -> DataFrame:
    """raw, name, n and first_ord of the active postings' places: raw places are counted first, and each distinct one is parsed once (see ``once_each``)."""
    raws = exploded(postings.where(is_active()).select("ord", loc.lines(F.col("location")).alias("raws")), "raws", "raw")
    return counts(raws, "raw").withColumn("raw", F.when(F.col("n") > 0, F.col("raw"))).select("raw", loc.formatted(F.col("raw")).alias("name"), "n", "first_ord").where("name is not null")


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` of a small dictionary with their place in an order."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shares(counted: DataFrame, kinds: dict[str, tuple[str, int] | None]) -> DataFrame:
    """kind, value, n and share (whole per cent of all rows, halves up) for each column of ``counted`` (c: rows); some only for their most frequent values."""
    total = counted.agg(F.sum("c").alias("total"))
    parts = []
    for kind, limit in kinds.items():
        column, most = limit or (kind, 0)
        one = counted.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.sum("c").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
        parts.append(one.orderBy(F.desc("n"), "value").limit(most) if most else one)
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(total)).select("kind", "value", "n", F.call_function("div", F.col("n") * 200 + F.col("total"), F.col("total") * 2).alias("share"))


def _some(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def page_title(roles: Column, locations: Column) -> Column:
    parts = F.array_join(F.filter(F.array(_some(roles, 2), _some(locations, 2)), lambda x: x != ""), " - ")
    return F.when(parts == "", "Job Opportunities").otherwise(F.concat(parts, F.lit(" Jobs")))


def page_description(n: Column, companies: Column, locations: Column) -> Column:
    part = lambda word, c: F.when(F.size(c) > 0, F.concat(F.lit(word), _some(c, 3)))
    return F.concat_ws(" ", F.concat(n.cast("string"), F.lit(" jobs available")), part("at ", companies), part("in ", locations))


def toggled(values: Column, value: str) -> Column:
    """``values`` without ``value`` if it was there, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, F.lit(value)))
