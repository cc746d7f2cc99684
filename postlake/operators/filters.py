"""Faceted filters: any of the chosen values within a facet, all facets together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions import location as loc
from postlake.functions.region import REGIONS, belongs
from postlake.functions.text import company_slug, posting_slug
from postlake.sources.scratch import Scratch

INACTIVE = ("removed", "paused")
FACETS = ("companies", "locations", "regions", "skills", "certifications", "roles", "employment_types")
_PARAMETER = {"employment_types": "employmentTypes"}


def is_active(status: Column = None) -> Column:
    """A missing status counts as active."""
    return ~F.coalesce(F.col("status") if status is None else status, F.lit("")).isin(*INACTIVE)


@dataclass
class FilterSpec:
    """The state of all facets. Postings need the columns that the chosen facets read: company, location_names (array),
    skill_names (array), certification_names (array), employment_type, role_id, status."""

    companies: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    certifications: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    employment_types: list[str] = field(default_factory=list)
    show_inactive: bool = False

    @classmethod
    def from_query(cls, query: str, comma: bool = False) -> FilterSpec:
        """Reads ``companies=a|b&showInactive=true``. ``comma`` also splits at commas, which breaks names that hold one."""
        given = parse_qs(query.lstrip("?"))
        split = lambda x: [p for p in (x.replace(",", "|") if comma else x).split("|") if p]
        values = {k: [v for part in given.get(_PARAMETER.get(k, k), []) for v in split(part)] for k in FACETS}
        return cls(**values, show_inactive=given.get("showInactive", [""])[0] == "true")

    def to_query(self) -> str:
        """The shortest query that ``from_query`` reads back; empty facets are left out."""
        pairs = [(_PARAMETER.get(k, k), "|".join(getattr(self, k))) for k in FACETS if getattr(self, k)]
        return urlencode(pairs + ([("showInactive", "true")] if self.show_inactive else []))

    def predicates(self) -> list[Column]:
        """Cheap tests first; no test for an empty facet."""
        out = [] if self.show_inactive else [is_active()]
        if self.companies:
            out.append(F.col("company").isin(self.companies))
        if self.employment_types:
            out.append(F.coalesce(F.col("employment_type").isin(self.employment_types), F.lit(False)))
        if self.locations or self.regions:
            out.append(F.exists("location_names", self._in_places))
        if self.skills:
            out.append(F.arrays_overlap(F.transform("skill_names", F.lower), F.array(*(F.lit(x.lower()) for x in self.skills))))
        if self.certifications:
            out.append(F.arrays_overlap("certification_names", F.array(*(F.lit(x) for x in self.certifications))))
        if self.roles:
            out.append(F.coalesce(F.col("role_id").isin(self.roles), F.lit(False)))
        return out

    def apply(self, postings: DataFrame) -> DataFrame:
        """A posting whose skill_names are NULL, as no canonical ones were found for it, is tested by its raw ``skills`` if it has that column."""
        if not (self.skills and {"skill_names", "skills"} <= {*postings.columns}):
            return self._apply(postings)
        tested = postings.withColumns({"_given": F.col("skill_names"), "skill_names": F.coalesce("skill_names", "skills")})
        return self._apply(tested).withColumn("skill_names", F.col("_given")).select(*postings.columns)

    def _apply(self, postings: DataFrame) -> DataFrame:
        return reduce(lambda df, p: df.where(p), self.predicates(), postings)

    def apply_to_raw(self, postings: DataFrame, key: str = "id", scratch: Scratch | None = None) -> DataFrame:
        """As ``apply``, on postings whose places are raw cells (``location``) and whose ``key`` is unique.

        The other facets narrow the rows first, and these are written. Of the distinct raw places that they hold each is parsed once, and the rows with a
        chosen one are kept.
        """
        if not (self.locations or self.regions):
            return self.apply(postings)
        scratch = scratch or Scratch(postings.sparkSession, "filter")
        narrowed = scratch.table(replace(self, locations=[], regions=[]).apply(postings), "narrowed")
        raws = narrowed.select(key, F.explode(loc.lines(F.col("location"))).alias("raw"))
        each = raws.groupBy("raw").agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.col("raw")).alias("raw"))  # keeps what is parsed above the grouping
        chosen = scratch.table(each.where(self._in_places(loc.formatted(F.col("raw")))), "chosen", small=True)
        return narrowed.join(raws.join(chosen, "raw", "left_semi").select(key), key, "left_semi")

    def _in_places(self, name: Column) -> Column:
        chosen = [r for r in REGIONS if r.id in self.regions]
        return loc.once(name, lambda x: reduce(lambda a, b: a | b, (belongs(x, r) for r in chosen), x.isin(self.locations) if self.locations else F.lit(False)))


def company_page(postings: DataFrame, slug: str, spec: FilterSpec | None = None) -> DataFrame:
    """All of a company's postings, inactive ones too, that pass the other facets."""
    spec = FilterSpec(**{**vars(spec or FilterSpec()), "show_inactive": True})
    return spec.apply(postings.where(company_slug(F.col("company")) == slug))


def posting_detail(postings: DataFrame, slug: str) -> DataFrame:
    """The first posting with the slug."""
    return postings.where(posting_slug(F.col("company"), F.col("title")) == slug).orderBy("ord").limit(1)


def by_id(postings: DataFrame, key) -> DataFrame:
    return postings.where(F.col("id") == key).orderBy("ord").limit(1)


def page(postings: DataFrame, number: int = 1, size: int = 24) -> DataFrame:
    """All rows up to the end of a page."""
    return postings.orderBy("ord").limit(number * size)


def unprocessed(postings: DataFrame, column: str = "structured_description") -> DataFrame:
    return postings.where(F.col(column).isNull())
