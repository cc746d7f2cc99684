"""Filters, facets, counts and groups over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.functions import location as loc
from postlake.functions.text import company_slug, posting_slug
from postlake.operators import facets, filters
from postlake.operators.facets import exploded
from postlake.operators.filters import FilterSpec, is_active
from postlake.plans.postings import FORMATTED, PLACES, POSTINGS, postings
from postlake.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SPEC = FilterSpec.from_query("companies=NATION_1|NATION_4|NATION_9&employmentTypes=1-URGENT|5-LOW&skills=promo|ECONOMY&locations=Nation%207,%20TX|Nation%208,%20AB,%20Canada|Nation%203,%20United%20Kingdom")


def with_names(df: DataFrame) -> DataFrame:
    return df.withColumn("location_names", loc.all_formatted(F.col("location"))).withColumn("skill_names", F.col("skills"))


@query(f"WITH {POSTINGS} SELECT company, count(*) AS n FROM active GROUP BY company ORDER BY n DESC, min(ord), company LIMIT 10")
def active_postings_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.top_companies(postings(spark, sf_dir), 10)


@query(f"WITH {POSTINGS} SELECT count(*) AS n_inactive FROM postings WHERE status IN ('removed', 'paused')")
def inactive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).agg(F.count_if(~is_active()).alias("n_inactive"))


@query(
    f"""WITH {POSTINGS}, {PLACES}
    SELECT id, company, employment_type, array_to_string(skills, ',') AS skills FROM active
    WHERE company IN ('NATION_1', 'NATION_4', 'NATION_9') AND employment_type IN ('1-URGENT', '5-LOW')
      AND list_has_any(skills, ['PROMO', 'ECONOMY'])
      AND id IN (SELECT id FROM places WHERE name IN ('Nation 7, TX', 'Nation 8, AB, Canada', 'Nation 3, United Kingdom'))"""
)
def faceted_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SPEC.apply_to_raw(postings(spark, sf_dir).withColumn("skill_names", F.col("skills"))).select("id", "company", "employment_type", F.array_join("skills", ",").alias("skills"))


@query(f"WITH {POSTINGS} SELECT DISTINCT company FROM active")
def facet_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.distinct_values(postings(spark, sf_dir), "company")


@query(f"WITH {POSTINGS} SELECT DISTINCT employment_type, CASE employment_type WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS place FROM postings")
def facet_employment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = postings(spark, sf_dir).select("employment_type").where("employment_type is not null").distinct()
    return types.withColumn("place", facets.ordinal(F.col("employment_type"), facets.EMPLOYMENT_ORDER)).orderBy("place", "employment_type")


@query(f"WITH {POSTINGS}, {PLACES} SELECT DISTINCT name FROM places")
def facet_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.place_counts(postings(spark, sf_dir)).select("name").distinct()


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Za-z]+')) AS ws FROM documents),
    e AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS term FROM w)
    SELECT term FROM (SELECT term, row_number() OVER (PARTITION BY lower(term) ORDER BY doc_id, p) AS r FROM e) WHERE r = 1"""
)
def facet_skills_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("status"), F.filter(F.split("text", " "), lambda x: x.rlike("^[A-Za-z]+$")).alias("skills"))
    return facets.distinct_ignoring_case(docs, "skills", "term")


@query(
    f"""WITH {POSTINGS}, terms AS (SELECT DISTINCT p_type || suffix AS term FROM part, (VALUES (''), ('X')) AS s(suffix)),
    n AS (SELECT s AS term, count(*) AS n FROM (SELECT unnest(skills) AS s FROM active) GROUP BY s)
    SELECT terms.term, CAST(coalesce(n, 0) AS BIGINT) AS n FROM terms LEFT JOIN n ON terms.term = n.term"""
)
def facet_terms_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").select("p_type").distinct().select(F.explode(F.array("p_type", F.concat("p_type", F.lit("X")))).alias("term"))
    return facets.zero_filled(terms, exploded(postings(spark, sf_dir).where(is_active()), "skills", "term"), "term")


@query(f"WITH {POSTINGS}, {PLACES} SELECT name, count(*) AS n FROM places GROUP BY name ORDER BY n DESC, min(ord), name LIMIT 10")
def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = facets.place_counts(postings(spark, sf_dir)).groupBy("name").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    return counts.orderBy(F.desc("n"), "first_ord", "name").limit(10).select("name", "n")


@query(
    f"""WITH {POSTINGS}, {PLACES}, t AS (SELECT raw, count(*) AS n, min(ord) AS o FROM places GROUP BY raw ORDER BY n DESC, o, raw LIMIT 10)
    SELECT {FORMATTED} AS name, n FROM (SELECT *, 'Nation ' || regexp_extract(raw, '([0-9]+)$', 1) AS city FROM t)"""
)
def top_raw_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = postings(spark, sf_dir).withColumn("raws", loc.lines(F.col("location")))
    return facets.top_elements(raws, "raws", "raw", 10).select(loc.formatted(F.col("raw")).alias("name"), "n")


@query(f"WITH {POSTINGS} SELECT s AS skill, count(*) AS n FROM (SELECT ord, unnest(skills) AS s FROM active) WHERE lower(s) IN ('promo', 'small', 'economy') GROUP BY s ORDER BY n DESC, min(ord), s LIMIT 2")
def top_skills_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = postings(spark, sf_dir).withColumn("skills", F.filter("skills", lambda x: F.lower(x).isin("promo", "small", "economy")))
    return facets.top_elements(listed, "skills", "skill", 2)


@query(
    f"""WITH {POSTINGS}, {PLACES}, d AS (SELECT DISTINCT name FROM places),
    g AS (SELECT name, CASE WHEN name LIKE '%, TX' THEN 'United States' WHEN name LIKE '%, Canada' THEN 'Canada' WHEN name LIKE '%, Brazil' THEN 'Brazil'
      WHEN name LIKE '%, %' THEN split_part(name, ', ', 2) ELSE 'Unknown' END AS country,
      CASE WHEN name LIKE '%, TX' THEN 'TX' WHEN name LIKE '%, AB, Canada' THEN 'AB' ELSE 'Cities' END AS region FROM d)
    SELECT country, region, array_to_string(list_sort(list(DISTINCT name)), ';') AS names FROM g GROUP BY country, region"""
)
def group_country_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = facets.place_counts(postings(spark, sf_dir)).select("name").distinct().withColumn("k", loc.group_keys(F.col("name")))
    return names.groupBy(F.col("k.country").alias("country"), F.coalesce("k.region", F.lit("Cities")).alias("region")).agg(F.array_join(F.sort_array(F.collect_set("name")), ";").alias("names"))


@query(
    f"""WITH {POSTINGS}, {PLACES}, d AS (SELECT DISTINCT raw FROM places),
    g AS (SELECT raw, CASE WHEN raw LIKE 'US-%' THEN 'United States - Texas' WHEN raw LIKE 'CA-%' THEN 'Canada - AB' WHEN raw LIKE 'BR-%' THEN 'Brazil - RJ'
      WHEN raw LIKE 'GB-%' THEN 'United Kingdom' WHEN raw LIKE 'AE-%' THEN 'United Arab Emirates' ELSE 'Other' END AS group_label,
      CASE WHEN raw LIKE '__-%' THEN 'Nation ' || regexp_extract(raw, '([0-9]+)$', 1) ELSE raw END AS label FROM d)
    SELECT group_label, CASE WHEN group_label LIKE 'United States%' THEN 0 WHEN group_label = 'Other' THEN 2 ELSE 1 END AS rank,
      array_to_string(list_sort(list(DISTINCT label)), ';') AS labels FROM g GROUP BY group_label"""
)
def group_ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = postings(spark, sf_dir).withColumn("raws", loc.lines(F.col("location")))
    parsed = facets.distinct_elements(raws, "raws", "raw").withColumn("g", loc.parse(F.col("raw")))
    group = F.coalesce(F.concat_ws(" - ", F.col("g.country"), F.coalesce("g.state", F.when(F.col("g.country").isNotNull(), F.col("g.state_code")))), F.lit(""))
    labelled = parsed.select(F.coalesce(F.nullif(group, F.lit("")), F.lit("Other")).alias("group"), F.coalesce("g.city", "g.formatted").alias("label"))
    out = facets.grouped_labels(labelled, F.col("group"), "label")
    return out.select("group_label", facets.group_rank(F.col("group_label")).alias("rank"), F.array_join("labels", ";").alias("labels")).orderBy("rank", "group_label")


@query(f"WITH {POSTINGS} SELECT company, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'removed') AS removed FROM postings GROUP BY company")
def status_counts_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.conditional_counts(postings(spark, sf_dir), "company", "status", ("active", "removed"))


@query(f"WITH {POSTINGS} SELECT id, title, company FROM postings WHERE lower(company) = 'nation_7' AND employment_type = '2-HIGH'")
def company_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugged = postings(spark, sf_dir).withColumn("company", F.replace("company", F.lit("_"), F.lit(" ")))
    out = filters.company_page(slugged, "nation-7", FilterSpec(employment_types=["2-HIGH"]))
    return out.select("id", "title", F.replace("company", F.lit(" "), F.lit("_")).alias("company"))


@query(f"WITH {POSTINGS} SELECT id, lower(replace(company, '_', '')) AS company_slug, lower(replace(company, '_', '')) || '-' || lower(replace(title, ' ', '-')) AS slug FROM postings")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("id", company_slug(F.col("company")).alias("company_slug"), posting_slug(F.col("company"), F.col("title")).alias("slug"))


@query(f"WITH {POSTINGS} SELECT id, title FROM postings WHERE company = 'NATION_3' AND title = 'Wireline Engineer' ORDER BY ord LIMIT 1")
def slug_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.posting_detail(postings(spark, sf_dir), "nation3-wireline-engineer").select("id", "title")


@query(f"WITH {POSTINGS} SELECT id FROM active ORDER BY ord LIMIT 48")
def page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.page(postings(spark, sf_dir).where(is_active()), 2).select("id")


@query(
    f"""WITH {POSTINGS} SELECT 'status' AS "check", count(*) AS rows, count(*) FILTER (coalesce(status, 'active') NOT IN ('active', 'paused', 'removed')) AS broken FROM postings
    UNION ALL SELECT 'skills without spaces', count(*), count(*) FILTER (regexp_matches(s, '\\s')) FROM (SELECT unnest(skills) AS s FROM active)
    UNION ALL SELECT 'label has document', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels"""
)
def quality_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = postings(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return facets.expectations(
        {
            "status": (posts, ~F.coalesce("status", F.lit("active")).isin("active", "paused", "removed")),
            "skills without spaces": (exploded(posts.where(is_active()), "skills", "skill"), F.col("skill").rlike(r"\s")),
            "label has document": (labels, F.col("known").isNull()),
        }
    )
