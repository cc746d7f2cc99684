"""Merges, lookups, matches and similarity."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.functions import location as loc, role, skill
from postlake.functions.certification import DEGREE, DUTY, DUTY_PHRASES, WINDOW, cited, named_in
from postlake.functions.region import REGIONS
from postlake.operators import facets, merge, regions, similar
from postlake.operators.facets import exploded
from postlake.plans.facet_queries import with_names
from postlake.plans.postings import PLACES, POSTINGS, postings
from postlake.sources.scratch import Scratch
from postlake.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN doc_id IS NULL THEN NULL ELSE quality END AS quality, doc_id IS NOT NULL AS enhanced FROM postings LEFT JOIN labels ON doc_id = id")
def overlay_enhancements(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return merge.overlay(postings(spark, sf_dir).select("id"), labels, "id", "quality").select("id", "quality", "enhanced")


#: The existing snapshot: events, several per user, as old postings; the last event of a user counts.
@query(
    f"""WITH {POSTINGS}, old AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
    SELECT id, company, event_type FROM postings LEFT JOIN old ON user_id = id"""
)
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "event_id")
    return merge.merge_snapshot(postings(spark, sf_dir).select("id", "company"), old, "id", ["event_type"], "event_id").select("id", "company", "event_type")


@query(f"WITH {POSTINGS} SELECT id, company FROM postings WHERE id NOT IN (SELECT doc_id FROM documents)")
def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.new_rows(postings(spark, sf_dir).select("id", "company"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


@query("SELECT doc_id, source FROM documents WHERE coalesce(text, '') <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def updated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.updated_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 0, "text").select("doc_id", "source")


@query(
    """WITH b AS (SELECT doc_id AS k, 1 AS batch, 'first ' || quality AS result FROM labels UNION ALL SELECT doc_id, 2, 'second ' || toxic FROM labels WHERE doc_id % 3 = 0)
    SELECT doc_id, (SELECT arg_max(result, batch) FROM b WHERE k = doc_id) AS result FROM documents"""
)
def batch_mergeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    first = labels.select("doc_id", F.lit(1).alias("batch"), F.concat(F.lit("first "), F.col("quality").cast("string")).alias("result"))
    second = labels.where("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("batch"), F.concat(F.lit("second "), F.col("toxic").cast("string")).alias("result"))
    return merge.merge_batches(table(spark, sf_dir, "documents").select("doc_id"), first.unionByName(second), "doc_id", "result", "batch")


@query(f"WITH {POSTINGS}, {PLACES} SELECT DISTINCT raw FROM places WHERE raw NOT IN (SELECT 'GB-NATION ' || n_nationkey FROM nation)")
def missing_dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = exploded(postings(spark, sf_dir).where(facets.is_active()).withColumn("raws", loc.lines(F.col("location"))), "raws", "raw")
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("GB-NATION "), F.col("n_nationkey").cast("string")).alias("raw"))
    return merge.missing_keys(raws, known, "raw")


@query(
    f"""WITH {POSTINGS}, {PLACES} SELECT raw, count(*) AS n, max(CASE WHEN g.n_name IS NOT NULL THEN g.n_name || ', Britain' ELSE places.name END) AS name,
    max(CASE WHEN g.n_name IS NOT NULL THEN 'geocoded' ELSE 'fallback' END) AS source
    FROM places LEFT JOIN nation g ON raw = 'GB-NATION ' || g.n_nationkey GROUP BY raw"""
)
def dictionary_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    raws = exploded(postings(spark, sf_dir).where(facets.is_active()).withColumn("raws", loc.lines(F.col("location"))), "raws", "raw")
    none = F.lit(None).cast("string")
    geo = F.struct(F.col("n_name").alias("city"), none.alias("state"), none.alias("stateCode"), F.lit("Britain").alias("country"), F.lit("GB").alias("countryCode"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("GB-NATION "), F.col("n_nationkey").cast("string")).alias("raw"), geo.alias("geo"))
    found = raws.groupBy("raw").agg(F.count("*").alias("n")).join(known, "raw", "left")
    named = F.when(F.col("geo").isNotNull(), loc.from_geocode(F.col("geo"))).otherwise(loc.formatted(F.col("raw")))
    return found.select("raw", "n", named.alias("name"), F.when(F.col("geo").isNotNull(), "geocoded").otherwise("fallback").alias("source"))


def _case(column: str, value: int) -> str:
    """The role patterns as SQL, on text without letters outside ASCII."""
    tests = " ".join(f"WHEN regexp_matches({column}, '{role.pattern(r[3])}') THEN '{r[value]}'" for r in role.ROLES)
    return f"CASE {tests} END"


@query(f"WITH {POSTINGS}, t AS (SELECT DISTINCT title FROM postings) SELECT title, {_case('title', 0)} AS role_id, {_case('title', 2)} AS confidence FROM t")
def first_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = postings(spark, sf_dir).select("title").distinct().withColumn("m", role.match(F.col("title")))
    return titles.select("title", F.col("m.role_id").alias("role_id"), F.col("m.confidence").alias("confidence"))


#: Licences take the place of certifications, as the documents name those.
LICENCES = (("Apache", "licence", (r"Apache License\b",)), ("MIT", "licence", (r"MIT License\b",)), ("GPL", "licence", (r"GNU General Public License\b", r"GPL\b")), ("CC", "licence", (r"CC BY-NC\b",)))


@query(
    r"""WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(replace(regexp_replace(text, '[^\x00-\x7F]', '§', 'g'), '.', '.' || chr(10)), '[\n\r]'))) AS s FROM documents),
    u AS (SELECT doc_id, string_agg(s, chr(10)) AS t FROM s WHERE s <> '' AND NOT regexp_matches(s, '(?i)\b(?:DUTIES)\b')
      AND NOT regexp_matches(s, '(?i)\b(?:DEGREE)\b') AND NOT (length(s) > 150 AND length(s) - length(replace(s, ',', '')) > 2) GROUP BY doc_id),
    n AS (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(t, '(?i)\b(?:Apache License\b)') THEN 'Apache' END, CASE WHEN regexp_matches(t, '(?i)\b(?:MIT License\b)') THEN 'MIT' END,
      CASE WHEN regexp_matches(t, '(?i)\b(?:GNU General Public License\b|GPL\b)') THEN 'GPL' END, CASE WHEN regexp_matches(t, '(?i)\b(?:CC BY-NC\b)') THEN 'CC' END], lambda x: x IS NOT NULL)) AS name FROM u)
    SELECT doc_id, name FROM n""".replace("DUTIES", "|".join((*DUTY, *DUTY_PHRASES))).replace("DEGREE", DEGREE)
)
def all_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(named_in(F.col("text"), LICENCES)).alias("name"))


@query(
    r"""WITH a(name, alternative, re) AS (VALUES PATTERNS),
    f AS (SELECT doc_id, name, alternative, regexp_extract_all(text, re) AS m, regexp_split_to_array(text, re) AS p FROM documents JOIN a ON regexp_matches(text, re)),
    e AS (SELECT *, unnest(range(1, len(m) + 1)) AS nth FROM f),
    c AS (SELECT doc_id, name, alternative, nth, m[nth] AS hit,
      array_to_string(list_transform(range(1, nth), lambda i: p[i] || m[i]), '') || p[nth] AS before,
      p[nth + 1] || array_to_string(list_transform(range(nth + 1, len(m) + 1), lambda i: m[i] || p[i + 1]), '') AS after FROM e),
    s AS (SELECT doc_id, name, alternative, nth, trim(regexp_extract(right(before, WINDOW), '[^.\n\r]*$') || hit || regexp_extract(left(after, WINDOW), '^[^.\n\r]*[.\n\r]?'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM c),
    n AS (SELECT *, regexp_replace(sentence, '[^\x00-\x7F]', '§', 'g') AS q FROM s)
    SELECT doc_id, name, CAST(alternative AS INTEGER) AS alternative, CAST(nth AS INTEGER) AS nth, sentence,
      NOT (regexp_matches(q, '(?i)\b(?:DUTIES)\b') OR regexp_matches(q, '(?i)\b(?:DEGREE)\b') OR (length(q) > 150 AND length(q) - length(replace(q, ',', '')) > 2)) AS usable FROM n""".replace(
        "PATTERNS", ", ".join(rf"('{name}', {k}, '(?i)\b(?:{a})')" for name, _, alternatives in LICENCES for k, a in enumerate(alternatives, 1))
    )
    .replace("WINDOW", str(WINDOW))
    .replace("DUTIES", "|".join((*DUTY, *DUTY_PHRASES)))
    .replace("DEGREE", DEGREE)
)
def pattern_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its sentence, up to 201 characters on each side, and whether the sentence counts."""
    return cited(table(spark, sf_dir, "documents"), "text", ["doc_id"], LICENCES)


@query(
    f"""WITH {POSTINGS}, m AS (SELECT {_case('title', 0)} AS r, {_case('title', 2)} AS c FROM postings)
    SELECT 'all' AS kind, NULL AS value, count(*) AS n, count(r) AS n_matched FROM m
    UNION ALL SELECT 'role', r, count(*), count(r) FROM m WHERE r IS NOT NULL GROUP BY r
    UNION ALL SELECT 'confidence', c, count(*), count(r) FROM m WHERE c IS NOT NULL GROUP BY c"""
)
def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = role.match_titles(postings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("c")))
    return facets.match_statistics(titles.select("match.role_id", "match.confidence", "c"), "role_id", "confidence", "c")


#: Cities of the regions stand in for customers' places: each customer's key picks one.
_CITIES = tuple(dict.fromkeys(x for r in REGIONS for x in r.locations if "'" not in x))
_SQL_CITIES = "[" + ", ".join(f"'{x}'" for x in _CITIES) + "]"


def _sql_belongs(r) -> str:
    cities = "|".join(dict.fromkeys(x.split(",")[0].strip().lower() for x in r.locations))
    edge = lambda names: rf"(?i)(^|[\s-])({names})([\s,-]|$)"
    out = f"regexp_matches(place, '{edge(cities)}')"
    if r.countries:
        out += f" OR regexp_matches(place, '(?i)^({'|'.join(r.countries)})-')"
        if "CA" in r.countries and r.states:
            out += f" OR regexp_matches(place, '(?i)-({'|'.join(r.states)})-') OR regexp_matches(place, '(?i), ({'|'.join(r.states)}),')"
    else:
        out += "".join(f" OR regexp_matches(place, '{edge(k) if ' ' not in k else '(?i)' + k}')" for k in r.keywords)
    return out


@query(
    f"""WITH c AS (SELECT DISTINCT list_extract({_SQL_CITIES}, CAST(c_custkey % {len(_CITIES)} AS INTEGER) + 1) AS place FROM customer)
    {" UNION ALL ".join(f"SELECT '{r.id}' AS region, place FROM c WHERE {_sql_belongs(r)}" for r in REGIONS)}"""
)
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.get(F.array(*(F.lit(x) for x in _CITIES)), (F.col("c_custkey") % len(_CITIES)).cast("int"))
    return regions.members(table(spark, sf_dir, "customer").select(place.alias("place")), "place", regions.region_keys(spark))


#: Regions that the tables give: a nation's two-letter code, its suppliers' cities, and its region's name as a phrase.
@query(
    """WITH k AS (SELECT DISTINCT 'n' || n_nationkey AS region, 'name' AS kind, lower(n_name) AS key FROM nation UNION SELECT DISTINCT 'r' || r_regionkey, 'phrase', lower(r_name) FROM region
      UNION SELECT DISTINCT 's' || s_nationkey, 'name', lower(s_name) FROM supplier WHERE s_suppkey % 3 = 0),
    p AS (SELECT DISTINCT s_name || ', ' || n_name || '-' || r_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT DISTINCT region, place FROM p JOIN k ON CASE kind WHEN 'phrase' THEN contains(lower(place), key) ELSE regexp_matches(lower(place), '(^|[\\s-])' || regexp_escape(key) || '([\\s,-]|$)') END"""
)
def region_table_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a table of regions that is made of nations, regions and suppliers."""
    nation, region, supplier = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    row = lambda kind, prefix, number, key: (F.concat(F.lit(prefix), F.col(number).cast("string")).alias("region"), F.lit(kind).alias("kind"), F.lower(key).alias("key"))
    keys = nation.select(*row("name", "n", "n_nationkey", "n_name")).union(region.select(*row("phrase", "r", "r_regionkey", "r_name"))).union(supplier.where("s_suppkey % 3 = 0").select(*row("name", "s", "s_nationkey", "s_name")))
    named = supplier.join(nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").join(region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return regions.members(named.select(F.concat("s_name", F.lit(", "), "n_name", F.lit("-"), "r_name").alias("place")), "place", keys.distinct())


@query(
    f"""WITH {POSTINGS}, allp AS (SELECT id, ord, company, skills, list_filter(string_split(location, chr(10)), lambda x: x NOT IN ('', 'locations')) AS raws FROM postings),
    q AS (SELECT id AS query_id, company AS c0, skills AS s0, raws AS r0 FROM allp WHERE id % 50 = 0),
    s AS (SELECT query_id, id, ord, CASE WHEN company = c0 THEN 0 ELSE 1 END AS tier,
      CASE WHEN company = c0 THEN 0 ELSE CASE WHEN list_has_any(raws, r0) THEN 2 ELSE 0 END + len(list_filter(skills, lambda x: list_contains(s0, x))) END AS score FROM allp, q WHERE id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, ord) AS r FROM s WHERE tier = 0 OR score > 0)
    SELECT query_id, id, CAST(tier AS INTEGER) AS tier, CAST(score AS BIGINT) AS score FROM r WHERE r <= 5"""
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every posting whose id is divisible by 50 the five most similar ones."""
    rows = postings(spark, sf_dir).select("id", "ord", "company", "skills", loc.lines(F.col("location")).alias("places"))
    rows = Scratch(spark, "postings").table(rows, "rows")
    return similar.most_similar(rows, rows.where("id % 50 = 0"), 5)


@query(
    """WITH ref AS (SELECT min(p_partkey) AS ref_ord, p_name || ' ' || lower(p_type) AS name FROM part GROUP BY 2),
    v AS (SELECT DISTINCT lower(p_brand) || ' ' || p_name AS value FROM part),
    vw AS (SELECT value, list_filter(string_split_regex(value, '[\\s\\-/]+'), lambda w: length(w) >= 2) AS ws FROM v),
    rw AS (SELECT ref_ord, name, list_filter(string_split_regex(lower(name), '[\\s\\-/]+'), lambda w: length(w) >= 2) AS ts FROM ref),
    vx AS (SELECT value, len(ws) AS n, unnest(ws) AS w FROM vw),
    rx AS (SELECT ref_ord, name, len(ts) AS m, unnest(list_distinct(ts)) AS w FROM rw),
    p AS (SELECT value, name, ref_ord, n, m, count(*) AS o FROM vx JOIN rx USING (w) GROUP BY ALL),
    s AS (SELECT value, name, ref_ord, (o / n + o / m) / 2 AS score FROM p)
    SELECT value, name, round(least(score, 1.0), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, ref_ord) AS r FROM s WHERE score >= 0.6) WHERE r = 1"""
)
def fuzzy_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names and types of parts as the reference, in the order of their first part; all distinct brands and names as values."""
    part = table(spark, sf_dir, "part")
    reference = part.groupBy(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")).agg(F.min("p_partkey").alias("ref_ord"))
    values = part.select(F.concat(F.lower("p_brand"), F.lit(" "), F.col("p_name")).alias("value"))
    return similar.fuzzy_match(values, reference, "value").withColumn("score", F.round("score", 6))


@query(
    """WITH v AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || split_part(p_name, ' ', 2)) AS b FROM part)
    SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN contains(b, a) THEN 0.9 WHEN contains(a, b) THEN 0.85 ELSE
      0.8 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))
      + 0.2 * least(length(a), length(b)) / greatest(length(a), length(b)) END, 6) AS score FROM v"""
)
def jaccard_length_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat("p_type", F.lit(" "), F.get(F.split("p_name", " "), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(skill.similarity(F.col("p_name"), other), 6).alias("score"))


@query(
    f"""WITH {POSTINGS}, allp AS (SELECT id, ord, o_custkey AS company, skills, list_filter(string_split(location, chr(10)), lambda x: x NOT IN ('', 'locations')) AS raws FROM postings JOIN orders ON o_orderkey = id),
    q AS (SELECT id AS query_id, company AS c0, skills AS s0, raws AS r0 FROM allp WHERE id % 50 = 0),
    s AS (SELECT query_id, id, ord, CASE WHEN company = c0 THEN 0 ELSE 1 END AS tier,
      CASE WHEN company = c0 THEN 0 ELSE CASE WHEN list_has_any(raws, r0) THEN 2 ELSE 0 END + len(list_filter(skills, lambda x: list_contains(s0, x))) END AS score FROM allp, q WHERE id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, ord) AS r FROM s WHERE tier = 0 OR score > 0)
    SELECT query_id, id, CAST(tier AS INTEGER) AS tier, CAST(score AS BIGINT) AS score FROM r WHERE r <= 5"""
)
def similar_across_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with customers as companies: most have too few other postings, so places and skills of others decide."""
    company = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"))
    rows = postings(spark, sf_dir).select("id", "ord", "skills", loc.lines(F.col("location")).alias("places")).join(company, "id")
    rows = Scratch(spark, "postings").table(rows, "rows")
    return similar.most_similar(rows, rows.where("id % 50 = 0"), 5)


@query(
    r"""WITH t AS (SELECT doc_id, text, unnest(['Apache License', 'MIT', 'idiot', 'the of', 'General Public License', 'Version']) AS term FROM documents)
    SELECT doc_id, term FROM t WHERE regexp_matches(text, '(?i)\b' || term || '\b')"""
)
def reference_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.scan_terms(table(spark, sf_dir, "documents"), "text", "doc_id", ["Apache License", "MIT", "idiot", "the of", "General Public License", "Version"])


#: A reference list by rule: all kinds of parts, every second with a hyphen, and signs at some ends.
KINDS = tuple(f"{a.title()}{'-' if k % 2 else ' '}{b.title()} {c.title()}" for k, (a, b, c) in enumerate(product(("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"), ("ANODIZED", "BURNISHED", "PLATED", "POLISHED", "BRUSHED"), ("TIN", "NICKEL", "BRASS", "STEEL", "COPPER"))))
LISTED = (*KINDS, "R&D", "C++", "C#", "Brushed", "Non-Polished Tin", "Tin")


@query(
    rf"""WITH d AS (SELECT l_orderkey AS id, string_agg(CASE l_linenumber % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN split_part(p_type, ' ', 1) || '-' || split_part(p_type, ' ', 2) || ' ' || split_part(p_type, ' ', 3)
      ELSE 'R&D, C++ non-' || split_part(p_type, ' ', 2) || ' ' || split_part(p_type, ' ', 3) END, ', ' ORDER BY l_linenumber) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
    t AS (SELECT id, text, unnest([{", ".join(repr(x) for x in LISTED)}]) AS term FROM d WHERE length(text) >= 50)
    SELECT id, term FROM t WHERE contains(lower(text), lower(term)) AND regexp_matches(text, '(?i)\b' || regexp_escape(term) || '\b')"""
)
def reference_terms_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a list in texts that are made of the parts' kinds; texts of under 50 characters are skipped."""
    kind = lambda k: F.split_part("p_type", F.lit(" "), F.lit(k))
    hyphened = F.concat(kind(1), F.lit("-"), kind(2), F.lit(" "), kind(3))
    said = F.when(F.col("l_linenumber") % 3 == 0, F.lower("p_type")).when(F.col("l_linenumber") % 3 == 1, hyphened).otherwise(F.concat(F.lit("R&D, C++ non-"), kind(2), F.lit(" "), kind(3)))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("id"))
    texts = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", said.alias("said")))), lambda x: x["said"]), ", ").alias("text"))
    return similar.scan_terms(texts, "text", "id", list(LISTED), least=50)


@query(
    f"""WITH {POSTINGS} SELECT id, CASE WHEN doc_id IS NULL THEN coalesce(km, 'other') WHEN quality = 1 THEN 'welder' ELSE coalesce(km, 'other') END AS role_id,
    CASE WHEN quality = 1 THEN 'mapping' WHEN km IS NOT NULL THEN 'keyword' ELSE 'none' END AS how
    FROM (SELECT id, {_case('title', 0)} AS km FROM postings) LEFT JOIN labels ON doc_id = id"""
)
def role_resolution_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("welder").alias("mapped"))
    matched = role.match_titles(postings(spark, sf_dir).select("id", "title")).select("id", F.col("match.role_id").alias("keyword")).join(mapping, "id", "left")
    how = F.when(F.col("mapped").isNotNull(), "mapping").when(F.col("keyword").isNotNull(), "keyword").otherwise("none")
    return matched.select("id", F.coalesce("mapped", "keyword", F.lit("other")).alias("role_id"), how.alias("how"))


@query(
    f"""WITH {POSTINGS}, r AS (SELECT coalesce({_case('title', 0)}, 'other') AS role_id FROM active) SELECT role_id, count(*) AS n, role_id = 'other' AS last FROM r GROUP BY role_id"""
)
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = postings(spark, sf_dir).where(facets.is_active())
    titles = role.match_titles(active.groupBy("title").agg(F.count("*").alias("c")))
    counts = titles.groupBy(F.coalesce("match.role_id", F.lit("other")).alias("role_id")).agg(F.sum("c").alias("n"))
    return counts.withColumn("last", F.col("role_id") == "other").orderBy("last", F.desc("n"), "role_id")


@query(
    """WITH s AS (SELECT p_partkey, p_type || ' widget' AS top, p_type || ' ' || p_name AS title, p_size % 9 AS n FROM part),
    c AS (SELECT p_partkey, CASE WHEN n = 1 OR contains(lower(title), lower(top)) OR contains(lower(top), lower(title)) THEN 'high' WHEN n <= 5 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN p_partkey % 2 = 0 THEN '51-8013.00' ELSE '11-1111.00' END AS code FROM s)
    SELECT p_partkey, confidence, CASE WHEN confidence = 'medium' AND code = '51-8013.00' THEN 'high' ELSE confidence END AS boosted FROM c"""
)
def confidence_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", role.confidence(F.col("p_size") % 9, F.concat("p_type", F.lit(" "), F.col("p_name")), F.concat("p_type", F.lit(" widget"))).alias("confidence"), F.when(F.col("p_partkey") % 2 == 0, "51-8013.00").otherwise("11-1111.00").alias("code"))
    return rows.select("p_partkey", "confidence", role.boosted(F.col("confidence"), F.col("code")).alias("boosted"))


@query(f"WITH {POSTINGS} SELECT CAST(ceil(row_number() OVER (ORDER BY ord) / 400.0) AS BIGINT) AS batch, id FROM postings")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.numbered(postings(spark, sf_dir).select("id", "ord"), "ord")
    return rows.select(merge.batch_number(F.col("row_no")).alias("batch"), "id")
