"""Dictionaries of roles, certifications, skills and places joined to the tables, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.functions import certification as cert, location as loc, role, skill
from postlake.functions.region import REGIONS
from postlake.functions.text import parse_method, percent, token_budget
from postlake.operators import facets, regions, skills
from postlake.operators.facets import exploded
from postlake.operators.filters import is_active
from postlake.operators.similar import STOP_WORDS
from postlake.plans.join_queries import _CITIES, _SQL_CITIES, _case, _sql_belongs
from postlake.plans.postings import PLACES, POSTINGS, pick, postings, sql_pick
from postlake.plans.text_queries import _NORMALIZE, raw_skill
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


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


# ---- roles ----

#: Each part gets an occupation code, or one that no role has.
CODES = tuple(code for _, (_, codes) in role.CODED_ROLES.items() for code in codes.split()) + ("11-9032.00", "99-9999.00")
_ROLE_OF_CODE = "CASE " + " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes.split())}) THEN '{r}'" for r, (_, codes) in role.CODED_ROLES.items() if codes)
_KEYWORDS = "|".join(role.TITLE_KEYWORDS["drilling-operations"])
_PART_CODES = f"pc AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {sql_pick(CODES, 'p_partkey')} END AS code, CASE WHEN p_partkey % 3 = 0 THEN 'Rig Crew ' ELSE 'Crew ' END || p_type AS title FROM part)"
_DIMENSION = "dim(role_id, label, category, category_label, place) AS (VALUES " + _values((r, role.LABELS[r], c, label, place) for place, (c, (label, rs)) in enumerate(role.CATEGORIES.items()) for r in rs.split()) + ")"


def _coded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = F.when(key % 5 != 0, pick(CODES, key))
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", code.alias("code"), F.concat(F.when(key % 3 == 0, "Rig Crew ").otherwise("Crew "), F.col("p_type")).alias("title"))


@query(f"WITH {_PART_CODES} SELECT p_partkey, code, {_ROLE_OF_CODE} WHEN regexp_matches(lower(title), '{_KEYWORDS}') THEN 'drilling-operations' ELSE 'other' END AS role_id FROM pc")
def role_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded_parts(spark, sf_dir).select("p_partkey", "code", role.of_code(F.col("code"), F.col("title")).alias("role_id"))


@query(
    f"""WITH {_PART_CODES}, {_DIMENSION}, r AS (SELECT {_ROLE_OF_CODE} WHEN regexp_matches(lower(title), '{_KEYWORDS}') THEN 'drilling-operations' ELSE 'other' END AS role_id FROM pc)
    SELECT role_id, label, category, category_label, count(*) AS n, role_id = 'other' AS last FROM r JOIN dim USING (role_id) GROUP BY role_id, label, category, category_label"""
)
def role_counts_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the roles that are in the dictionary, most frequent first and the rest role at the end."""
    counts = _coded_parts(spark, sf_dir).groupBy(role.of_code(F.col("code"), F.col("title")).alias("role_id")).agg(F.count("*").alias("n"))
    out = counts.join(role.dimension(spark), "role_id").select("role_id", "label", "category", "category_label", "n", (F.col("role_id") == "other").alias("last"))
    return out.orderBy("last", F.desc("n"), "role_id")


@query(
    f"""WITH {POSTINGS}, {_DIMENSION}, m AS (SELECT {_case('title', 0)} AS role_id, count(*) AS n FROM active GROUP BY 1)
    SELECT category, category_label, place, string_agg(role_id, ',' ORDER BY role_id) AS roles, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM dim LEFT JOIN m USING (role_id) GROUP BY category, category_label, place"""
)
def roles_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category in its order of display with its roles and the active postings that fit them."""
    counts = role.match_titles(postings(spark, sf_dir).where(is_active()).groupBy("title").agg(F.count("*").alias("c"))).groupBy(F.col("match.role_id").alias("role_id")).agg(F.sum("c").alias("n"))
    joined = role.dimension(spark).join(counts, "role_id", "left")
    return joined.groupBy("category", "category_label", "place").agg(F.array_join(F.sort_array(F.collect_list("role_id")), ",").alias("roles"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy("place")


def _sql_keyword(column: str) -> str:
    """What the first fitting alternative of the first fitting role matches."""
    first = lambda alternatives: "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, '(?i)({role.plain(x)})', 1), '')" for x in alternatives) + ")"
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{role.pattern(r[3])}') THEN {first(r[3])}" for r in role.ROLES) + " END"


@query(f"WITH {POSTINGS}, t AS (SELECT DISTINCT title FROM postings) SELECT title, {_case('title', 1)} AS role_name, {_sql_keyword('title')} AS keyword FROM t")
def role_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = role.match_titles(postings(spark, sf_dir).select("title").distinct())
    return titles.select("title", "match.role_name", "match.keyword")


@query(
    f"""WITH {POSTINGS}, p AS (SELECT id, title, {_case('title', 0)} AS word, CASE WHEN id % 7 < 3 THEN {sql_pick(CODES, 'id')} END AS code FROM postings),
    c AS (SELECT id, word, code, {_ROLE_OF_CODE} END AS coded FROM p)
    SELECT id, CASE WHEN quality = 1 THEN 'welder' ELSE coalesce(coded, word, 'other') END AS role_id, CASE WHEN quality = 1 THEN 'mapping' WHEN coded IS NOT NULL THEN 'code' WHEN word IS NOT NULL THEN 'keyword' ELSE 'none' END AS how
    FROM c LEFT JOIN labels ON doc_id = id"""
)
def role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting's role: the mapped one, else that of its occupation code, else that of its title, else the rest role."""
    mapping = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("welder").alias("mapped"))
    code = F.when(F.col("id") % 7 < 3, pick(CODES, F.col("id")))
    posts = role.match_titles(postings(spark, sf_dir).select("id", "title", F.nullif(role.of_code(code, F.lit("")), F.lit("other")).alias("coded")))
    posts = posts.select("id", "coded", F.col("match.role_id").alias("keyword")).join(mapping, "id", "left")
    how = F.when(F.col("mapped").isNotNull(), "mapping").when(F.col("coded").isNotNull(), "code").when(F.col("keyword").isNotNull(), "keyword").otherwise("none")
    return posts.select("id", F.coalesce("mapped", "coded", "keyword", F.lit("other")).alias("role_id"), how.alias("how"))


#: Remote answers on parts: a role or one that doesn't exist, and a confidence.
ANSWERS, LEVELS = ("welder", "geologist", "no-such-role", "drilling-operations"), ("high", "medium", "low", "none")
_DECIDED = f"""WITH {_PART_CODES},
    a AS (SELECT *, {sql_pick(ANSWERS, 'p_partkey')} AS role0, {sql_pick(LEVELS, 'p_partkey // 4')} AS level0, code IS NOT NULL AS found, p_partkey % 11 = 0 AS cached FROM pc),
    v AS (SELECT *, CASE WHEN role0 <> 'no-such-role' AND level0 <> 'none' THEN role0 END AS role_id, CASE WHEN role0 <> 'no-such-role' THEN level0 ELSE 'none' END AS confidence FROM a),
    d AS (SELECT *, CASE WHEN cached THEN 'cache' WHEN confidence IN ('high', 'medium') THEN 'ai' WHEN found THEN 'onet_fallback' WHEN confidence = 'low' THEN 'ai_fallback' END AS match_type FROM v)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    answered = _coded_parts(spark, sf_dir).withColumn("answer", role.validated(pick(ANSWERS, key), pick(LEVELS, F.floor(key / 4))))
    return answered.withColumn("match_type", role.decided(key % 11 == 0, F.col("answer"), F.col("code").isNotNull()))


@query(f"{_DECIDED} SELECT p_partkey, role_id, confidence, match_type FROM d")
def occupation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached answer, else a sure remote one, else a looked-up occupation, else an unsure answer, else nothing."""
    return _decisions(spark, sf_dir).select("p_partkey", "answer.role_id", "answer.confidence", "match_type")


@query(
    f"""{_DECIDED}, m AS (SELECT * FROM d WHERE match_type IS NOT NULL), n AS (SELECT count(*) AS n FROM m),
    r AS (SELECT 'role' AS kind, role_id AS value, count(*) AS c FROM m WHERE role_id IS NOT NULL GROUP BY role_id ORDER BY c DESC, value LIMIT 10)
    SELECT kind, value, c AS n, CAST((c * 200 + n) // (2 * n) AS BIGINT) AS share FROM (
      SELECT 'confidence' AS kind, confidence AS value, count(*) AS c FROM m GROUP BY confidence UNION ALL SELECT 'match_type', match_type, count(*) FROM m GROUP BY match_type UNION ALL SELECT * FROM r), n"""
)
def occupation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows by confidence, by match type and for the ten most frequent roles, with whole per cents."""
    matched = _decisions(spark, sf_dir).where("match_type is not null").select("answer.role_id", "answer.confidence", "match_type")
    return facets.shares(matched.groupBy("role_id", "confidence", "match_type").agg(F.count("*").alias("c")), {"confidence": None, "match_type": None, "role": ("role_id", 10)})


# ---- certifications ----

#: A sentence per certification; every seventh posting says it as a duty, which doesn't count.
CERTIFICATES = tuple(name.replace("CPR/First Aid", "CPR").replace("NACE CIP", "NACE CIP Level 2").replace("Six Sigma", "Lean Six Sigma").replace("H2S", "H2S Alive").replace("USCG License", "USCG Master").replace("Rigger Certification", "Certified Rigger").replace("NCCCO Crane Operator", "NCCCO") for name, _, _ in cert.CERTIFICATIONS)
_CERTIFIED = f"""c AS (SELECT id, status, {sql_pick(CERTIFICATES, 'id')} AS one, {sql_pick(CERTIFICATES, 'id // 3')} AS two FROM postings),
    t AS (SELECT id, status, CASE WHEN id % 7 = 0 THEN two ELSE 'Holds ' || one || '. Also ' || two END AS text FROM c),
    named AS (SELECT id, status, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{cert.pattern(a).replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, _, a in cert.CERTIFICATIONS)}], lambda x: x IS NOT NULL)) AS name FROM t)"""
_OFFICIAL = "official(name, category) AS (VALUES " + _values((name, category) for name, category, _ in cert.CERTIFICATIONS) + ")"


def _certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings' certifications; texts are built of few parts, so the distinct texts are searched."""
    one, two = pick(CERTIFICATES, F.col("id")), pick(CERTIFICATES, F.floor(F.col("id") / 3))
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("You will manage "), one, F.lit(" matters.\n"), two)).otherwise(F.concat(F.lit("Holds "), one, F.lit(". Also "), two))
    posts = postings(spark, sf_dir).select("id", "ord", "status", text.alias("text"))
    names = posts.select("text").distinct().withColumn("names", cert.named_in(F.col("text")))
    return posts.join(names, "text").select("id", "ord", "status", "names")


@query(f"WITH {POSTINGS}, {_CERTIFIED} SELECT DISTINCT name FROM named WHERE coalesce(status, '') NOT IN ('removed', 'paused')")
def facet_certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.distinct_elements(_certified(spark, sf_dir), "names", "name").orderBy("name")


@query(
    f"""WITH {POSTINGS}, {_CERTIFIED}, {_OFFICIAL}, n AS (SELECT name, count(*) AS n FROM named WHERE coalesce(status, '') NOT IN ('removed', 'paused') GROUP BY name)
    SELECT name, category, CAST(coalesce(n, 0) AS BIGINT) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, lower(name)) AS place FROM official LEFT JOIN n USING (name)"""
)
def certification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every official certification with its active postings, zero included, in the order of the list: most frequent first, then by locale."""
    found = exploded(_certified(spark, sf_dir).where(is_active()), "names", "name")
    return facets.placed(facets.zero_filled(cert.dictionary(spark), found, "name"), F.desc("n"), cert.by_locale(F.col("name")))


@query(f"WITH {POSTINGS}, {_CERTIFIED}, {_OFFICIAL} SELECT category, string_agg(DISTINCT name, ';' ORDER BY name) AS names, count(DISTINCT id) AS postings FROM named JOIN official USING (name) GROUP BY category")
def certifications_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _certified(spark, sf_dir).select("id", F.explode("names").alias("name")).join(F.broadcast(cert.dictionary(spark)), "name")  # 41 rows
    return found.groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("name")), ";").alias("names"), F.count_distinct("id").alias("postings"))


# ---- skills ----

#: The reference list, in order, and a prepared dictionary from a normalised skill to its canonical name.
REFERENCE = ("Financial Analysis", "Welding", "Ring Management", "Mechanical Design Operations", "Pipe Inspection", "Safety Operations", "Critical Thinking")
PREPARED = {"safety management": "Health and Safety", "non-destructive testing": "NDT", "welding operations": "WELDING"}
_WORDS = lambda c: f"list_filter(string_split_regex({c}, '[\\s\\-/]+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))"
_PROCESSED = rf"""{_NORMALIZE},
    ref(ref_ord, name) AS (VALUES {_values(enumerate(REFERENCE))}),
    prepared(key, known) AS (VALUES {_values(PREPARED.items())}),
    n AS (SELECT DISTINCT skill FROM h WHERE skill IS NOT NULL),
    pairs AS (SELECT n.skill, ref_ord, name, {_WORDS('lower(n.skill)')} AS sw, {_WORDS('lower(name)')} AS rw FROM n, ref),
    scores AS (SELECT skill, ref_ord, name, CASE WHEN lower(skill) = lower(name) THEN 3.0 WHEN trim(regexp_replace(regexp_replace(lower(skill), '[\-/]+', ' ', 'g'), '\s+', ' ', 'g')) = lower(name) THEN 2.0
      ELSE (len(list_filter(sw, lambda w: list_contains(rw, w))) / len(sw) + len(list_filter(sw, lambda w: list_contains(rw, w))) / len(rw)) / 2 END AS score FROM pairs WHERE len(sw) > 0 AND len(rw) > 0),
    best AS (SELECT skill, name FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY score DESC, ref_ord) AS r FROM scores WHERE score >= 0.6) WHERE r = 1),
    canon AS (SELECT n.skill, coalesce(known, best.name) AS canonical FROM n LEFT JOIN prepared ON key = lower(n.skill) LEFT JOIN best ON best.skill = n.skill),
    parts AS (SELECT p_brand, part.p_partkey AS k, canonical FROM part JOIN h USING (p_partkey) JOIN canon ON canon.skill = h.skill WHERE canonical IS NOT NULL),
    once AS (SELECT p_brand, lower(canonical) AS key, arg_min(canonical, k) AS name, min(k) AS k FROM parts GROUP BY ALL)"""


def _brand_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per brand with the raw skills of its parts, in their order; compound ones are left whole, as the SQL has it."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("place"), raw_skill().alias("raw"))


@query(f"WITH {_PROCESSED} SELECT p_brand AS id, string_agg(name, ';' ORDER BY k) AS skills FROM once GROUP BY p_brand")
def skills_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw skills to canonical names: normalised, looked up in the prepared dictionary, matched to the reference, each name once."""
    reference = spark.createDataFrame(list(enumerate(REFERENCE)), "ref_ord int, name string")
    prepared = spark.createDataFrame(list(PREPARED.items()), "key string, known string")
    out = skills.processed(_brand_skills(spark, sf_dir), reference, prepared, split=False)
    return out.select("id", F.array_join("skills", ";").alias("skills"))


@query(
    f"""WITH {_PROCESSED} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(canonical) AS BIGINT) AS matched, CAST(count(*) - count(canonical) AS BIGINT) AS unmatched,
    (count(canonical) * 200 + count(*)) // (2 * count(*)) || '%' AS match_rate FROM canon"""
)
def skill_cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the distinct normalised skills, those that a canonical name was found for."""
    reference = spark.createDataFrame(list(enumerate(REFERENCE)), "ref_ord int, name string")
    prepared = spark.createDataFrame(list(PREPARED.items()), "key string, known string")
    raws = facets.once_each(_brand_skills(spark, sf_dir), "raw")
    found = skills.canonical(raws.select(skill.normalize(F.col("raw")).alias("skill")).where("skill is not null").distinct(), reference, prepared)
    sums = found.agg(F.count("*").alias("total"), F.count("canonical").alias("matched"))
    return sums.select("total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), percent(F.col("matched"), F.col("total"), 0).alias("match_rate"))


@query(
    f"""WITH {POSTINGS}, b AS (SELECT id, skills, list_filter([CASE WHEN id % 2 = 0 THEN 'Promo' END, CASE WHEN id % 3 = 0 THEN 'Safety' END, CASE WHEN len(skills) > 2 THEN lower(skills[1]) END],
      lambda x: x IS NOT NULL AND NOT list_contains(list_transform(skills, lambda s: lower(s)), lower(x))) AS more FROM postings)
    SELECT count(*) AS total, CAST(count(*) FILTER (len(more) > 0) AS BIGINT) AS updated, CAST(sum(len(more)) AS BIGINT) AS added, CAST(count(*) FILTER (len(skills) = 0 AND len(more) > 0) AS BIGINT) AS gained,
    CAST(count(*) FILTER (len(skills) + len(more) > 0) AS BIGINT) AS with_skills FROM b"""
)
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What skills found in texts add to the postings' own."""
    found = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "Promo"), F.when(F.col("id") % 3 == 0, "Safety"), F.when(F.size("skills") > 2, F.lower(F.get("skills", F.lit(0))))))
    merged = postings(spark, sf_dir).select(F.size("skills").alias("had"), F.size(skill.merge_ordered(F.col("skills"), found)).alias("has"))
    return merged.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("has") > F.col("had")).alias("updated"),
        F.sum(F.col("has") - F.col("had")).cast("long").alias("added"),
        F.count_if((F.col("had") == 0) & (F.col("has") > 0)).alias("gained"),
        F.count_if(F.col("has") > 0).alias("with_skills"),
    )


@query(
    """WITH m AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT count(*) AS total, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS enhanced, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS errors,
    (count(*) FILTER (quality = 1) * 2000 + count(*)) // (2 * count(*)) // 10 || '.' || (count(*) FILTER (quality = 1) * 2000 + count(*)) // (2 * count(*)) % 10 || '%' AS share FROM m"""
)
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a merge of processed batches: with results, with errors, and the share of the first."""
    merged = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = merged.agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("enhanced"), F.count_if(F.col("toxic") == 1).alias("errors"))
    return sums.withColumn("share", percent(F.col("enhanced"), F.col("total")))


_FOUND = f"""f AS (SELECT DISTINCT p_name AS skill, l_suppkey AS code, l_suppkey % 7 = 0 AS priority, (l_suppkey * 31) % 101 AS occ_ord, l_suppkey % 5 AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT skill, code, priority, occ_ord, unnest([0, 1]) AS elem_ord, k FROM f),
    n AS (SELECT *, CASE WHEN elem_ord = 1 THEN 'manage ' || skill WHEN k = 0 THEN skill || ' work' WHEN k = 1 THEN 'general ' || split_part(skill, ' ', 1) WHEN k = 2 THEN 'that has been ' || skill WHEN k = 3 THEN split_part(skill, ' ', 2) || ' ' || split_part(skill, ' ', 1) ELSE 'nothing alike' END AS name FROM e)"""
_SCORE = """CASE WHEN skill = name THEN 1.0 WHEN contains(name, skill) THEN 0.9 WHEN contains(skill, name) THEN 0.85 ELSE
    0.8 * len(list_intersect(list_distinct(string_split(skill, ' ')), list_distinct(string_split(name, ' ')))) / len(list_distinct(list_concat(string_split(skill, ' '), string_split(name, ' ')))) + 0.2 * least(length(skill), length(name)) / greatest(length(skill), length(name)) END"""


@query(
    f"""WITH {_FOUND}, o AS (SELECT skill, code, row_number() OVER (PARTITION BY skill ORDER BY priority DESC, occ_ord, code) AS rank FROM (SELECT DISTINCT skill, code, priority, occ_ord FROM n)),
    s AS (SELECT skill, code, name, elem_ord, rank, priority, ({_SCORE}) * CASE WHEN priority THEN 1.3 ELSE 1.0 END AS score FROM n JOIN o USING (skill, code)
      WHERE rank <= 8 AND NOT regexp_matches(name, '^manage') AND NOT regexp_matches(name, 'that has been')),
    b AS (SELECT skill, rank, bool_or(priority) AS priority, max(max(score)) OVER (PARTITION BY skill ORDER BY rank) AS best FROM s GROUP BY skill, rank),
    l AS (SELECT skill, min(rank) AS last FROM b WHERE priority AND best > 0.85 GROUP BY skill)
    SELECT skill, name, code, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.skill ORDER BY score DESC, rank, elem_ord) AS r FROM s LEFT JOIN l ON s.skill = l.skill WHERE rank <= coalesce(last, 8) AND score > 0.35) WHERE r = 1"""
)
def skill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best remote element for each skill: suppliers stand for occupations, their parts for skills."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("skill"))
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("code")).join(parts, "l_partkey").select("skill", "code").distinct()
    word = lambda k: F.split_part("skill", F.lit(" "), F.lit(k))
    kinds = (F.concat("skill", F.lit(" work")), F.concat(F.lit("general "), word(1)), F.concat(F.lit("that has been "), F.col("skill")), F.concat_ws(" ", word(2), word(1)), F.lit("nothing alike"))
    name = F.get(F.array(*kinds), (F.col("code") % 5).cast("int"))
    found = pairs.select("skill", "code", (F.col("code") % 7 == 0).alias("priority"), (F.col("code") * 31 % 101).alias("occ_ord"), F.posexplode(F.array(name, F.concat(F.lit("manage "), F.col("skill")))).alias("elem_ord", "name"))
    return skills.best_of_occupations(found).withColumn("score", F.round("score", 6))


STRATEGIES = ("auto", "ai_only", "ai_first", "traditional_only", "unknown")


@query(
    f"""WITH d AS (SELECT doc_id, text, source, {sql_pick(STRATEGIES, 'doc_id')} AS strategy, doc_id % 3 <> 0 AS available, doc_id % 4 = 1 AS failed FROM documents),
    w AS (SELECT *, doc_id % 2 = 0 AS well FROM d)
    SELECT doc_id, strategy, CASE WHEN coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') = '' THEN 'none' WHEN strategy = 'ai_only' THEN CASE WHEN available THEN 'ai' ELSE 'none' END
      WHEN strategy = 'auto' THEN CASE WHEN well OR NOT available THEN 'traditional' ELSE 'ai' END WHEN strategy = 'ai_first' AND available AND NOT failed THEN 'ai' ELSE 'traditional' END AS method,
    CAST(least(4096, greatest(2048, ceil(length(text) / 2))) AS BIGINT) AS budget FROM w"""
)
def parse_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document would be parsed under its strategy, and the output tokens to ask of the model."""
    key = F.col("doc_id")
    strategy = pick(STRATEGIES, key)
    method = parse_method(strategy, F.col("text"), key % 2 == 0, key % 3 != 0, key % 4 == 1)
    return table(spark, sf_dir, "documents").select("doc_id", strategy.alias("strategy"), method.alias("method"), token_budget(F.col("text")).cast("long").alias("budget"))


@query(
    f"""WITH {POSTINGS}, k AS (SELECT quality, doc_id FROM labels)
    SELECT id, doc_id IS NOT NULL AS matched, CASE WHEN doc_id IS NOT NULL THEN title END AS occupation, CASE WHEN quality = 1 THEN array_to_string(skills, ',') ELSE '' END AS recommended FROM postings LEFT JOIN k ON doc_id = id"""
)
def enriched_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with one struct of what a remote service knows of their occupation."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", F.lit(True).alias("known"))
    posts = postings(spark, sf_dir).select("id", "title", "skills").join(known, "id", "left")
    recommended = F.when(F.col("quality") == 1, F.col("skills")).otherwise(F.array().cast("array<string>"))
    enriched = posts.withColumn("onet", F.struct(F.coalesce("known", F.lit(False)).alias("matched"), F.when(F.col("known"), F.col("title")).alias("occupation"), recommended.alias("recommendedSkills")))
    return enriched.select("id", "onet.matched", "onet.occupation", F.array_join("onet.recommendedSkills", ",").alias("recommended"))


# ---- places ----

#: Places as people write them; each customer's key picks one.
WRITTEN = ("Houston", " london ", "Houston, Texas", "Aberdeen, United Kingdom", "Calgary, AB, Canada", "Global Recruiting", "Nowhere", "Perth, WA", "Dallas,TX", "A, B, C, D", "Paris, France", "")
_OPTIONS = f"""w AS (SELECT DISTINCT {sql_pick(WRITTEN, 'c_custkey')} AS raw FROM customer),
    v AS (SELECT CASE raw WHEN 'Houston' THEN 'Houston, TX' WHEN ' london ' THEN 'london, United Kingdom' WHEN 'Houston, Texas' THEN 'Houston, TX' WHEN 'Dallas,TX' THEN 'Dallas, TX' WHEN '' THEN NULL ELSE raw END AS value FROM w),
    p AS (SELECT DISTINCT value, string_split(value, ', ') AS parts FROM v WHERE value IS NOT NULL),
    o AS (SELECT value, CASE WHEN value = 'Global Recruiting' THEN 'Other' WHEN len(parts) = 1 THEN 'Unknown' WHEN len(parts) = 2 AND length(parts[2]) = 2 THEN 'United States' WHEN len(parts) = 2 THEN parts[2] WHEN len(parts) = 3 THEN parts[3] ELSE 'Other' END AS country, parts FROM p)"""


@query(
    f"""WITH {_OPTIONS} SELECT value, country, CASE WHEN len(parts) > 3 THEN value WHEN len(parts) = 1 THEN country || ': ' || value WHEN country = 'United States' THEN 'United States: ' || value
    WHEN len(parts) = 2 THEN country || ': ' || parts[1] ELSE country || ': ' || parts[1] || ', ' || parts[2] END AS label,
    lower(CASE WHEN len(parts) > 3 OR len(parts) = 1 THEN value WHEN country = 'United States' THEN country || ' ' || parts[1] || ' ' || parts[2] WHEN len(parts) = 2 THEN country || ' ' || parts[1] ELSE country || ' ' || parts[1] || ' ' || parts[2] END) AS search_text FROM o"""
)
def location_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "customer").select(pick(WRITTEN, F.col("c_custkey")).alias("raw")).distinct()
    values = written.select(loc.normalized(F.col("raw")).alias("value")).where("value is not null").distinct()
    return values.select(loc.filter_option(F.col("value")).alias("o")).select("o.value", "o.country", "o.label", "o.search_text")


@query(f"WITH {_OPTIONS} SELECT country, CASE country WHEN 'United States' THEN 0 WHEN 'Unknown' THEN 2 WHEN 'Other' THEN 3 ELSE 1 END AS rank, string_agg(value, ';' ORDER BY value) AS places FROM o GROUP BY country")
def location_options_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = location_options(spark, sf_dir).groupBy("country").agg(F.array_join(F.sort_array(F.collect_set("value")), ";").alias("places"))
    return grouped.select("country", loc.country_rank(F.col("country")).alias("rank"), "places").orderBy("rank", "country")


@query(f"WITH {POSTINGS}, {PLACES}, n AS (SELECT name, count(*) AS n FROM places GROUP BY name) SELECT DISTINCT p.name, n FROM (SELECT DISTINCT name FROM places UNION SELECT 'Nation ' || n_nationkey || ', Norway' FROM nation) p JOIN n USING (name)")
def location_option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active postings per option of a location list; options without any are dropped."""
    counts = Scratch(spark, "options").table(facets.place_counts(postings(spark, sf_dir)).groupBy("name").agg(F.sum("n").alias("n")), "counts", small=True)  # read twice
    more = table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"), F.lit(", Norway")).alias("name"))
    return counts.select("name").union(more).distinct().join(counts, "name")


_JOBS = f"place_of AS (SELECT o_orderkey AS id, list_extract({_SQL_CITIES}, CAST(o_custkey % {len(_CITIES)} AS INTEGER) + 1) AS place FROM orders)"


@query(
    f"""WITH {_JOBS}, n AS (SELECT place, count(*) AS n FROM place_of GROUP BY place)
    {" UNION ALL ".join(f"SELECT '{r.id}' AS region, count(*) AS places, CAST(sum(n) AS BIGINT) AS postings, CAST(count(*) FILTER (place IN ('Houston, TX', 'Aberdeen, United Kingdom', 'Denver, CO')) AS BIGINT) AS selected FROM n WHERE {_sql_belongs(r)} HAVING count(*) > 0" for r in REGIONS)}"""
)
def region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched places and postings of each region, and how many of the selected places it holds. Postings are counted per place first."""
    place = pick(_CITIES, F.col("o_custkey"))
    counts = table(spark, sf_dir, "orders").groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    tagged = counts.join(regions.members(counts, "place", regions.region_keys(spark)), "place")
    chosen = F.col("place").isin("Houston, TX", "Aberdeen, United Kingdom", "Denver, CO")
    return tagged.groupBy("region").agg(F.count("*").alias("places"), F.sum("n").alias("postings"), F.count_if(chosen).alias("selected"))


_KINDS = ("US", "CA", "BR", "SG", "GB", "NONE")


@query(
    f"""WITH g AS (SELECT c_custkey, {sql_pick(_KINDS, 'c_custkey')} AS cc, 'City ' || c_nationkey AS city, 'State ' || c_nationkey AS state, 'S' || c_nationkey AS short FROM customer)
    SELECT c_custkey, CASE WHEN cc = 'SG' THEN 'Singapore' WHEN cc = 'NONE' THEN NULL ELSE city END AS city,
    CASE cc WHEN 'US' THEN short WHEN 'CA' THEN short WHEN 'BR' THEN short END AS state_code, CASE WHEN cc IN ('SG', 'NONE') THEN NULL ELSE cc END AS country_code,
    CASE cc WHEN 'US' THEN city || ', ' || short WHEN 'CA' THEN city || ', ' || short || ', Canada' WHEN 'BR' THEN city || ', ' || state || ', Brazil' WHEN 'SG' THEN 'Singapore' WHEN 'GB' THEN city || ', United Kingdom' ELSE 'somewhere' END AS with_geodata,
    CASE cc WHEN 'US' THEN city || ', ' || short WHEN 'CA' THEN city || ', ' || short || ', Canada' WHEN 'BR' THEN city || ', ' || state || ', Brazil' WHEN 'GB' THEN city || ', ' || state || ', United Kingdom' ELSE 'raw ' || c_custkey END AS geocoded FROM g"""
)
def geocoder_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoders' JSON answers as flat records and the names made of them."""
    cc, n = pick(_KINDS, F.col("c_custkey")), F.col("c_nationkey").cast("string")
    names = F.create_map(*(F.lit(x) for x in ("US", "United States", "CA", "Canada", "BR", "Brazil", "GB", "United Kingdom")))
    region = F.struct(F.lit("region.1").alias("id"), F.when(cc == "SG", "Singapore region").otherwise(F.concat(F.lit("State "), n)).alias("text"), F.when(cc.isin("US", "CA", "BR"), F.concat(F.lower(cc), F.lit("-s"), n)).alias("short_code"))
    country = F.struct(F.lit("country.1").alias("id"), F.try_element_at(names, cc).alias("text"), F.lower(cc).alias("short_code"))
    context = F.when(cc == "NONE", F.array().cast("array<struct<id:string,text:string,short_code:string>>")).when(cc == "SG", F.array(region)).otherwise(F.array(region, country))
    feature = F.struct(F.lit("somewhere").alias("place_name"), F.when(cc == "SG", "Singapore").otherwise(F.concat(F.lit("City "), n)).alias("text"), F.array(F.when(cc == "NONE", "address").otherwise("place")).alias("place_type"), F.array(F.lit(1.5), F.lit(2.5)).alias("center"), context.alias("context"))
    geo = table(spark, sf_dir, "customer").select("c_custkey", loc.geocoded(F.to_json(feature)).alias("geo"))
    original = F.concat(F.lit("raw "), F.col("c_custkey").cast("string"))
    return geo.select("c_custkey", "geo.city", F.col("geo.stateCode").alias("state_code"), F.col("geo.countryCode").alias("country_code"), loc.with_states(F.col("geo"), original, True).alias("with_geodata"), loc.with_states(F.col("geo"), original).alias("geocoded"))


@query(
    f"""WITH {POSTINGS}, {PLACES}, r AS (SELECT DISTINCT raw, 'Nation ' || regexp_extract(raw, '([0-9]+)$', 1) AS city, name FROM places),
    g AS (SELECT raw, city, name, n_name, n_regionkey, raw LIKE 'GB-%' AND n_nationkey % 2 = 1 AS known FROM r LEFT JOIN nation ON raw LIKE '%NATION ' || n_nationkey)
    SELECT raw AS original, CASE WHEN known THEN n_name || ', United Kingdom' ELSE name END AS formatted, CASE WHEN known THEN n_name WHEN raw NOT LIKE 'NATION%' THEN city END AS city,
    CASE WHEN raw LIKE 'US-%' THEN 'Texas' WHEN known THEN 'State ' || n_regionkey END AS state, CASE WHEN raw LIKE 'US-%' THEN 'TX' WHEN raw LIKE 'CA-%' THEN 'AB' WHEN raw LIKE 'BR-%' THEN 'RJ' END AS state_code,
    CASE raw[1:3] WHEN 'US-' THEN 'United States' WHEN 'CA-' THEN 'Canada' WHEN 'BR-' THEN 'Brazil' WHEN 'GB-' THEN 'United Kingdom' WHEN 'AE-' THEN 'United Arab Emirates' ELSE 'Other' END AS country,
    CASE WHEN raw LIKE '__-%' THEN raw[1:2] END AS country_code, CASE WHEN known THEN n_regionkey + 0.5 END AS latitude, CASE WHEN known THEN 'geocoded' ELSE 'fallback' END AS source FROM g"""
)
def location_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each raw place: every second British one from a dictionary without countries' names, the others from the parser."""
    raws = exploded(postings(spark, sf_dir).where(is_active()).withColumn("raws", loc.lines(F.col("location"))), "raws", "raw").select("raw").distinct()
    none = F.lit(None).cast("string")
    point = F.struct(F.lit(1.0).alias("longitude"), (F.col("n_regionkey") + 0.5).alias("latitude"))
    state = F.concat(F.lit("State "), F.col("n_regionkey").cast("string"))
    geo = F.struct(F.col("n_name").alias("city"), state.alias("state"), none.alias("stateCode"), none.alias("country"), F.lit("GB").alias("countryCode"), point.alias("coordinates"))
    known = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("GB-NATION "), F.col("n_nationkey").cast("string")).alias("raw"), geo.alias("geo"))
    found = raws.join(known, "raw", "left").select(loc.metadata(F.col("raw"), F.col("geo")).alias("m"))
    return found.select("m.original", "m.formatted", "m.city", "m.state", "m.state_code", "m.country", "m.country_code", "m.latitude", "m.source")


@query(f"WITH {POSTINGS}, {PLACES} SELECT name, count(*) AS n FROM places WHERE name LIKE 'Nation %, TX' GROUP BY name")
def locations_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = facets.place_counts(postings(spark, sf_dir)).groupBy("name").agg(F.sum("n").alias("n"))
    return counts.where(loc.in_region(F.col("name"), "United States", "TX"))


@query(
    f"""WITH {POSTINGS}, {PLACES}, f AS (SELECT id, raw, name, count(*) OVER (PARTITION BY id) AS n FROM places QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1)
    SELECT id, CASE WHEN g.n_name IS NOT NULL THEN g.n_name || ', United Kingdom' ELSE name END || CASE WHEN n > 1 THEN ' +' || n - 1 || ' more' ELSE '' END AS place FROM f LEFT JOIN nation g ON raw = 'GB-NATION ' || g.n_nationkey"""
)
def location_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place shown for each active posting that has one: its first, by the dictionary where that has it, and the number of others."""
    scratch, cell = Scratch(spark, "display"), F.col("location")
    cells = postings(spark, sf_dir).where(is_active()).select("id", loc.lines(cell).alias("raws"), loc.named_lines(cell).alias("named")).where(F.size("raws") > 0)
    first = lambda c: F.get(c, F.lit(0))
    cells = scratch.table(cells.select("id", first("raws").alias("raw"), (F.size("raws") - 1).alias("more"), first("named").alias("first"), (F.size("named") - 1).alias("others")), "cells")
    names = scratch.table(facets.once_each(cells.where("first is not null"), "first").select("first", loc.formatted(F.col("first")).alias("name")), "names", small=True)
    none = F.lit(None).cast("string")
    geo = F.struct(F.col("n_name").alias("city"), none.alias("state"), none.alias("stateCode"), F.lit("United Kingdom").alias("country"), F.lit("GB").alias("countryCode"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("GB-NATION "), F.col("n_nationkey").cast("string")).alias("raw"), geo.alias("geo"))
    place = F.when(F.col("geo").isNotNull(), loc.shown(loc.from_geocode(F.col("geo")), F.col("more"))).otherwise(loc.shown(F.col("name"), F.col("others")))
    return cells.join(known, "raw", "left").join(names, "first", "left").select("id", place.alias("place"))


# ---- reports ----


@query(
    f"""WITH {POSTINGS}, m AS (SELECT count(*) AS total, count({_case('title', 0)}) AS matched FROM postings)
    SELECT total, matched, total - matched AS unmatched, (matched * 2000 + total) // (2 * total) // 10 || '.' || (matched * 2000 + total) // (2 * total) % 10 || '%' AS match_rate FROM m"""
)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings have a role by their title; each distinct title is matched once."""
    titles = role.match_titles(postings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("c")))
    return facets.match_rate(titles.select("match.role_id", "c"), "role_id", "c")


#: Parts of skills that make some of them invalid, by the order's key.
BLEMISHES = ("", "", " 5 years", "", " degree", " (any)", "", "")
_BLEMISHED = f"""s AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE list_transform(skills, lambda x: CASE WHEN id % 9 = 0 THEN 'Must ' ELSE '' END || x || {sql_pick(BLEMISHES, 'id')}) END AS skills FROM active),
    d AS (SELECT DISTINCT unnest(skills) AS skill FROM s), o AS (SELECT DISTINCT p_type || suffix AS skill FROM part, (VALUES (''), (' unused')) AS t(suffix))"""


@query(
    f"""WITH {POSTINGS}, {_BLEMISHED}
    SELECT 'years' AS "check", count(*) AS rows, count(*) FILTER (regexp_matches(skill, '(?i)\\d+\\s*(?:years?|yrs?)')) AS broken FROM d
    UNION ALL SELECT 'education', count(*), count(*) FILTER (regexp_matches(skill, '(?i)bachelor|degree|diploma|certification required')) FROM d
    UNION ALL SELECT 'parentheses', count(*), count(*) FILTER (regexp_matches(skill, '\\([^)]+\\)')) FROM d
    UNION ALL SELECT 'generic start', count(*), count(*) FILTER (regexp_matches(skill, '(?i)^(?:with|be|show|demonstrate|must|should|will|can)\\s')) FROM d
    UNION ALL SELECT 'options without postings', count(*), count(*) FILTER (skill NOT IN (SELECT skill FROM d)) FROM o
    UNION ALL SELECT 'postings without skills', count(*), count(*) FILTER (coalesce(len(skills), 0) = 0) FROM s"""
)
def skill_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality checks of the active postings' skills, some of which are blemished, and of a list of options."""
    key = F.col("id")
    blemished = F.transform("skills", lambda x: F.concat(F.when(key % 9 == 0, "Must ").otherwise(""), x, pick(BLEMISHES, key)))
    posts = postings(spark, sf_dir).select("id", "status", F.when(key % 5 != 0, blemished).alias("skills"))
    options = table(spark, sf_dir, "part").select("p_type").distinct().select(F.explode(F.array("p_type", F.concat("p_type", F.lit(" unused")))).alias("skill"))
    return facets.skill_checks(posts, "skills", options)


# ---- pages' words ----


@query(
    f"""WITH {POSTINGS}, c AS (SELECT region, list_sort(list(DISTINCT company)) AS companies, list_sort(list(DISTINCT employment_type)) AS types, count(*) AS n FROM active GROUP BY region)
    SELECT region, companies[1] || ', ' || companies[2] || ' - ' || types[1] || ', ' || types[2] || ' Jobs' AS title, n || ' jobs available at ' || companies[1] || ', ' || companies[2] || ', ' || companies[3] || ' in ' || types[1] || ', ' || types[2] || ', ' || types[3] AS description,
    CASE WHEN list_contains(types, '2-HIGH') THEN array_to_string(list_filter(types, lambda x: x <> '2-HIGH'), ';') ELSE array_to_string(list_append(types, '2-HIGH'), ';') END AS toggled, n * 0.01 AS cost FROM c"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions of list pages from the chosen values, a choice switched on or off, and the cost of that many remote calls."""
    active = postings(spark, sf_dir).where(is_active())
    rows = active.groupBy("region").agg(F.sort_array(F.collect_set("company")).alias("companies"), F.sort_array(F.collect_set("employment_type")).alias("types"), F.count("*").alias("n"))
    return rows.select("region", facets.page_title(F.col("companies"), F.col("types")).alias("title"), facets.page_description(F.col("n"), F.col("companies"), F.col("types")).alias("description"), F.array_join(facets.toggled(F.col("types"), "2-HIGH"), ";").alias("toggled"), (F.col("n") * 0.01).alias("cost"))
