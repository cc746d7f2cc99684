"""Functions on texts, skills, places, dates and JSON, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions import location as loc, skill, text as tx
from postlake.functions.markup import strip_html
from postlake.operators import blocks
from postlake.operators.facets import exploded
from postlake.plans.postings import POSTINGS, pick, postings, sql_pick
from postlake.sources.providers import json_of_answer, sections_of_answer, sections_text
from postlake.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Raw skills are made of the parts' names, with words around them that the functions must deal with.
BEFORE = ("Strong ", "", "Proven ", "Technical ", "Our ", "Lead ", "The ", "5 years ")
AFTER = (" Skills", " and Analysis", " Management", " or Welding Experience", "", " Certifications", " that has been made", " (basic)", ":", " Operations")
CORE = ("Financial", "Small Ring", "Pipe Inspections", "Mechanical Design", "Written", "Communications", "Safety", "Critical Thinking", "Welding", "Career Path", "Managing Projects", "NDT")


def raw_skill() -> Column:
    return F.concat(pick(BEFORE, F.col("p_partkey")), pick(CORE, F.floor(F.col("p_partkey") / 8)), pick(AFTER, F.col("p_size")))


_RAW = f"{sql_pick(BEFORE, 'p_partkey')} || {sql_pick(CORE, 'p_partkey // 8')} || {sql_pick(AFTER, 'p_size')}"


def _list(values) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + ")"


def _has(column: str, values) -> str:
    return " OR ".join(f"contains({column}, '{x}')" for x in values)


def _title(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


_NOUN = "CASE lower(w) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in skill.NOUNS.items()) + " ELSE w END"
_EXPAND = "CASE lower(s) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in skill.EXPANSIONS.items()) + " ELSE s END"
_ONE = f"CASE WHEN lower(w) IN {_list(skill.FIELD_NAMES)} THEN w WHEN w LIKE '%ications' OR (w LIKE '%ions' AND w NOT LIKE '%sions') THEN w[1:-2] ELSE w END"
_NORMALIZE = rf"""
v AS (SELECT p_partkey, {_RAW} AS raw FROM part),
a AS (SELECT *, lower(raw) AS low, trim(regexp_replace(regexp_replace(raw, '(?i)\b(?:{"|".join(skill.ADJECTIVES)})\b', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM v),
b AS (SELECT p_partkey, raw, array_to_string(list_filter(list_transform(string_split(s, ' '), lambda w: {_NOUN}), lambda w: w <> ''), ' ') AS s,
  NOT regexp_matches(raw, '^[a-zA-Z]') OR contains(raw, ',') OR regexp_matches(raw, '(?i)\b\d+\+?\s*(years?|yrs?|months?)\b') OR regexp_matches(raw, '[()]') OR regexp_matches(raw, '(?i)\b(our|we|us)\b') OR {_has("low", skill.RECRUITMENT)} AS bad FROM a),
c AS (SELECT p_partkey, raw, bad, trim(regexp_replace(trim(regexp_replace(s, '(?i)\s+(skills?|abilities|ability)$', '')), '(?i)^understanding\s+', '')) AS s FROM b),
d AS (SELECT p_partkey, raw, bad, {_EXPAND} AS s FROM c),
e AS (SELECT p_partkey, raw, bad OR lower(s) = 'understanding' OR split_part(lower(s), ' ', 1) IN {_list(skill.ACTION_VERBS)} OR regexp_matches(s, '(?i)that (has|have|had) been') OR regexp_matches(s, '(?i)^(the )?ability to') OR regexp_matches(s, '(?i)^(with|for) the\b') AS bad,
  trim(regexp_replace(regexp_replace(s, '(?i)^(and|or|with|the|a|an|of)\s+', ''), '(?i)\s+(and|or|with|the|a|an|of)$', '')) AS s FROM d),
f AS (SELECT p_partkey, raw, bad OR length(s) < 2 AS bad, array_to_string(list_transform(string_split(s, ' '), lambda w: {_ONE}), ' ') AS s FROM e),
g AS (SELECT *, lower(s) AS low, list_filter(string_split_regex(s, '\s+'), lambda w: length(w) >= 3 AND lower(w) NOT IN {_list(skill.FILLERS)}) AS m, string_split_regex(lower(s), '\s+') AS ws FROM f),
h AS (SELECT p_partkey, raw, CASE WHEN bad OR low IN {_list(skill.TOO_GENERIC)} OR len(m) < 1 OR (len(m) = 1 AND (length(m[1]) < 4 OR lower(m[1]) IN {_list(skill.VAGUE)}))
  OR regexp_matches(s, '(?i)\b(diploma|degree|certification|license|certified|licensed)\b') OR regexp_matches(s, '(?i)\s+(I{{1,3}}V?|VI{{1,3}}|Iv)$')
  OR (regexp_matches(s, '(?i)\b(system|software|tool|platform)\b') AND len(ws) = 2 AND regexp_full_match(split_part(s, ' ', 1), '[A-Z][a-z]*')) OR {_has("low", skill.ARTIFACTS)}
  OR regexp_matches(s, '(?i)^[a-z]-') OR (s LIKE '%)' AND NOT contains(s, '(')) OR (len(m) = 1 AND low IN {_list(skill.VAGUE_ALONE)}) OR regexp_matches(s, '(?i)^to\s+')
  OR regexp_matches(s, '(?i)\b(interact|work|communicate|collaborate|interface|react)\s+(with|across)\b') OR regexp_matches(s, '(?i)^(continuously|constantly|regularly|routinely)\s+')
  OR (len(ws) = 2 AND (ws[1] IN ('just', 'only', 'some') OR (ws[2] = 'thinking' AND ws[1] NOT IN {_list(skill.THINKING)}) OR ws[2] IN ('programs', 'values')))
  THEN NULL ELSE {_title("low")} END AS skill FROM g)"""


@query(f"WITH {_NORMALIZE} SELECT p_partkey, raw, skill FROM h")
def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", raw_skill().alias("raw")).withColumn("skill", skill.normalize(F.col("raw")))


@query(
    rf"""WITH v AS (SELECT p_partkey, {_RAW} AS t FROM part), a AS (SELECT *, lower(t) AS low, string_split_regex(lower(trim(t)), '\s+') AS ws, string_split_regex(trim(t), '\s+') AS cs FROM v)
    SELECT p_partkey, NOT (NOT regexp_matches(t, '^[a-zA-Z]') OR len(ws) > 4 OR length(t) > 50 OR length(t) < 2 OR regexp_matches(t, '[:.!?]$') OR regexp_matches(t, '\$|USD|EUR|GBP|\d+k|\d{{3,}}')
      OR low IN {_list(skill.BLACKLIST)} OR {" OR ".join(f"contains(low, '{x.replace(chr(39), chr(39) * 2)}') OR contains('{x.replace(chr(39), chr(39) * 2)}', low)" for x in skill.BLACKLIST if " " in x)}
      OR regexp_matches(t, '(?i)\b(that|which|who|whom|whose)\b') OR (regexp_matches(t, '(?i)^[A-Z][a-z]+ing\b') AND ws[1] NOT IN {_list(skill.GERUNDS)}) OR ws[1] IN {_list(skill.IMPERATIVES)}
      OR (ws[1] IN {_list(skill.VAGUE_NOUNS)} AND len(ws) > 1) OR regexp_matches(t, '(?i)degree|years? of experience|years? experience|clearance|certification required|elected|voluntary')
      OR regexp_matches(t, '(?i)\b(internships?|work experience|up to\s+\d+|one year|two years|three years)\b') OR regexp_matches(t, '(?i)travel \d+|us citizen|citizenship required|general hours|flexible hours|willing to travel')
      OR regexp_matches(t, '\d+%') OR regexp_matches(t, '(?i)^this (role|position|job|opportunity)') OR ws[1] IN {_list(skill.STARTERS)}
      OR (len(ws) > 2 AND len(list_filter(ws, lambda w: w IN {_list(skill.FILLERS)})) / len(ws) > 0.3)
      OR {" + ".join(f"CAST(contains(low, '{x}') AS INTEGER)" for x in skill.SENTENCE_WORDS)} >= 2
      OR (len(list_filter(cs, lambda w: regexp_matches(w, '^[A-Z]'))) >= 4 AND len(list_filter(cs, lambda w: regexp_matches(w, '^[A-Z]'))) = len(ws))) AS valid FROM a"""
)
def skill_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", skill.is_valid(raw_skill()).alias("valid"))


@query(
    rf"""WITH v AS (SELECT p_partkey, {_RAW} AS t FROM part), a AS (SELECT p_partkey, t, string_split_regex(t, '(?i)\s+(?:and|&|or)\s+') AS ps FROM v),
    b AS (SELECT *, regexp_extract(ps[-1], '(?i)\b(skills?|experience|knowledge|ability|abilities|engineering|management|analysis)\b', 1) AS x FROM a)
    SELECT p_partkey, CASE WHEN len(ps) = 1 THEN t WHEN x <> '' THEN array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = len(ps) OR regexp_matches(p, '(?i)\b(skills?|experience|knowledge|ability|abilities|engineering|management|analysis)\b') THEN trim(p) ELSE trim(p) || ' ' || x END), ';')
      ELSE array_to_string(list_transform(ps, lambda p: trim(p)), ';') END AS parts FROM b"""
)
def skill_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(skill.split_compound(raw_skill()), ";").alias("parts"))


@query(
    f"""WITH {_NORMALIZE}, j AS (SELECT h.*, p_brand FROM h JOIN part USING (p_partkey))
    SELECT p_brand, count(*) AS before, count(skill) AS after, count(DISTINCT skill) AS distinct_after, ((count(*) - count(skill)) * 2000 + count(*)) // (2 * count(*)) // 10 || '.' || ((count(*) - count(skill)) * 2000 + count(*)) // (2 * count(*)) % 10 || '%' AS filtered FROM j GROUP BY p_brand"""
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = table(spark, sf_dir, "part").select("p_brand", skill.normalize(raw_skill()).alias("skill"))
    # counted per skill first, so that distinct skills need no second shuffle of rows
    per = cleaned.groupBy("p_brand", "skill").agg(F.count("*").alias("n"))
    sums = per.groupBy("p_brand").agg(F.sum("n").alias("before"), F.sum(F.when(F.col("skill").isNotNull(), F.col("n")).otherwise(0)).alias("after"), F.count("skill").alias("distinct_after"))
    return sums.withColumn("filtered", tx.percent(F.col("before") - F.col("after"), F.col("before")))


@query(
    f"""WITH {POSTINGS}, m AS (SELECT id, skills, list_filter(['promo', lower(company), 'SMALL', company, title], lambda x: NOT list_contains(list_transform(skills, lambda s: lower(s)), lower(x))) AS more FROM postings)
    SELECT id, array_to_string(list_concat(skills, list_filter(more, lambda x, i: list_position(list_transform(more, lambda y: lower(y)), lower(x)) = i)), ',') AS merged FROM m"""
)
def skills_merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.array(F.lit("promo"), F.lower("company"), F.lit("SMALL"), F.col("company"), F.col("title"))
    return postings(spark, sf_dir).select("id", F.array_join(skill.merge_ordered(F.col("skills"), more), ",").alias("merged"))


@query(
    """WITH c AS (SELECT c_custkey, c_mktsegment AS s, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS t FROM customer)
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN t || ', TX' WHEN 1 THEN t || ', United Arab Emirates' WHEN 2 THEN t || ', TX' WHEN 3 THEN t || ', TX' WHEN 4 THEN t WHEN 5 THEN 'Texas' ELSE t || ', AB, Canada' END AS name,
    CASE c_custkey % 7 WHEN 1 THEN 'AE' WHEN 4 THEN NULL WHEN 6 THEN 'CA' ELSE 'US' END AS country_code, c_custkey % 7 <> 4 AS parsed FROM c"""
)
def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit("US-TX-"), s, F.lit("-12 RANKIN ROAD")))
        .when(k == 1, F.concat(F.lit("locations AE-"), s, F.lit("-TOWER, ROAD")))
        .when(k == 2, F.concat(s, F.lit(", TX")))
        .when(k == 3, F.concat(F.lower(s), F.lit(", Texas")))
        .when(k == 4, s)
        .when(k == 5, "US-TX-OTHER TEXAS")
        .otherwise(F.concat(F.lit("CA-AB-"), s, F.lit(" (north)")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", loc.parse(raw).alias("p")).select("c_custkey", F.col("p.formatted").alias("name"), F.col("p.country_code").alias("country_code"), F.col("p.parsed").alias("parsed"))


@query("SELECT 'page' AS kind, page_id AS id, coalesce(regexp_matches(html, '(?is)</?[a-z].*>'), false) AS has_html FROM pages UNION ALL SELECT 'document', doc_id, coalesce(regexp_matches(text, '(?is)</?[a-z].*>'), false) FROM documents")
def html_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), tx.contains_html(F.col("html")).alias("has_html"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), tx.contains_html(F.col("text")).alias("has_html")))


_DECODE = "x"  # nested replacements of the basic references
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _DECODE = f"replace({_DECODE}, '{_a}', '{_b}')"


@query(
    rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|h[1-6]|li|ul|ol|section|article|header|footer|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM pages),
    d AS (SELECT page_id, {_DECODE} AS x FROM b)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) AS plain FROM d"""
)
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_text(F.col("html")).alias("plain"))


#: All references that the pages hold. Older names also count without a semicolon (a title cut to a length ends with ``&amp``); the ampersand comes last, so that nothing is decoded twice.
_DECODE_BODY = "x"
for _name, _b in (("copy", "©"), ("middot", "·"), ("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
    _DECODE_BODY = f"regexp_replace({_DECODE_BODY}, '&{_name};?', '{_b}', 'g')"
for _a, _b in (("&rsquo;", "’"), ("&mdash;", "—"), ("&hellip;", "…"), ("&#39;", "''")):
    _DECODE_BODY = f"replace({_DECODE_BODY}, '{_a}', '{_b}')"
_DECODE_BODY = f"regexp_replace({_DECODE_BODY}, '&amp;?', '&', 'g')"


@query(
    rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|h[1-6]|li|ul|ol|section|article|header|footer|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM pages),
    d AS (SELECT page_id, {_DECODE_BODY} AS x FROM b)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l, chr(160) || chr(32) || chr(9) || chr(13))), lambda l: l <> ''), chr(10)) AS plain FROM d"""
)
def page_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of whole pages by the rules of HTML: without the head, with all character references."""
    return table(spark, sf_dir, "pages").select("page_id", strip_html(tx.break_blocks(F.col("html"))).alias("plain"))


# Documents get headers, bullets and blank lines, to be taken apart again.
def _styled() -> Column:
    body = F.replace(F.replace(F.col("text"), F.lit("\nThe"), F.lit("\n\n- The")), F.lit("\nAn"), F.lit("\n* An"))
    return F.concat(F.lit("JOB SUMMARY\n"), body, F.lit("\nWhat you will do:\n1. end"))


_HEADERS = "|".join(tx.SECTION_HEADERS)


@query(
    rf"""WITH t AS (SELECT doc_id, string_split('JOB SUMMARY' || chr(10) || replace(replace(text, chr(10) || 'The', chr(10) || chr(10) || '- The'), chr(10) || 'An', chr(10) || '* An') || chr(10) || 'What you will do:' || chr(10) || '1. end', chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS line FROM t),
    k AS (SELECT *, CASE WHEN line = '' THEN 'blank'
      WHEN (line LIKE '%:' AND regexp_matches(lower(line), '{_HEADERS}')) OR (line NOT LIKE '%:' AND line = upper(line) AND length(line) < 50 AND regexp_matches(lower(line), '{_HEADERS}')) THEN 'header'
      WHEN regexp_matches(line, '^([•\-*▪]|o |[0-9]+\.)') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
    p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM k),
    f AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS last FROM p WHERE kind <> 'blank'),
    b AS (SELECT *, sum(CASE WHEN kind = 'header' OR last IS NULL OR last <> kind OR (kind = 'list' AND before = 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block_no,
      CASE kind WHEN 'list' THEN trim(regexp_replace(regexp_replace(line, '^[•\-*▪o]\s*', ''), '^[0-9]+\.\s*', '')) WHEN 'header' THEN array_to_string(list_transform(string_split(regexp_replace(line, ':$', ''), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE line END AS c FROM f)
    SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, kind AS type, CASE WHEN kind <> 'list' THEN string_agg(c, ' ' ORDER BY n) END AS content, CASE WHEN kind = 'list' THEN string_agg(c, '|' ORDER BY n) END AS items FROM b GROUP BY doc_id, block_no, kind"""
)
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.text_blocks(table(spark, sf_dir, "documents").select("doc_id", _styled().alias("text")), "doc_id", "text")
    return out.withColumn("items", F.when(F.col("items").isNotNull(), F.array_join("items", "|")))


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), repeat(chr(10), 5)) ELSE replace(text, chr(10), repeat(chr(10), 3)) END AS text FROM documents)
    SELECT doc_id, coalesce(text, '') <> '' AND NOT contains(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '1' ELSE '0' END), ''), '1111') AS well FROM t"""
)
def well_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.replace(F.col("text"), F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "\n" * 5).otherwise("\n" * 3))
    return table(spark, sf_dir, "documents").select("doc_id", tx.well_formatted(spaced).alias("well"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 150 THEN t[1:150] || '...' ELSE t END AS preview FROM t"""
)
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(
    r"""SELECT doc_id, regexp_matches(text, '[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0900}-\x{097F}\x{1100}-\x{11FF}]')
      OR (length(text) - length(regexp_replace(text, '[\x{00C0}-\x{024F}]', '', 'g'))) / greatest(length(text), 1) > 0.03 AS foreign_text FROM documents"""
)
def non_english_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.non_english(F.col("text")).alias("foreign_text"))


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH d AS (SELECT o_orderkey, floor(epoch_us(TIMESTAMP '2001-12-31 23:00:00' - o_orderdate) / 86400000000) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN '1 day ago' WHEN d < 7 THEN CAST(d AS BIGINT) || ' days ago' WHEN d < 30 THEN CAST(floor(d / 7) AS BIGINT) || ' weeks ago'
      WHEN d < 365 THEN CAST(floor(d / 30) AS BIGINT) || ' months ago' ELSE CAST(floor(d / 365) AS BIGINT) || ' years ago' END AS ago FROM d"""
)
def time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.time_ago(F.col("o_orderdate").cast("timestamp"), F.lit("2001-12-31 23:00:00").cast("timestamp")).alias("ago"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Invalid Date' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS shown FROM orders")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.format_date(given).alias("shown"))


# Answers as a model might give them, made of the events: fenced, with one good section and one that may be broken.
def _answer() -> Column:
    kind = pick(("paragraph", "list", "table"), F.col("event_id"))
    content = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('[\\"'), F.col("event_type"), F.lit('\\",\\"b\\"]'))).otherwise(F.col("event_type"))
    return F.concat(F.lit('Here it is:\n```json\n{"sections": [{"title": "A", "type": "paragraph", "content": "first"}, {"title": "B", "type": "'), kind, F.lit('", "content": "'), content, F.lit('"}]}\n```'))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'first' || chr(10) || event_type WHEN 1 THEN 'first' || chr(10) || event_type || chr(10) || 'b' ELSE 'first' END AS plain FROM events")
def json_sections_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sections_text(sections_of_answer(_answer())).alias("plain"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 2 END AS n_valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object(json_of_answer(F.col("props")), "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.size(sections_of_answer(_answer())).alias("n_valid"), k.alias("k"))


TITLES = ("Key Responsibilities", "Must have", "Education", "What we offer", "Salary range", "About us", "Duties and pay", "")


@query(
    f"""WITH t AS (SELECT p_partkey, lower({sql_pick(TITLES, 'p_partkey')}) AS t FROM part)
    SELECT p_partkey, CASE {" ".join(f"WHEN {_has('t', parts)} THEN '{style}'" for style, parts in tx.SECTION_STYLES)} ELSE 'default' END AS style FROM t"""
)
def section_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.section_style(pick(TITLES, F.col("p_partkey"))).alias("style"))


@query("SELECT page_id, lower(regexp_replace('web-' || url, '[^a-zA-Z0-9-]', '-', 'g')) AS key, lower(regexp_replace(url, '[^a-zA-Z0-9-]', '-', 'g'))[1:100] AS short_key FROM pages")
def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.surrogate_key(F.lit("web"), F.col("url")).alias("key"), tx.url_key(F.col("url")).alias("short_key"))


@query(
    r"""SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS n,
      array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ';') AS parts FROM documents"""
)
def split_trim_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.split_compact(F.col("text"), ",").alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", ";").alias("parts"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.escape_html(F.col("html")).alias("escaped"))


@query(f"WITH {POSTINGS} SELECT id, CASE WHEN len(skills) > 3 THEN array_to_string(skills[1:3], ',') || ' +' || (len(skills) - 3) || ' more' ELSE array_to_string(skills, ',') END AS shown FROM postings")
def skill_pills(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("skills")
    first = F.array_join(F.slice(s, 1, 3), ",")
    return postings(spark, sf_dir).select("id", F.when(F.size(s) > 3, F.concat(first, F.lit(" +"), (F.size(s) - 3).cast("string"), F.lit(" more"))).otherwise(first).alias("shown"))


@query(f"WITH {POSTINGS} SELECT s AS skill, s || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' job)' ELSE ' jobs)' END AS label FROM (SELECT unnest(skills) AS s FROM active) GROUP BY s")
def option_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = exploded(postings(spark, sf_dir).where("coalesce(status, '') not in ('removed', 'paused')"), "skills", "skill").groupBy("skill").agg(F.count("*").alias("n"))
    return n.select("skill", F.concat(F.col("skill"), F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " job)").otherwise(" jobs)")).alias("label"))
