"""The queries of the numbered operators, each over its whole table, and their SQL statements where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.llm.decontamination import find_leaks
from postlake.llm.html_text import extract_text
from postlake.llm.language_model import language_scores
from postlake.llm.license_scan import scan_licenses
from postlake.llm.line_dedup import dedupe_lines
from postlake.llm.mixing import mix_rates
from postlake.llm.near_duplicates import near_duplicates
from postlake.llm.quality_classifier import quality_scores
from postlake.llm.quality_rules import base_failed, quality_rules, text_counts
from postlake.llm.source_divergence import source_divergence
from postlake.llm.url_filter import BLOCKED, LOWER, RULES, UPPER, judge_urls
from postlake.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from postlake.llm.warc import archived_pages
from postlake.sources.tables import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "removed", F.size("removed").alias("n_removed"), "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's rules read of each text, and its first test."""
    counts = text_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_decontamination, op3_language_model, op4_near_duplicates, op5_line_dedup, op6_mixing, op7_quality_classifier, op8_quality_rules, op9_license_scan, op10_warc, op11_url_filter, op12_source_divergence, op13_vector_codes, rule_counts)
}


def _glob_sql(glob: str) -> str:
    stars = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?s)^" + re.sub(r"\*\*|\*|\?|[^*?]+", lambda m: stars.get(m[0]) or re.escape(m[0]), glob) + "$"


def _codes_sql() -> str:
    """Rounds written out: assignments a0 .. and codebooks c0 .. in turn."""
    nearest = """a{k} AS (SELECT rid, part, w, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
          SELECT rid, p.part, w, entry, list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))) AS d FROM p JOIN c{k} ON c{k}.part = p.part) GROUP BY rid, part, w)"""
    moved = """m{k} AS (SELECT part, entry, list(floor_div ORDER BY i) AS c FROM (SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (
          SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM (SELECT part, entry, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM a{k}) GROUP BY part, entry, i)) GROUP BY part, entry),
        c{n} AS (SELECT c{k}.part, c{k}.entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.part = c{k}.part AND m{k}.entry = c{k}.entry)"""
    rounds = ",\n        ".join(f"{nearest.format(k=k)},\n        {moved.format(k=k, n=k + 1)}" for k in range(ROUNDS))
    return f"""
        WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT rid, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS w FROM k, (SELECT unnest(range({PARTS})) AS part)),
        c0 AS (SELECT part, rid - 1 AS entry, w AS c FROM p WHERE rid <= {ENTRIES}),
        {rounds},
        {nearest.format(k=ROUNDS)},
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM c{ROUNDS}),
        e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256, label FROM e JOIN k USING (rid), h"""


ORACLE_SQL: dict[str, str] = {
    "op4_near_duplicates": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
        both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, both_ways.b FROM r JOIN both_ways ON r.y = both_ways.a)
        SELECT doc_id, len(sh) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) ON x = doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        h AS (SELECT d, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN head <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head <> p.page_id THEN head END AS refers_to
        FROM p LEFT JOIN h ON p.d = h.d""",
    "rule_counts": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
        c AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
          FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "op11_url_filter": f"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, RULES))}),
        f AS (SELECT page_id, arg_max((rule_host || rule_path, verdict), length(rule_host || rule_path)) AS best FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN {" OR ".join(f"regexp_matches('.' || host || path, '{_glob_sql(g)}')" for g in BLOCKED)} THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN f USING (page_id)""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
        v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
        vs AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY ALL),
        full_ AS (SELECT g.lang, g.source, v.term, coalesce(n.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
        p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (CAST(1000000000 AS HUGEINT) * (f.n + 5)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 5 * vs.v) AS p FROM full_ f JOIN vs ON vs.lang = f.lang),
        l AS (SELECT lang, term, sum(n) AS n FROM full_ GROUP BY lang, term),
        q AS (SELECT l.lang, l.term, 1 + (CAST(1000000000 AS HUGEINT) * (l.n + 5)) // (sum(l.n) OVER (PARTITION BY l.lang) + 5 * vs.v) AS q FROM l JOIN vs ON vs.lang = l.lang),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
          SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        tops AS (SELECT p.lang, p.source, p.term AS item, p - q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p > q),
        both_ AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM tops)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_) WHERE part = 'pair' OR rank <= 50""",
    "op13_vector_codes": _codes_sql(),
}
