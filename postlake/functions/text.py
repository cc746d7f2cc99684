"""Text, date and number functions as Column expressions. NULL in gives NULL out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The words that make a line a section header.
SECTION_HEADERS = (
    "responsibilities", "qualifications", "requirements", "desired characteristics", "essential responsibilities", "key responsibilities", "required skills",
    "preferred skills", "what you will do", "what we offer", "about the role", "about you", "working with us", "working for you", "partner with the best",
    "fuel your passion", "work in a way that works for you", "benefits", "compensation", "education", "experience", "skills", "key changes",
    "implementation details", "testing", "summary", "duties", "job description",
)
# Style of a section by parts of its title; the first that fits wins.
SECTION_STYLES = (
    ("responsibilities", ("responsibilit", "duties")),
    ("requirements", ("requirement", "must have")),
    ("qualifications", ("qualification", "education", "experience")),
    ("benefits", ("benefit", "we offer", "perks")),
    ("compensation", ("compensation", "salary", "pay")),
)
NON_LATIN = "[\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0E00}-\\x{0E7F}\\x{3000}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{0900}-\\x{097F}\\x{1100}-\\x{11FF}]"
ACCENTED = "[\\x{00C0}-\\x{024F}]"
HTML = "(?is)</?[a-z].*>"
BULLET = r"^(?:[•\-*▪]|o |[0-9]+\.)"


def trim(c: Column) -> Column:
    """Strips all white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def or_default(c: Column, value) -> Column:
    """An empty string counts as missing."""
    return F.coalesce(F.nullif(c, F.lit("")), value if isinstance(value, Column) else F.lit(value))


def split_compact(c: Column, separator: str = ";") -> Column:
    """A list cell as an array: split, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(c, separator), trim), lambda x: x != "")


def surrogate_key(*parts: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("-", *parts), "[^a-zA-Z0-9-]", "-"))


def url_key(url: Column) -> Column:
    return F.substring(surrogate_key(url), 1, 100)


def company_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "-"), "[^a-z0-9-]", "")


def slug_to_company(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def _slug_part(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(company_slug(trim(c)), "-+", "-"), "^-|-$", "")


def posting_slug(company: Column, title: Column) -> Column:
    """Empty if either part is missing or empty; the title's part is cut to 100 characters."""
    missing = (or_default(company, "") == "") | (or_default(title, "") == "")
    return F.when(missing, "").otherwise(F.concat(_slug_part(company), F.lit("-"), F.substring(_slug_part(title), 1, 100)))


def preview(c: Column, length: int = 150) -> Column:
    """One line of plain text, cut with three dots."""
    plain = trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(plain) > length, F.concat(F.substring(plain, 1, length), F.lit("..."))).otherwise(plain)


def format_date(c: Column) -> Column:
    """``Jan 5, 2024``; text that is no date gives ``Invalid Date``."""
    return F.when(or_default(c.cast("string"), "") == "", None).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(c.cast("string")), "MMM d, yyyy"), F.lit("Invalid Date")))


def time_ago(c: Column, now: Column) -> Column:
    """By whole elapsed days, not by calendar days."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(c)) / F.lit(86_400_000_000))
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "1 day ago")
        .when(days < 7, text(days, "days"))
        .when(days < 30, text(F.floor(days / 7), "weeks"))
        .when(days < 365, text(F.floor(days / 30), "months"))
        .otherwise(text(F.floor(days / 365), "years"))
    )


def non_english(c: Column) -> Column:
    """A script other than Latin, or more than 3 % of accented letters."""
    return F.coalesce(c.rlike(NON_LATIN) | (F.regexp_count(c, F.lit(ACCENTED)) / F.greatest(F.length(c), F.lit(1)) > 0.03), F.lit(False))


def well_formatted(c: Column) -> Column:
    """False for missing or empty text and for more than three blank lines in a row."""
    runs = F.aggregate(
        F.transform(F.split(c, "\n"), lambda x: trim(x) == ""),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda s, blank: F.struct(F.when(blank, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["most"], F.when(blank, s["run"] + 1).otherwise(0)).alias("most")),
        lambda s: s["most"],
    )
    return F.coalesce(F.when(c != "", runs <= 3), F.lit(False))


def contains_html(c: Column) -> Column:
    return F.coalesce(c.rlike(HTML), F.lit(False))


def break_blocks(c: Column) -> Column:
    """Line breaks where HTML has them."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), "(?i)</(p|div|h[1-6]|li|ul|ol|section|article|header|footer|tr)>", "\n")


def strip_tags(c: Column) -> Column:
    """Text of simple markup: tags go, the five basic references are decoded, lines are trimmed, blank ones dropped."""
    text = F.regexp_replace(c, "<[^>]*>", "")
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(by))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != ""), "\n")


def clean_text(c: Column) -> Column:
    """Plain text of a description that may hold HTML."""
    return F.when(contains_html(c), strip_tags(break_blocks(c))).otherwise(c)


def escape_html(c: Column) -> Column:
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(sign), F.lit(by))
    return c


def is_section_header(line: Column) -> Column:
    """A line that ends in a colon, or is short and in capitals, and holds a known header."""
    t = trim(line)
    low = F.lower(t)
    body = F.when(low.endswith(":"), F.regexp_replace(low, ":$", "")).when((F.length(t) < 50) & (t == F.upper(t)), low)
    return F.coalesce(body.rlike("|".join(SECTION_HEADERS)), F.lit(False))


def is_bullet(line: Column) -> Column:
    return trim(line).rlike(BULLET)


def clean_bullet(line: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(trim(line), r"^[•\-*▪o]\s*", ""), r"^[0-9]+\.\s*", ""))


def clean_header(line: Column) -> Column:
    return F.array_join(F.transform(F.split(F.regexp_replace(trim(line), ":$", ""), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def section_style(title: Column) -> Column:
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.when(F.lit(False), "default")
    for style, parts in SECTION_STYLES:
        out = out.when(reduce(lambda a, b: a | b, (low.contains(p) for p in parts)), style)
    return out.otherwise("default")


def token_budget(c: Column) -> Column:
    """Output tokens to ask of a remote model for a text."""
    return F.least(F.lit(4096), F.greatest(F.lit(2048), F.ceil(F.length(c) / 2)))


def parse_method(strategy: Column, text: Column, well: Column, available: Column, failed: Column) -> Column:
    """How a description is parsed: by rules (traditional), by a remote model (ai), or not at all (none).

    ``auto`` asks the model only for badly formatted texts, ``ai_only`` never falls back, ``ai_first`` falls back to rules if the model isn't there or fails.
    """
    model = F.when(available, "ai")
    return (
        F.when(F.coalesce(trim(text), F.lit("")) == "", "none")
        .when(strategy == "ai_only", F.coalesce(model, F.lit("none")))
        .when(strategy == "auto", F.when(well, "traditional").otherwise(F.coalesce(model, F.lit("traditional"))))
        .when((strategy == "ai_first") & available & ~failed, "ai")
        .otherwise("traditional")
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``12.5%`` of two whole numbers, exact and with halves rounded up; no rows give ``NaN%``."""
    unit = 10**digits
    scaled = F.call_function("div", part * (200 * unit) + whole, whole * 2)
    text = F.concat(F.call_function("div", scaled, F.lit(unit)).cast("string"), F.lit("." if digits else ""), F.lpad((scaled % unit).cast("string"), digits, "0"), F.lit("%"))
    return F.when(whole == 0, "NaN%").otherwise(text)


def word(pattern: str) -> str:
    """A pattern between word boundaries as ASCII text has them; use it on ``neutral`` text."""
    return rf"(?i)\b(?:{pattern})\b"


def neutral(c: Column) -> Column:
    """Letters outside ASCII become a sign that is no word character, so boundaries are the same in all dialects."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "§")
