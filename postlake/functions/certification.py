"""Certifications named in texts. The tables are fixed values; patterns are written once for ASCII word boundaries."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions.location import once
from postlake.functions.text import neutral, trim, word

# Name, category, alternatives. Each alternative begins at a word's edge, which ``pattern`` adds.
CERTIFICATIONS = (
    ("API 510", "api", (r"API[\s-]*510\b",)),
    ("API 570", "api", (r"API[\s-]*570\b",)),
    ("API 653", "api", (r"API[\s-]*653\b",)),
    ("API 571", "api", (r"API[\s-]*571\b",)),
    ("API 580", "api", (r"API[\s-]*580\b",)),
    ("API 1169", "api", (r"API[\s-]*1169\b",)),
    ("IADC WellSharp", "well_control", (r"IADC[\s-]*WellSharp\b", r"WellSharp\b", r"Well[\s-]*Control[\s-]*Certif")),
    ("IWCF", "well_control", (r"IWCF\b",)),
    ("BOSIET", "offshore_survival", (r"BOSIET\b", r"T-BOSIET\b")),
    ("HUET", "offshore_survival", (r"HUET\b",)),
    ("FOET", "offshore_survival", (r"FOET\b",)),
    ("NACE CIP", "corrosion", (r"NACE[\s-]*CIP[\s-]*[1-4]?\b",)),
    ("NACE CP", "corrosion", (r"NACE[\s-]*CP[\s-]*[1-4]?\b",)),
    ("Rigger Certification", "rigging", (r"Rigger[\s-]*Level[\s-]*[1-3]\b", r"Certified[\s-]*Rigger\b")),
    ("Signal Person", "rigging", (r"Signal[\s-]*Person\b",)),
    ("NCCCO Crane Operator", "crane", (r"NCCCO\b", r"Crane[\s-]*Operator[\s-]*Certif", r"CCO\b")),
    ("CWI", "welding", (r"CWI\b", r"Certified[\s-]*Welding[\s-]*Inspector\b")),
    ("CWB", "welding", (r"CWB\b",)),
    ("AWS Certification", "welding", (r"AWS[\s-]*Certif",)),
    ("OSHA 10", "safety", (r"OSHA[\s-]*10\b",)),
    ("OSHA 30", "safety", (r"OSHA[\s-]*30\b",)),
    ("OSHA 40", "safety", (r"OSHA[\s-]*40\b",)),
    ("HAZMAT", "safety", (r"HAZMAT\b", r"Hazardous[\s-]*Materials[\s-]*Certif")),
    ("HAZWOPER", "safety", (r"HAZWOPER\b",)),
    ("H2S", "safety", (r"H2S[\s-]*Alive\b", r"H2S[\s-]*Clear\b", r"H2S[\s-]*Safety\b")),
    ("CPR/First Aid", "first_aid", (r"CPR\b", r"CPR[\s/]*First[\s-]*Aid\b", r"First[\s-]*Aid[\s-]*Certif", r"BLS\b")),
    ("AED", "first_aid", (r"AED[\s-]*Certif",)),
    ("USCG License", "maritime", (r"USCG[\s-]*[\w\s]*License\b", r"USCG[\s-]*Master\b", r"USCG[\s-]*Chief[\s-]*Engineer\b")),
    ("DPO", "maritime", (r"DPO\b", r"Dynamic[\s-]*Positioning[\s-]*Operator\b")),
    ("STCW", "maritime", (r"STCW\b",)),
    ("PE License", "professional", (r"PE[\s-]*License\b", r"P\.E\.[\s-]*License\b", r"Professional[\s-]*Engineer[\s-]*License\b")),
    ("PMP", "professional", (r"PMP\b", r"Project[\s-]*Management[\s-]*Professional\b")),
    ("Six Sigma", "professional", (r"Six[\s-]*Sigma[\s-]*Green[\s-]*Belt\b", r"Six[\s-]*Sigma[\s-]*Black[\s-]*Belt\b", r"Lean[\s-]*Six[\s-]*Sigma\b")),
    ("CDL", "professional", (r"CDL\b", r"Class[\s-]*[ABC][\s-]*CDL\b", r"Commercial[\s-]*Driver'?s?[\s-]*License\b")),
    ("Master Electrician", "trades", (r"Master[\s-]*Electrician\b",)),
    ("Journeyman Electrician", "trades", (r"Journeyman[\s-]*Electrician\b",)),
    ("EPA 608", "trades", (r"EPA[\s-]*608\b",)),
    ("Forklift Operator", "trades", (r"Forklift[\s-]*Operator\b", r"Forklift[\s-]*Certif", r"Forklift[\s-]*License\b")),
    ("IADC", "industry", (r"IADC[\s-]*Certif",)),
    ("IMCA", "industry", (r"IMCA[\s-]*Certif",)),
    ("NICET", "industry", (r"NICET\b",)),
)
# Verbs and phrases that make a sentence describe duties.
DUTY = (
    "oversee overseeing manage managing ensure ensuring develop developing coordinate coordinating implement implementing maintain maintaining support supporting "
    "provide providing lead leading drive driving perform performing execute executing deliver delivering create creating build building"
).split()
DUTY_PHRASES = (r"you\s+will", r"your\s+responsibilities", r"responsibilities\s+include", r"duties\s+include", r"tasks\s+include")
# Fixed value: what makes a sentence name a degree.
DEGREE = r"(?:bachelor|master|engineering|science|business)\s+(?:degree|diploma)"


def pattern(alternatives: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:{'|'.join(alternatives)})"


def is_duty(sentence: Column) -> Column:
    return sentence.rlike(word("|".join((*DUTY, *DUTY_PHRASES))))


def is_degree(sentence: Column) -> Column:
    return sentence.rlike(word(DEGREE))


def is_long(sentence: Column) -> Column:
    return (F.length(sentence) > 150) & (F.regexp_count(sentence, F.lit(",")) > 2)


def sentences(c: Column) -> Column:
    """Parts that end with a full stop or a line, without those on duties and degrees and overlong ones."""
    parts = F.filter(F.transform(F.split(neutral(c), r"(?<=\.)|[\n\r]"), trim), lambda x: x != "")
    return F.filter(parts, lambda x: ~(is_duty(x) | is_degree(x) | is_long(x)))


def literal(alternative: str) -> str:
    """The longest run of letters and digits that every match of an alternative holds, in lower case."""
    plain = re.sub(r"\[[^\]]*\]\*?\??|\\.|[^A-Za-z0-9]\?|[A-Za-z0-9]\?", " ", alternative)
    return max(plain.split(), key=len, default="").lower()


def named_in(c: Column, table=CERTIFICATIONS) -> Column:
    """Sorted names of the certifications that a usable sentence of the text holds; empty for missing text.

    Most texts name none. So an expression runs only where the text holds a literal that one of its alternatives needs, and the sentences are
    split only where one of the text's literals is there at all; each is bound once, however many names look at it.
    """

    def candidate(low: Column, alternatives: tuple[str, ...]) -> Column:
        needed = {literal(a) for a in alternatives}
        return F.lit(True) if "" in needed else reduce(lambda a, b: a | b, (low.contains(x) for x in sorted(needed)))

    def tested(text: Column) -> Column:
        found = F.array(*(F.when(candidate(text["low"], alternatives) & text["usable"].rlike(pattern(alternatives)), name) for name, _, alternatives in table))
        return F.array_sort(F.array_compact(found))

    def searched(text: Column) -> Column:
        usable = once(F.array_join(sentences(text), "\n"), lambda x: once(F.struct(x.alias("usable"), F.lower(x).alias("low")), tested))
        some = once(F.lower(text), lambda low: reduce(lambda a, b: a | b, (candidate(low, alternatives) for _, _, alternatives in table)))
        return F.when(some, usable).otherwise(F.array().cast("array<string>"))

    return once(c, searched)


#: Characters of a sentence on either side of a match, its end included; what lies further away isn't looked at.
WINDOW = 201


def around(text: str, start: int, end: int) -> str:
    """The match with what surrounds it in its sentence or line, up to ``WINDOW`` code points on each side."""
    before = re.split(r"[.\n\r]", text[max(0, start - WINDOW) : start])[-1]
    return before + text[start:end] + re.match(r"[^.\n\r]*[.\n\r]?", text[end : end + WINDOW])[0]


def matches(c: Column, table=CERTIFICATIONS) -> Column:
    """Every match of every alternative in a text: name, alternative and nth (from 1), sentence. Empty for missing text.

    ``named_in`` splits texts into sentences without a bound; here each match is judged by its own window, as two matches in a long line may be.
    """
    compiled = [(name, k, literal(a), re.compile(pattern((a,)), re.ASCII)) for name, _, alternatives in table for k, a in enumerate(alternatives, 1)]

    @F.pandas_udf("array<struct<name:string,alternative:int,nth:int,sentence:string>>")
    def found(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[dict]:
            low = (text or "").lower()
            return [
                {"name": name, "alternative": k, "nth": nth, "sentence": around(text, m.start(), m.end())}
                for name, k, needed, expression in compiled
                if text and needed in low
                for nth, m in enumerate(expression.finditer(text), 1)
            ]

        return texts.map(of)

    return found(c)


def cited(df: DataFrame, text: str, keys: list[str], table=CERTIFICATIONS) -> DataFrame:
    """``keys``, name, alternative, nth, sentence and usable for each match in the column ``text``; usable is false for duties, degrees and overlong sentences.

    Texts without a match, and null or empty ones, give no rows; repeated rows give repeated ones. Other columns are ignored.
    """
    out = df.select(*keys, F.inline(matches(F.col(text), table))).withColumn("sentence", trim(F.col("sentence")))
    plain = neutral(F.col("sentence"))
    return out.withColumn("usable", ~(is_duty(plain) | is_degree(plain) | is_long(plain)))


def named_in_posting(description: Column, skills: Column) -> Column:
    """Of the description and of each skill."""
    empty = F.array().cast("array<string>")
    from_skills = F.flatten(F.transform(F.coalesce(skills, empty), lambda x: named_in(x)))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(named_in(description), empty), from_skills)))


def dictionary(spark: SparkSession) -> DataFrame:
    """name and category of every certification."""
    return spark.createDataFrame([(name, category) for name, category, _ in CERTIFICATIONS], "name string, category string")


def by_locale(c: Column) -> Column:
    """A key that orders names as people do: letters before case, accents beside their letters."""
    return F.collate(c, "UNICODE")
