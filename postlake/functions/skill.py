"""Skill names: splitting, normalising and judging them, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from postlake.functions.location import lookup, once
from postlake.functions.text import trim

# Phrases that mark advertising.
RECRUITMENT = (
    "join our", "partner with", "become part", "be part of", "work with us", "join us", "we are", "we offer", "our team", "our company", "our culture",
    "our mission", "our vision", "our values", "innovating field", "the best", "world-class", "industry-leading", "market-leading", "award-winning",
    "cutting-edge", "state-of-the-art", "premier", "leading provider",
)
# Words that are dropped from a skill.
ADJECTIVES = (
    "excellent good strong great best top high outstanding exceptional superior advanced intermediate basic essential important key necessary vital crucial "
    "significant substantial extensive comprehensive broad wide deep thorough detailed complete full total entire multiple various several many numerous diverse "
    "proven demonstrated solid sound professional proficient competent skilled experienced qualified capable effective successful accomplished expert seasoned "
    "veteran senior junior entry-level mid-level relevant recent current contemporary modern up-to-date latest new emerging developing growing evolving "
    "highly very extremely particularly especially remarkably notably significantly considerably substantially thoroughly "
    "practical hands-on applied real-world direct active proactive dynamic functional quantitative qualitative theoretical conceptual tailored customized specialized "
    "positive enthusiastic motivated dedicated committed passionate energetic driven ambitious flexible adaptable reliable dependable responsible conscientious "
    "diligent meticulous related applicable appropriate suitable pertinent specific particular certain given respective corresponding "
    "corporate business commercial industrial enterprise global international domestic local regional national preferred desired required ideal perfect optimal prime"
).split()
# Adjectives that become nouns.
NOUNS = {
    "operational": "operations", "financial": "finance", "analytical": "analysis", "organizational": "organization", "technical": "technical",
    "managerial": "management", "strategic": "strategy", "tactical": "tactics", "administrative": "administration", "supervisory": "supervision",
    "regulatory": "regulation", "developmental": "development", "educational": "education", "professional": "professional", "interpersonal": "interpersonal",
    "computational": "computing", "mechanical": "mechanical", "electrical": "electrical", "chemical": "chemical", "mathematical": "mathematics",
    "statistical": "statistics", "logical": "logic", "creative": "creativity", "innovative": "innovation",
}
# Short forms spelt out.
EXPANSIONS = {"written": "written communication", "verbal": "verbal communication", "oral": "oral communication", "interpersonal": "interpersonal communication"}
# Verbs that start a task.
ACTION_VERBS = "delegate organize establish maintain develop implement create manage coordinate supervise direct oversee monitor evaluate assess review update prepare conduct perform execute complete ensure provide support assist help facilitate lead guide train teach instruct mentor coach advise".split()
# Fields that keep their plural.
FIELD_NAMES = "operations systems analytics logistics mathematics statistics economics".split()
# Names too general for a skill.
TOO_GENERIC = (
    "experience", "skills", "knowledge", "ability", "abilities", "qualification", "qualifications", "requirement", "requirements", "background", "expertise",
    "capability", "capabilities", "competency", "competencies", "proficiency", "characteristic", "characteristics", "attribute", "attributes", "trait",
    "traits", "thinking skills", "just experience", "work experience",
)
# Words without meaning of their own.
FILLERS = "a the in for you us and or to that when your our we are is of on at from as".split()
# Single words too vague for a skill.
VAGUE = "thinking just programs values benefits work tasks duties activities functions customers drive equivalent competitive".split()
# Words that are no skill alone.
VAGUE_ALONE = (
    "college university attitude rules human italian spanish french german chinese japanese portuguese arabic russian hindi marketing design organization "
    "isolation activation deactivation parts lists system systems operator networking projects front-end peers"
).split()
# Parts of phrases that are no skill.
ARTIFACTS = ("work-life balance", "wellbeing", "policies", "approach", "stakeholders", "colleagues", "teammates", "coworkers", "work location", "upon study", "administrators")
# Kinds of thinking that are skills.
THINKING = ("critical", "analytical", "strategic", "creative", "logical", "systems")
# Closing words that parts of a compound share.
SUFFIX = r"(?i)\b(skills?|experience|knowledge|ability|abilities|engineering|management|analysis)\b"

# What is no skill by itself.
BLACKLIST = (
    "basic compensation", "basic qualifications", "key responsibilities", "job requirements", "position requirements", "essential functions", "job duties",
    "position summary", "job summary", "responsibilities", "requirements", "qualifications", "compensation", "benefits", "job description",
    "position description", "duties", "special requirements", "special qualifications", "additional requirements", "what you'll do", "what you will do",
    "what you do", "how to apply", "application process", "equal opportunity", "business career", "career", "career path", "career development",
    "career opportunities", "professional development", "growth opportunities", "key", "basic", "essential", "important", "critical", "necessary", "various",
    "other", "general", "additional", "miscellaneous", "etc", "tbd", "tba", "n/a", "na", "none", "all", "any", "special", "specific", "particular", "certain",
    "typical", "transportation", "location", "hours", "schedule", "shift", "job", "position", "role", "opportunity", "opening", "vacancy", "full-time",
    "part-time", "contract", "temporary", "permanent", "remote", "on-site", "hybrid", "flexible", "immediate", "excellent", "good", "strong", "great", "best",
    "top", "high", "outstanding", "exceptional", "superior", "advanced", "intermediate", "entry-level", "senior", "junior", "mid-level",
)
# Gerunds that name skills.
GERUNDS = (
    "welding programming engineering accounting banking nursing teaching training marketing advertising consulting recruiting troubleshooting debugging testing "
    "planning modeling forecasting budgeting scheduling networking drafting drawing painting building manufacturing processing"
).split()
# Verbs that begin duties.
IMPERATIVES = (
    "ensure ensures maintain maintains delegate delegates perform performs complete completes execute executes deliver delivers achieve achieves demonstrate "
    "demonstrates provide provides support supports assist assists conduct conducts implement implements follow follows adhere adheres comply complies meet meets "
    "fulfill fulfills satisfy satisfies handle handles"
).split()
# Nouns that begin requirements.
VAGUE_NOUNS = ("thoroughness", "accuracy", "precision", "consistency", "reliability")
# Words that begin sentences.
STARTERS = (
    "with be show demonstrate work working have must should can will able ability experience comprehensive contemporary candidates additional applies active "
    "requires required preferred minimum ba bs ma ms phd join partner become explore discover learn grow take make build create develop pursue achieve"
).split()
# Words of sentences.
SENTENCE_WORDS = ("you", "your", "we", "our", "must", "should", "will")


def _any(tests) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def words(c: Column) -> Column:
    return F.split(c, r"\s+")


def split_compound(c: Column) -> Column:
    """Parts joined by and, & or or; a closing word such as Skills is given to parts that have none like it."""
    parts = F.transform(F.split(c, r"(?i)\s+(?:and|&|or)\s+"), trim)
    suffix = F.regexp_extract(F.element_at(parts, -1), SUFFIX, 1)
    extended = F.transform(parts, lambda x, i: F.when((i == F.size(parts) - 1) | x.rlike(SUFFIX), x).otherwise(F.concat(x, F.lit(" "), suffix)))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) == 1, F.array(c)).when(suffix != "", extended).otherwise(parts)


def normalize(c: Column) -> Column:
    """A skill's plain name in title case, or NULL if it is none.

    Each step is bound as a variable, so that it is planned and computed once however often it is used.
    """
    return once(trim(c), lambda raw: F.when(_is_noise(raw), None).otherwise(once(_bare(raw), _named)))


def _is_noise(raw: Column) -> Column:
    low = F.lower(raw)
    return _any([~raw.rlike("^[a-zA-Z]"), raw.contains(","), raw.rlike(r"(?i)\b\d+\+?\s*(years?|yrs?|months?)\b"), raw.rlike("[()]"), raw.rlike(r"(?i)\b(our|we|us)\b"), low.rlike("|".join(RECRUITMENT))])


def _bare(raw: Column) -> Column:
    """Without adjectives and closing words, nouns for verbs, short forms spelt out."""
    noun = lambda w: once(F.lower(w), lambda k: F.coalesce(lookup(NOUNS, k), w))
    s = trim(F.regexp_replace(F.regexp_replace(raw, rf"(?i)\b(?:{'|'.join(ADJECTIVES)})\b", " "), r"\s+", " "))
    s = trim(F.array_join(F.filter(F.transform(words(s), noun), lambda w: w != ""), " "))
    s = trim(F.regexp_replace(trim(F.regexp_replace(s, r"(?i)\s+(skills?|abilities|ability)$", "")), r"(?i)^understanding\s+", ""))
    return once(s, lambda x: F.coalesce(lookup(EXPANSIONS, F.lower(x)), x))


def _named(s: Column) -> Column:
    low = F.lower(s)
    bad = _any([low == "understanding", F.get(words(low), F.lit(0)).isin(*ACTION_VERBS), s.rlike("(?i)that (has|have|had) been"), s.rlike("(?i)^(the )?ability to"), s.rlike(r"(?i)^(with|for) the\b")])
    edged = trim(F.regexp_replace(F.regexp_replace(s, r"(?i)^(and|or|with|the|a|an|of)\s+", ""), r"(?i)\s+(and|or|with|the|a|an|of)$", ""))
    single = lambda w: F.when(F.lower(w).isin(*FIELD_NAMES), w).when(w.endswith("ications") | (w.endswith("ions") & ~w.endswith("sions")), F.regexp_replace(w, "s$", "")).otherwise(w)
    singular = lambda x: F.array_join(F.transform(F.split(x, " "), single), " ")
    return F.when(bad, None).otherwise(once(edged, lambda x: F.when(F.coalesce(F.length(x) < 2, F.lit(True)), None).otherwise(once(singular(x), _specific))))


def _specific(s: Column) -> Column:
    """In title case, unless it is too general to be a skill."""
    return once(F.struct(s.alias("s"), F.lower(s).alias("low"), words(F.lower(s)).alias("words"), F.filter(words(s), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*FILLERS)).alias("meaning")), _judged)


def _judged(x: Column) -> Column:
    s, low, two, meaning = x["s"], x["low"], F.size(x["words"]) == 2, x["meaning"]
    first, second = F.get(x["words"], F.lit(0)), F.get(x["words"], F.lit(1))
    alone, only = F.size(meaning) == 1, F.lower(F.get(meaning, F.lit(0)))
    bad = _any(
        [
            low.isin(*TOO_GENERIC),
            F.size(meaning) < 1,
            alone & ((F.length(only) < 4) | only.isin(*VAGUE)),
            s.rlike(r"(?i)\b(diploma|degree|certification|license|certified|licensed)\b"),
            s.rlike(r"(?i)\s+(I{1,3}V?|VI{1,3}|Iv)$"),
            s.rlike(r"(?i)\b(system|software|tool|platform)\b") & two & F.get(words(s), F.lit(0)).rlike("^[A-Z][a-z]*$"),
            *(low.contains(k) for k in ARTIFACTS),
            s.rlike("(?i)^[a-z]-"),
            s.rlike(r"\)$") & ~s.contains("("),
            alone & low.isin(*VAGUE_ALONE),
            s.rlike(r"(?i)^to\s+"),
            s.rlike(r"(?i)\b(interact|work|communicate|collaborate|interface|react)\s+(with|across)\b"),
            s.rlike(r"(?i)^(continuously|constantly|regularly|routinely)\s+"),
            two & first.isin("just", "only", "some"),
            two & (second == "thinking") & ~first.isin(*THINKING),
            two & second.isin("programs", "values"),
        ]
    )
    return F.when(bad, None).otherwise(F.initcap(low))


def is_valid(c: Column) -> Column:
    """Whether a text names a skill and isn't a sentence, a header or a requirement. NULL is none."""
    return once(F.struct(c.alias("c"), trim(c).alias("t"), F.lower(trim(c)).alias("low"), words(F.lower(trim(c))).alias("words")), _is_valid)


def _is_valid(x: Column) -> Column:
    c, t, low, parts = x["c"], x["t"], x["low"], x["words"]
    cased = words(t)
    n, first = F.size(parts), F.get(parts, F.lit(0))
    fillers = F.size(F.filter(parts, lambda w: w.isin(*FILLERS)))
    indicators = sum((F.when(low.contains(x), 1).otherwise(0) for x in SENTENCE_WORDS), F.lit(0))
    capitals = F.size(F.filter(cased, lambda w: w.rlike("^[A-Z]")))
    bad = _any(
        [
            ~t.rlike("^[a-zA-Z]"),
            n > 4,
            F.length(t) > 50,
            F.length(t) < 2,
            t.rlike("[:.!?]$"),
            t.rlike(r"\$|USD|EUR|GBP|\d+k|\d{3,}"),
            low.isin(*BLACKLIST),
            *(low.contains(x) | F.lit(x).contains(low) for x in BLACKLIST if " " in x),
            t.rlike(r"(?i)\b(that|which|who|whom|whose)\b"),
            t.rlike(r"(?i)^[A-Z][a-z]+ing\b") & ~first.isin(*GERUNDS),
            first.isin(*IMPERATIVES),
            first.isin(*VAGUE_NOUNS) & (n > 1),
            t.rlike("(?i)degree|years? of experience|years? experience|clearance|certification required|elected|voluntary"),
            t.rlike(r"(?i)\b(internships?|work experience|up to\s+\d+|one year|two years|three years)\b"),
            t.rlike(r"(?i)travel \d+|us citizen|citizenship required|general hours|flexible hours|willing to travel"),
            t.rlike(r"\d+%"),
            t.rlike("(?i)^this (role|position|job|opportunity)"),
            first.isin(*STARTERS),
            (n > 2) & (fillers / n > 0.3),
            indicators >= 2,
            (capitals >= 4) & (capitals == n),
        ]
    )
    return F.coalesce(F.when(c != "", ~bad), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if ``b`` holds ``a``, 0.85 the other way round, else mostly the Jaccard of their words."""
    x, y = F.lower(a), F.lower(b)
    u, v = F.array_distinct(words(x)), F.array_distinct(words(y))
    jaccard = F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(y.contains(x), 0.9).when(x.contains(y), 0.85).otherwise(jaccard * 0.8 + ratio * 0.2)


def merge_ordered(first: Column, more: Column) -> Column:
    """``first``, then what ``more`` adds to it, without regard to case."""
    seen = F.transform(first, F.lower)
    new = F.filter(more, lambda x: ~F.array_contains(seen, F.lower(x)))
    once = F.filter(new, lambda x, i: F.array_position(F.transform(new, F.lower), F.lower(x)) == i + 1)
    return F.concat(first, once)
