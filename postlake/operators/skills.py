"""Raw skills to canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.functions.skill import ACTION_VERBS, is_valid, normalize, similarity, split_compound
from postlake.functions.text import trim
from postlake.operators.facets import once_each
from postlake.operators.similar import fuzzy_match

LEAST_SCORE = 0.6


def canonical(values: DataFrame, reference: DataFrame, prepared: DataFrame) -> DataFrame:
    """``values`` (skill) with canonical: the prepared dictionary's name (key, known), else the reference's (ref_ord, name) that is equal,
    equal with hyphens and slashes as blanks, or most alike by shared words, the first of equals; NULL if none reaches 0.6.

    Alike names come from ``similar.fuzzy_match``; give distinct values.
    """
    low = F.lower(F.col("skill"))
    collapsed = trim(F.regexp_replace(F.regexp_replace(low, r"[\-/]+", " "), r"\s+", " "))
    values = values.withColumn("_low", low).withColumn("_flat", collapsed)
    first = reference.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", "ref_ord").alias("_name"))
    alike = fuzzy_match(values.select("skill"), reference, "skill", LEAST_SCORE).select("skill", F.col("name").alias("_alike"))
    out = values.join(prepared.select(F.col("key").alias("_low"), "known"), "_low", "left")
    out = out.join(first.select(F.col("_key").alias("_low"), F.col("_name").alias("_exact")), "_low", "left").join(first.select(F.col("_key").alias("_flat"), F.col("_name").alias("_collapsed")), "_flat", "left")
    return out.join(alike, "skill", "left").select("skill", F.coalesce("known", "_exact", "_collapsed", "_alike").alias("canonical"))


def processed(raws: DataFrame, reference: DataFrame, prepared: DataFrame, split: bool = True) -> DataFrame:
    """id and skills: for ``raws`` (id, place, raw) the canonical names in order, each once without regard to case.

    Each raw skill is split (unless ``split`` is off) and normalised; what has no canonical name goes. Only distinct skills are looked up.
    """
    parts = raws.select("id", "place", F.posexplode(split_compound(F.col("raw")) if split else F.array("raw")).alias("part", "raw"))
    distinct = once_each(parts, "raw").select("raw", normalize(F.col("raw")).alias("skill")).where("skill is not null")
    names = canonical(distinct.select("skill").distinct(), reference, prepared).where("canonical is not null")
    found = parts.join(distinct, "raw").join(names, "skill").select("id", "canonical", F.struct("place", "part").alias("at"))
    once = found.groupBy("id", F.lower("canonical").alias("key")).agg(F.min_by("canonical", "at").alias("name"), F.min("at").alias("at"))
    return once.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("skills"))


def searchable(skills: Column, canonical_skills: Column) -> Column:
    """What a skill filter looks at: the canonical skills of a posting, or its raw ones where it has no entry."""
    return F.transform(F.coalesce(canonical_skills, skills), F.lower)


#: Verbs that begin tasks rather than skills: those before the helping ones.
TASK_VERBS = tuple(ACTION_VERBS[: ACTION_VERBS.index("provide")])
#: Of a search: occupations that are looked at, the boost of priority ones, the least score and the score that ends the search there.
OCCUPATIONS, BOOST, LEAST, ENOUGH = 8, 1.3, 0.35, 0.85


def is_reference(c: Column) -> Column:
    """Whether a remote skill's name is one, and not a task."""
    first = F.get(F.split(F.lower(c), r"\s+"), F.lit(0))
    return ~first.isin(*TASK_VERBS) & (F.length(c) <= 40) & (F.size(F.split(c, r"\s+")) <= 5) & ~c.rlike("(?i)that (has|have|had) been")


def best_of_occupations(found: DataFrame) -> DataFrame:
    """skill, name, code and score of the best element for each skill of ``found`` (skill, occ_ord, code, priority, elem_ord, name).

    Priority occupations come first, eight are looked at, and none after a priority one at which the best so far is over 0.85. Of equal
    scores the first stands. Scores of priority occupations count 1.3 times; 0.35 must be passed.
    """
    occupations = found.groupBy("skill", "code").agg(F.min("occ_ord").alias("occ_ord"), F.max("priority").alias("priority"))
    by_rank = Window.partitionBy("skill").orderBy(F.desc("priority"), "occ_ord", "code")
    ranked = occupations.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= OCCUPATIONS).select("skill", "code", "rank")
    scored = found.join(ranked, ["skill", "code"]).where(is_reference(F.col("name")))
    scored = scored.withColumn("score", similarity(F.col("skill"), F.col("name")) * F.when(F.col("priority"), BOOST).otherwise(1.0))
    so_far = Window.partitionBy("skill").orderBy("rank")
    each = scored.groupBy("skill", "rank").agg(F.max("score").alias("top"), F.max("priority").alias("priority")).withColumn("best", F.max("top").over(so_far))
    last = each.where(F.col("priority") & (F.col("best") > ENOUGH)).groupBy("skill").agg(F.min("rank").alias("last"))
    kept = scored.join(last, "skill", "left").where((F.col("rank") <= F.coalesce("last", F.lit(OCCUPATIONS))) & (F.col("score") > LEAST))
    best = kept.groupBy("skill").agg(F.max_by(F.struct("name", "code", "score"), F.struct("score", -F.col("rank"), -F.col("elem_ord"))).alias("b"))
    return best.select("skill", "b.name", "b.code", "b.score")


def standardized(c: Column, answer: Column) -> Column:
    """A remote service's name for a skill if one holds the other, else the skill."""
    a, b = F.lower(c), F.lower(answer)
    return F.when(a.contains(b) | b.contains(a), answer).otherwise(c)


def processed_remotely(raws: DataFrame, answers: DataFrame) -> DataFrame:
    """id and skills: as ``processed``, but valid normalised skills stay, under a remote service's name (skill, answer) where it gave one like them."""
    parts = raws.select("id", "place", F.posexplode(split_compound(F.col("raw"))).alias("part", "raw"))
    distinct = once_each(parts, "raw").select("raw", normalize(F.col("raw")).alias("skill")).where(is_valid(F.col("skill")))
    found = parts.join(distinct.join(answers, "skill", "left"), "raw").select("id", standardized(F.col("skill"), F.col("answer")).alias("name"), F.struct("place", "part").alias("at"))
    once = found.groupBy("id", F.lower("name").alias("key")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
    return once.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("skills"))
