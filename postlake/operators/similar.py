"""Similar postings, fuzzy matches to a reference list, term scans."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlake.sources.scratch import Scratch

# Words that don't count in fuzzy matches.
STOP_WORDS = ("and", "the", "for", "with", "from", "into", "that", "this", "have", "has", "been", "are", "was", "were", "will", "can", "may")


#: Postings that hold a set of skills, up to which all of them are paired with the queries that hold it; of more the first are.
MOST_PAIRED = 32
#: Skills of a query up to which its sets are looked at; queries with more meet all that share one.
MOST_SKILLS = 16
#: Ranges of ``ord`` in which a list's members are counted, to find where its first ones end.
RANGES = 256


def similar_to(postings: DataFrame, key: int, n: int = 5, active: Column | None = None) -> DataFrame:
    """Postings like one: first those of its company, then by shared location (2) and shared skills (1 each).

    The one posting is a single row that is broadcast; the others stream past it, and each task keeps its best n.
    """
    current = postings.where(F.col("id") == key).orderBy("ord").limit(1).select(F.col("company").alias("_company"), F.col("location_names").alias("_locations"), F.col("skills").alias("_skills"))
    others = postings.where(F.col("id") != key)
    if active is not None:
        others = others.where(active)
    near = others.join(F.broadcast(current), F.lit(True))
    same = F.col("company") == F.col("_company")
    shared = F.size(F.filter("skills", lambda x: F.array_contains("_skills", x)))  # repeated skills count each time
    score = F.when(F.arrays_overlap("location_names", "_locations"), 2).otherwise(0) + shared
    ranked = near.withColumn("tier", F.when(same, 0).otherwise(1)).withColumn("score", F.when(same, 0).otherwise(score)).where(same | (F.col("score") > 0))
    return ranked.orderBy("tier", F.desc("score"), "ord").limit(n).select("id", "tier", "score")


def _heads(rows: DataFrame, keys: list[str], most: int, ends: tuple, scratch: Scratch, name: str) -> DataFrame:
    """The first ``most`` rows by ``ord`` (a number between ``ends``) of each list. Members are counted by ranges of ``ord`` first, so only those up to the range that
    holds the last one are dealt and sorted."""
    low, high = ends
    ranged = rows.withColumn("_range", F.floor((F.col("ord") - low) * RANGES / (high - low + 1)))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sizes.withColumn("_before", before).where(F.col("_before") < most).groupBy(*keys).agg(F.max("_range").alias("_last"))
    few = ranged.join(scratch.table(last, f"{name}_ends", small=True), keys).where(F.col("_range") <= F.col("_last"))
    by = Window.partitionBy(*keys).orderBy("ord")
    return scratch.table(few.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).select(rows.columns), name, small=True)


def _first(rows: DataFrame, keys: list[str], n: int, ends: tuple, scratch: Scratch) -> DataFrame:
    """Of each list so many rows that whichever row or company is left out, the first n of the others are there: the first 2 n + 1, and n
    others if a company has more than n + 1 of these."""
    first = _heads(rows, keys, 2 * n + 1, ends, scratch, "first")
    main = first.groupBy(*keys, F.col("company").alias("_main")).agg(F.count("*").alias("_c")).where(F.col("_c") > n + 1).drop("_c")
    main = scratch.table(main, "main", small=True)
    if not main.take(1):
        return first
    others = rows.join(main, keys).where(~F.col("company").eqNullSafe(F.col("_main"))).select(rows.columns)
    return first.unionByName(_heads(others, keys, n, ends, scratch, "others")).distinct()


def most_similar(postings: DataFrame, queries: DataFrame, n: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """query_id, id, tier and score of the n postings most like each query (both: id, ord (a number), company, skills, places), itself left out.

    A company's other postings come first, in their order, so n + 1 per company are enough for all its queries. Queries that
    these don't fill go on to postings of other companies: 2 for a shared place and 1 for each shared skill (as often as the posting has it), ties in order.

    No query meets all postings of a place, a skill or a set of skills. The sets of a query's skills, the rarest first, grow from common sets only:
    one that at most ``MOST_PAIRED`` postings hold is rare, and all its postings are met, so those that share more are too. Of a common set,
    alone and with each place, a list has the first postings: one that shares just this is among the best only if it is among these, as n others
    before it have its score. A list is left out where the n-th best met through rare sets has more than its score. Pairs are
    so many for each set of a query, whatever the number of postings. NULL places or skills are none. Both tables are read several times, so give written ones.
    """
    scratch = scratch or Scratch(postings.sparkSession, "similar")
    none = F.array().cast("array<string>")
    shape = lambda df: df.select("id", "ord", "company", F.coalesce("skills", none).alias("skills"), F.array_distinct(F.coalesce("places", none)).alias("places"))
    postings, queries = shape(postings), shape(queries)
    first = postings.select("company", "id", "ord").withColumn("_r", F.row_number().over(Window.partitionBy("company").orderBy("ord"))).where(F.col("_r") <= n + 1).drop("_r")
    own = queries.select(F.col("id").alias("query_id"), "company").join(first, "company").where("id <> query_id")
    own = own.select("query_id", "id", "ord", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("score"))
    full = own.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(F.col("query_id").alias("id"))
    short = queries.join(full, "id", "left_anti").select(F.col("id").alias("query_id"), F.col("company").alias("_company"), F.array_distinct("skills").alias("_skills"), F.col("places").alias("_places"))
    short = scratch.table(short, "short", small=True)
    if not short.take(1):
        return _best(own, n)

    # skills as numbers, the rarest first, with the times that a posting has them
    once = F.size("skills") == F.size(F.array_distinct("skills"))
    weight = lambda x: F.when(once, 1).otherwise(F.size(F.filter("skills", lambda y: y == x))).cast("long")
    skills = postings.select("id", F.inline(F.transform(F.array_distinct("skills"), lambda x: F.struct(x.alias("skill"), weight(x).alias("w")))))
    wanted = short.select(F.explode("_skills").alias("skill")).distinct()
    times = skills.join(wanted, "skill", "left_semi").groupBy("skill").agg(F.count("*").alias("_times"))
    numbers = scratch.table(times.orderBy("_times", "skill").select("skill", F.monotonically_increasing_id().alias("k")), "numbers", small=True)
    gathered = F.sort_array(F.collect_list(F.struct("k", "w")))
    empty = F.array().cast("array<struct<k:bigint,w:bigint>>")
    held = skills.join(numbers, "skill").groupBy("id").agg(gathered.alias("held"))
    base = scratch.table(postings.drop("skills").join(held, "id", "left").withColumn("held", F.coalesce("held", empty)), "base")
    known = short.select("query_id", F.explode("_skills").alias("skill"), F.lit(1).cast("long").alias("w")).join(numbers, "skill").groupBy("query_id").agg(gathered.alias("own"))
    asked = scratch.table(short.drop("_skills").join(known, "query_id", "left").withColumn("own", F.coalesce("own", empty)), "asked", small=True)
    low, high, repeats = base.agg(F.min("ord"), F.max("ord"), F.max(F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["w"] - 1))).first()

    other = (F.col("id") != F.col("query_id")) & ~F.coalesce(F.col("company") == F.col("_company"), F.lit(False))
    place, numbers_of = F.when(F.arrays_overlap("places", "_places"), 2).otherwise(0), lambda c: F.transform(c, lambda x: x["k"])
    score = place + F.aggregate(F.filter("held", lambda x: F.array_contains(numbers_of("own"), x["k"])), F.lit(0).cast("long"), lambda s, x: s + x["w"])

    def deeper(rows: DataFrame) -> DataFrame:
        """A row for each skill that a set can grow by."""
        grown = rows.select("*", F.posexplode("rest").alias("_at", "_x")).withColumn("rest", F.slice("rest", F.col("_at") + 2, F.size("rest")))
        return grown.withColumns({"k": F.col("_x.k"), "weight": F.col("weight") + F.col("_x.w")}).drop("_at", "_x")

    def grown(rows: DataFrame, sets: DataFrame) -> DataFrame:
        return deeper(rows).withColumnRenamed("node", "parent").join(sets, ["parent", "k"]).drop("parent", "k")

    start = lambda df, rest: df.withColumns({"node": F.lit(0).cast("long"), "weight": F.lit(0).cast("long"), "rest": rest})
    few = F.size("own") <= MOST_SKILLS
    having, asking = start(base, F.col("held")), start(asked, F.when(few, F.col("own")).otherwise(empty))
    level, common, pairs = 0, [(having, asking, 0)], []
    many = asked.where(~few).select("*", F.explode(numbers_of("own")).alias("k")).join(base.select("*", F.explode(numbers_of("held")).alias("k")), "k")
    pairs.append(many.where(other).select("query_id", "id", "ord", score.alias("score")))
    while True:
        level += 1
        keys = scratch.table(deeper(asking).select("node", "k").distinct(), f"keys{level}", small=True)
        if not keys.take(1):
            break
        counted = deeper(having).select("node", "k").join(keys, ["node", "k"], "left_semi").groupBy("node", "k").agg(F.count("*").alias("_times"))
        sets = counted.select(F.col("node").alias("parent"), "k", ((F.monotonically_increasing_id() + 1) * (MOST_SKILLS + 1) + level).alias("node"), (F.col("_times") <= MOST_PAIRED).alias("rare"))
        sets = scratch.table(sets, f"sets{level}", small=True)
        asking = scratch.table(grown(asking, sets), f"asking{level}", small=True)
        met = grown(having, sets.where("rare").drop("rare")).drop("weight", "rest").join(asking.where("rare").select("query_id", "_company", "_places", "own", "node"), "node")
        pairs.append(met.where(other).select("query_id", "id", "ord", score.alias("score")))
        having, asking = grown(having, sets.where("not rare").drop("rare")), asking.where("not rare").drop("rare")
        common.append((having, asking, level))
    rest = scratch.table(reduce(DataFrame.unionByName, pairs).distinct(), "rest", small=True)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    bound = rest.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == n).select("query_id", F.col("score").alias("_bound"))

    # lists of the common sets, alone and with each place; an empty name is no place
    named = lambda c: F.explode(F.concat(F.array(F.lit("")), F.transform(c, lambda x: F.concat(F.lit("at "), x)))).alias("place")
    lists = reduce(DataFrame.unionByName, (q.select("query_id", "_company", "node", F.lit(k).alias("_level"), named("_places")) for _, q, k in common))
    most = F.col("_level") + F.when(F.col("_level") > 0, repeats).otherwise(0) + F.when(F.col("place") != "", 2).otherwise(0)
    lists = lists.join(bound, "query_id", "left").withColumn("_most", most).where((F.col("_most") > 0) & (F.col("_most") >= F.coalesce("_bound", F.lit(0))))
    lists = scratch.table(lists.select("query_id", "_company", "node", "place"), "lists", small=True)
    tokens = scratch.table(lists.select("node", "place").distinct(), "tokens", small=True)
    members = reduce(DataFrame.unionByName, (p.select("id", "ord", "company", "node", "weight", named("places")).join(tokens, ["node", "place"], "left_semi") for p, _, _ in common))
    heads = _first(members, ["node", "place", "weight"], n, (low, high), scratch)
    listed = lists.join(heads, ["node", "place"]).where(other).select("query_id", "id", "ord", (F.col("weight") + F.when(F.col("place") != "", 2).otherwise(0)).alias("score"))
    listed = scratch.table(listed.groupBy("query_id", "id", "ord").agg(F.max("score").alias("score")), "listed", small=True)

    others = listed.unionByName(rest).groupBy("query_id", "id", "ord").agg(F.max("score").alias("score")).where("score > 0")
    return _best(own.unionByName(others.select("query_id", "id", "ord", F.lit(1).alias("tier"), "score")), n)


def _best(rows: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "ord")
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).select("query_id", "id", "tier", "score")


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s\-/]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def fuzzy_match(values: DataFrame, reference: DataFrame, value: str, least: float = 0.6) -> DataFrame:
    """The best entry of ``reference`` (ref_ord, name) for each value by the mean of both coverages of their words.

    Equal names win, ties go to the earlier entry; NULL and values without words match nothing. Words are ordered by the number of names that
    have them, rarest first. A value of n words and a name of m reach ``least`` only with 2 least n m / (n + m) words in common, so the rarest of
    these is among the first words of both, all but as many as are needed less one. Only those are joined, per pair of lengths:
    a common word never makes a pair unless it is needed. The lengths (as many numbers as there are words in the longest name) are literals.
    """
    of_value, of_name = terms(F.col(value)), terms(F.col("name"))
    v = values.select(value).distinct().select(value, F.size(of_value).alias("_n"), (F.size(of_value) > F.size(F.array_distinct(of_value))).alias("_repeats"), F.explode(of_value).alias("_word"))
    r = reference.select("ref_ord", "name", F.size(of_name).alias("_m"), F.explode(F.array_distinct(of_name)).alias("_word"))
    times = r.groupBy("_word").agg(F.count("*").alias("_times"))
    v = v.groupBy(value, "_n", "_repeats", "_word").agg(F.count("*").alias("_c")).join(times, "_word")
    v = v.groupBy(value, "_n", "_repeats").agg(F.sort_array(F.collect_list(F.struct("_times", "_word", "_c"))).alias("_own"))
    r = r.join(times, "_word").groupBy("ref_ord", "name", "_m").agg(F.sort_array(F.collect_list(F.struct("_times", "_word"))).alias("_theirs"))
    m_lengths = sorted(x["_m"] for x in r.select("_m").distinct().collect())
    n_lengths = sorted((x["_n"], x["_repeats"]) for x in v.select("_n", "_repeats").distinct().collect())
    numbers = F.lit(m_lengths) if m_lengths else F.array().cast("array<int>")
    pairs_of = F.array(*(F.struct(F.lit(n).alias("_n"), F.lit(again).alias("_repeats")) for n, again in n_lengths)) if n_lengths else F.array().cast("array<struct<_n:int,_repeats:boolean>>")
    needed = lambda n, m: F.greatest(F.lit(1), F.ceil(2 * least * n * m / (n + m) - 1e-9))
    reaches = lambda n, m, again: (needed(n, m) <= n) & (again | (needed(n, m) <= m))  # noqa: E731  a name may be shorter than its share in repeated words
    left = v.withColumn("_m", F.explode(F.filter(numbers, lambda m: reaches(F.col("_n"), m, F.col("_repeats")))))
    weight = lambda k: F.aggregate(F.slice("_own", k + 1, F.size("_own")), F.lit(0).cast("long"), lambda s, x: s + x["_c"])
    left = left.withColumn("_word", F.explode(F.filter("_own", lambda x, k: weight(k) >= needed(F.col("_n"), F.col("_m"))))).withColumn("_word", F.col("_word._word"))
    right = r.withColumn("_of", F.explode(F.filter(pairs_of, lambda x: reaches(x["_n"], F.col("_m"), x["_repeats"])))).select("*", "_of.*").drop("_of")
    enough = F.when(F.col("_repeats"), 1).otherwise(needed(F.col("_n"), F.col("_m")))
    right = right.withColumn("_word", F.explode(F.filter("_theirs", lambda x, k: F.size("_theirs") - k >= enough))).withColumn("_word", F.col("_word._word"))
    pairs = left.join(right, ["_n", "_m", "_repeats", "_word"])
    common = F.array_intersect(F.transform("_own", lambda x: x["_word"]), F.transform("_theirs", lambda x: x["_word"]))
    pairs = pairs.where(F.get(common, F.lit(0)) == F.col("_word"))  # of the words that two share, one makes the pair
    shared = F.aggregate(F.filter("_own", lambda x: F.array_contains(F.transform("_theirs", lambda y: y["_word"]), x["_word"])), F.lit(0).cast("long"), lambda s, x: s + x["_c"])
    pairs = pairs.select(value, "ref_ord", "name", "_n", "_m", shared.alias("_shared"))
    score = F.when(F.lower(value) == F.lower("name"), 2.0).otherwise((F.col("_shared") / F.col("_n") + F.col("_shared") / F.col("_m")) / 2)
    scored = pairs.withColumn("score", score).where(F.col("score") >= least)
    best = scored.groupBy(value).agg(F.max_by(F.struct("name", "score"), F.struct("score", (-F.col("ref_ord")).alias("_before"))).alias("_best"))
    return best.select(value, F.col("_best.name").alias("name"), F.least(F.col("_best.score"), F.lit(1.0)).alias("score"))


_PIECE = re.compile(rb"[a-z0-9_]+|[^a-z0-9_]+")
_WORD_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_")


def term_trie(reference: list[str]) -> dict:
    """A trie of the terms' pieces: words, and what stands between them."""
    trie: dict = {}
    for place, term in enumerate(dict.fromkeys(reference)):
        node = trie
        for piece in _PIECE.findall(term.encode().lower()):
            node = node.setdefault(piece, {})
        node.setdefault(None, []).append(place)
    return trie


def terms_in(text: str, trie: dict) -> list[int]:
    """Places of the terms that the text holds between word edges, in the list's order. Cost: a step for each piece of the text, and more only inside terms."""
    pieces, found = _PIECE.findall(text.encode("utf-8", "surrogatepass").lower()), set()
    for k, piece in enumerate(pieces):
        # signs have an edge before them only after a word, and after them only before a word
        node, at = trie.get(piece) if k or piece[0] in _WORD_BYTES else None, k
        while node is not None:
            if None in node and (pieces[at][0] in _WORD_BYTES or at + 1 < len(pieces)):
                found.update(node[None])
            at += 1
            node = node.get(pieces[at]) if at < len(pieces) else None
    return sorted(found)


def scan_terms(texts: DataFrame, text: str, key: str, reference: list[str], least: int = 0) -> DataFrame:
    """Rows (key, term) for each term of the list that a text holds as whole words, as the list spells it.

    Letters are compared without case, what stands between a term's words as it is written. Texts of fewer than ``least`` characters and NULL
    hold none; a term that is listed twice counts once. The list goes with the tasks as a trie.
    """
    names, trie = list(dict.fromkeys(reference)), term_trie(reference)

    @F.pandas_udf("array<string>")
    def found(column: pd.Series) -> pd.Series:
        return pd.Series([[names[k] for k in terms_in(x, trie)] if x is not None else [] for x in column])

    long = texts.where(F.length(text) >= least)
    return long.select(key, F.explode(found(F.col(text))).alias("term"))
