"""Near-duplicate documents: HyperMinHash sketches, banded registers, exact confirmation.

A document's set holds its distinct five-word shingles (see ``words``). A sketch has 128 registers: the top
seven bits of a shingle's hash name a bucket, and the bucket's smallest remainder is kept as its count of
leading zeros (6 bits) and the 10 bits after the first one (the mantissa), 16 bits in all. Four registers make
one 64-bit band, so a sketch is 32 longs. A band's key is made of its four smallest remainders as they are, as short texts
fill few registers, and bands of one register of 16 bits would be equal by chance more often than the input grows. Two sets of
Jaccard 0.85 miss each other in all 32 bands with a probability below 1e-9, of 0.8 below 1e-7.

Steps, each a Spark job over the whole table:

1. sketch every text; texts with equal sets are one class from here on, whatever their number;
2. count the classes in each band bucket; the hub of a bucket is its class that meets most others over all its
   buckets (copies gather around the text they were made from);
3. candidate pairs: every class with the hubs of its buckets, and within buckets of at most ``SMALL`` classes all
   pairs (at most (SMALL - 1)/2 for each row), but those whose sizes differ by more than the limit allows;
4. the collision-corrected estimate of Jaccard removes pairs six standard deviations below the limit;
5. the others are confirmed on the full shingle sets, a hub's set being sent once for ``SALT`` partners; then components are computed;
6. classes of larger buckets that still hold several components are dealt anew, by their rarest shingles: two sets that
   meet the limit share so many that of each the rarest ones, all but as many as are needed less one, have one in common
   (a prefix filter: it loses nothing). What one component has alone comes first in that order and makes no bucket. So a line that many
   short texts have makes no pairs. Pairs of different components in new buckets of at most ``SMALL`` sets go through 4 and 5;
7. new buckets that are larger are joined to families, and a family's classes are compared across
   components, exactly, in blocks: a family is cut by size and
   into chunks, a task takes two chunks at a time, drops pairs by their estimates and counts the shared shingles
   of the rest with matrix products. It emits one link for two components at most.

So copies in one component are never expanded into all their pairs, no list of all pairs is ever made, and every pair that shares a
bucket is either in one component or compared. Step 7 grows with the square of a family's classes if these are alike but not
near copies, at some 0.1 microseconds a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlake.llm.components import connected_components
from postlake.llm.rows import bounded_batches, with_ids
from postlake.llm.words import hash_cache, intersection_size, mix, shingle_set
from postlake.sources.scratch import Scratch

BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
#: A random register of one set equals that of another: equal zero counts (about 1 in 3) and equal mantissas.
CHANCE = 2.0**-MANTISSA_BITS / 3
SMALL = 16
#: Partners that a hub's set is sent for at once.
SALT = 1024
#: Classes and bytes of sets in a chunk of a family; components from ``APART`` classes have chunks of their own.
CHUNK, CHUNK_BYTES, APART = 2048, 16 << 20, 256
#: Shingles, columns of a matrix, and pairs that are counted at once.
_COLUMNS, _PAIRS = 1024, 4_000_000
#: Link if 100 * shared >= PERCENT * union, unless a caller gives another percentage.
PERCENT = 85


#: Odd factors for the smallest hashes of a band's registers.
_FACTORS = mix(np.arange(1, BAND + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingles that a batch of ``_spread`` has, unless one text has more.
_SPREAD = 1 << 20


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A number for each band of a sorted set of hashes, equal where the smallest hashes of all its buckets are; 0 for an empty band.

    Hashes begin with their bucket's number, so keys of different bands differ, but for one chance in 2^64.
    """
    least = np.zeros(1 << BUCKET_BITS, dtype=np.uint64)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        least[bucket[first]] = np.maximum(shingles[first], np.uint64(1))
    least = least.reshape(-1, BAND)
    return np.where(least.any(axis=1), np.maximum(mix((least * _FACTORS).sum(axis=1, dtype=np.uint64)), np.uint64(1)), np.uint64(0))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 128 registers of a sorted set of hashes; 0 marks an empty bucket."""
    out = np.zeros(1 << BUCKET_BITS, dtype=np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        value = (shingles[first] << np.uint64(BUCKET_BITS)) >> np.uint64(BUCKET_BITS)
        bits = np.minimum(np.frexp(value.astype(np.float64))[1], 64 - BUCKET_BITS)
        zeros = 64 - BUCKET_BITS - bits
        shift = np.maximum(bits - 1 - MANTISSA_BITS, 0).astype(np.uint64)
        mantissa = (value >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
        out[bucket[first]] = (((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, less what chance makes equal; and the buckets that they rest on."""
    used = (a > 0) | (b > 0)
    n = np.maximum(used.sum(axis=1), 1)
    equal = ((a == b) & used).sum(axis=1) / n
    return np.clip((equal - CHANCE) / (1 - CHANCE), 0, 1), n


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = hash_cache()
    for batch in batches:
        sizes, digests, bands, keys = [], [], [], []
        for text in batch["text"]:
            shingles = shingle_set(text, cache)
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            bands.append(registers(shingles).view(np.int64))
            keys.append(band_keys(shingles).view(np.int64))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests, "bands": bands, "keys": keys})


def _near(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of registers aren't six standard deviations below the limit."""
    j, n = estimate(a, b)
    return j >= limit - 6 * np.sqrt(limit * (1 - limit) / n)


def _close_enough(limit: float):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.array(batch[k].tolist(), dtype=np.int64).view(np.uint16) for k in ("bands_a", "bands_b"))
                yield batch.loc[_near(a, b, limit), ["a", "b"]]

    return keep


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = hash_cache()
    for batch in batches:
        yield pd.DataFrame({"id": batch["doc_id"], "shingles": [shingle_set(x, cache).tobytes() for x in batch["text"]]})


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each shingle of each set."""
    for batch in batches:
        sizes = batch["shingles"].map(len).to_numpy() // 8
        part = np.cumsum(sizes) // _SPREAD
        for k in np.unique(part):
            some, times = batch[part == k], sizes[part == k]
            yield pd.DataFrame({"set": np.repeat(some["set"].to_numpy(), times), "component": np.repeat(some["component"].to_numpy(), times), "shingle": np.frombuffer(b"".join(some["shingles"]), dtype=np.int64)})


def _rarest(sets: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (key, id, component, size, n): for each set (set, id, size, shingles) of the ``members`` (id, component) the rarest of its shingles, with the sets that have it among theirs.

    Two sets of different components that meet the limit share ``needed`` shingles of each at least, all of which occur in several components. In one
    order, by number of sets, the first of these is therefore among the first of both sets' shingles that occur in several components, ``needed`` less one
    left out. Keys of one component only are left out.
    """
    spread = scratch.table(sets.join(members, "id").select("set", "component", "shingles").mapInPandas(_spread, "set long, component long, shingle long"), "spread")
    several = spread.groupBy("shingle").agg(F.count("*").alias("times"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle", "times")
    shared = spread.select("set", "shingle").join(several, "shingle").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    needed = F.ceil(F.col("size") * percent / 100)
    taken = (F.size("shared") - needed + 1).cast("int")
    rare = sets.select("set", "id", "size").join(members, "id").join(shared, "set").where(taken > 0).select("id", "component", "size", F.explode(F.slice("shared", F.lit(1), taken)).alias("x"))
    rare = scratch.table(rare.select("id", "component", "size", F.col("x.shingle").alias("key")), "rare")
    scratch.drop("spread")
    mixed = rare.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "n")
    return scratch.table(rare.join(mixed, "key"), "rarest")


def _confirm(percent: int):
    """Pairs (a, b) that are linked, from rows in order: a hub (b is null) with its sets, then its partners with theirs.

    An id has several sets only if it has several texts.
    """

    def close(x: np.ndarray, y: np.ndarray) -> bool:
        shared = intersection_size(x, y)
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, of = [], None
        for batch in batches:
            linked = []
            for a, b, data in zip(batch["a"], batch["b"], batch["shingles"]):
                own = np.frombuffer(data, dtype=np.uint64)
                if pd.isna(b):
                    hub, of = [*hub, own] if a == of else [own], a
                linked.append(not pd.isna(b) and any(close(x, own) for x in hub))
            out = batch.loc[linked, ["a", "b"]]
            yield out.astype("int64") if len(out) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return confirm


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets.

    Shingles found in many of both are counted with matrix products, the others by listing where they meet.
    """
    n, m = len(left), len(right)
    owner_l, owner_r = np.repeat(np.arange(n), [len(x) for x in left]), np.repeat(np.arange(m), [len(x) for x in right])
    names, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    place_l, place_r = place[: len(owner_l)], place[len(owner_l) :]
    times_l, times_r = np.bincount(place_l, minlength=len(names)), np.bincount(place_r, minlength=len(names))
    meets = times_l * times_r
    many = np.flatnonzero(meets * 50 > n * m)
    out = np.zeros((n, m), dtype=np.float32)
    column = np.full(len(names), -1)
    for lo in range(0, len(many), _COLUMNS):
        some = many[lo : lo + _COLUMNS]
        column[some] = np.arange(len(some))
        parts = []
        for owner, at, size in ((owner_l, place_l, n), (owner_r, place_r, m)):
            hit = column[at] >= 0
            matrix = np.zeros((size, len(some)), dtype=np.float32)
            matrix[owner[hit], column[at[hit]]] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
        column[some] = -1
    few = (meets > 0) & (meets * 50 <= n * m)
    keep_l, keep_r = few[place_l], few[place_r]
    owner_l, place_l, owner_r, place_r = owner_l[keep_l], place_l[keep_l], owner_r[keep_r], place_r[keep_r]
    by = np.argsort(place_r, kind="stable")
    owner_r, begin = owner_r[by], np.searchsorted(place_r[by], place_l)
    sizes = times_r[place_l]
    cuts = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + _PAIRS, side="right")))
        k = sizes[lo:hi]
        at = np.repeat(begin[lo:hi] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        out += np.bincount(np.repeat(owner_l[lo:hi], k) * m + owner_r[at], minlength=n * m).reshape(n, m)
        lo = hi
    return out


def block_links(left: pd.DataFrame, right: pd.DataFrame | None, percent: int) -> pd.DataFrame:
    """The pairs (a, b) of components that some link joins, among rows (id, component, bands, shingles) of two chunks, or of one."""
    inner = right is None
    right = left if inner else right
    regs = [np.stack([np.frombuffer(np.asarray(x, dtype=np.int64).tobytes(), dtype=np.uint16) for x in t["bands"]]) for t in (left, right)]
    parts = [t["component"].to_numpy(dtype=np.int64) for t in (left, right)]
    ids = [t["id"].to_numpy(dtype=np.int64) for t in (left, right)]
    near = np.zeros((len(left), len(right)), dtype=bool)
    for x in range(len(left)):
        others = np.flatnonzero((parts[1] != parts[0][x]) & (ids[1] > ids[0][x] if inner else True))
        if len(others):
            near[x, others] = _near(regs[0][x][None], regs[1][others], percent / 100)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sets = [[np.frombuffer(t["shingles"].iloc[k], dtype=np.uint64) for k in some] for t, some in ((left, rows), (right, columns))]
    near = near[np.ix_(rows, columns)]
    size_l, size_r = (np.array([len(x) for x in some], dtype=np.int64) for some in sets)
    if near.sum() * 20 < near.size:
        i, j = np.nonzero(near)
        shared = np.array([intersection_size(sets[0][a], sets[1][b]) for a, b in zip(i, j)], dtype=np.int64)
        ok = 100 * shared >= percent * (size_l[i] + size_r[j] - shared)
        i, j = i[ok], j[ok]
    else:
        shared = np.rint(shared_counts(*sets)).astype(np.int64)
        i, j = np.nonzero(near & (100 * shared >= percent * (size_l[:, None] + size_r[None, :] - shared)))
    a, b = parts[0][rows[i]], parts[1][columns[j]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _compare(percent: int):
    """Links within each block; the rows of a block follow each other."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["side"] == 0]
        return block_links(left, None if rows["inner"].iloc[0] else rows[rows["side"] == 1], percent)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, rows in batch.groupby(["family", "block"], sort=False):
                if held and (held[0]["family"].iloc[0], held[0]["block"].iloc[0]) != (rows["family"].iloc[0], rows["block"].iloc[0]):
                    yield links(pd.concat(held))
                    held = []
                held.append(rows)
        if held:
            yield links(pd.concat(held))

    return compare


def _thin(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, but fewer: each b keeps its smallest partner, and its other partners are linked to that one.

    A b has at most one hub and ``SMALL`` partners in each band's bucket. Copies that share their hubs give the same links between these.
    """
    met = links.groupBy("b").agg(F.collect_set("a").alias("met")).select("b", "met", F.array_min("met").alias("low"))
    hubs = met.select(F.col("low").alias("a"), F.explode("met").alias("b")).where("a <> b").distinct()
    return met.select(F.col("low").alias("a"), "b").unionByName(hubs)


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents`` (doc_id, text; others ignored).

    Texts are linked from a Jaccard similarity of ``percent`` hundredths. component_id is the smallest doc_id that links reach, kept marks that one. A null, empty or blank text has no
    shingles and is its own component. A row without doc_id has no component and is kept. Rows with one doc_id
    count as one document in the links. An empty table gives an empty result. Long texts are taken whole: a task holds a text's shingles at a time, and the
    sets that it compares, whose sizes are counted first. Equal texts are one class, whose id is their smallest doc_id, so ties can't occur.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "near")
    bounded_batches(spark)
    docs = documents.select("doc_id", "text")
    sketches = scratch.table(docs.mapInPandas(_sketch, "doc_id long, n_shingles long, digest binary, bands array<long>, keys array<long>"), "sketches")
    classes = sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = scratch.table(classes, "classes", small=True)
    heads = sketches.join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "bands", "keys", "n_shingles")
    heads = scratch.table(heads.distinct(), "heads")

    rows = heads.select("id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key")).where("key <> 0").distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = scratch.table(rows.join(shared, "key"), "rows")
    central = scratch.table(rows.groupBy("id").agg(F.sum("n").alias("met"), F.min("size").alias("low"), F.max("size").alias("high")), "central", small=True)
    rows = scratch.table(rows.drop("size").join(central, "id"), "ranked")
    scratch.drop("rows")

    #: Whether the sizes of a and b allow a link; an id with several texts has several.
    sizes_meet = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))

    def side(members: DataFrame, x: str, *more: str) -> DataFrame:
        return members.select("key", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("low", "high", *more)))

    def with_hubs(members: DataFrame, hub_of: DataFrame) -> DataFrame:
        """Pairs (hub, other) of each bucket; hub_of: the rows among which a bucket's hub is chosen."""
        hubs = hub_of.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"), "low", "high")).alias("top")).select("key", (-F.col("top.minus")).alias("a"), F.col("top.low").alias("low_a"), F.col("top.high").alias("high_a"))
        return side(members, "b").join(hubs, "key").where(F.col("a") != F.col("b")).where(sizes_meet).select("a", "b")

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        return scratch.table(with_ids(docs, ids.select(F.col("id").alias("doc_id"))).mapInPandas(_sets, "id long, shingles binary").distinct(), name)

    def confirmed(pairs: DataFrame, name: str = "") -> DataFrame:
        near = pairs.distinct().join(heads.select(F.col("id").alias("b"), F.col("bands").alias("bands_b")), "b").join(heads.select(F.col("id").alias("a"), F.col("bands").alias("bands_a")), "a")
        near = scratch.table(near.mapInPandas(_close_enough(percent / 100), "a long, b long"), f"{name}near", small=True)
        sets = sets_of(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct(), f"{name}near-sets")
        salts = near.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
        partners = near.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
        partners = partners.join(sets.select(F.col("id").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
        hubs = salts.join(sets.select(F.col("id").alias("a"), "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
        rows = hubs.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
        return scratch.table(rows.mapInPandas(_confirm(percent), "a long, b long"), f"{name}links", small=True)

    small = rows.where(F.col("n") <= SMALL)
    within = side(small, "a").join(side(small, "b"), "key").where("a < b").where(sizes_meet).select("a", "b")
    links = confirmed(with_hubs(rows, rows).unionByName(within))
    components = connected_components(_thin(links), scratch, "cc")

    # classes of larger buckets with several components, dealt anew by their rarest shingles
    placed = rows.where(F.col("n") > SMALL).select("key", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    members = scratch.table(placed.join(mixed, "key").select("id", "component").distinct(), "mixed", small=True)
    sets = sets_of(members.select("id"), "member-texts").select(F.monotonically_increasing_id().alias("set"), "id", F.expr("octet_length(shingles) div 8").alias("size"), "shingles")
    sets = scratch.table(sets, "member-sets")
    scratch.drop("member-texts")
    rare = _rarest(sets, members, percent, scratch)
    few = rare.where(F.col("n") <= SMALL).withColumns({"low": F.col("size"), "high": F.col("size")})
    within = side(few, "a", "component").join(side(few, "b", "component"), "key").where("a < b and component_a <> component_b").where(sizes_meet).select("a", "b")
    of = lambda x: members.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    found = confirmed(within, "rare-").join(of("a"), "a").join(of("b"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))

    # families: the classes of buckets that are still larger, joined through these buckets
    placed = rare.where(F.col("n") > SMALL).select("key", "id", "component").distinct()
    placed = scratch.table(placed.join(placed.groupBy("key").agg(F.min("id").alias("first")), "key").select("id", "component", "first"), "alike")
    families = connected_components(_thin(placed.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))), scratch, "families").withColumnRenamed("component", "family")
    members = placed.select("id", "component").distinct().join(families, "id").join(heads.select("id", "bands", "n_shingles"), "id")
    # chunks: a large component by itself, the others together; each by size, then by number and bytes
    apart = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    members = members.join(apart, ["family", "component"]).withColumn("whole", F.when(F.col("n") >= APART, F.col("component")).otherwise(F.lit(None).cast("long")))
    members = members.withColumn("step", F.floor(F.log("n_shingles") / math.log(100 / min(percent, 99))))
    chunk = F.struct(F.coalesce("whole", F.lit(-1)).alias("of"), F.col("whole").isNull().alias("many"), "step")
    members = members.withColumn("chunk", chunk).select("family", "id", "component", "bands", "n_shingles", "chunk")
    sizes = members.groupBy("family", "chunk").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") * 8 / CHUNK_BYTES)).cast("int").alias("pieces"))
    members = scratch.table(members.join(sizes, ["family", "chunk"]).select("family", "id", "component", "bands", "chunk", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")), "members")
    one = scratch.table(members.select("family", F.struct("chunk", "piece").alias("x")).distinct(), "chunks", small=True)
    blocks = one.join(one.select("family", F.col("x").alias("y")), "family").where("x <= y and abs(x.chunk.step - y.chunk.step) <= 1 and not (x.chunk.of = y.chunk.of and not x.chunk.many and not y.chunk.many)")
    blocks = blocks.select("family", "x", "y", F.xxhash64("x", "y").alias("block"), (F.col("x") == F.col("y")).alias("inner"))
    sides = blocks.select("family", "block", "inner", F.col("x").alias("at"), F.lit(0).alias("side")).unionByName(blocks.where("not inner").select("family", "block", "inner", F.col("y").alias("at"), F.lit(1).alias("side")))
    rows = members.withColumn("at", F.struct("chunk", "piece")).join(sides, ["family", "at"]).join(sets.select("id", "shingles"), "id")
    rows = rows.select("family", "block", "inner", "side", "id", "component", "bands", "shingles").repartition("family", "block").sortWithinPartitions("family", "block")
    joined = scratch.table(rows.mapInPandas(_compare(percent), "a long, b long").unionByName(found).distinct(), "family-links", small=True)
    wider = connected_components(joined, scratch, "wider").select(F.col("id").alias("component"), F.col("component").alias("wider"))

    placed = classes.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(wider, "component", "left").select("digest", F.coalesce("wider", "component").alias("component_id"))
    # equal ids in several classes count as one document
    return (
        sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(placed, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
