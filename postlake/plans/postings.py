"""Postings made from the star schema, in Spark and as a SQL prefix, so that every query works on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlake.sources.tables import table

#: Titles are made of these words by the order's key; they exercise the role patterns.
TITLE_HEADS = ("Wireline", "ROV", "Senior Drilling", "Coiled Tubing", "Welding", "Offshore", "Accounting", "Field")
TITLE_TAILS = ("Operator", "Engineer", "Supervisor", "Specialist", "Technician")
#: Prefixes of raw locations by the nation's key.
PLACE_CODES = ("US-TX-", "CA-AB-", "BR-RJ-", "GB-", "AE-", "XX-", "")


def pick(options: tuple[str, ...], key):
    return F.get(F.array(*(F.lit(x) for x in options)), (F.pmod(key, F.lit(len(options)))).cast("int"))


def sql_pick(options: tuple[str, ...], key: str) -> str:
    return f"list_extract([{', '.join(repr(x) for x in options)}], CAST(({key}) % {len(options)} AS INTEGER) + 1)"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting per order. An unknown status is NULL for odd keys, so it must count as active. Orders without lines
    have no skills and no places."""
    nation = table(spark, sf_dir, "nation")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey")
        .join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
        .join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.sort_array(F.collect_set("p_type")).alias("skills"), F.sort_array(F.collect_set("s_nationkey")).alias("nations"))
    )
    empty = F.array().cast("array<string>")
    place = lambda k: F.concat(pick(PLACE_CODES, k), F.lit("NATION "), k.cast("string"))
    places = F.coalesce(F.transform("nations", place), empty)
    status = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "P", "paused").when(F.col("o_orderkey") % 2 == 0, "active")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), "c_nationkey")
        .join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
        .withColumn("id", F.col("o_orderkey"))
        .join(lines, "id", "left")
        .select(
            "id",
            F.col("id").alias("ord"),
            F.concat(pick(TITLE_HEADS, F.col("id")), F.lit(" "), pick(TITLE_TAILS, F.col("o_custkey"))).alias("title"),
            F.col("n_name").alias("company"),
            F.col("r_name").alias("region"),
            status.alias("status"),
            F.col("o_orderpriority").alias("employment_type"),
            F.col("o_orderdate").alias("posted"),
            F.concat(F.lit("locations\n"), F.array_join(places, "\n")).alias("location"),
            F.coalesce("skills", empty).alias("skills"),
        )
    )


POSTINGS = f"""
line AS (
  SELECT l_orderkey AS k, list_sort(list(DISTINCT p_type)) AS skills, list_sort(list(DISTINCT s_nationkey)) AS nations
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
postings AS (
  SELECT o_orderkey AS id, o_orderkey AS ord,
    {sql_pick(TITLE_HEADS, 'o_orderkey')} || ' ' || {sql_pick(TITLE_TAILS, 'o_custkey')} AS title,
    n_name AS company, r_name AS region,
    CASE WHEN o_orderstatus = 'F' THEN 'removed' WHEN o_orderstatus = 'P' THEN 'paused' WHEN o_orderkey % 2 = 0 THEN 'active' END AS status,
    o_orderpriority AS employment_type, o_orderdate AS posted,
    'locations' || chr(10) || coalesce(array_to_string(list_transform(nations, lambda x: {sql_pick(PLACE_CODES, 'x')} || 'NATION ' || x), chr(10)), '') AS location,
    coalesce(skills, []) AS skills
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN line ON k = o_orderkey),
active AS (SELECT * FROM postings WHERE coalesce(status, '') NOT IN ('removed', 'paused'))"""

#: Formatted names of a raw place, as SQL on ``raw``; the general parser is in functions.location.
FORMATTED = """CASE WHEN raw LIKE 'US-%' THEN city || ', TX' WHEN raw LIKE 'CA-%' THEN city || ', AB, Canada' WHEN raw LIKE 'BR-%' THEN city || ', Brazil'
  WHEN raw LIKE 'GB-%' THEN city || ', United Kingdom' WHEN raw LIKE 'AE-%' THEN city || ', United Arab Emirates' WHEN raw LIKE 'XX-%' THEN city ELSE raw END"""
PLACES = f"""
raws AS (SELECT id, ord, company, p AS place, raw FROM (
  SELECT id, ord, company, generate_subscripts(parts, 1) - 1 AS p, unnest(parts) AS raw
  FROM (SELECT id, ord, company, list_filter(string_split(location, chr(10)), lambda x: trim(x) <> '' AND lower(trim(x)) <> 'locations') AS parts FROM active))),
places AS (SELECT id, ord, company, place, raw, {FORMATTED} AS name FROM (SELECT *, 'Nation ' || regexp_extract(raw, '([0-9]+)$', 1) AS city FROM raws))"""
