"""Readers of postings and dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postlake.functions.text import or_default, split_compact, surrogate_key, trim, url_key
from postlake.sources.schemas import GEO, OCCUPATION, POSTING, SHEET_COLUMNS, SKILL
from postlake.sources.sqlite import sqlite_table


def json_postings(spark: SparkSession, path: str) -> DataFrame:
    """An array of postings; broken records keep their text in ``_corrupt_record``."""
    return spark.read.schema(POSTING).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def sheet(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A worksheet as CSV, by its header. None if title, company or URL is missing. Rows without title or URL are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    given = {c.strip(): c for c in raw.columns}
    if not {"Title", "Company", "URL"} <= {*given}:
        return None
    cell = lambda title: trim(F.col(f"`{given[title]}`")) if title in given else F.lit(None).cast("string")
    columns = {to: cell(title) for title, to in SHEET_COLUMNS.items()}
    columns |= {"company": or_default(columns["company"], name), "status": or_default(columns["status"], "active")}
    columns |= {k: F.coalesce(split_compact(columns[k]), F.array().cast("array<string>")) for k in ("skills", "certifications")}
    columns |= {k: F.nullif(columns[k], F.lit("")) for k in ("requisitionId", "postedDate", "salary", "employmentType", "statusChangedDate", "scrapedAt")}
    rows = raw.select(*(c.alias(k) for k, c in columns.items())).where((or_default(F.col("title"), "") != "") & (or_default(F.col("url"), "") != ""))
    return rows.withColumn("id", surrogate_key(F.lit(name), F.col("url")))


def sheets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All usable worksheets, one after the other."""
    found = [df for name, path in paths.items() if (df := sheet(spark, path, name)) is not None]
    if not found:
        raise ValueError("no sheet has the columns Title, Company and URL")
    return reduce(DataFrame.unionByName, found)


def scraped(rows: DataFrame) -> DataFrame:
    """Postings of the scraper's table (url, company, title, status, first_seen, last_seen, status_changed_date)."""
    kept = rows.where((or_default(F.col("title"), "") != "") & (or_default(F.col("url"), "") != ""))
    return kept.select(
        url_key(F.col("url")).alias("id"),
        "title",
        "company",
        "url",
        or_default(F.col("status"), "active").alias("status"),
        F.col("first_seen").alias("postedDate"),
        F.col("last_seen").alias("scrapedAt"),
        F.col("status_changed_date").alias("statusChangedDate"),
    ).orderBy("company", F.desc("scrapedAt"))


def sqlite_scraped(spark: SparkSession, path: str, table: str = "scraped_jobs", partitions: int = 8) -> DataFrame:
    """The scraper's table read from its SQLite file, in ranges of rows."""
    return scraped(sqlite_table(spark, path, table, partitions))


def jdbc_scraped(spark: SparkSession, url: str, table: str = "scraped_jobs", **options: str) -> DataFrame:
    """The scraper's table over JDBC; the driver's jar comes with the session."""
    return scraped(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def dictionary(spark: SparkSession, path: str, value: T.DataType, broken: bool = False) -> DataFrame:
    """A JSON object used as a map, as rows (key, value...). A missing file gives an empty table, and so does one that isn't an object.

    The file is parsed to a VARIANT once and its entries become rows, so that each is cast to the schema by itself: entries that aren't objects, or whose
    fields have other types, are left out, or are the rows (key, entry) that ``broken`` asks for. Fields that an entry lacks are NULL.
    """
    try:
        text = spark.read.option("wholetext", True).text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = spark.createDataFrame([], T.StructType([T.StructField("value", T.StringType())]))
    parsed = text.select(F.try_parse_json("value").alias("file")).where(F.schema_of_variant("file").startswith("OBJECT"))
    entries = parsed.lateralJoin(spark.tvf.variant_explode(F.col("file").outer())).select("key", F.col("value").alias("entry"))
    read = entries.select("key", "entry", F.when(F.schema_of_variant("entry").startswith("OBJECT"), F.try_variant_get("entry", "$", value.simpleString())).alias("read"))
    if broken:
        return read.where("read is null").select("key", F.col("entry").cast("string").alias("entry"))
    return read.where("read is not null").select("key", "read.*")


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dictionary that ``sinks.write_dictionary`` wrote."""
    return spark.read.schema(schema).json(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary of geocoded places: key and the parts of ``GEO``."""
    return dictionary(spark, path, GEO)


def known_skills(spark: SparkSession, path: str) -> DataFrame:
    """The prepared dictionary of skills: key, normalized and onet."""
    return dictionary(spark, path, SKILL)


def occupations(spark: SparkSession, path: str) -> DataFrame:
    """The map of matched occupations: a posting's id as key, and the parts of ``OCCUPATION``."""
    return dictionary(spark, path, OCCUPATION)


def batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Processed batches with the number in their file name."""
    rows = spark.read.schema(POSTING).option("multiLine", True).json(f"{folder}/batch-*-processed.json")
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch-(\d+)-processed", 1).cast("int"))
