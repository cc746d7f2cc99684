"""Schemas of the entities; readers never infer them."""

from pyspark.sql import types as T

SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content_text", T.StringType()), T.StructField("content_items", T.ArrayType(T.StringType()))])
STRUCTURED = T.StructType([T.StructField("sections", T.ArrayType(SECTION)), T.StructField("extractedSkills", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
POSTING = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("id", "title", "company", "location", "description", "url", "requisitionId", "postedDate")]
    + [T.StructField(x, T.ArrayType(T.StringType())) for x in ("skills", "certifications")]
    + [T.StructField(x, T.StringType()) for x in ("salary", "employmentType", "status", "statusChangedDate", "scrapedAt")]
    + [T.StructField("structuredDescription", STRUCTURED), T.StructField("_corrupt_record", T.StringType())]
)
GEO = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("original", "mapboxPlaceName", "city", "state", "stateCode", "country", "countryCode", "postalCode")]
    + [T.StructField("coordinates", T.StructType([T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType())])), T.StructField("placeType", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]
)
SKILL = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("onet", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType())]))])
OCCUPATION = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("match_type", "role_id", "role_name", "confidence", "reasoning", "onet_code", "onet_title")]
    + [T.StructField("is_priority", T.BooleanType()), T.StructField("match_count", T.LongType())]
)
# Column titles of a sheet and the posting's columns.
SHEET_COLUMNS = {
    "Title": "title", "Company": "company", "Location": "location", "Description": "description", "URL": "url", "Requisition ID": "requisitionId",
    "Posted Date": "postedDate", "Skills": "skills", "Certifications": "certifications", "Salary": "salary", "Employment Type": "employmentType",
    "Status": "status", "Status Changed Date": "statusChangedDate", "Scraped At": "scrapedAt",
}
