"""Declared schemas: the item table and its records (no inference anywhere)."""

from pyspark.sql import types as T

HISTORY_ENTRY = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("comment", T.StringType()),
])

# Column order of the published item table (23 columns).
ITEM_SCHEMA = T.StructType([
    T.StructField("link", T.StringType(), False),
    T.StructField("scp", T.StringType(), False),
    T.StructField("scp_number", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("series", T.StringType(), False),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("rating", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("creator", T.StringType()),
    T.StructField("url", T.StringType(), False),
    T.StructField("domain", T.StringType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("raw_source", T.StringType()),
    T.StructField("raw_content", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("hubs", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("history", T.ArrayType(HISTORY_ENTRY)),
    T.StructField("content_file", T.StringType()),
    T.StructField("content_sha1", T.StringType()),
    T.StructField("dataset_commit", T.StringType()),
])

ITEM_COLUMNS = [f.name for f in ITEM_SCHEMA.fields]

# Light projection used for search results and lists.
HIT_COLUMNS = ["link", "scp", "scp_number", "title", "rating", "series",
               "tags", "created_at", "creator", "summary"]

# Columns that hold whole texts; pruned unless content is asked for.
HEAVY_COLUMNS = ["raw_source", "raw_content", "markdown"]

# Raw item as found in snapshot content files: loose types, validated later.
RAW_HISTORY_ENTRY = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("comment", T.StringType()),
])

RAW_ITEM = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("scp", T.StringType()),
    T.StructField("scp_number", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("creator", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("raw_source", T.StringType()),
    T.StructField("raw_content", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("hubs", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("history", T.ArrayType(RAW_HISTORY_ENTRY)),
    T.StructField("content_file", T.StringType()),
])

INDEX_ENTRY = T.StructType([T.StructField("content_file", T.StringType())])

VERSION_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("dataset_commit", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("path", T.StringType()),
])
