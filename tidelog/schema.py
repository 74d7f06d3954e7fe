"""Column names and types of the tables that the library reads, makes and stores."""

from __future__ import annotations

from pyspark.sql import types as T

#: One parsed request.
ENTRY_FIELDS = (
    ("id", T.LongType()),
    ("source_id", T.LongType()),
    ("file_id", T.LongType()),
    ("source_path", T.StringType()),
    ("line_number", T.LongType()),
    ("timestamp_utc", T.TimestampType()),
    ("server_ip", T.StringType()),
    ("method", T.StringType()),
    ("uri_stem", T.StringType()),
    ("uri_query", T.StringType()),
    ("server_port", T.IntegerType()),
    ("username", T.StringType()),
    ("client_ip", T.StringType()),
    ("resolved_client_ip", T.StringType()),
    ("user_agent", T.StringType()),
    ("referer", T.StringType()),
    ("status_code", T.IntegerType()),
    ("sub_status_code", T.IntegerType()),
    ("win32_status", T.IntegerType()),
    ("time_taken_ms", T.IntegerType()),
    ("bytes_sent", T.LongType()),
    ("bytes_received", T.LongType()),
    ("host", T.StringType()),
    ("protocol_version", T.StringType()),
    ("cookie", T.StringType()),
    ("forwarded_for", T.StringType()),
    ("real_client_ip", T.StringType()),
    ("raw_line", T.StringType()),
    ("additional_fields", T.MapType(T.StringType(), T.StringType(), True)),
    ("is_complete_line", T.BooleanType()),
)
ENTRY = T.StructType([T.StructField(n, t) for n, t in ENTRY_FIELDS])
ENTRY_COLUMNS = [n for n, _ in ENTRY_FIELDS]

#: Columns that the store does not keep.
NOT_STORED = ("real_client_ip", "additional_fields", "is_complete_line")
STORED = T.StructType([f for f in ENTRY.fields if f.name not in NOT_STORED])

LINE = T.StructType([
    T.StructField("source_path", T.StringType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_complete_line", T.BooleanType()),
])

SOURCES = T.StructType([
    T.StructField("source_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("include_subfolders", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("last_used_at", T.TimestampType()),
])

LOG_FILES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("last_write_utc", T.TimestampType()),
    T.StructField("indexed_length", T.LongType()),
    T.StructField("indexed_line_count", T.LongType()),
    T.StructField("physical_lines", T.LongType()),
    T.StructField("is_fully_indexed", T.BooleanType()),
    T.StructField("fields_header", T.StringType()),
    T.StructField("prefix_length", T.LongType()),
    T.StructField("prefix_sha256", T.StringType()),
    T.StructField("last_indexed_at", T.TimestampType()),
])
