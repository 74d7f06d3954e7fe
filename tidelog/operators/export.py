"""Writing results as CSV and JSON: one file for a person, or many for a cluster."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.search import grid

#: The exported names, in order.
CSV_HEADER = "Time,Status,Method,ResolvedClientIp,URL,TimeTakenMs,UserAgent,SourceFile,LineNumber"
JSON_KEYS = {"TimestampLocal": "time", "Status": "status", "Method": "method", "ClientIp": "resolved_client_ip", "Url": "url", "TimeTakenMs": "time_taken_ms", "UserAgent": "user_agent", "SourceFile": "source_file", "LineNumber": "line_number", "RawLine": "raw_line"}


def _iso(ts: Column, zone: str) -> Column:
    """ISO 8601 to seven digits with the offset of ``zone``."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"), _offset(ts, zone))


def _offset(ts: Column, zone: str) -> Column:
    minutes = F.timestamp_diff("MINUTE", ts, F.from_utc_timestamp(ts, zone))
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def _shown(results: DataFrame, zone: str) -> DataFrame:
    return grid(results).withColumn("time", _iso(F.col("timestamp_utc").cast("timestamp"), zone))


def _quoted(c: Column) -> Column:
    """Quoted only if the value holds a comma, a quote or a line feed; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(results: DataFrame, zone: str = "UTC") -> DataFrame:
    """The grid with each row's CSV ``line``."""
    columns = ("time", "status", "method", "resolved_client_ip", "url", "time_taken_ms", "user_agent", "source_file", "line_number")
    return _shown(results, zone).withColumn("line", F.concat_ws(",", *(_quoted(F.col(c)) for c in columns)))


def json_rows(results: DataFrame, keys: Sequence[str] = tuple(JSON_KEYS), zone: str = "UTC") -> DataFrame:
    """``(line_number, json)``: each row as a JSON object that keeps nulls."""
    shown = _shown(results, zone)
    row = F.struct(*(F.col(JSON_KEYS[k]).alias(k) for k in keys))
    return shown.select("line_number", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def export_csv(results: DataFrame, path: str | Path, zone: str = "UTC") -> int:
    """One CSV file, UTF-8 with a byte order mark; rows stream through the driver. Returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(CSV_HEADER + "\r\n")
        for row in csv_lines(results, zone).select("line").toLocalIterator():
            f.write(row["line"] + "\r\n")
            n += 1
    return n


def export_json(results: DataFrame, path: str | Path, zone: str = "UTC") -> int:
    """One compact JSON array; rows stream through the driver. Returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in json_rows(results, zone=zone).select("json").toLocalIterator():
            f.write(("," if n else "") + row["json"])
            n += 1
        f.write("]")
    return n


def write_csv(results: DataFrame, path: str, zone: str = "UTC") -> None:
    """A folder of CSV files, written by the executors, for results of any size."""
    names = dict(zip(("time", "status", "method", "resolved_client_ip", "url", "time_taken_ms", "user_agent", "source_file", "line_number"), CSV_HEADER.split(","), strict=True))
    _shown(results, zone).select(*(F.col(c).alias(n) for c, n in names.items())).write.option("header", "true").option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(results: DataFrame, path: str, zone: str = "UTC") -> None:
    """A folder of files with a JSON object a line."""
    json_rows(results, zone=zone).select("json").write.text(path)
