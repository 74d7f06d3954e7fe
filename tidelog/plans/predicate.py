"""A search request as one Column: the same for raw text, stored entries and live streams."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.text import contains, display_url, equals
from tidelog.plans.request import METHODS, SearchRequest, parse_int

KEYWORD_COLUMNS = ("raw_line", "client_ip", "resolved_client_ip", "uri_stem", "uri_query", "user_agent", "method")


def _blank(x: str | None) -> bool:
    return x is None or not x.strip()


def _no(x: Column) -> Column:
    """Null conditions do not hold."""
    return F.coalesce(x, F.lit(False))


def _instant(value: datetime, zoned: bool) -> Column:
    if zoned:
        return F.lit(value)
    naive = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")


def micros_of_day(ts: Column, zoned: bool) -> Column:
    """Microseconds since midnight UTC; the session's zone plays no part."""
    if zoned:
        return F.pmod(F.unix_micros(ts), F.lit(86_400_000_000))
    return F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def keyword_matches(keyword: str, columns: list[str]) -> Column:
    """The keyword is in one of the text columns, or is the status code."""
    parts = [contains(F.col(c), keyword) for c in KEYWORD_COLUMNS if c in columns]
    n = parse_int(keyword)
    parts.append(_no(F.col("status_code") == (-1 if n is None else n)))
    return reduce(lambda a, b: a | b, parts)


def to_predicate(request: SearchRequest, entries: DataFrame) -> Column:
    """The request's conditions over the columns of ``entries``; true without any."""
    zoned = isinstance(entries.schema["timestamp_utc"].dataType, T.TimestampType)
    ts, r, conds = F.col("timestamp_utc"), request, []
    has = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    span = lambda t: F.lit(t // timedelta(microseconds=1))
    if not _blank(r.keyword):
        conds.append(keyword_matches(r.keyword, entries.columns))
    if r.from_utc is not None:
        conds.append(ts >= _instant(r.from_utc, zoned))
    if r.to_utc is not None:
        conds.append(ts <= _instant(r.to_utc, zoned))
    if r.time_from is not None:
        conds.append(micros_of_day(ts, zoned) >= span(r.time_from))
    if r.time_to is not None:
        conds.append(micros_of_day(ts, zoned) <= span(r.time_to))
    if not _blank(r.method):
        conds.append(equals(F.col("method"), r.method))
    if r.status_code is not None:
        conds.append(F.col("status_code") == r.status_code)
    if not _blank(r.client_ip):
        conds.append(contains(F.col("client_ip"), r.client_ip) | contains(has("resolved_client_ip"), r.client_ip))
    if not _blank(r.url_contains):
        conds.append(contains(display_url(F.col("uri_stem"), F.col("uri_query")), r.url_contains))
    if not _blank(r.user_agent_contains):
        conds.append(contains(F.col("user_agent"), r.user_agent_contains))
    if r.min_time_taken_ms is not None:
        conds.append(F.col("time_taken_ms") >= r.min_time_taken_ms)
    if r.max_time_taken_ms is not None:
        conds.append(F.col("time_taken_ms") <= r.max_time_taken_ms)
    if not _blank(r.username):
        conds.append(contains(has("username"), r.username))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def classify_keyword(keyword: Column) -> Column:
    """:func:`detect_intent` as a Column."""
    from tidelog.functions.client_ip import is_ip

    k = F.coalesce(keyword, F.lit(""))
    n = F.when(k.rlike(r"^\s*[+-]?[0-9]+\s*$"), k.try_cast("int"))
    return (
        F.when((F.contains(k, F.lit(".")) | F.contains(k, F.lit(":"))) & is_ip(F.trim(k)), "ip_address")
        .when(~F.contains(k, F.lit(".")) & _no(n.between(100, 599)), "http_status")
        .when(F.upper(F.trim(k)).isin(*METHODS), "http_method")
        .when(F.contains(k, F.lit("/")) | F.contains(k, F.lit("?")), "uri")
        .otherwise("general_keyword")
    )
