"""Scalar expressions of the log format and of the filters, all built from Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s*$"
#: Runs of anything but white space, in which quotes may hide white space.
TOKEN_RUN = r'(?U)((?:[^\s"]|"[^"]*(?:"|\z))+)'
HEADER_JUNK = r"(?i)cs\(|sc\(|[)_-]"


def blank(x: Column) -> Column:
    """Null, empty or nothing but Unicode white space."""
    return F.coalesce(x.rlike(BLANK), F.lit(True))


def contains(x: Column, part: str) -> Column:
    """Case-insensitive substring; false for null."""
    return F.coalesce(F.contains(F.lower(x), F.lit(part.lower())), F.lit(False))


def equals(x: Column, other: str) -> Column:
    """Case-insensitive equality; false for null."""
    return F.coalesce(F.upper(x) == other.upper(), F.lit(False))


def tokenize(line: Column) -> Column:
    """Tokens of a log line. A quote opens or closes quoting anywhere; a leading quote is
    dropped, and a token that has a later quote ends before its last one.

    Most lines have no quote and are split outright; only tokens that have one are trimmed of it.
    """
    unquoted = lambda t: F.regexp_replace(F.regexp_replace(t, '^"', ""), r'(?s)\A(.+)".*\z', "$1")
    has_quote = lambda x: F.contains(x, F.lit('"'))
    ascii_only = F.length(line) == F.octet_length(line)
    quoted = F.transform(F.regexp_extract_all(line, F.lit(TOKEN_RUN), 1), lambda t: F.when(has_quote(t), unquoted(t)).otherwise(t))
    plain = F.when(ascii_only, F.split(line, r"[ \t-\r]+")).otherwise(F.split(line, r"(?U)\s+"))
    return F.when(has_quote(line), quoted).otherwise(F.filter(plain, lambda t: t != ""))


def normalize_header(name: Column) -> Column:
    """Column names compare without ``cs(``, ``sc(``, brackets, dashes, underscores and case."""
    return F.lower(F.regexp_replace(name, HEADER_JUNK, ""))


def _starts_plainly(x: Column) -> Column:
    """The first character is visible ASCII: such a text is not blank, and no pattern need be tried."""
    return F.coalesce(F.substring(x, 1, 1).between("!", "~"), F.lit(False))


def value_or_null(x: Column) -> Column:
    """Null for a missing value: blank or a lone dash."""
    return F.when((x != "-") & (_starts_plainly(x) | ~blank(x)), x)


def strip(x: Column) -> Column:
    """Without Unicode white space on either side."""
    plain = _starts_plainly(x) & _starts_plainly(F.substring(x, -1, 1))
    return F.when(plain, x).otherwise(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def to_int(x: Column) -> Column:
    return x.try_cast("int")


def to_long(x: Column) -> Column:
    return x.try_cast("bigint")


def to_date(x: Column) -> Column:
    """The day of an exact ``yyyy-MM-dd``; null if it is something else or no such day."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


def to_timestamp(date: Column, time: Column) -> Column:
    """UTC instant of an exact ``yyyy-MM-dd`` and ``HH:mm:ss``, whatever the session's zone; null if either is missing or wrong."""
    part = lambda at: F.substring(time, at, 2).cast("long")
    seconds = F.unix_date(to_date(date)).cast("long") * 86_400 + part(1) * 3600 + part(4) * 60 + part(7)
    return F.when(time.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), F.timestamp_seconds(seconds))


def display_url(stem: Column, query: Column) -> Column:
    stem = F.coalesce(stem, F.lit(""))
    return F.when(blank(query) | (query == "-"), stem).otherwise(F.concat(stem, F.lit("?"), query))


def display_status(code: Column, sub: Column) -> Column:
    whole = code.cast("string")
    return F.when(code.isNull(), F.lit("")).when(sub.isNull(), whole).otherwise(F.concat(whole, F.lit("."), sub.cast("string")))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body``, however often that refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
