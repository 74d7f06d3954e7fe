"""Scalar expressions against plain restatements of their rules."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import client_ip, text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def tokens_of(line):
    """Quotes toggle quoting; unquoted white space splits; a token ends before a later quote."""
    out, start, end, quoted = [], None, None, False
    for k, c in enumerate(line + " "):
        last = k == len(line)
        if c == '"' and not last:
            quoted = not quoted
            if start is None:
                start = k + 1
            else:
                end = k
        elif last or (c.isspace() and not quoted):
            if start is not None:
                out.append(line[start : end if end is not None and end > start else k])
            start = end = None
        elif start is None:
            start = k
    return out


@pytest.mark.parametrize("line, expected", [("a b  c", ["a", "b", "c"]), ('GET "a b" x', ["GET", "a b", "x"]), ('abc"def ghi"jkl', ['abc"def ghi']), ("", []), ('x "unclosed to the end', ["x", "unclosed to the end"])])
def test_tokens(spark, line, expected):
    assert column(spark, [line], text.tokenize) == [expected]


def test_tokens_of_random_lines(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('ab1 \t"-') for _ in range(rng.randrange(1, 24))) for _ in range(400)]
    lines = [x for x in lines if '""' not in x and not x.endswith('"')]
    assert column(spark, lines, text.tokenize) == [tokens_of(x) for x in lines]


def test_values(spark):
    assert column(spark, ["-", " ", "　", "a", " - ", None, "-x"], text.value_or_null) == [None, None, None, "a", " - ", None, "-x"]
    assert column(spark, ["12", "+5", " 12 ", "12.5", "1e3", "x", "5000000000", None], text.to_int) == [12, 5, 12, None, None, None, None, None]
    assert column(spark, ["5000000000", "9223372036854775808"], text.to_long) == [5_000_000_000, None]
    assert column(spark, ["cs(User-Agent)", "sc-status", "X_Forwarded-For", "time-taken"], text.normalize_header) == ["useragent", "scstatus", "xforwardedfor", "timetaken"]


def test_timestamps(spark):
    rows = [("2024-01-15", "02:10:03"), ("2024-02-30", "00:00:00"), ("2024-01-01", "24:00:00"), ("2024-01-01", "1:02:03"), ("2024-01-01", None), (None, "00:00:00"), ("x", "y")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d string, t string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in df.orderBy("k").select(F.unix_seconds(text.to_timestamp(F.col("d"), F.col("t")))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [1705284603, None, None, None, None, None, None]


def test_display(spark):
    df = spark.createDataFrame([("/a", "q=1", 404, 2), ("/a", "-", 200, None), (None, None, None, 1), ("/a", "  ", 500, 0)], "s string, q string, c int, u int")
    got = [tuple(r) for r in df.select(text.display_url(F.col("s"), F.col("q")), text.display_status(F.col("c"), F.col("u"))).collect()]
    assert got == [("/a?q=1", "404.2"), ("/a", "200"), ("", ""), ("/a", "500.0")]


def test_addresses(spark):
    good = ["1.2.3.4", "255.255.255.255", "::1", "::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "fe80::1%eth0", "[::1]", "[2001:db8::1]:443", "1::2:3.4.5.6"]
    bad = ["256.1.1.1", "1.2.3", "abc", "", "1:2:3", "1::2::3", "1:2:3:4:5:6:7:8:9", "g::1", "1.2.3.4.5", ":::"]
    assert column(spark, good + bad, client_ip.is_ip) == [True] * len(good) + [False] * len(bad)
    rng = random.Random(2)
    some = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(50)]
    assert all(column(spark, some, client_ip.is_ip))


def test_first_valid(spark):
    got = column(spark, ["unknown, 10.0.0.1 , 8.8.8.8", "-", None, " ", "x", ",,::1"], client_ip.first_valid_ip)
    assert got == ["10.0.0.1", None, None, None, None, "::1"]
