from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.plans.predicate import classify_keyword, to_predicate
from tidelog.plans.request import SearchRequest, day_range, detect_intent, parse_time_span, quick_range

INTENTS = [("192.168.1.1", "ip_address"), ("::1", "ip_address"), ("404", "http_status"), ("99", "general_keyword"), ("post", "http_method"), (" GET ", "http_method"), ("/api", "uri"), ("a?b", "uri"), ("plain", "general_keyword"), ("", "general_keyword"), (None, "general_keyword"), ("1.5", "general_keyword")]


@pytest.mark.parametrize("keyword, intent", INTENTS)
def test_intent(keyword, intent):
    assert detect_intent(keyword) == intent


def test_intent_column(spark):
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(INTENTS)], "k int, v string")
    assert [r[0] for r in df.orderBy("k").select(classify_keyword(F.col("v"))).collect()] == [i for _, i in INTENTS]


def test_time_spans():
    assert parse_time_span("10:30") == timedelta(hours=10, minutes=30)
    assert parse_time_span("1.02:03:04.5") == timedelta(days=1, hours=2, minutes=3, seconds=4, milliseconds=500)
    assert parse_time_span("10") == timedelta(days=10)
    assert parse_time_span("25:00") is None and parse_time_span("x") is None and parse_time_span(None) is None


def test_from_strings():
    r = SearchRequest.from_strings(keyword="  x ", method=" ", status_code="abc", min_time_taken_ms="5", time_from="10:00")
    assert (r.keyword, r.method, r.status_code, r.min_time_taken_ms, r.time_from) == ("x", None, None, 5, timedelta(hours=10))


def test_ranges():
    now = datetime(2024, 3, 10, 12, 0, tzinfo=UTC)
    assert quick_range("last_hour", now) == (now - timedelta(hours=1), now)
    # clocks go forward in New York on this day: it has 23 hours
    a, b = quick_range("today", now, "America/New_York")
    assert (a, b - a + timedelta(microseconds=1)) == (datetime(2024, 3, 10, 5, tzinfo=UTC), timedelta(hours=23))
    assert quick_range("yesterday", now)[0] == datetime(2024, 3, 9, tzinfo=UTC)
    assert day_range(None, datetime(2024, 1, 1)) == (None, datetime(2024, 1, 1, 23, 59, 59, 999999, tzinfo=UTC))


ROWS = [
    (1, "2024-01-01 10:00:00", "GET", "/a", "q=1", 200, 5, "10.0.0.1", "9.9.9.9", "curl", "bob", "raw One"),
    (2, "2024-01-02 11:00:00", "post", "/b", None, 404, None, None, None, None, None, None),
    (3, None, None, None, None, None, 50, "10.0.0.2", None, "Mozilla", "ALICE", "raw 100% _x"),
]
CASES = [
    (SearchRequest(), {1, 2, 3}),
    (SearchRequest(keyword="one"), {1}),
    (SearchRequest(keyword="404"), {2}),
    (SearchRequest(keyword="0404"), {2}),
    (SearchRequest(keyword="%"), {3}),
    (SearchRequest(keyword="_"), {3}),
    (SearchRequest(keyword="  "), {1, 2, 3}),
    (SearchRequest(from_utc=datetime(2024, 1, 2, tzinfo=UTC)), {2}),
    (SearchRequest(to_utc=datetime(2024, 1, 1, 10, tzinfo=UTC)), {1}),
    (SearchRequest(time_from=timedelta(hours=10, minutes=30)), {2}),
    (SearchRequest(time_from=timedelta(hours=12), time_to=timedelta(hours=1)), set()),
    (SearchRequest(method="POST"), {2}),
    (SearchRequest(status_code=200), {1}),
    (SearchRequest(client_ip="9.9"), {1}),
    (SearchRequest(url_contains="A?Q"), {1}),
    (SearchRequest(user_agent_contains="MOZ"), {3}),
    (SearchRequest(min_time_taken_ms=10), {3}),
    (SearchRequest(max_time_taken_ms=10), {1}),
    (SearchRequest(username="ali"), {3}),
]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("request_, ids", CASES)
def test_predicate(spark, kind, request_, ids):
    df = spark.createDataFrame(ROWS, "id int, t string, method string, uri_stem string, uri_query string, status_code int, time_taken_ms int, client_ip string, resolved_client_ip string, user_agent string, username string, raw_line string")
    df = df.withColumn("timestamp_utc", F.col("t").cast(kind))
    assert {r["id"] for r in df.where(to_predicate(request_, df)).collect()} == ids
