"""Analyses on small logs with values worked out by hand."""

from pyspark.sql import functions as F

from tidelog.operators import analyze, security
from tidelog.operators.search import search, statistics, union_distinct
from tidelog.plans.request import SearchRequest
from tidelog.schema import ENTRY

EMPTY = dict.fromkeys(ENTRY.names)


def entries(spark, *rows):
    from datetime import datetime

    made = []
    for k, r in enumerate(rows, 1):
        row = {**EMPTY, "id": k, "source_id": 1, "source_path": "p", "line_number": k, **r}
        if isinstance(row["timestamp_utc"], str):
            row["timestamp_utc"] = datetime.fromisoformat(row["timestamp_utc"])
        made.append(tuple(row[n] for n in ENTRY.names))
    return spark.createDataFrame(made, ENTRY)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_order_and_limit(spark):
    df = entries(spark, {"timestamp_utc": "2024-01-01 00:00:00"}, {"timestamp_utc": None}, {"timestamp_utc": "2024-01-02 00:00:00"}, {"timestamp_utc": "2024-01-01 00:00:00", "source_path": "q"}, {"timestamp_utc": "2024-01-01 00:00:00"})
    ids = lambda **kw: [r["id"] for r in search(df, SearchRequest(**kw)).collect()]
    assert ids() == [3, 4, 5, 1, 2]
    assert ids(max_results=2) == [3, 4]
    assert ids(max_results=0) == [] == ids(max_results=-1)
    assert values(statistics(df)) == [(5, 5, 0, True)]


def test_union_prefers_raw(spark):
    raw, indexed = entries(spark, {"method": "raw"}, {"method": "raw"}), entries(spark, {"method": "old"})
    got = union_distinct(raw, indexed).orderBy("line_number").select("method", "is_indexed")
    assert values(got) == [("raw", False), ("raw", False)]


def test_slow_percentiles(spark):
    df = entries(spark, *({"time_taken_ms": n, "uri_stem": "/A" if n % 2 else "/a", "timestamp_utc": "2024-01-01 00:00:00"} for n in range(101, 201)), {"time_taken_ms": 5}, {"time_taken_ms": None})
    report = analyze.analyze_slow(df, 100)
    assert values(report.summary) == [(100, 100, 150.5, 195.0, 199.0, 200)]
    assert values(report.top_urls) == [("/a", 150.5, 100)]
    assert values(analyze.analyze_slow(df, 10_000).summary) == [(10_000, 0, 0.0, 0.0, 0.0, 0)]


def test_ip(spark):
    df = entries(
        spark,
        {"client_ip": "1.1.1.1", "status_code": 404, "uri_stem": "/x", "timestamp_utc": "2024-01-01 00:00:02", "time_taken_ms": 10, "method": "GET", "user_agent": "B"},
        {"client_ip": "2.2.2.2", "resolved_client_ip": "1.1.1.1", "status_code": 503, "uri_stem": "/X", "timestamp_utc": "2024-01-01 00:00:01", "method": "get", "user_agent": "a"},
        {"client_ip": "1.1.1.1", "timestamp_utc": None, "user_agent": "b"},
        {"client_ip": "3.3.3.3"},
    )
    report = analyze.analyze_ip(df, "1.1.1.1")
    row = report.summary.first().asDict()
    assert (row["request_count"], row["unique_urls"], row["not_found_count"], row["server_error_count"], row["average_time_taken_ms"]) == (3, 1, 1, 1, 10.0)
    assert values(report.top_urls) == [("/x", 2)]
    assert values(report.user_agents) == [("B",), ("a",)]
    assert values(report.methods) == [("GET", 2)]
    assert [r["status"] for r in report.timeline.collect()] == ["", "503", "404"]


def test_errors(spark):
    df = entries(spark, {"status_code": 400, "client_ip": "a"}, {"status_code": 599, "client_ip": " "}, {"status_code": 600}, {"status_code": 399}, {"status_code": 400, "resolved_client_ip": "A"})
    report = analyze.analyze_errors(df)
    assert values(report.summary) == [(3,)]
    assert sorted(values(report.statuses)) == [(400, 2), (599, 1)]
    assert [c for _, c in values(report.top_ips)] == [2]
    assert values(analyze.analyze_errors(df.limit(0)).summary) == [(0,)]


def test_traffic(spark):
    df = entries(spark, {"timestamp_utc": "2024-01-01 00:00:10", "client_ip": "x"}, {"timestamp_utc": "2024-01-01 00:02:10", "client_ip": "X"}, {"timestamp_utc": None, "client_ip": "-"})
    report = analyze.analyze_traffic(df)
    assert values(report.summary) == [(3, 2, 1.5)]
    assert [c for _, c in values(report.trend)] == [1, 1]
    assert values(analyze.traffic_summary(df.limit(0))) == [(0, 0, 0.0)]


def test_trend_units(spark):
    at = lambda *t: entries(spark, *({"timestamp_utc": x} for x in t))
    assert analyze.trend_unit(at("2024-01-01 00:00:00", "2024-01-02 23:59:59")) == "minute"
    assert analyze.trend_unit(at("2024-01-01 00:00:00", "2024-01-03 00:00:00")) == "hour"
    assert analyze.trend_unit(at("2024-01-01 00:00:00", "2024-03-01 00:00:00")) == "day"
    assert analyze.trend_unit(at(None)) == "minute"


def test_top_orders_underscore_after_letters(spark):
    df = entries(spark, {"uri_stem": "/a_"}, {"uri_stem": "/aa"}, {"uri_stem": ""})
    assert [u for u, _ in values(analyze.top_by_count(analyze.with_url(df), F.col("url"), "url"))] == ["/aa", "/a_"]


def test_rules(spark):
    df = entries(spark, {"uri_stem": "/.ENV", "raw_line": "x"}, {"method": "trace"}, {"uri_query": "id=1'+OR+'1'='1"}, {"raw_line": "<ScRiPt ../"}, {"raw_line": "clean"})
    got = values(security.match_rules(df).select("log_entry_id", "rule_id", "severity").orderBy("log_entry_id", "ordinal"))
    assert got == [(1, "SENSITIVE_ENV", "Medium"), (2, "METHOD_TRACE", "Medium"), (3, "SQL_BOOLEAN", "High"), (4, "TRAVERSAL", "High"), (4, "XSS_SCRIPT", "High")]
    assert security.match_rules(df, []).count() == 0
    off = [security.SecurityRule("X", "c", "clean", enabled=False)]
    assert security.match_rules(df, off).count() == 0
    titled = [security.SecurityRule("X", "Some category", "clean", title=" ")]
    assert values(security.findings(df, titled).select("title")) == [("Some category",)]
    assert security.findings(df, most=2).count() == 2


def score_of(df, rules=security.DEFAULT_RULES):
    r = security.score(df, rules).first()
    return r["score"], r["severity"], r["likely_scanner"]


def test_scores(spark):
    assert score_of(entries(spark, {"status_code": 200, "user_agent": "Mozilla"})) == (0, "Low", False)
    assert score_of(entries(spark, {"raw_line": "../ sleep( <script"})) == (65, "High", False)
    assert score_of(entries(spark).limit(0)) == (0, "Low", False)
    rows = [{"uri_stem": f"/.env/{k}", "status_code": 404, "client_ip": "1.1.1.1", "timestamp_utc": "2024-01-01 00:00:00"} for k in range(101)]
    assert score_of(entries(spark, *rows)) == (70, "High", True)
    assert score_of(entries(spark, *rows[:100])) == (50, "High", False)
    assert "Heuristic" in security.score(entries(spark, *rows[:2])).first()["reasons"][0]


def test_rules_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"Id": "A", "Category": "c", "Pattern": "p", "Match": "contains", "Score": 1, "Enabled": false, "Title": "t"}]')
    assert security.load_rules(path) == (security.SecurityRule("A", "c", "p", "contains", 1, False, "t"),)
    path.write_text("{")
    assert security.load_rules(path) == () == security.load_rules(tmp_path / "none.json")
