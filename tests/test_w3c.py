"""Scanning logs: headers, line numbers, values, addresses, blocks and incomplete lines."""

import time

import pytest
from pyspark.sql import functions as F

from tidelog.sources.ranges import lines_from
from tidelog.sources.samples import DIRECTIVES, sample_lines
from tidelog.sources.w3c import number_lines, parse_lines, read_ranges, read_text, read_w3c, read_w3c_with_totals, scan_blocks

HEADER = "#Fields: date time s-ip cs-method cs-uri-stem sc-status"


def log(tmp_path, text, name="a.log"):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def rows(spark, path, *columns, **kw):
    return [tuple(r) for r in read_w3c(spark, path, **kw).select(*columns).orderBy("line_number").collect()]


def test_standard(spark, tmp_path):
    path = log(tmp_path, "#Software: x\r\n#Version: 1.0\r\n#Date: y\r\n" + HEADER + "\r\n2024-01-01 00:00:01 1.1.1.1 GET /a 200\r\n\r\n2024-01-01 00:00:02 1.1.1.1 POST - 404\r\n")
    got = rows(spark, path, "line_number", "method", "uri_stem", "status_code", "is_complete_line", "raw_line")
    assert got == [(5, "GET", "/a", 200, True, "2024-01-01 00:00:01 1.1.1.1 GET /a 200"), (7, "POST", None, 404, True, "2024-01-01 00:00:02 1.1.1.1 POST - 404")]


def test_header_changes_inside_the_file(spark, tmp_path):
    path = log(tmp_path, "x before any header\n" + HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /a 200\n#Fields: cs-uri-stem sc-status\n/b 500\n")
    assert rows(spark, path, "line_number", "uri_stem", "status_code") == [(3, "/a", 200), (5, "/b", 500)]


def test_rows_that_are_left_out(spark, tmp_path):
    path = log(tmp_path, HEADER + "\ngarbage here now ok then 1\n2024-02-30 00:00:00 - GET /no 1\n- 00:00:00 - GET /dash 2\n2024-01-01 99:00:00 - GET /time 3\n2024-01-01\n")
    assert rows(spark, path, "line_number", "uri_stem", "timestamp_utc") == [(4, "/dash", None), (5, "/time", None), (6, None, None)]


def test_no_header_no_rows(spark, tmp_path):
    assert rows(spark, log(tmp_path, "2024-01-01 00:00:01 1.1.1.1 GET /a 200\n"), "line_number") == []
    assert rows(spark, log(tmp_path, "", "empty.log"), "line_number") == []


def test_last_duplicate_column_wins_and_extras(spark, tmp_path):
    path = log(tmp_path, "#Fields: cs-uri-stem cs-uri-stem x(My-Field) cs(Host)\n/a /b v h.example\n/c /d - -\n")
    assert rows(spark, path, "uri_stem", "host", "additional_fields", include_additional=True) == [("/b", None, {"x(My-Field)": "v", "cs(Host)": "h.example"}), ("/d", None, {"x(My-Field)": None, "cs(Host)": None})]
    assert rows(spark, path, "additional_fields") == [(None,), (None,)]


@pytest.mark.parametrize("header, expected", [("cs(CF-Connecting-IP)", "9.9.9.9"), ("cs(cnd-src-ip)", "9.9.9.9"), ("cs(X-Forwarded-For)", "9.9.9.9"), ("X-Real-IP", "9.9.9.9"), ("cs(Other)", "1.1.1.1")])
def test_resolved_address(spark, tmp_path, header, expected):
    path = log(tmp_path, f'#Fields: c-ip {header}\n1.1.1.1 "unknown, 9.9.9.9"\n')
    assert rows(spark, path, "client_ip", "resolved_client_ip") == [("1.1.1.1", expected)]


def test_priority_is_ours_to_choose(spark, tmp_path):
    path = log(tmp_path, "#Fields: c-ip X-Forwarded-For X-Real-IP\n1.1.1.1 2.2.2.2 3.3.3.3\n")
    assert rows(spark, path, "resolved_client_ip", ip_priority=("X-Real-IP", "c-ip")) == [("3.3.3.3",)]
    assert rows(spark, path, "resolved_client_ip", ip_priority=("c-ip",)) == [("1.1.1.1",)]


def test_large_and_quoted_values(spark, tmp_path):
    agent = "A " * 2500 + "Z"
    path = log(tmp_path, f'#Fields: sc-bytes cs-bytes time-taken cs(User-Agent) cs-uri-stem\n3000000000 4000000000 5000000000 "{agent}" /ünï\n')
    assert rows(spark, path, "bytes_sent", "bytes_received", "time_taken_ms", "user_agent", "uri_stem") == [(3_000_000_000, 4_000_000_000, None, agent, "/ünï")]


def test_incomplete_last_line(spark, tmp_path):
    path = log(tmp_path, HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /a 200\n2024-01-01 00:00:02 1.1.1.1 GET /b 200")
    assert rows(spark, path, "line_number", "is_complete_line") == [(2, True), (3, False)]
    assert rows(spark, path, "line_number", include_incomplete=False) == [(2,)]


@pytest.mark.parametrize("end, complete", [("\n", True), ("", False)])
def test_byte_order_mark(spark, tmp_path, end, complete):
    path = log(tmp_path, "﻿" + HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /a 200" + end)
    assert rows(spark, path, "line_number", "uri_stem", "is_complete_line") == [(2, "/a", complete)]


def test_other_encoding(spark, tmp_path):
    path = log(tmp_path, (HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /caf\xe9 200\n").encode("latin-1") + "2024-01-01 00:00:01 1.1.1.1 GET /\u00fc 200\n".encode())
    assert rows(spark, path, "uri_stem") == [("/caf\u00e9",), ("/\u00fc",)]


def test_a_file_of_many_blocks(spark, tmp_path):
    """Line numbers and headers hold across splits of a file, also next to other files."""
    body = [r["line"] for r in sample_lines(spark, 3000).orderBy("i").collect()]
    text = "\n".join([*DIRECTIVES, *body[:1500], "", "#Fields: cs-uri-stem sc-status", *(f"/late/{k} 200" for k in range(1500))]) + "\n"
    log(tmp_path, text, "big.log")
    log(tmp_path, HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /a 200\n", "small.log")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        entries, totals = read_w3c_with_totals(spark, str(tmp_path))
        got = {(r[0].rsplit("/", 1)[-1], r[1]): r[2] for r in entries.select("source_path", "line_number", "uri_stem").collect()}
        ends = {r["source_path"].rsplit("/", 1)[-1]: (r["file_lines"], r["ends_with_lf"]) for r in totals.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {("big.log", n): line.split(" ")[4] for n, line in enumerate(body[:1500], 5)}
    want |= {("big.log", n): f"/late/{n - 1507}" for n in range(1507, 3007)}
    want["small.log", 2] = "/a"
    assert got == want
    assert ends == {"big.log": (3006, True), "small.log": (2, True)}


def test_splits_may_change_between_reading_and_acting(spark, tmp_path):
    """What Spark would plan now does not matter to a scan made before, be it settings or cores."""
    body = [r["line"] for r in sample_lines(spark, 6000).orderBy("i").collect()]
    text = "\n".join([*DIRECTIVES, *body[:3000], "#Fields: cs-uri-stem sc-status", *(f"/late/{k} 200" for k in range(3000))]) + "\n"
    for k in range(3):
        log(tmp_path, text, f"{k}.log")
    want = [(n, line.split(" ")[4]) for n, line in enumerate(body[:3000], 5)] + [(3006 + k, f"/late/{k}") for k in range(3000)]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "60000")
        entries = read_w3c(spark, str(tmp_path))
        assert entries.sparkSession is spark
        for name, value in (names[0], "9000"), (names[0], "128m"), (names[1], "64"), (names[2], "1k"):
            spark.conf.set(name, value)
            got = [(r[0], r[1], r[2]) for r in entries.select("source_path", "line_number", "uri_stem").collect()]
            assert sorted(got) == sorted((p, n, u) for p in {g[0] for g in got} for n, u in want) and len(got) == 3 * len(want)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_blocks_that_do_not_match_are_an_error(spark, tmp_path):
    path = log(tmp_path, "\n".join([HEADER, *("2024-01-01 00:00:01 1.1.1.1 GET /a 200" for _ in range(3000))]) + "\n")
    lines = read_text(spark, path)
    blocks = scan_blocks(spark, lines)
    for wrong in (blocks.withColumn("block", F.col("block") + 1), blocks.withColumn("n", F.col("n") - 1)):
        with pytest.raises(Exception, match="changed while it was read"):
            parse_lines(number_lines(lines, wrong, ("c-ip",), False)).select("uri_stem").collect()


def test_ranges_go_on_where_told(spark, tmp_path):
    first = HEADER + "\n2024-01-01 00:00:01 1.1.1.1 GET /a 200\n"
    path = log(tmp_path, first + "2024-01-01 00:00:02 1.1.1.1 GET /b 200\n2024-01-01 00:00:03 1.1.1.1 GET /c 200")
    for given in ({"line": 2, "header": HEADER}, {}):
        got = read_ranges(spark, [{"path": path, "offset": len(first), **given}]).select("line_number", "uri_stem", "is_complete_line").orderBy("line_number").collect()
        assert [tuple(r) for r in got] == [(3, "/b", True), (4, "/c", False)]
    assert read_ranges(spark, [{"path": str(tmp_path / "gone.log"), "offset": 0}]).count() == 0


def test_lines_have_exact_offsets(tmp_path):
    path = log(tmp_path, b"ab\r\nc\rd\n\nlast")
    assert list(lines_from(path, 0)) == [(0, 4, True, b"ab"), (4, 8, True, b"c\rd"), (8, 9, True, b""), (9, 13, False, b"last")]
    assert list(lines_from(path, 4, 8)) == [(4, 8, True, b"c\rd")]
    assert list(lines_from(path, 99)) == []


def test_sample_facts(spark, tmp_path):
    lines = sample_lines(spark, 1000)
    assert lines.where("line LIKE '%/api/order%'").count() == 100
    assert lines.where("line LIKE '% 404 0 0 %'").count() == 10


def test_recursive_reads_names_of_any_case(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("a.log", "s/B.LOG", "s/c.Log", "d.txt"):
        (tmp_path / name).write_text("#Fields: date cs-uri-stem\n2024-01-01 /x\n")
    found = read_w3c(spark, str(tmp_path), recursive=True).select("source_path").collect()
    assert sorted(r[0].rsplit("/", 1)[1] for r in found) == ["B.LOG", "a.log", "c.Log"]


def test_headers_every_few_lines(spark, tmp_path):
    """60 000 lines under 20 000 headers: each line is compared with the headers around it, not with all of its block."""
    def run(k):
        names, values = (("cs-uri-stem sc-status", "/{} {}") if k % 2 == 0 else ("sc-status cs-uri-stem", "{1} /{0}"))
        return "".join((f"#Fields: {names}\n", *(values.format(3 * k + i, 200 + i) + "\n" for i in range(3))))

    path, n = log(tmp_path, "/early 1\n" + "".join(run(k) for k in range(20_000))), 60_000
    began = time.monotonic()
    got = rows(spark, path, "line_number", "uri_stem", "status_code")
    assert got == [(2 + i // 3 + 1 + i, f"/{i}", 200 + i % 3) for i in range(n)]
    assert time.monotonic() - began < 60
