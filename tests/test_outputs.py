"""Exports, discovery, settings, and the registered queries against their SQL."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_analyze import entries
from tidelog.operators import export
from tidelog.operators.search import detail_json
from tidelog.plans import catalog
from tidelog.settings import EngineSettings
from tidelog.sources.sites import discover_sites, site_sources

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture
def results(spark):
    return entries(spark, {"timestamp_utc": "2024-07-01 10:00:00.123456", "status_code": 404, "sub_status_code": 3, "method": "GET", "uri_stem": '/a,"b"', "source_path": "file:///x/u.log", "resolved_client_ip": "1.1.1.1", "user_agent": "é\nx", "raw_line": "raw"}, {})


def test_csv(results, tmp_path):
    assert export.export_csv(results, tmp_path / "x.csv") == 2
    data = (tmp_path / "x.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfTime,Status,Method,ResolvedClientIp,URL,TimeTakenMs,UserAgent,SourceFile,LineNumber\r\n")
    assert data.decode("utf-8-sig").split("\r\n")[1:] == ['2024-07-01T10:00:00.1234560+00:00,404.3,GET,1.1.1.1,"/a,""b""",,"é\nx",u.log,1', ",,,,,,,p,2", ""]


def test_json(results, tmp_path):
    assert export.export_json(results, tmp_path / "x.json", "America/New_York") == 2
    rows = json.loads((tmp_path / "x.json").read_text())
    assert list(rows[0]) == list(export.JSON_KEYS) == list(rows[1])
    assert rows[0]["TimestampLocal"] == "2024-07-01T06:00:00.1234560-04:00" and rows[1]["TimestampLocal"] is None
    assert rows[0]["RawLine"] == "raw" and rows[0]["LineNumber"] == 1
    assert export.export_json(results.limit(0), tmp_path / "y.json") == 0 and (tmp_path / "y.json").read_text() == "[]"


def test_folders(spark, results, tmp_path):
    export.write_csv(results, str(tmp_path / "c"))
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "c"))
    assert {(r["Status"], r["URL"]) for r in back.collect()} == {("404.3", '/a,"b"'), (None, None)}
    export.write_json(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(detail_json(results).first()["json"])["status_code"] == 404


def test_sites(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    config = tmp_path / "host.config"
    config.write_text(f"""<configuration><sites>
      <site name="Main" id="1"><bindings><binding bindingInformation="*:80:" /><binding bindingInformation="*:443:x" /></bindings><logFile directory="%BASE%/logs" /></site>
      <site id="2" serverAutoStart="False"><logFile directory="/none" /></site>
      <site name="Plain"/>
    </sites></configuration>""")
    rows = {r["name"]: tuple(r)[1:] for r in discover_sites(spark, str(config), {"base": str(tmp_path)}).collect()}
    assert rows["Main"] == ("1", "*:80:; *:443:x", f"{logs}/W3SVC1", True)
    assert rows["Unnamed"] == ("2", "", "/none", False)
    assert rows["Plain"][1] == "" and rows["Plain"][2].endswith("LogFiles")
    assert [s.name for s in site_sources(discover_sites(spark, str(config), {"base": str(tmp_path)}))] == ["Main", "Plain"]
    assert discover_sites(spark, str(tmp_path / "none")).count() == 0
    config.write_text("<site")
    assert discover_sites(spark, str(config)).count() == 0


def test_settings(tmp_path):
    path = tmp_path / "deep" / "settings.json"
    EngineSettings(slow_request_threshold_ms=5, client_ip_priority=("c-ip",)).save(path)
    assert EngineSettings.load(path) == EngineSettings(slow_request_threshold_ms=5, client_ip_priority=("c-ip",))
    assert not list(path.parent.glob("*.tmp"))
    path.write_text("[1]")
    assert EngineSettings.load(path) == EngineSettings() == EngineSettings.load(tmp_path / "none")
    assert EngineSettings(max_search_results=1, index_batch_size=10**6).bounded_max_results == 100
    assert EngineSettings(index_batch_size=10**6).bounded_batch_size == 10_000


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, tmp_path, name):
    catalog.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db.sql(f"CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    db.sql(f"CREATE OR REPLACE TEMP TABLE b AS {catalog.ORACLES[name]}")
    types = [sorted(tuple(r[:2]) for r in db.sql(f"DESCRIBE {x}").fetchall()) for x in "ab"]
    assert types[0] == types[1]
    columns = ", ".join(f'"{c}"' for c, _ in types[0])
    for x, y in (("a", "b"), ("b", "a")):
        assert not db.sql(f"SELECT {columns} FROM {x} EXCEPT ALL SELECT {columns} FROM {y}").fetchall()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["url", "count"] and entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
