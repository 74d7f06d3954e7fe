"""A demonstration access log: a view over the ``events`` table, the same text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW = """
SELECT *,
 CASE WHEN uri_query IS NULL OR trim(uri_query) = '' OR uri_query = '-' THEN coalesce(uri_stem, '') ELSE concat(coalesce(uri_stem, ''), '?', uri_query) END AS display_url,
 concat_ws(' ', line_number, method, uri_stem, coalesce(uri_query,'-'), client_ip, user_agent, status_code, time_taken_ms) AS raw_line
FROM (
WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events})
SELECT event_id AS id, event_id + 1 AS line_number, ts AS timestamp_utc,
 CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'purchase' THEN 'PUT' WHEN event_type = 'error' AND k % 10 = 0 THEN 'TRACE' ELSE 'GET' END AS method,
 CASE WHEN k < 3 THEN '/.env' WHEN k < 6 THEN '/.git/config' WHEN k < 9 THEN '/wp-login.php' WHEN event_type = 'purchase' THEN '/api/order' WHEN k % 2 = 0 THEN concat('/Page_', k) ELSE concat('/page/', k) END AS uri_stem,
 CASE WHEN k % 10 = 7 THEN 'q=<script>alert(1)</script>' WHEN k % 10 = 8 THEN 'path=../../../../windows/win.ini' WHEN k % 10 = 9 THEN 'id=1''+OR+''1''=''1' WHEN k % 2 = 0 THEN concat('id=', k) ELSE NULL END AS uri_query,
 CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END WHEN k % 20 = 1 THEN 301 ELSE 200 END AS status_code,
 CAST(floor(value * 10) AS INT) AS time_taken_ms,
 concat('10.0.', CAST(floor(user_id / 256) AS INT), '.', user_id % 256) AS client_ip,
 CASE WHEN user_id % 4 = 0 THEN 'Mozilla/5.0 (Windows NT 10.0)' WHEN user_id % 4 = 1 THEN 'curl/8.1' WHEN user_id % 4 = 2 THEN 'sqlmap/1.5' ELSE 'mozilla/5.0 (windows nt 10.0)' END AS user_agent
FROM e
) v"""

#: Columns of an entry that the operators may ask for and the view does not have.
FILLED = "1 AS source_id, 'events' AS source_path, client_ip AS resolved_client_ip, CASE WHEN client_ip LIKE '%.1' THEN 'Alice' ELSE NULL END AS username"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with FILLED columns, ready for every operator."""
    return spark.sql(f"SELECT *, {FILLED} FROM ({VIEW.format(events='{events}')}) a", events=events(spark, sf_dir))


def oracle(query: str) -> str:
    """DuckDB SQL of ``query``, which may read ``log``."""
    return f"WITH log AS (SELECT *, {FILLED} FROM ({VIEW.format(events='events')}) a) {query}"
