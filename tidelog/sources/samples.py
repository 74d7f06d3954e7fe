"""Generated logs whose every value follows from the line's index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample's directives, the last of which names its columns, and its server, client and agent.
DIRECTIVES = (
    "#Software: Microsoft Internet Information Services 10.0",
    "#Version: 1.0",
    "#Date: 2026-08-28 00:00:00",
    "#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip cs(User-Agent) cs(Referer) sc-status sc-substatus sc-win32-status time-taken sc-bytes cs-bytes",
)
SERVER, CLIENT, AGENT = "10.0.0.1", "1.2.3.4", "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"


def sample_lines(spark: SparkSession, n: int, keyword: str = "/api/order") -> DataFrame:
    """``(i, line)`` of the data rows, in no order; every tenth has ``keyword`` as its path."""
    i = F.col("id")
    text = lambda c: c.cast("string")
    pad = lambda c: F.lpad(text(c.cast("int")), 2, "0")
    line = F.concat_ws(
        " ",
        F.lit("2026-08-28"),
        F.concat(F.lit("10:"), pad(F.floor(i / 60) % 60), F.lit(":"), pad(i % 60)),
        F.lit(SERVER),
        F.when(i % 2 == 0, "GET").otherwise("POST"),
        F.when(i % 10 == 0, keyword).otherwise(F.concat(F.lit("/page/"), text(i))),
        F.when(i % 3 == 0, "id=1").otherwise("-"),
        F.lit(f'443 - {CLIENT} "{AGENT}" -'),
        F.when(i % 100 == 0, "404").otherwise("200"),
        F.lit("0 0"),
        text(i % 5000),
        F.lit("100 200"),
    )
    return spark.range(n).select(i.alias("i"), line.alias("line"))


def write_sample(spark: SparkSession, path: str, n: int, keyword: str = "/api/order") -> None:
    """One log file at a local ``path``."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(d + "\r\n" for d in DIRECTIVES))
        for row in sample_lines(spark, n, keyword).orderBy("i").toLocalIterator():
            f.write(row["line"] + "\r\n")
