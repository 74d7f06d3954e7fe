"""Sites and their log folders from a web server's XML configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.files import LogSource
from tidelog.storage import filesystem

#: Fixed value: where logs lie unless a site says otherwise.
DEFAULT_LOGS = r"%SystemDrive%\inetpub\logs\LogFiles"
SITES = "name string, site_id string, bindings string, log_path string, enabled boolean"

_SITE = T.StructType([
    T.StructField("_name", T.StringType()),
    T.StructField("_id", T.StringType()),
    T.StructField("_serverAutoStart", T.StringType()),
    T.StructField("bindings", T.StructType([T.StructField("binding", T.ArrayType(T.StructType([T.StructField("_bindingInformation", T.StringType())])))])),
    T.StructField("logFile", T.StructType([T.StructField("_directory", T.StringType())])),
])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        fs, where = filesystem(spark, path)
        return fs.exists(where)
    except Py4JError:
        return False


def _expand(path: str, env: Mapping[str, str]) -> str:
    known = {k.lower(): v for k, v in env.items()}
    return re.sub(r"%([^%]+)%", lambda m: known.get(m[1].lower(), m[0]), path)


def discover_sites(spark: SparkSession, config_path: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """``(name, site_id, bindings, log_path, enabled)`` of each site; empty if the configuration cannot be read.

    ``env`` replaces ``%NAME%`` in folders. A site's own subfolder is added where the folder exists.
    """
    try:
        if not _exists(spark, config_path):
            return spark.createDataFrame([], SITES)
        sites = spark.read.format("xml").option("rowTag", "site").schema(_SITE).load(config_path)
        rows = sites.select(
            F.coalesce("_name", F.lit("Unnamed")).alias("name"),
            F.coalesce("_id", F.lit("")).alias("site_id"),
            F.coalesce(F.concat_ws("; ", F.transform("bindings.binding", lambda b: F.coalesce(b["_bindingInformation"], F.lit("")))), F.lit("")).alias("bindings"),
            F.coalesce("logFile._directory", F.lit(DEFAULT_LOGS)).alias("folder"),
            (F.lower(F.coalesce("_serverAutoStart", F.lit(""))) != "false").alias("enabled"),
        ).collect()  # a server's sites
    except PySparkException:
        return spark.createDataFrame([], SITES)
    out = []
    for r in rows:
        folder = _expand(r["folder"], os.environ if env is None else env)
        own = f"{folder.rstrip('/')}/W3SVC{r['site_id']}" if r["site_id"].strip() and _exists(spark, folder) else folder
        out.append((r["name"], r["site_id"], r["bindings"], own, r["enabled"]))
    return spark.createDataFrame(out, SITES)


def site_sources(sites: DataFrame) -> list[LogSource]:
    """The enabled sites as sources."""
    return [LogSource(r["log_path"], "site", False, r["name"]) for r in sites.where("enabled").collect()]
