"""A session as the library likes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidelog", **conf: str) -> SparkSession:
    """Adaptive execution, UTC; keyword arguments spell dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def private(spark: SparkSession) -> SparkSession:
    """A session that nobody else holds, with ``spark``'s settings."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def pin_splits(scan: DataFrame) -> None:
    """Fix how the files of ``scan``, made in a private session, are cut: to suit the cores there are now.

    Spark plans a file scan anew for each job, by the settings of the session that the scan was made in and the cores
    there are then. From here on the cut is the same every time, whatever changes outside.
    """
    spark, setting = scan.sparkSession, "spark.sql.files.{}".format
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    most, least = (int(in_bytes(spark.conf.get(setting(n), d))) for n, d in (("maxPartitionBytes", "128m"), ("openCostInBytes", "4m")))
    total = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cut = max(1, min(most, max(least, -(-total // max(1, spark.sparkContext.defaultParallelism)))))
    spark.conf.set(setting("maxPartitionBytes"), str(cut))
    spark.conf.set(setting("minPartitionNum"), "1")
    spark.conf.unset(setting("maxPartitionNum"))
