"""Small durable tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is configured a session of one machine (master ``local``) gets a folder of our own; on a cluster, whose
    executors would each write to their own disks, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _fallback[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else uses."""
    parent = _scopes[-1] if _scopes else f"{shared_dir(spark)}/tidelog"
    return f"{parent}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back, by ``spark`` if given.

    Lineage ends here, and Catalyst knows the table's size when it picks a join.
    """
    spark = spark or df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Tables made inside are deleted at the end: for work whose result is written elsewhere before that."""
    path = fresh_path(spark, label)
    _scopes.append(path)
    try:
        yield
    finally:
        _scopes.pop()
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where
