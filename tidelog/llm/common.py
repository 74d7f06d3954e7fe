"""Shared helpers: durable intermediate tables, let-bindings, word splitting.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor costs a re-read and never a re-computation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.storage import delete, drop_table, durable, fresh_path, scratch

__all__ = ["ascii_lower", "dealt", "delete", "drop_table", "durable", "each_batch", "free_name", "fresh_path", "let", "long_rows", "scratch", "small_groups", "words_of"]

#: A word is a run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


#: Rows of an Arrow batch between the JVM and Python: texts are long, and both sides hold a batch.
BATCH_ROWS = 2000


def long_rows(spark: SparkSession) -> SparkSession:
    """Set the session's Arrow batches to BATCH_ROWS rows, for jobs whose rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


#: Bytes of a Parquet row group of texts: a task holds the one that it reads and the one that it writes.
GROUP_BYTES = 16 << 20


def small_groups(spark: SparkSession) -> SparkSession:
    """Let what the session writes from here on have row groups of GROUP_BYTES, not of 128 MB."""
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out by their keys, whatever size Spark takes them for.

    Catalyst does not count what ``explode`` makes of a row, and takes lists that compress well for as small as their
    file. Such a table can pass for one to broadcast, which the driver has to hold.
    """
    return df.hint("merge")


def each_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one by one; what Arrow holds for those already done goes back to the system."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, however often the body refers to it.

    A lambda variable holds a value, while a plain column reference inside another lambda
    would be evaluated again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with as many trailing ``_`` as it takes to differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """All words of a text in order; empty for null and for blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
