"""Finding log files, their sizes and their prefixes' digests, on any file system that Hadoop knows."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, date, datetime

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.ranges import open_at
from tidelog.storage import filesystem

PREFIX = 4096


@dataclass(frozen=True)
class LogSource:
    """What to scan: a ``file``, a ``folder`` or a ``site`` (a folder that discovery found)."""

    path: str
    kind: str = "folder"
    include_subfolders: bool = False
    name: str | None = None
    source_id: int = 0


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    modified: datetime

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


def plain_uri(path: str) -> str:
    """Local paths in one spelling, ``file:///...``."""
    return re.sub(r"^file:/+", "file:///", path)


def _of(status) -> LogFile:
    return LogFile(plain_uri(status.getPath().toString()), status.getLen(), datetime.fromtimestamp(status.getModificationTime() / 1000, UTC))


def list_log_files(spark: SparkSession, source: LogSource) -> list[LogFile]:
    """The source's log files, last written first, then by name descending without regard to case.

    A file source is that file whatever its name; folders give ``*.log``. What is missing or may not be read is left out.
    """
    try:
        fs, path = filesystem(spark, source.path)
        if not fs.exists(path):
            return []
        status = fs.getFileStatus(path)
        if source.kind == "file" or status.isFile():
            return [_of(status)] if status.isFile() else []
        found = []
        if source.include_subfolders:
            each = fs.listFiles(path, True)
            while each.hasNext():
                found.append(_of(each.next()))
        else:
            found = [_of(s) for s in fs.listStatus(path) if s.isFile()]
    except Py4JJavaError:
        return []
    found = [f for f in found if f.name.lower().endswith(".log")]
    found.sort(key=lambda f: f.name.upper(), reverse=True)
    return sorted(found, key=lambda f: f.modified, reverse=True)


def read_bytes(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    """A few bytes of a file, through the driver."""
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def detect_encoding(prefix: bytes, fallback: str = "ISO-8859-1") -> str:
    """UTF-8 if the prefix is valid UTF-8, perhaps cut inside its last character; else ``fallback``."""
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(prefix)
        return "UTF-8"
    except UnicodeDecodeError:
        return fallback


def prefix_digest(prefix: bytes) -> str:
    return hashlib.sha256(prefix).hexdigest()


def prefix_digests(spark: SparkSession, files: Iterable[tuple[str, int]]) -> dict[str, str]:
    """Digest of the first ``min(PREFIX, length)`` bytes of each (path, length); files that vanished are left out.

    Executors open the files, so many files cost no more than a few.
    """
    wanted = [(p, min(PREFIX, n)) for p, n in files]
    if not wanted:
        return {}

    def run(batches):
        for pdf in batches:
            out = []
            for path, n in zip(pdf["path"], pdf["n"], strict=True):
                try:
                    with open_at(path, 0) as f:
                        out.append((path, hashlib.sha256(f.read(n)).hexdigest()))
                except OSError:
                    continue
            yield pd.DataFrame(out, columns=["path", "digest"])

    rows = spark.createDataFrame(wanted, "path string, n long").repartition(max(1, len(wanted) // 64))
    return {r[0]: r[1] for r in rows.mapInPandas(run, "path string, digest string").collect()}


_DATED = re.compile(r"^u_ex(\d{6})", re.IGNORECASE)


def _file_date(name: str) -> date | None:
    m = _DATED.match(name)
    try:
        return datetime.strptime(m[1], "%y%m%d").date() if m else None
    except ValueError:
        return None


def index_order(files: list[LogFile], wanted_from: date | None = None) -> list[LogFile]:
    """Files in the order to index them: nearest to ``wanted_from``, or newest first, by the date in the name
    and else by the last write."""
    if len(files) < 2:
        return files

    def score(f: LogFile) -> float:
        day = _file_date(f.name) or f.modified.date()
        return -abs((day - wanted_from).days) if wanted_from else day.toordinal()

    return sorted(files, key=lambda f: (score(f), f.modified), reverse=True)


def files_frame(spark: SparkSession, files: list[LogFile]) -> DataFrame:
    """The listing as a table ``(path, name, size, modified, name_date)``."""
    rows = [(f.path, f.name, f.size, f.modified) for f in files]
    df = spark.createDataFrame(rows, "path string, name string, size long, modified timestamp")
    return df.withColumn("name_date", F.try_to_timestamp(F.regexp_extract("name", r"(?i)^u_ex(\d{6})", 1), F.lit("yyMMdd")).cast("date"))
