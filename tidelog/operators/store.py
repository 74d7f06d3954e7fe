"""The indexed store: parsed entries in Parquet, a small catalogue of files, incremental indexing.

Entries lie in ``entries/source_id=S/file_id=F`` so that a file's rows are replaced or dropped
without touching others, and a search reads only its source. A catalogue table is written whole as a new version, or
what changed is written beside it, and a pointer file that names the parts is renamed over the old one: readers see
one state or the next.

Files are indexed batch by batch. A batch's file ids are in the catalogue before its rows are written, and its checkpoints after; appended
rows that are already there are left out. So an indexing run that dies and is repeated goes on after the last whole
batch and leaves each line once. The driver holds the catalogue rows of one source, about a kilobyte a file.

New and reset files are scanned in bulk by Spark's reader; files that grew are read from their
checkpoint's byte offset on.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.search import matching, result_order
from tidelog.plans.request import SearchRequest
from tidelog.schema import LOG_FILES, SOURCES, STORED
from tidelog.settings import CLIENT_IP_PRIORITY, EngineSettings
from tidelog.sources.files import PREFIX, LogFile, LogSource, index_order, list_log_files, prefix_digests
from tidelog.sources.ranges import RangeSource
from tidelog.sources.w3c import parse_ranged, read_ranges, read_w3c, read_w3c_with_totals
from tidelog.storage import durable, filesystem

ID_BITS = 40
#: File ids that a filter may list, and checkpoints that may be broadcast: 16 bytes each.
LISTED, BROADCAST_FILES = 10_000, 1_000_000
#: Bytes of a batch of files: enough to keep a large cluster busy, little enough to lose.
BATCH_BYTES = 1 << 40


@dataclass(frozen=True)
class FileState:
    """One row of the file catalogue."""

    file_id: int
    source_id: int
    full_path: str
    file_name: str
    file_size: int = 0
    last_write_utc: datetime | None = None
    indexed_length: int = 0
    indexed_line_count: int = 0
    physical_lines: int = 0
    is_fully_indexed: bool = False
    fields_header: str | None = None
    prefix_length: int = 0
    prefix_sha256: str | None = None
    last_indexed_at: datetime | None = None

    @property
    def state(self) -> str:
        if self.is_fully_indexed and self.last_indexed_at:
            return "Outdated" if self.last_write_utc and self.last_write_utc > self.last_indexed_at else "Indexed"
        return "Partial" if self.indexed_length > 0 else "NotIndexed"


def index_state() -> Column:
    """:attr:`FileState.state` over the catalogue's columns."""
    done = F.col("is_fully_indexed") & F.col("last_indexed_at").isNotNull()
    late = F.coalesce(F.col("last_write_utc") > F.col("last_indexed_at"), F.lit(False))
    return F.when(done, F.when(late, "Outdated").otherwise("Indexed")).when(F.col("indexed_length") > 0, "Partial").otherwise("NotIndexed")


def requires_reset(state: FileState, file: LogFile, digest: str | None) -> bool:
    """The file shrank, its beginning changed, or it was rewritten at the same size."""
    if state.indexed_length == 0:
        return False
    if file.size < state.indexed_length or (state.prefix_sha256 is not None and digest != state.prefix_sha256):
        return True
    return file.size == state.file_size and state.last_write_utc is not None and file.modified != state.last_write_utc


def is_usable(state: FileState | None, file: LogFile, digest: str | None) -> bool:
    """Whether the indexed rows still are a prefix of the file."""
    if state is None or state.indexed_length == 0 or file.size < state.indexed_length:
        return False
    if state.prefix_sha256 is None:
        return True
    return digest == state.prefix_sha256 and (file.size > state.file_size or file.modified == state.last_write_utc)


@dataclass(frozen=True)
class IndexRun:
    """What an indexing run did."""

    files: int
    indexed: int
    reset: int
    rows: int
    seconds: float
    cancelled: bool = False


@dataclass(frozen=True)
class IndexProgress:
    """How far an indexing run has come: files and bytes that need nothing more, and rows written."""

    files_done: int
    files: int
    bytes_done: int
    bytes_total: int
    rows: int

    @property
    def percent(self) -> float:
        return min(100.0, 100 * self.bytes_done / self.bytes_total) if self.bytes_total else 100.0


def in_batches(files: list[tuple[LogFile, FileState]], most_files: int, most_bytes: int) -> Iterator[list[tuple[LogFile, FileState]]]:
    """Runs of files in their order, each of at most ``most_files`` and, unless one file has more, ``most_bytes``."""
    batch, size = [], 0
    for f, s in files:
        more = max(f.size - s.indexed_length, 0)
        if batch and (len(batch) == most_files or size + more > most_bytes):
            yield batch
            batch, size = [], 0
        batch.append((f, s))
        size += more
    if batch:
        yield batch


class LogStore:
    """Entries and catalogue below ``root``, any folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, ip_priority: Sequence[str] = CLIENT_IP_PRIORITY, batch_files: int = EngineSettings().bounded_batch_size, batch_bytes: int = BATCH_BYTES):
        self.spark, self.root, self.ip_priority = spark, root.rstrip("/"), tuple(ip_priority)
        self.batch_files, self.batch_bytes = batch_files, batch_bytes
        self._lock, self._cancel = threading.RLock(), threading.Event()
        self._worker: threading.Thread | None = None

    # Catalogue tables: small, rewritten whole, swapped by a rename.

    def _path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _exists(self, path: str) -> bool:
        fs, where = filesystem(self.spark, path)
        return fs.exists(where)

    def _current(self, table: str) -> list[str]:
        """The parts of the table, later ones overriding earlier ones."""
        fs, where = filesystem(self.spark, self._path("catalog", f"{table}.current"))
        if not fs.exists(where):
            return []
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def _read(self, table: str, schema) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(self._path("catalog", p)) for p in self._current(table)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if len(parts) == 1:
            return parts[0]
        rows = reduce(DataFrame.unionByName, (p.select(F.struct("*").alias("row"), F.lit(k).alias("part")) for k, p in enumerate(parts)))
        return rows.groupBy(F.col("row")[schema.names[0]]).agg(F.max_by("row", "part").alias("row")).select("row.*")

    def _write(self, table: str, rows: list[tuple], schema, added: bool = False) -> None:
        self._put(table, self.spark.createDataFrame(rows, schema), added)

    def _put(self, table: str, rows: DataFrame, added: bool = False) -> None:
        """Make ``rows`` the table, or with ``added`` those of its rows that have their ids."""
        before, version = self._current(table), f"{table}-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(self._path("catalog", version))
        fs, temp = filesystem(self.spark, self._path("catalog", f"{table}.current.{uuid.uuid4().hex}"))
        out = fs.create(temp, True)
        out.write(bytearray("\n".join([*before, version] if added else [version]).encode()))
        out.close()
        jvm = self.spark._jvm
        final = jvm.org.apache.hadoop.fs.Path(self._path("catalog", f"{table}.current"))
        if not fs.rename(temp, final):  # file systems that do not rename over a file
            fs.delete(final, False)
            fs.rename(temp, final)
        for gone in [] if added else before:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._path("catalog", gone)), True)

    # Sources.

    def sources(self) -> DataFrame:
        return self._read("sources", SOURCES)

    def save_source(self, source: LogSource, now: datetime | None = None) -> LogSource:
        """Insert or touch the source, known by kind and path; returns it with its id."""
        now = now or datetime.now(UTC)
        with self._lock:
            rows = [tuple(r) for r in self.sources().collect()]
            for k, r in enumerate(rows):
                if (r[2], r[3]) == (source.kind, source.path):
                    rows[k] = (r[0], source.name or r[1], r[2], r[3], source.include_subfolders, r[5], now)
                    found = r[0]
                    break
            else:
                found = max((r[0] for r in rows), default=0) + 1
                rows.append((found, source.name or source.path.rsplit("/", 1)[-1], source.kind, source.path, source.include_subfolders, now, now))
            self._write("sources", rows, SOURCES)
        return replace(source, source_id=found)

    def recent_sources(self, limit: int = 10) -> DataFrame:
        return self.sources().orderBy(F.coalesce("last_used_at", "created_at").desc(), "source_id").limit(limit)

    # Files.

    def files(self) -> DataFrame:
        return self._read("files", LOG_FILES)

    def file_states(self, source: LogSource) -> DataFrame:
        """The source's files, last written first, with their ``state``."""
        return self.files().where(F.col("source_id") == source.source_id).withColumn("state", index_state()).orderBy(F.desc("last_write_utc"), "full_path")

    def _states(self, source: LogSource) -> dict[int, FileState]:
        stamp = lambda t: t.replace(tzinfo=UTC) if t is not None and t.tzinfo is None else t
        rows = (FileState(**r.asDict()) for r in self.files().where(F.col("source_id") == source.source_id).collect())
        return {s.file_id: replace(s, last_write_utc=stamp(s.last_write_utc), last_indexed_at=stamp(s.last_indexed_at)) for s in rows}

    def _add_states(self, states: list[FileState]) -> None:
        """Insert or replace some files' rows."""
        if states:
            self._write("files", [tuple(getattr(s, n) for n in LOG_FILES.names) for s in states], LOG_FILES, added=True)

    def entries(self) -> DataFrame:
        """All stored rows."""
        path = self._path("entries")
        return self.spark.read.schema(STORED).parquet(path) if self._exists(path) else self.spark.createDataFrame([], STORED)

    def _rows_of(self, source: LogSource, ids: list[int]) -> DataFrame:
        """Stored rows of some of the source's files: a filter on folders, or a join where the list is long."""
        rows = self.entries().where(F.col("source_id") == source.source_id)
        if len(ids) <= LISTED:
            return rows.where(F.col("file_id").isin(ids))
        return rows.join(self.spark.createDataFrame([(i,) for i in ids], "file_id long"), "file_id", "left_semi")

    def find_file(self, source: LogSource, path: str) -> FileState | None:
        return next((s for s in self._states(source).values() if s.full_path.lower() == path.lower()), None)

    # Indexing.

    def index(self, source: LogSource, priority: SearchRequest | None = None, blocking: bool = True, now: datetime | None = None, on_progress: Callable[[IndexProgress], None] | None = None) -> IndexRun | None:
        """Bring the source's rows up to date. Without ``blocking`` a worker does it; a later call replaces an earlier one.

        ``on_progress`` hears of the state at the beginning and after each batch, which is committed by then.
        """
        if blocking:
            return self._index(source, priority, now, on_progress)
        self.cancel()
        self._worker = threading.Thread(target=self._index, args=(source, priority, now, on_progress), daemon=True)
        self._worker.start()
        return None

    def cancel(self) -> None:
        """Stop the worker, if any, and wait for it; what it committed stays."""
        if self._worker and self._worker.is_alive():
            self._cancel.set()
            self.spark.interruptTag(f"index-{id(self)}")
            self._worker.join()
        self._cancel.clear()

    def _index(self, source: LogSource, priority: SearchRequest | None, now: datetime | None, on_progress: Callable[[IndexProgress], None] | None = None) -> IndexRun:
        began = datetime.now(UTC)
        tag = f"index-{id(self)}"
        with self._lock:
            self.spark.addTag(tag)
            try:
                return self._index_files(source, priority, now or began, began, on_progress or (lambda _: None))
            except Exception:
                if not self._cancel.is_set():
                    raise
                return IndexRun(0, 0, 0, 0, (datetime.now(UTC) - began).total_seconds(), cancelled=True)
            finally:
                self.spark.removeTag(tag)

    def _index_files(self, source: LogSource, priority: SearchRequest | None, now: datetime, began: datetime, on_progress: Callable[[IndexProgress], None]) -> IndexRun:
        wanted = priority.from_utc.date() if priority and priority.from_utc else None
        files = index_order(list_log_files(self.spark, source), wanted)
        by_path = {s.full_path.lower(): s for s in self._states(source).values()}
        digests = prefix_digests(self.spark, [(f.path, s.prefix_length) for f in files if (s := by_path.get(f.path.lower())) and s.prefix_length])
        todo, touched, reset = [], [], 0
        top = self.files().agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
        for f in files:
            s = by_path.get(f.path.lower())
            if s is None:
                top += 1
                s = FileState(top, source.source_id, f.path, f.name)
            elif requires_reset(s, f, digests.get(f.path)):
                reset += 1
                s = FileState(s.file_id, source.source_id, f.path, f.name)
            elif s.is_fully_indexed and s.indexed_length == f.size:
                if (s.file_size, s.last_write_utc) != (f.size, f.modified):
                    touched.append(replace(s, file_size=f.size, last_write_utc=f.modified))
                continue
            todo.append((f, s))
        self._add_states(touched)
        total, rows, done = sum(f.size for f in files), 0, len(files) - len(todo)
        left = sum(f.size for f, _ in todo)
        on_progress(IndexProgress(done, len(files), total - left, total, rows))
        for batch in in_batches(todo, self.batch_files, self.batch_bytes):
            if self._cancel.is_set():
                break
            rows += self._index_batch(source, batch, now)
            done, left = done + len(batch), left - sum(f.size for f, _ in batch)
            on_progress(IndexProgress(done, len(files), total - left, total, rows))
        if len(self._current("files")) > 1:
            self._put("files", self.files())
        return IndexRun(len(files), done - (len(files) - len(todo)), reset, rows, (datetime.now(UTC) - began).total_seconds(), cancelled=self._cancel.is_set())

    def _index_batch(self, source: LogSource, batch: list[tuple[LogFile, FileState]], now: datetime) -> int:
        """Rows and then checkpoints of some files."""
        states = {s.file_id: s for _, s in batch}
        fresh = [(f, s) for f, s in batch if not s.indexed_length]
        if fresh:
            self._add_states([s for _, s in fresh])
            self._forget_rows(source, [s.file_id for _, s in fresh])
        rows = self._index_fresh(source, fresh, states, now) + self._index_grown(source, [(f, s) for f, s in batch if s.indexed_length], states, now)
        self._add_states(list(states.values()))
        return rows

    def _forget_rows(self, source: LogSource, ids: list[int]) -> None:
        """Delete what earlier runs stored for files that are to be indexed from the beginning."""
        fs, folder = filesystem(self.spark, self._path("entries", f"source_id={source.source_id}"))
        if fs.exists(folder):
            for name in {f"file_id={i}" for i in ids} & {s.getPath().getName() for s in fs.listStatus(folder)}:
                self._delete(self._path("entries", f"source_id={source.source_id}", name))

    def _with_ids(self, entries: DataFrame, files: list[tuple[LogFile, FileState]], source: LogSource) -> DataFrame:
        ids = durable(self.spark.createDataFrame([(f.path, s.file_id) for f, s in files], "source_path string, file_id long"), "ids")
        rows = entries.drop("file_id", "source_id", "id").join(ids, "source_path")
        rows = rows.withColumn("source_id", F.lit(source.source_id).cast("long")).withColumn("id", F.col("file_id") * F.lit(1 << ID_BITS) + F.col("line_number"))
        return rows.select(*STORED.names)

    def _index_fresh(self, source: LogSource, files: list[tuple[LogFile, FileState]], states: dict[int, FileState], now: datetime) -> int:
        """Whole files: their partitions are replaced, so a repeated run leaves no copies."""
        if not files:
            return 0
        entries, totals = read_w3c_with_totals(self.spark, [f.path for f, _ in files], ip_priority=self.ip_priority, include_incomplete=False)
        rows = self._with_ids(entries, files, source)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "file_id").parquet(self._path("entries"))
        ids = [s.file_id for _, s in files]
        kept = self._rows_of(source, ids)
        counts = {r[0]: (r[1], r[2]) for r in kept.groupBy("file_id").agg(F.count("*"), F.max("line_number")).collect()}
        found = {t["source_path"]: t for t in totals.collect()}  # one row a file
        digests = prefix_digests(self.spark, [(f.path, f.size) for f, _ in files])
        for f, s in files:
            n, last_line = counts.get(s.file_id, (0, 0))
            t = found.get(f.path)
            if t is None:
                continue
            end = t["file_size"] if t["ends_with_lf"] else t["file_size"] - (t["last_size"] - 1)
            states[s.file_id] = replace(
                s, file_size=f.size, last_write_utc=f.modified, indexed_length=end, indexed_line_count=last_line or 0, physical_lines=t["file_lines"] - (not t["ends_with_lf"]), is_fully_indexed=t["ends_with_lf"], fields_header=t["last_header"],
                prefix_length=min(PREFIX, f.size), prefix_sha256=digests.get(f.path), last_indexed_at=now,
            )
        return sum(n for n, _ in counts.values())

    def _index_grown(self, source: LogSource, files: list[tuple[LogFile, FileState]], states: dict[int, FileState], now: datetime) -> int:
        """Appended bytes: only rows past the checkpoint that are not stored yet are added."""
        if not files:
            return 0
        ranges = [{"path": f.path, "offset": s.indexed_length, "line": s.physical_lines, "header": s.fields_header, "stop": f.size} for f, s in files]
        self.spark.dataSource.register(RangeSource)
        lines = durable(self.spark.read.format("w3c_ranges").option("ranges", json.dumps(ranges)).load(), "appended").where("is_complete_line")
        ends = {r[0]: r for r in lines.groupBy("source_path").agg(F.max("end_offset"), F.max("line_number"), F.max_by("header", "line_number")).collect()}
        rows = self._with_ids(parse_ranged(lines, ip_priority=self.ip_priority), files, source)
        least = min(s.indexed_line_count for _, s in files)
        ids = [s.file_id for _, s in files]
        there = self._rows_of(source, ids).where(F.col("line_number") > least).select("file_id", "line_number")
        rows = durable(rows.join(there, ["file_id", "line_number"], "left_anti").select(*STORED.names), "new-rows")
        rows.write.mode("append").partitionBy("source_id", "file_id").parquet(self._path("entries"))
        kept = self._rows_of(source, ids)
        last = dict(kept.groupBy("file_id").agg(F.max("line_number")).collect())
        digests = prefix_digests(self.spark, [(f.path, f.size) for f, _ in files])
        for f, s in files:
            end = ends.get(f.path)
            to = end[1] if end else s.indexed_length
            states[s.file_id] = replace(
                s, file_size=f.size, last_write_utc=f.modified, indexed_length=to, indexed_line_count=max(last.get(s.file_id, 0), s.indexed_line_count), physical_lines=end[2] if end else s.physical_lines, is_fully_indexed=to >= f.size,
                fields_header=end[3] if end else s.fields_header, prefix_length=min(PREFIX, f.size), prefix_sha256=digests.get(f.path), last_indexed_at=now,
            )
        return rows.count()

    # Maintenance.

    def _delete(self, path: str) -> None:
        fs, where = filesystem(self.spark, path)
        fs.delete(where, True)

    def reset_file(self, state: FileState) -> None:
        """Drop the file's rows and its checkpoint."""
        with self._lock:
            self._delete(self._path("entries", f"source_id={state.source_id}", f"file_id={state.file_id}"))
            self._add_states([FileState(state.file_id, state.source_id, state.full_path, state.file_name)])

    def rebuild(self, source: LogSource) -> IndexRun:
        """Index all files of the source anew."""
        with self._lock:
            self._delete(self._path("entries", f"source_id={source.source_id}"))
            self._add_states([FileState(s.file_id, s.source_id, s.full_path, s.file_name) for s in self._states(source).values()])
            return self._index(source, None, None)

    def clear(self) -> None:
        """Drop all rows and files; sources stay."""
        with self._lock:
            self._delete(self._path("entries"))
            self._write("files", [], LOG_FILES)

    def cleanup(self, days: int | None, now: datetime | None = None) -> int:
        """Drop rows older than ``days``; rows without a time and all checkpoints stay. Returns the number dropped."""
        if days is None:
            return 0
        cutoff = (now or datetime.now(UTC)) - timedelta(days=days)
        with self._lock:
            rows = self.entries()
            old = F.coalesce(F.col("timestamp_utc") < F.lit(cutoff), F.lit(False))
            gone = {(r[0], r[1]): r[2] for r in rows.where(old).groupBy("source_id", "file_id").count().collect()}  # one row a file
            if not gone:
                return 0
            touched = self.spark.createDataFrame(list(gone), "source_id long, file_id long")
            kept = durable(rows.where(~old).join(F.broadcast(touched) if len(gone) < 100_000 else touched, ["source_id", "file_id"], "left_semi").select(*STORED.names), "kept")
            full = {(r[0], r[1]) for r in kept.select("source_id", "file_id").distinct().collect()}
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "file_id").parquet(self._path("entries"))
            for s, f in gone.keys() - full:
                self._delete(self._path("entries", f"source_id={s}", f"file_id={f}"))
            return sum(gone.values())

    def optimize(self, source: LogSource, rows_per_file: int = 5_000_000) -> None:
        """Rewrite the source's partitions as few files, sorted by time so that their statistics prune.

        A log file's rows are dealt out in runs of ``rows_per_file`` lines, so that many tasks share a large one.
        """
        with self._lock:
            rows = durable(self.entries().where(F.col("source_id") == source.source_id), "compact")
            run = F.floor(F.col("line_number") / rows_per_file)
            rows.repartition("source_id", "file_id", run).sortWithinPartitions("file_id", "timestamp_utc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("source_id", "file_id").parquet(self._path("entries"))

    def stats(self) -> DataFrame:
        """One row: stored bytes, entries, files, time of the last indexing."""
        fs, where = filesystem(self.spark, self._path("entries"))
        size = fs.getContentSummary(where).getLength() if fs.exists(where) else 0
        files = self.files().agg(F.count("*").alias("files"), F.max("last_indexed_at").alias("last_indexed_at")).first()
        one = self.entries().agg(F.count("*").alias("entries"))
        return one.select(F.lit(size).cast("long").alias("stored_bytes"), "entries", F.lit(files["files"]).cast("long").alias("files"), F.lit(files["last_indexed_at"]).cast("timestamp").alias("last_indexed_at"))

    # Searching.

    def search_frame(self, request: SearchRequest) -> DataFrame:
        """All matching entries of the request's source, stored or not, each line once, in no order."""
        source = request.source
        states = {s.full_path.lower(): s for s in self._states(source).values()}
        files = list_log_files(self.spark, source)
        digests = prefix_digests(self.spark, [(f.path, s.prefix_length) for f in files if (s := states.get(f.path.lower())) and s.prefix_length])
        whole, tails, stored, ends = [], [], [], []
        for f in files:
            s = states.get(f.path.lower())
            if not is_usable(s, f, digests.get(f.path)):
                whole.append(f.path)
                continue
            stored.append(s.file_id)
            if not s.is_fully_indexed or s.indexed_length < f.size:
                tails.append({"path": f.path, "offset": s.indexed_length, "line": s.physical_lines, "header": s.fields_header})
                ends.append((s.file_id, s.physical_lines))
        raw = read_w3c(self.spark, whole, ip_priority=self.ip_priority)
        indexed = self._rows_of(source, stored)
        if tails:
            # lines up to a file's checkpoint are stored, those after it are read, so none is in both; rows that a run which died left after it do not count
            raw = raw.unionByName(read_ranges(self.spark, tails, ip_priority=self.ip_priority))
            upto = self.spark.createDataFrame(ends, "file_id long, upto long")
            indexed = indexed.join(F.broadcast(upto) if len(ends) <= BROADCAST_FILES else upto, "file_id", "left").where("upto IS NULL OR line_number <= upto").drop("upto")
        raw = raw.withColumn("source_id", F.lit(source.source_id).cast("long"))
        raw, indexed = matching(raw, request), matching(indexed, request)
        return raw.withColumn("is_indexed", F.lit(False)).unionByName(indexed.withColumn("is_indexed", F.lit(True)), allowMissingColumns=True)

    def search(self, request: SearchRequest) -> DataFrame:
        """The first ``max_results`` matches in result order."""
        found = self.search_frame(request).withColumn("source_file", F.element_at(F.split("source_path", "/"), -1)).orderBy(*result_order())
        return found if request.max_results is None else found.limit(max(request.max_results, 0))
