"""Following log files as they grow.

The streaming source ``w3c_tail`` polls the files of a source. Its offset holds, for each file, the
byte and line up to which complete lines were emitted and the header in effect there, so
Spark's checkpoint makes a restarted stream go on where it stopped. A batch is re-read from its two
offsets alone.

The driver looks at the new bytes for line ends and headers only, a chunk at a time; executors read the
lines, in ranges of about RANGE_BYTES. A batch takes ``batch_bytes`` of each file and leaves the rest to
the next ones; the first batch after a restart takes all that came meanwhile.

A file seen for the first time is attached at its checkpoint in the store, or else at its
end: nothing old is emitted, and the last header before it is sought when the first complete line arrives. A file that shrank is attached anew; one that vanished is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidelog.plans.predicate import to_predicate
from tidelog.plans.request import SearchRequest
from tidelog.settings import CLIENT_IP_PRIORITY, EngineSettings
from tidelog.sources.files import LogSource
from tidelog.sources.ranges import decode, header_before, headers_in, is_header, lines_from, open_at, place_of
from tidelog.sources.w3c import parse_ranged

TAIL_SCHEMA = "source_path string, line_number long, is_complete_line boolean, header string, text string"
CHUNK = 64 * 1024
#: Bytes that the driver looks through at a time, that a task reads, and that a batch takes of a file.
LOOK_BYTES, RANGE_BYTES, BATCH_BYTES = 1 << 20, 32 << 20, 1 << 30


def tail_offset(path: str) -> tuple[int, int]:
    """(offset after the last LF, bytes read to find it), searching backwards in small chunks."""
    with open_at(path, 0) as f:
        size = f.size()
        end, seen = size, 0
        while end > 0:
            start = max(0, end - CHUNK)
            f.seek(start)
            data = f.read(end - start)
            seen += len(data)
            at = data.rfind(b"\n")
            if at >= 0:
                return start + at + 1, seen
            end = start
    return 0, seen


class TailRange(InputPartition):
    """Whole lines of a file, with the line before them and the header in effect."""

    def __init__(self, path: str, off: int, stop: int, line: int, hdr: str | None):
        self.path, self.off, self.stop, self.line, self.hdr = path, off, stop, line, hdr


def advance(path: str, state: dict, size: int, most: int) -> Iterator[dict]:
    """The states at the ends of whole lines, about every RANGE_BYTES and then the last, up to ``most`` bytes on or, in a longer line, to its end."""
    off, line, hdr, sought = state["off"], state["line"] or 0, state["hdr"], state.get("sought", state["hdr"] is not None)
    begun, rest = off, bytearray()
    with open_at(path, off) as stream:
        while off - state["off"] < most and off + len(rest) < size:
            data = stream.read(min(LOOK_BYTES, size - off - len(rest)))
            if not data:
                break
            looked = len(rest)
            rest += data
            cut = rest.rfind(b"\n", looked) + 1
            if not cut:
                continue
            if not sought:
                hdr, sought = header_before(path, state["off"]), True
            if off - begun >= RANGE_BYTES:
                begun = off
                yield {"off": off, "line": line, "hdr": hdr, "sought": sought}
            block = bytes(rest[:cut])
            line += block.count(b"\n")
            found = headers_in(block)
            hdr = decode(found[-1]) if found else hdr
            off += cut
            del rest[:cut]
    yield {"off": off, "line": line, "hdr": hdr, "sought": sought}


class TailReader(DataSourceStreamReader):
    """Batches of complete lines; the reader itself remembers only where the last planned one ends."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.deep = options.get("recursive", "false") == "true"
        self.known = json.loads(options.get("checkpoint", "{}"))
        self.most = int(options.get("batch_bytes", BATCH_BYTES))
        self.now: dict[str, dict] | None = None
        self.marks: dict[str, list[dict]] = {}

    def _files(self) -> dict[str, int]:
        """Path and size of each file; what is missing or closed to us is left out until it appears."""
        fs, root, before = place_of(self.path)
        try:
            info = fs.get_file_info(root)
            if info.type == pafs.FileType.File:
                return {before + info.path: info.size}
            found = fs.get_file_info(pafs.FileSelector(root, recursive=self.deep, allow_not_found=True))
        except OSError:
            return {}
        return {before + f.path: f.size for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(".log")}

    def _attach(self, path: str, size: int, restarted: bool = False) -> dict | None:
        saved = self.known.get(path)
        saved = saved if saved and 0 < saved["off"] <= size else None
        if saved and not restarted:
            return saved
        try:
            # lines are numbered from the attachment on: counting all earlier ones would read the whole file
            state = {"off": tail_offset(path)[0], "line": None if restarted else 0, "hdr": None}
        except OSError:
            return None
        return state | {"since": saved} if saved else state

    def initialOffset(self) -> dict:
        found = {p: self._attach(p, n) for p, n in self._files().items()}
        self.now = {p: s for p, s in found.items() if s}
        return self.now

    def latestOffset(self) -> dict:
        end = {}
        for path, size in sorted(self._files().items()):
            state = (self.now or {}).get(path)
            if state is None or size < state["off"]:
                if state is not None:
                    self.known.pop(path, None)
                new = self._attach(path, size, self.now is None)
            else:
                try:
                    *marks, new = advance(path, state, size, self.most)
                    self.marks[path] = marks
                except OSError:
                    new = state
            if new:
                end[path] = new
        self.now = end
        self.marks = {p: m for p, m in self.marks.items() if p in end}
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Ranges of the lines between two offsets; where the reader does not remember what lies between, it looks again."""
        found = []
        for path, to in sorted(end.items()):
            state = start.get(path) or to.get("since")
            if state is None or to["off"] <= state["off"]:
                continue
            marks = [m for m in self.marks.get(path, ()) if state["off"] < m["off"] < to["off"]]
            if to["line"] is None or state["line"] is None or not (marks or to["off"] - state["off"] <= 2 * RANGE_BYTES):
                try:
                    *marks, last = advance(path, state, to["off"], to["off"])
                except OSError:
                    continue
                if to["line"] is None and (self.now or {}).get(path) == to:
                    self.now[path] = last  # after a restart the lines are known from here on
            hdr = state["hdr"] if state.get("sought", state["hdr"] is not None) else self._sought(path, state["off"])
            steps = [state | {"hdr": hdr}, *marks]
            stops = [*(m["off"] for m in marks), to["off"]]
            found += [TailRange(path, a["off"], b, a["line"] or 0, a["hdr"]) for a, b in zip(steps, stops, strict=True)]
        return found

    @staticmethod
    def _sought(path: str, offset: int) -> str | None:
        try:
            return header_before(path, offset)
        except OSError:
            return None

    def read(self, partition: TailRange) -> Iterator[tuple]:
        """The range's lines; if the file was truncated meanwhile, what is left of them."""
        header, n = partition.hdr, partition.line
        try:
            for _, _, complete, line in lines_from(partition.path, partition.off, partition.stop):
                if not complete:
                    return
                n += 1
                text = decode(line)
                header = text if is_header(text) else header
                yield partition.path, n, True, header, text
        except OSError:
            return


class TailSource(DataSource):
    """``spark.readStream.format("w3c_tail").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "w3c_tail"

    def schema(self) -> str:
        return TAIL_SCHEMA

    def streamReader(self, schema: object) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, source: LogSource, store=None, request: SearchRequest | None = None, ip_priority: tuple[str, ...] = CLIENT_IP_PRIORITY, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A stream of the entries appended to the source's files from now on, or since the store's checkpoint.

    Lines count from the checkpoint's line on; without one, from the first new line.
    """
    spark.dataSource.register(TailSource)
    known = {}
    if store is not None:
        for s in store._states(source).values():
            if s.indexed_length > 0:
                known[s.full_path.removeprefix("file://").removeprefix("file:")] = {"off": s.indexed_length, "line": s.physical_lines, "hdr": s.fields_header}
    reader = spark.readStream.format("w3c_tail").option("path", source.path).option("recursive", str(source.include_subfolders).lower()).option("batch_bytes", str(batch_bytes)).option("checkpoint", json.dumps(known))
    entries = parse_ranged(reader.load(), ip_priority=ip_priority)
    return entries.where(to_predicate(request, entries)) if request else entries


def follow(entries: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, refresh_seconds: int = EngineSettings.realtime_refresh_seconds) -> StreamingQuery:
    """Poll every ``refresh_seconds``, one at least, and hand each batch to ``each``; the query returned is stopped by its ``stop``."""
    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, refresh_seconds)} seconds").start()


def live_trend(entries: DataFrame, bucket: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests a bucket of event time; buckets close when the watermark has passed them."""
    rows = entries.where(F.col("timestamp_utc").isNotNull()).withWatermark("timestamp_utc", late)
    return rows.groupBy(F.window("timestamp_utc", bucket).alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("bucket"), "count")


def newest(view: DataFrame, batch: DataFrame, most: int) -> DataFrame:
    """A bounded view with the batch in front: for use in ``foreachBatch``."""
    both = view.unionByName(batch, allowMissingColumns=True)
    return both.orderBy(F.desc_nulls_last("timestamp_utc"), F.desc("source_path"), F.desc("line_number")).limit(most)
