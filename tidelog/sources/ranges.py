"""Reading lines of files from given byte offsets, with exact offsets and line numbers.

The batch source ``w3c_ranges`` reads what was appended to files since a checkpoint: one task a
file, from its offset on. Bulk scans of whole files use Spark's own text reader instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_SCHEMA = "source_path string, line_number long, start_offset long, end_offset long, is_complete_line boolean, header string, text string"
CHUNK = 1 << 20
_HEADER_LINE = re.compile(rb"^(?:\xef\xbb\xbf)*#fields:[^\n]*", re.IGNORECASE | re.MULTILINE)


def place_of(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system, the path in it and what stands before that path in a URI: nothing for local files.

    Any file system that Arrow knows; others are an error.
    """
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", path), ""
    fs, where = pafs.FileSystem.from_uri(path)
    return fs, where, path.removesuffix("/").removesuffix(where.removesuffix("/"))


def open_at(path: str, offset: int):
    """A binary stream of the file from ``offset`` on."""
    fs, where, _ = place_of(path)
    stream = fs.open_input_file(where)
    stream.seek(min(offset, stream.size()))
    return stream


def lines_from(path: str, offset: int, stop: int | None = None) -> Iterator[tuple[int, int, bool, bytes]]:
    """(start, end, complete, bytes without line end) of each line from ``offset`` to ``stop`` or the end.

    Only LF ends a line; one CR before it is dropped. A last line without LF is not complete.
    """
    with open_at(path, offset) as stream:
        at, rest = stream.tell(), b""
        while stop is None or at + len(rest) < stop:
            room = CHUNK if stop is None else min(CHUNK, stop - at - len(rest))
            data = stream.read(room)
            if not data:
                break
            parts = (rest + data).split(b"\n")
            rest = parts.pop()
            for p in parts:
                yield at, at + len(p) + 1, True, p.removesuffix(b"\r")
                at += len(p) + 1
        if rest:
            yield at, at + len(rest), False, rest.removesuffix(b"\r")


def decode(line: bytes, fallback: str = "ISO-8859-1") -> str:
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        text = line.decode(fallback)
    return text.lstrip("﻿")


def is_header(text: str) -> bool:
    return text[:8].lower() == "#fields:"


def last_header(path: str, offset: int) -> tuple[str | None, int]:
    """The last header before ``offset`` and the number of lines before it."""
    header, n = None, 0
    for start, _, _, line in lines_from(path, 0, offset):
        if start >= offset:
            break
        n += 1
        text = decode(line)
        header = text if is_header(text) else header
    return header, n


def headers_in(block: bytes) -> list[bytes]:
    """The header lines of a run of whole lines, without line ends."""
    return [m[0].removesuffix(b"\r") for m in _HEADER_LINE.finditer(block)]


def header_before(path: str, offset: int) -> str | None:
    """The last header before ``offset``, sought backwards, so that no more is read than has to be."""
    with open_at(path, 0) as stream:
        end, first = min(offset, stream.size()), b""
        while end > 0:
            start = max(0, end - CHUNK)
            stream.seek(start)
            block = stream.read(end - start) + first
            whole = block.find(b"\n") + 1 if start else 0  # the line at the block's start may have begun before it
            found = headers_in(block[whole:]) if whole or not start else []
            if found:
                return decode(found[-1])
            first, end = block[:whole] if whole else block, start
    return None


class _Range(InputPartition):
    def __init__(self, path: str, offset: int, line: int, header: str | None, stop: int | None):
        self.path, self.offset, self.line, self.header, self.stop = path, offset, line, header, stop


class _RangeReader(DataSourceReader):
    def __init__(self, ranges: list[dict]):
        self.ranges = ranges

    def partitions(self) -> list[_Range]:
        return [_Range(r["path"], r.get("offset", 0), r.get("line", 0), r.get("header"), r.get("stop")) for r in self.ranges]

    def read(self, partition: _Range) -> Iterator[tuple]:
        header, n = partition.header, partition.line
        try:
            if header is None and partition.offset > 0:
                header, before = last_header(partition.path, partition.offset)
                n = n or before
            for start, end, complete, line in lines_from(partition.path, partition.offset, partition.stop):
                n += 1
                text = decode(line)
                if is_header(text):
                    header = text
                yield partition.path, n, start, end, complete, header, text
        except (FileNotFoundError, PermissionError):
            return  # a file that went away ends where it was


class RangeSource(DataSource):
    """``spark.read.format("w3c_ranges").option("ranges", json)`` with ``[{path, offset, line, header, stop}]``."""

    @classmethod
    def name(cls) -> str:
        return "w3c_ranges"

    def schema(self) -> str:
        return RANGE_SCHEMA

    def reader(self, schema: object) -> _RangeReader:
        return _RangeReader(json.loads(self.options["ranges"]))
