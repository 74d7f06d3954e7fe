"""Following files: partial lines, rotation, new files, restarts, checkpoints."""

import json
import os
from unittest import mock

import pytest

from tidelog.operators.store import LogStore
from tidelog.plans.request import SearchRequest
from tidelog.sources.files import LogSource
from tidelog.sources.samples import write_sample
from tidelog.sources.ranges import header_before
from tidelog.streaming.tail import CHUNK, TailReader, follow, live_trend, newest, tail, tail_offset

HEADER = "#Fields: date time cs-method cs-uri-stem sc-status\n"
LINE = "2024-01-01 00:0{0}:00 GET /new{0} 200\n"


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def between(reader, start, end):
    return [r for part in reader.partitions(start, end) for r in reader.read(part)]


def poll(reader, state):
    end = reader.latestOffset()
    return [(r[1], r[4]) for r in between(reader, state, end)], end


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "a.log"
    p.write_text(HEADER + "old\n")
    return p


def test_only_new_complete_lines(tmp_path, path):
    reader = TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()
    got, state = poll(reader, state)
    assert got == []
    append(path, "one\ntw")
    got, state = poll(reader, state)
    assert got == [(1, "one")]
    append(path, "o\r\nthree\n")
    got, after = poll(reader, state)
    assert got == [(2, "two"), (3, "three")]
    assert [r[4] for r in between(TailReader({"path": str(tmp_path)}), state, after)] == ["two", "three"]
    assert after[str(path)]["hdr"] == HEADER.strip()


@pytest.mark.parametrize("before", [HEADER + "old\n#Fields: date cs-uri-stem\nold\n", "\n#Fields: date cs-uri-stem\n", "old\n" * 30_000 + "#Fields: date cs-uri-stem\n"])
def test_the_last_header_before_the_end_holds(tmp_path, path, before):
    path.write_text(before)
    reader = TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()
    append(path, "one\n")
    after = reader.latestOffset()
    assert [r[3:] for r in between(reader, state, after)] == [("#Fields: date cs-uri-stem", "one")]
    assert [r[3:] for r in between(TailReader({"path": str(tmp_path)}), state, after)] == [("#Fields: date cs-uri-stem", "one")]
    append(path, "two\n")
    assert [r[3:] for r in between(reader, after, reader.latestOffset())] == [("#Fields: date cs-uri-stem", "two")]


def test_header_before(tmp_path):
    path = tmp_path / "h.log"
    for chunk in (7, 30, 1 << 20):
        for text in (b"", b"#Fields: a", b"\xef\xbb\xbf#Fields: a b\r\nx\n", b"x #Fields: no\n#fields: one\r\nrow\n#FIELDS: two\nrow\nrow 2\n", b"row\n" * 40):
            path.write_bytes(text)
            for off in range(len(text) + 1):
                lines = [m for m in text[:off].replace(b"\xef\xbb\xbf", b"").split(b"\n") if m.lower().startswith(b"#fields:")]
                with mock.patch("tidelog.sources.ranges.CHUNK", chunk):
                    assert header_before(str(path), off) == (lines[-1].removesuffix(b"\r").decode() if lines else None)


def test_a_batch_takes_so_many_bytes_and_leaves_the_rest(tmp_path, path):
    """Far behind, a stream catches up batch by batch, each read in ranges, and nothing is lost or numbered anew."""
    text = path.read_text()
    body = "".join(f"row {k}\n" + ("#Fields: date cs-uri-stem\n" if k == 500 else "") for k in range(1000)) + "z" * 3000 + "\nlast\n"
    append(path, body)
    known = {str(path): {"off": len(text), "line": 2, "hdr": HEADER.strip()}}
    with mock.patch.multiple("tidelog.streaming.tail", LOOK_BYTES=256, RANGE_BYTES=600):
        reader = TailReader({"path": str(tmp_path), "checkpoint": json.dumps(known), "batch_bytes": "2000"})
        state, rows, batches, parts = reader.initialOffset(), [], 0, 0
        while (end := reader.latestOffset()) != state:
            parts += len(reader.partitions(state, end))
            new = between(reader, state, end)
            assert sum(len(r[4]) + 1 for r in new) < 2000 + 256 or len(new[-1][4]) == 3000 or "last" in new[-1][4]
            assert new == between(TailReader({"path": str(tmp_path)}), state, end)
            rows, state, batches = rows + new, end, batches + 1
    want = body.split("\n")[:-1]
    assert [(r[1], r[4]) for r in rows] == list(enumerate(want, 3)) and batches >= 4 and parts > 2 * batches
    assert {r[3] for r in rows[:501]} == {HEADER.strip()} and {r[3] for r in rows[502:]} == {"#Fields: date cs-uri-stem"}


def test_restart_takes_what_came_meanwhile(tmp_path, path):
    reader = TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()
    append(path, "one\n")
    got, state = poll(reader, state)
    assert got == [(1, "one")]
    append(path, "two\nthree\nfo")
    stale = {str(path): {"off": 5, "line": 0, "hdr": None}}  # a checkpoint older than what was emitted
    (tmp_path / "b.log").write_text("kept\nnew\n")
    stale[str(tmp_path / "b.log")] = {"off": 5, "line": 1, "hdr": None}
    again = TailReader({"path": str(tmp_path), "checkpoint": json.dumps(stale)})
    got, state = poll(again, state)
    assert got == [(2, "two"), (3, "three"), (2, "new")]
    append(path, "ur\n")
    got, state = poll(again, state)
    assert got == [(4, "four")]


def test_unknown_file_systems_are_an_error():
    with pytest.raises(ValueError):
        TailReader({"path": "nosuch://host/logs"}).initialOffset()


def test_truncation_attaches_anew(tmp_path, path):
    reader = TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()
    path.write_text("x\n")
    got, state = poll(reader, state)
    assert got == []
    append(path, "y\n")
    got, state = poll(reader, state)
    assert got == [(1, "y")]
    path.unlink()
    got, state = poll(reader, state)
    assert (got, state) == ([], {})


def test_new_files_are_attached_at_their_end(tmp_path, path):
    reader = TailReader({"path": str(tmp_path)})
    state = reader.initialOffset()
    (tmp_path / "b.log").write_text("before\n")
    (tmp_path / "c.txt").write_text("no log\n")
    got, state = poll(reader, state)
    assert got == [] and len(state) == 2
    append(tmp_path / "b.log", "after\n")
    got, state = poll(reader, state)
    assert got == [(1, "after")]


def test_subfolders_and_missing_folders(tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "d.log").write_text("")
    assert TailReader({"path": str(tmp_path)}).initialOffset() == {}
    assert len(TailReader({"path": str(tmp_path), "recursive": "true"}).initialOffset()) == 1
    assert TailReader({"path": str(tmp_path / "none")}).initialOffset() == {}


def test_attaching_reads_little(tmp_path):
    path = tmp_path / "big.log"
    path.write_text(HEADER + "x" * 99 + "\n" + ("y" * 99 + "\n") * 70_000)
    offset, seen = tail_offset(str(path))
    assert offset == os.path.getsize(path) and seen <= CHUNK
    path.write_text("no line end" * 20_000)
    assert tail_offset(str(path))[0] == 0


def run(stream, tmp_path, name, mode="append"):
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()


def test_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    path = folder / "a.log"
    path.write_text(HEADER + LINE.format(1))
    source = LogSource(str(folder))
    query = run(tail(spark, source, request=SearchRequest(url_contains="new")), tmp_path, "tailed")
    try:
        query.processAllAvailable()
        append(path, LINE.format(2) + "2024-01-01 00:00:00 GET /other 200\n" + LINE.format(3)[:-9])
        query.processAllAvailable()
        assert [r["uri_stem"] for r in spark.table("tailed").collect()] == ["/new2"]
        append(path, LINE.format(3)[-9:])
        query.processAllAvailable()
        assert sorted(r["uri_stem"] for r in spark.table("tailed").collect()) == ["/new2", "/new3"]
        view = newest(spark.table("tailed").limit(0), spark.table("tailed"), 1)
        assert [r["uri_stem"] for r in view.collect()] == ["/new3"]
    finally:
        query.stop()


def test_stream_goes_on_from_the_store(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    path = folder / "u_ex260828.log"
    write_sample(spark, str(path), 20)
    store = LogStore(spark, str(tmp_path / "store"))
    source = store.save_source(LogSource(str(folder)))
    store.index(source)
    append(path, "2026-08-28 11:00:00 1.1.1.1 GET /x - 443 - 1.1.1.1 a - 200 0 0 1 1 1\n")
    query = run(tail(spark, source, store), tmp_path, "resumed")
    try:
        query.processAllAvailable()
        assert [(r["line_number"], r["uri_stem"]) for r in spark.table("resumed").collect()] == [(25, "/x")]
    finally:
        query.stop()


def test_follow(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(HEADER)
    seen = []
    query = follow(tail(spark, LogSource(str(folder))), lambda batch, _: seen.extend(r["uri_stem"] for r in batch.collect()), str(tmp_path / "ck_follow"), 0)
    try:
        query.processAllAvailable()
        append(folder / "a.log", LINE.format(1))
        query.processAllAvailable()
        assert seen == ["/new1"]
    finally:
        query.stop()


def test_live_trend(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(HEADER)
    query = run(live_trend(tail(spark, LogSource(str(folder))), late="0 seconds"), tmp_path, "trend", "complete")
    try:
        query.processAllAvailable()
        append(folder / "a.log", LINE.format(1) + LINE.format(1) + LINE.format(2) + "- - GET /x 1\n")
        query.processAllAvailable()
        assert sorted(r["count"] for r in spark.table("trend").collect()) == [1, 2]
    finally:
        query.stop()
