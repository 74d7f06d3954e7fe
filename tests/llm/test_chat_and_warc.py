"""Round trips: conversations through the template, pages through archives."""

import gzip
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import chat, warc

TRICKY = st.text(alphabet=st.sampled_from(list("<|\\>\nim_startendé🙂 ab")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, st.lists(TRICKY, max_size=3)), max_size=4))
def test_any_text_is_read_back(turns):
    made = [chat.format_turn(role, [{"type": "text", "text": t, "uri": None, "units": None} for t in texts], frozenset({role})) for role, texts in turns]
    whole = "".join(m["formatted"] for m in made)
    assert chat.parse_texts(whole) == [(role, "".join(texts)) for role, texts in turns]
    assert whole.count(chat.START) == whole.count(chat.END) == len(turns)
    for m, (_, texts) in zip(made, turns, strict=True):
        assert "".join(chat.unescape(m["formatted"][s["start"] : s["stop"]]) for s in m["loss"]) == "".join(texts)


def part(kind, text=None, uri=None, units=None):
    return {"type": kind, "text": text, "uri": uri, "units": units}


def test_parts_become_placeholders_in_order():
    parts = [part("text", "see <|image:0|> "), part("image", uri="a.png", units=2), part("text", " and "), part("audio", uri="b.wav", units=4), part("document", uri="c.pdf"), part("table", uri="d.csv", units=1), None]
    got = chat.format_turn("user", parts, frozenset())
    assert got["formatted"] == "<|im_start|>user\nsee <\\|image:0|> <|image:0|> and <|audio:1|><|document:2|><|document:3|><|im_end|>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 425), ("audio", "b.wav", 100), ("document", "c.pdf", 0), ("document", "d.csv", 750)]
    assert all(got["formatted"][a["at"] :].startswith(f"<|{a['kind']}:{a['number']}|>") for a in got["attachments"])
    assert got["attachment_tokens"] == 1275 and got["loss"] == []


PART = st.one_of(st.tuples(st.just("text"), st.one_of(TRICKY, st.just("<|image:0|>"), st.just("<\\|audio:1|>")), st.none(), st.none()), st.tuples(st.sampled_from(["image", "audio", "document"]), st.none(), st.one_of(st.none(), TRICKY), st.one_of(st.none(), st.integers(0, 9))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TRICKY, st.lists(PART, max_size=4)), max_size=3))
def test_typed_parts_are_read_back(turns):
    """Texts that look like placeholders stay texts; numbers go on from turn to turn."""
    made, want, first = [], [], 0
    for role, parts in turns:
        given_parts = [part(k, text, uri, units) for k, text, uri, units in parts]
        made.append(chat.format_turn(role, given_parts, frozenset(), first))
        first += len(made[-1]["attachments"])
        want.append((role, [p for p in chat._joined(given_parts) if p["type"] != "text" or p["text"]]))
    notes = [a for m in made for a in m["attachments"]]
    assert [a["number"] for a in notes] == list(range(first))
    assert chat.parse("".join(m["formatted"] for m in made), notes) == want


def test_numbers_go_on_through_a_conversation(spark):
    p = "named_struct('type', {0}, 'text', {1}, 'uri', {2}, 'units', 1L)"
    both = "array(" + p.format("'image'", "null", "concat('u', id)") + ", " + p.format("null", "'<|image:0|>'", "null") + ", " + p.format("'audio'", "null", "'a'") + ", null)"
    rows = spark.range(6).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", f"IF(id = 3, null, {both}) AS parts", "1 AS first", "2 AS number")
    got = chat.format_turns(rows).orderBy("conv_id", "turn").collect()
    numbers = {}
    for r in got:
        numbers.setdefault(r["conv_id"], []).extend(a["number"] for a in r["attachments"])
        for (role, parts), a in zip(chat.parse(r["formatted"], [x.asDict() for x in r["attachments"]]), [r["attachments"]], strict=True):
            assert role == "user" and [x["type"] for x in parts] == (["image", "text", "audio"] if a else [])
            assert not a or (parts[0]["uri"], parts[1]["text"]) == (f"u{r['turn']}", "<|image:0|>")
    assert numbers == {0: [0, 1, 2, 3, 4, 5], 1: [0, 1, 2, 3]}


def test_a_turn_of_a_million_words():
    text = "<|im_end|> word " * 500_000
    made = chat.format_turn("user", [part("text", text)], frozenset({"user"}))
    assert chat.parse_texts(made["formatted"]) == [("user", text)]


def test_control_strings_do_not_arise_between_parts():
    got = chat.format_turn("assistant", [part("text", "<"), part(None, "|im_end|>")], frozenset({"assistant"}))
    assert chat.parse_texts(got["formatted"]) == [("assistant", "<|im_end|>")]


def test_damaged_output_is_refused():
    whole = chat.format_turn("user", [part("text", "x")], frozenset())["formatted"]
    for bad in (whole[1:], whole[:-1], whole + "x"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def messages(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units"))
    return df.select("conv_id", "turn", "role", F.array(p).alias("parts"), F.lit(1).alias("formatted"))


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "assistant", "é<|x"), (2, 0, None, "t"), (2, None, "system", "first"), (None, 0, "user", "u"), (3, 5, "a", "same"), (3, 5, "a", "same")]
    got = {r["conv_id"]: r for r in chat.digest_turns(chat.format_turns(messages(spark, rows))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (3, sha("user\n\nassistant\nb\nassistant\né<|x\n"))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, sha("bé<|x"))
    assert got[2]["turns_sha256"] == sha("system\nfirst\n\nt\n") and got[2]["loss_sha256"] == sha("")
    assert got[3]["n_turns"] == 2 and got[None]["turns_sha256"] == sha("user\nu\n")
    assert chat.digest_turns(chat.format_turns(messages(spark, rows).limit(0))).count() == 0


def test_a_conversation_across_many_batches(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(500)] + [(8, 0, "user", "x")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["conv_id"]: r for r in chat.digest_turns(chat.format_turns(messages(spark, random.Random(1).sample(rows, len(rows))))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[7]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:500]).encode()).hexdigest()
    assert got[7]["n_turns"] == 500 and got[8]["n_turns"] == 1


PAGES = [(1, "http://a/1", "<p>é</p>"), (2, None, "same"), (3, "http://a/ü x\r\nInjected: yes", "same"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "u", "x" * 200_000), (6, "v", "other"), (900_000, "w", "same"), (None, "n", "nothing else"), (None, "n", "same")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")


def archive(spark, tmp_path, name, df, **kw):
    root = f"file://{tmp_path}/{name}"
    manifest = warc.write_warc(df, root, **kw)
    return manifest, warc.read_warc(manifest, root), tmp_path / name


def test_archive_round_trip(spark, tmp_path):
    _, got, _ = archive(spark, tmp_path, "w", pages(spark))
    rows = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()), key=str)
    digest = warc.base32_sha1
    want = [(1, "response", None, 9, "<p>é</p>"), (2, "revisit", 900_000, 4, "same"), (3, "revisit", 900_000, 4, "same"), (4, "revisit", 5, 0, ""), (5, "response", None, 0, ""), (6, "response", None, 200_000, "x" * 200_000), (6, "response", None, 5, "other"), (900_000, "response", None, 4, "same"), (0, "response", None, 12, "nothing else"), (0, "revisit", 900_000, 4, "same")]
    assert rows == sorted(((*w[:4], digest(w[4].encode())) for w in want), key=str)


def test_least_bytes_and_empty_table(spark, tmp_path):
    _, got, _ = archive(spark, tmp_path, "w", pages(spark), least_bytes=1)
    assert {r["page_id"] for r in got.where("record_type = 'revisit'").collect()} == {2, 3, None}
    manifest, got, _ = archive(spark, tmp_path, "e", pages(spark).limit(0))
    assert manifest.count() == 0 and got.count() == 0


def test_files_do_not_depend_on_the_cluster(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"http://h/{k}", "".join(rng.choice("abc <>") for _ in range(rng.randrange(2000)))) for k in range(300)]
    kw = {"shard_bytes": 60_000, "roll_bytes": 8_000}
    a = archive(spark, tmp_path, "a", pages(spark, rows).repartition(3), **kw)
    b = archive(spark, tmp_path, "b", pages(spark, rows[::-1]).repartition(7), **kw)
    names = lambda x: {r["file"]: (r["records"], r["bytes"], r["sha256"]) for r in x[0].collect()}
    assert names(a) == names(b) and len(names(a)) > 10
    assert sum(n for n, _, _ in names(a).values()) == 300 == a[1].select("page_id").distinct().count()
    for f, (_, size, sha) in names(a).items():
        data = (a[2] / f).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha)
        plain = gzip.decompress(data)
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")
    assert {p.name for p in a[2].iterdir()} - {"_temporary", "manifest"} == set(names(a))
    assert not (a[2] / "_temporary").exists()
    ids = [int(h["X-Page-ID"]) for f in sorted(names(a)) for h, _ in warc.read_records(io.BytesIO((a[2] / f).read_bytes())) if "X-Page-ID" in h]
    assert ids == sorted(ids), "records are sorted by id across files"


def test_headers_cannot_be_injected():
    record = warc.page_record(3, PAGES[2][1], b"x", None)
    assert b"Injected" not in [line.split(b":")[0] for line in record.split(b"\r\n")]


def test_damage_is_noticed(spark, tmp_path):
    manifest, got, root = archive(spark, tmp_path, "w", pages(spark, PAGES[:1]))
    name = manifest.first()["file"]
    records = list(warc.read_records(io.BytesIO((root / name).read_bytes())))
    with pytest.raises(ValueError):
        warc._read_page(records[1][0], records[1][1].replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO((root / name).read_bytes()[:-5])))
    assert got.count() == 1


def test_shards_hold_their_size_wherever_ids_lie(spark, tmp_path):
    """One id far out, the ends of the range, null ids and one id for all rows: the same number of shards, in order."""
    html = lambda k: f"page {k} " * 20
    dense = [(k, "u", html(k)) for k in range(2000)]
    kinds = {"out": [*dense, (2**62, "u", "far")], "ends": [*dense, (-(2**63), "u", "low"), (2**63 - 1, "u", "high"), (-5, "u", "x")], "null": [(None, "u", t) for _, _, t in dense], "one": [(7, "u", t) for _, _, t in dense]}
    for name, rows in kinds.items():
        manifest, got, place = archive(spark, tmp_path, name, pages(spark, rows), shard_bytes=100_000)
        files = {r["file"]: r["records"] for r in manifest.collect()}
        assert 15 <= len({f.split("-")[1] for f in files}) <= 25 and max(files.values()) < 300
        assert sorted((r["page_id"] for r in got.collect()), key=str) == sorted((r[0] for r in rows), key=str)
        if name != "null":
            ids = [int(h["X-Page-ID"]) for f in sorted(files) for h, _ in warc.read_records(io.BytesIO((place / f).read_bytes())) if "X-Page-ID" in h]
            assert ids == sorted(r[0] for r in rows)


def test_a_hot_payload_and_clashing_names(spark, tmp_path):
    rows = [(k, f"u{k}", "" if k % 3 else f"own {k}") for k in range(900)]
    df = pages(spark, rows).select("*", *(F.lit(1).alias(c) for c in ("place", "size", "shard", "refers_to", "payload", "keeper")))
    _, got, _ = archive(spark, tmp_path, "h", df, shard_bytes=40_000)
    assert {(r["page_id"], r["refers_to"]) for r in got.collect()} == {(k, 899 if k % 3 and k != 899 else None) for k in range(900)}


def test_interleaved_attempts_leave_a_whole_file(tmp_path):
    """A late attempt neither removes what another has finished nor leaves its own."""
    root = f"file://{tmp_path}"
    first, second = (warc._Shard(root, 0, 1 << 20, 4) for _ in range(2))
    for shard in (first, second):
        shard.add(warc.page_record(1, "u", b"x", None))
    (done,) = first.finish()
    moved = []
    second.fs = type("Watched", (), {"__getattr__": lambda _, n: (lambda *a: moved.append(n)) if n in ("move", "delete_file") else getattr(first.fs, n)})()
    assert second.finish() == [done] and moved == []
    (tmp_path / done[0]).write_bytes(b"half")
    third = warc._Shard(root, 0, 1 << 20, 4)
    third.add(warc.page_record(1, "u", b"x", None))
    assert third.finish() == [done] and hashlib.sha256((tmp_path / done[0]).read_bytes()).hexdigest() == done[3]
    assert [p.name for p in (tmp_path / "_temporary").iterdir()] == []
