"""Deterministic sharded WARC writer and reader.

Records are sorted by id, equal ids by digest, and dealt to shards that cover ranges of that order; each shard is written by
one task as a run of gzip files that roll at a compressed size. Headers, record ids and digests
are generated from the records alone, so a task that runs again writes the same bytes. A file
is written under a temporary name and moved when complete; one that is there already with the same content is left alone, whichever
attempt wrote it. Readers go by the manifest table, which Spark commits after all files are in place: half-written files are never read.

Of the records whose payloads are equal, the one with the largest id is a response and the others
are revisits that refer to it. This is worked out on ids and digests alone; what a revisit refers to then travels
to the writers as a narrow row in front of its record, so payloads are shuffled once. Shard limits are quantiles by bytes of a sample by hash of
the records, all of them if few: neither chance nor the cluster's size change any file.

Defined results: a null payload is empty, a null url becomes ``urn:page:<id>``; payloads shorter
than ``least_bytes`` are responses each; rows that repeat the largest id of a payload are responses
too; rows with a null id come first and are responses unless a row with an id has the same payload;
an empty table gives an empty manifest; ids may lie anywhere in 64 bits; other columns of the input may have any name. A
payload must fit in a writer's memory. Rows alike in id, payload and url always share a shard.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import delete, durable, each_batch
from tidelog.llm.learning import chosen

#: Duplicate groups that may be broadcast: 48 bytes each.
BROADCAST_GROUPS = 100_000
#: Records of the sample that shard limits come from, 64 for each shard unless those are more, and bytes of a record beside its payload.
SAMPLE, HEAD_BYTES = 2_000_000, 700
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
READ = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=4)}>"


def _block(kind: str, headers: list[tuple[str, object]], body: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", "sha1:" + base32_sha1(body)), ("Content-Length", len(body))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + body + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The first record of each file."""
    body = b"software: tidelog\r\nformat: WARC File Format 1.1\r\n"
    return _block("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of page ``refers_to``, whose payload is the same."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{'' if page_id is None else page_id}"
    headers: list[tuple[str, object]] = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + digest)]
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if refers_to is None:
        return _block("response", headers, http + payload)
    return _block("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)], http)


class _Shard:
    """Writes one shard's records to files that roll at ``roll_bytes`` of compressed data."""

    def __init__(self, root: str, shard: int, roll_bytes: int, level: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.level, self.count = shard, roll_bytes, level, 0
        self.temp = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.out, self.done = None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.fs.create_dir(self.temp, recursive=True)
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(f"{self.temp}/{self.name}", compression=None), 0, 0, hashlib.sha256()
            self._member(info_record(self.name))
        self._member(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _member(self, record: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.out.write(data)
        self.size += len(data)
        self.sum.update(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        final = f"{self.root}/{self.name}"
        if not self._is_there(final):  # else another attempt of this task wrote the same bytes
            try:
                self.fs.move(f"{self.temp}/{self.name}", final)
            except OSError:  # a file system that does not move over a file, and what is there is not ours
                if not self._is_there(final):
                    self.fs.delete_file(final)
                    self.fs.move(f"{self.temp}/{self.name}", final)
        self.done.append((self.name, self.records, self.size, self.sum.hexdigest()))
        self.count += 1

    def _is_there(self, final: str) -> bool:
        """Whether the file is there whole, by size and digest."""
        if self.fs.get_file_info(final).size != self.size:
            return False
        found = hashlib.sha256()
        with self.fs.open_input_stream(final, compression=None) as stream:
            while data := stream.read(1 << 20):
                found.update(data)
        return found.digest() == self.sum.digest()

    def finish(self) -> list[tuple]:
        self.close()
        if self.fs.get_file_info(self.temp).type != pafs.FileType.NotFound:
            self.fs.delete_dir(self.temp)
        return self.done


def _place(page_id: Column, digest: Column) -> Column:
    """Text in whose order records are written: null ids first, then ids as signed numbers, then digests."""
    shifted = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(page_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), shifted)), F.upper(digest))


def _limits(facts: DataFrame, shard_bytes: int) -> list[str]:
    """The places at which a new shard begins, so that each has about ``shard_bytes``."""
    rows, size = facts.agg(F.count("*"), F.coalesce(F.sum(F.col("size") + HEAD_BYTES), F.lit(0))).first()
    shards = -(-size // shard_bytes)
    if shards <= 1:
        return []
    if shards > SAMPLE // 8:
        raise ValueError(f"{shards} shards of {shard_bytes} bytes: make them larger")
    share = min(1.0, max(min(64 * shards, SAMPLE), SAMPLE // 40) / rows)
    some = facts.where(chosen(F.col("place"), share, 5)).select("place", "size").toArrow()  # SAMPLE rows or so at most
    places = np.array(some.column(0).to_pylist(), "S")
    order = np.argsort(places, kind="stable")
    places, sizes = places[order], some.column(1).to_numpy()[order] + HEAD_BYTES
    first = np.concatenate(([True], places[1:] != places[:-1]))  # rows of one place stay together
    before = (np.cumsum(sizes) - sizes)[first] * shards // sizes.sum()
    return [p.decode() for p in places[first][np.flatnonzero(before[1:] != before[:-1]) + 1]]


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, level: int = 4) -> DataFrame:
    """Write all rows below ``root`` and return the committed manifest ``(file, records, bytes, sha256)``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    rows = rows.withColumn("place", _place(F.col("page_id"), F.col("digest")))
    facts = durable(rows.select("page_id", "digest", "size", "place"), "payloads")
    groups = facts.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeats = durable(groups.where("n > 1 and keeper is not null").select("digest", "size", "keeper"), "repeats")
    if repeats.count() <= BROADCAST_GROUPS:
        repeats = F.broadcast(repeats)
    revisits = facts.join(repeats, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("place", F.col("keeper").alias("refers_to")).distinct()
    limits = np.array(_limits(facts, shard_bytes), "S")

    @F.arrow_udf("int")
    def shard_of(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(limits, np.array(place.to_pylist(), "S"), "right").astype(np.int32) if len(limits) else np.zeros(len(place), np.int32))

    notes = revisits.select("place", "refers_to", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    records = rows.select("place", F.lit(None).cast("long").alias("refers_to"), "page_id", "url", "payload")
    both = notes.unionByName(records).withColumn("shard", shard_of("place"))
    dealt = both.repartitionById(len(limits) + 1, F.col("shard")).sortWithinPartitions("place", F.col("payload").isNotNull(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, noted, refers_to = None, [], None, None
        for b in each_batch(batches):
            for place, refer, page_id, url_, payload_, shard in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), b.column(5).to_pylist(), strict=True):
                if not payload_.is_valid:
                    noted, refers_to = place, refer
                    continue
                if now is None or now.shard != shard:
                    done += now.finish() if now else []
                    now = _Shard(root, shard, roll_bytes, level)
                now.add(page_record(page_id, url_.as_py(), payload_.as_py(), refers_to if noted == place else None))
        done += now.finish() if now else []
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    manifest, spark = f"{root}/manifest", pages.sparkSession
    dealt.mapInArrow(run, MANIFEST).write.parquet(manifest)
    delete(spark, f"{root}/_temporary")  # of attempts that were killed; what still runs is not in the manifest's way
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_records(stream: object, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one gzip file, a record at a time."""
    data, unpacker, plain = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        plain.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            record = b"".join(plain)
            head, _, rest = record.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            unpacker, plain = zlib.decompressobj(31), []
    if plain and any(plain):
        raise ValueError("the file ends inside a record")


def _read_page(headers: dict[str, str], block: bytes) -> tuple:
    if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs: {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload differs: {headers['WARC-Record-ID']}")
    number = lambda key: int(headers[key]) if key in headers else None
    return number("X-Page-ID"), headers["WARC-Target-URI"], size, digest, kind, number("X-Refers-To-Page-ID")


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """One row per page record of the files that ``manifest`` lists; digests and lengths are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        fs, base = pafs.FileSystem.from_uri(root)
        for b in each_batch(batches):
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = []
                    for headers, block in read_records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_read_page(headers, block))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                            rows = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(run, READ)


#: DuckDB SQL for the rows of query op10.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k"""
