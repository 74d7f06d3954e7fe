"""Scanning W3C extended logs whose columns are declared, and may change, inside the files.

Bulk scans keep to Spark's text reader and to Catalyst expressions. A first pass reduces each block
of a file to its number of lines and the headers in it. From that small table follow, for each
block, the number of lines before it and the headers that may be in effect in it. The second pass
joins it to the lines by file and block, so that a file of any size is read by as many tasks as
it has blocks, and no line is shuffled while the table may be broadcast: some 150 bytes a block, up to
BROADCAST_BLOCKS of them (a hundred terabytes in blocks of 128 MB). Beyond that the join shuffles. Where a block has
more than FEW_HEADERS headers, its lines meet them by a second small table, that of the stretches they hold in.

Both passes must cut the files into the same blocks. Spark cuts them by its session's settings and the cores it
has when a job starts, so the scan lives in a session of its own, whose split size is fixed when the scan is
made. Lines that nevertheless meet no block of the first pass raise an error.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import client_ip, text
from tidelog.schema import ENTRY, ENTRY_COLUMNS
from tidelog.session import pin_splits, private
from tidelog.settings import CLIENT_IP_PRIORITY
from tidelog.sources.ranges import RangeSource
from tidelog.storage import durable

#: Columns of an entry and the normalised header names they are read from.
SLOTS = {
    "date": ("date",),
    "time": ("time",),
    "server_ip": ("sip",),
    "method": ("csmethod",),
    "uri_stem": ("csuristem",),
    "uri_query": ("csuriquery",),
    "server_port": ("sport",),
    "username": ("csusername",),
    "client_ip": ("cip",),
    "user_agent": ("useragent", "csuseragent"),
    "referer": ("referer", "csreferer"),
    "status_code": ("scstatus",),
    "sub_status_code": ("scsubstatus",),
    "win32_status": ("scwin32status",),
    "time_taken_ms": ("timetaken",),
    "bytes_sent": ("scbytes",),
    "bytes_received": ("csbytes",),
    "host": ("shost", "cshost"),
    "protocol_version": ("csversion",),
    "cookie": ("cookie", "cscookie"),
    "forwarded_for": ("xforwardedfor", "forwardedfor"),
    "real_client_ip": ("xrealip", "realip"),
}
#: Blocks or stretches of them, and distinct headers, up to which their tables are broadcast.
BROADCAST_BLOCKS, BROADCAST_HEADERS = 1_000_000, 20_000
#: Headers that each line of a block is compared with; blocks with more are cut into stretches of STRETCH lines at least.
FEW_HEADERS, STRETCH = 8, 32
_NAMED = [n for names in SLOTS.values() for n in names]
_INTS = ("server_port", "status_code", "sub_status_code", "win32_status", "time_taken_ms")
_LONGS = ("bytes_sent", "bytes_received")


def _normal(name: str) -> str:
    name = name.lower()
    for part in ("cs(", "sc(", ")", "-", "_"):
        name = name.replace(part, "")
    return name


def layout(header: Column, ip_priority: Sequence[str], include_additional: bool) -> Column:
    """Where a header puts each column: ``struct(slots, candidates, extras)`` of token positions.

    ``slots`` follow SLOTS, -1 where absent, the last of repeated names counting. ``extras`` maps
    the other names that are kept; ``candidates`` are the positions to try for each address header.
    """
    fields = F.filter(F.transform(F.split(F.substring(header, 9, 1 << 20), " "), F.trim), lambda x: x != "")
    wanted = [_normal(h) for h in ip_priority]

    def place(f: Column) -> Column:
        last = lambda names: F.coalesce(F.array_max(F.transform(f, lambda x, i: F.when(x["norm"].isin(*names), i))), F.lit(-1))
        kept = (lambda x: ~x["norm"].isin(*_NAMED)) if include_additional else (lambda x: ~x["norm"].isin(*_NAMED) & x["norm"].isin(*wanted))
        extras = F.filter(f, kept)

        def first(test) -> Column:
            return F.coalesce(F.get(F.filter(extras, test), F.lit(0))["pos"], F.lit(-1))

        tries = []
        for h in ip_priority:
            if h.lower() == "c-ip":
                tries.append((last(SLOTS["client_ip"]), F.lit(-1)))
            elif h.lower() == "x-forwarded-for":
                tries.append((last(SLOTS["forwarded_for"]), first(lambda x: F.contains(x["norm"], F.lit("forwarded")))))
            elif h.lower() == "x-real-ip":
                tries.append((last(SLOTS["real_client_ip"]), first(lambda x: F.contains(x["norm"], F.lit("realip")))))
            else:
                tries.append((first(_is_name(_normal(h))), F.lit(-1)))
        names = F.array_distinct(F.transform(extras, lambda x: x["name"]))
        return F.struct(
            F.size(f).alias("n_fields"),
            F.array(*(last(names_) for names_ in SLOTS.values())).alias("slots"),
            F.array(*(F.struct(a.alias("first"), b.alias("then")) for a, b in tries)).alias("candidates"),
            F.transform(names, lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter(extras, lambda x: x["name"] == n), lambda x: x["pos"])).alias("pos"))).alias("extras"),
        )

    return text.let(F.transform(fields, lambda x, i: F.struct(x.alias("name"), text.normalize_header(x).alias("norm"), i.alias("pos"))), place)


def _is_name(name: str):
    return lambda x: x["norm"] == name


def parse_lines(lines: DataFrame) -> DataFrame:
    """Entries from ``lines(source_path, line_number, text, is_complete_line, layout)``.

    Directives, blank lines, lines without a header in effect and lines whose date column holds something else
    than a date are left out; a value that cannot be read is null.
    """
    lines = lines.where((F.col("text") != "") & ~F.startswith(F.col("text"), F.lit("#")))
    position = {name: k for k, name in enumerate(SLOTS)}
    where = F.col("layout")

    def read(t: Column) -> Column:
        at = lambda pos: text.value_or_null(F.get(t, pos))
        raw_date = F.get(t, where["slots"][position["date"]])
        dated = raw_date.isNull() | raw_date.isin("", "-") | text.to_date(raw_date).isNotNull()
        tries = F.transform(where["candidates"], lambda c: F.coalesce(at(c["first"]), at(c["then"])))
        own = F.array(at(where["slots"][position["client_ip"]]))
        extras = F.when(F.size(where["extras"]) > 0, F.map_from_entries(F.transform(where["extras"], lambda x: F.struct(x["name"], at(x["pos"])))))
        return F.struct(
            F.coalesce(dated & (where["n_fields"] > 0), F.lit(False)).alias("valid"),
            F.transform(F.transform(where["slots"], lambda p: F.get(t, p)), text.value_or_null).alias("values"),
            client_ip.resolve(F.concat(tries, own)).alias("resolved_client_ip"),
            extras.alias("additional_fields"),
        )

    # exploding the valid ones, unlike filtering, does not make the optimizer parse each line twice
    valid = F.filter(F.array(text.let(text.tokenize(F.col("text")), read)), lambda v: v["valid"])
    rows = lines.select("source_path", "line_number", "text", "is_complete_line", F.explode(valid).alias("v"))
    value = lambda n: F.col("v")["values"][position[n]]
    made = {n: value(n) for n in SLOTS if n not in ("date", "time")}
    made |= {n: text.to_int(value(n)) for n in _INTS} | {n: text.to_long(value(n)) for n in _LONGS}
    made |= {
        "id": F.lit(0).cast("long"),
        "source_id": F.lit(0).cast("long"),
        "file_id": F.lit(0).cast("long"),
        "source_path": F.col("source_path"),
        "line_number": F.col("line_number"),
        "timestamp_utc": text.to_timestamp(value("date"), value("time")),
        "resolved_client_ip": F.col("v")["resolved_client_ip"],
        "additional_fields": F.col("v")["additional_fields"],
        "raw_line": F.col("text"),
        "is_complete_line": F.col("is_complete_line"),
    }
    return rows.select(*(made[n].cast(ENTRY[n].dataType).alias(n) for n in ENTRY_COLUMNS))


def read_text(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, fallback: str = "ISO-8859-1") -> DataFrame:
    """``(source_path, block, file_size, seq, text, size)`` of every physical line; only LF ends a line.

    Lines that are not UTF-8 are decoded as ``fallback``.
    """
    reader = private(spark).read.option("lineSep", "\n").option("ignoreMissingFiles", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][oO][gG]")
    rows = reader.text([paths] if isinstance(paths, str) else list(paths))
    pin_splits(rows)
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), fallback))
    rows = rows.select(
        F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("seq"),
        (F.octet_length("value") + 1).cast("long").alias("size"),
        F.regexp_replace(value, r"^\uFEFF+|\r\z", "").alias("text"),
    )
    return rows


def scan_blocks(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """One row a file block: lines before it, the file's totals and the hashes of the headers that may hold in it."""
    header = F.lower(F.substring("text", 1, 8)) == "#fields:"
    found = lines.select("source_path", "block", "file_size", "seq", "size", F.when(header, F.col("text")).alias("header"))
    headers = F.sort_array(F.collect_list(F.when(F.col("header").isNotNull(), F.struct("seq", "header"))))
    blocks = found.groupBy("source_path", "block").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum("size").alias("bytes"), F.max("file_size").alias("file_size"), F.max_by("size", "seq").alias("last_size"), headers.alias("headers")
    )
    blocks = durable(blocks, "blocks", spark)
    w = Window.partitionBy("source_path").orderBy("block")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bytes_read = F.sum("bytes").over(whole)
    last = F.when(F.size("headers") > 0, F.element_at("headers", -1)["header"])
    return blocks.select(
        "source_path",
        "block",
        "first_seq",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("file_lines"),
        # the reader skips a byte order mark, which leaves the bytes read three short of the file
        ((bytes_read == F.col("file_size")) | (bytes_read == F.col("file_size") - 3)).alias("ends_with_lf"),
        F.col("file_size").alias("file_size"),
        F.last("last_size").over(whole).alias("last_size"),
        F.last(last, ignorenulls=True).over(whole).alias("last_header"),
        F.array_compact(F.concat(F.array(F.when(F.last(last, ignorenulls=True).over(before).isNotNull(), F.struct(F.lit(-1).cast("long").alias("seq"), F.last(last, ignorenulls=True).over(before).alias("header")))), F.col("headers"))).alias("headers"),
    )


def header_stretches(marked: DataFrame) -> DataFrame:
    """``(first_seq, stretch, near)`` for blocks with a ``width``: the headers that hold in some of each ``width`` lines, at most three rows a header.

    Headers may change every few lines. So a line meets those of its stretch, about one on average, and not all those of its block.
    """
    last = F.col("first_seq") + F.col("n") - 1
    spans = F.transform("known", lambda h, i: F.struct(h["seq"].alias("seq"), h["held"].alias("held"), F.greatest(h["seq"] + 1 - F.col("first_seq"), F.lit(0)).alias("a"), (F.coalesce(F.get("known", i + 1)["seq"], last) - F.col("first_seq")).alias("b")))
    rows = marked.where("width IS NOT NULL").select("first_seq", "width", F.explode(spans).alias("h")).where("h.a <= h.b")
    rows = rows.select("first_seq", F.explode(F.expr("sequence(h.a div width, h.b div width)")).alias("stretch"), F.struct("h.seq", "h.held").alias("h"))
    return rows.groupBy("first_seq", "stretch").agg(F.sort_array(F.collect_list("h")).alias("near"))


def number_lines(lines: DataFrame, blocks: DataFrame, ip_priority: Sequence[str], include_additional: bool) -> DataFrame:
    """Lines with their physical number, completeness and the layout in effect (null before any header).

    The result belongs to the session of ``blocks``. Blocks other than those that were counted are an error.
    """
    texts = durable(blocks.select(F.explode("headers.header").alias("header")).distinct(), "headers")
    layouts = texts.select(F.xxhash64("header").alias("held"), layout(F.col("header"), ip_priority, include_additional).alias("layout"))
    layouts = F.broadcast(layouts) if texts.count() <= BROADCAST_HEADERS else layouts
    known = F.transform("headers", lambda h: F.struct(h["seq"].alias("seq"), F.xxhash64(h["header"]).alias("held")))
    width = F.when(F.size("headers") > FEW_HEADERS, F.greatest(F.lit(STRETCH), F.expr("n div size(headers)")))
    marked = blocks.select("source_path", "block", "first_seq", "n", "before", "file_lines", "ends_with_lf", known.alias("known"), width.cast("long").alias("width"))
    n_blocks, busy = blocks.select(F.count("*"), F.count(width)).first()
    if busy:
        marked = durable(marked, "known")
        stretches = durable(header_stretches(marked), "stretches")
        stretches = F.broadcast(stretches) if stretches.count() <= BROADCAST_BLOCKS else stretches
        marked = marked.withColumn("known", F.when(F.col("width").isNull(), F.col("known")))
    small = F.broadcast(marked) if n_blocks <= BROADCAST_BLOCKS else marked
    joined = small.join(lines.select("source_path", "block", "seq", "text"), ["source_path", "block"], "right")
    place = F.col("seq") - F.col("first_seq")
    joined = joined.where(F.when((place >= 0) & (place < F.col("n")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the blocks of "), "source_path", F.lit(" changed while it was read"))).cast("boolean")))
    if busy:
        joined = joined.withColumn("stretch", F.expr("(seq - first_seq) div width")).join(stretches, ["first_seq", "stretch"], "left").withColumn("known", F.coalesce("near", "known"))
    number = F.col("before") + place + 1
    only = F.get("known", F.lit(0))
    one = F.when(only["seq"] < F.col("seq"), only["held"])
    now = F.when(F.size("known") == 1, one).otherwise(F.try_element_at(F.filter("known", lambda h: h["seq"] < F.col("seq")), F.lit(-1))["held"])
    joined = joined.select("source_path", number.alias("line_number"), "text", (F.col("ends_with_lf") | (number < F.col("file_lines"))).alias("is_complete_line"), now.alias("held"))
    return joined.join(layouts, "held", "left").drop("held")


def read_w3c(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    recursive: bool = False,
    include_additional: bool = False,
    ip_priority: Sequence[str] = CLIENT_IP_PRIORITY,
    include_incomplete: bool = True,
    fallback: str = "ISO-8859-1",
) -> DataFrame:
    """Entries of all files at ``paths`` (files, folders or globs)."""
    entries, _ = read_w3c_with_totals(spark, paths, recursive=recursive, include_additional=include_additional, ip_priority=ip_priority, include_incomplete=include_incomplete, fallback=fallback)
    return entries


def read_w3c_with_totals(spark: SparkSession, paths: str | Sequence[str], *, recursive: bool = False, include_additional: bool = False, ip_priority: Sequence[str] = CLIENT_IP_PRIORITY, include_incomplete: bool = True, fallback: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """Entries, and per file ``(source_path, file_size, file_lines, ends_with_lf, last_size, last_header)``."""
    if not isinstance(paths, str) and not paths:
        empty = spark.createDataFrame([], ENTRY)
        return empty, spark.createDataFrame([], "source_path string, file_size long, file_lines long, ends_with_lf boolean, last_size long, last_header string")
    lines = read_text(spark, paths, recursive, fallback)
    blocks = durable(scan_blocks(spark, lines), "layouts")
    entries = parse_lines(number_lines(lines, blocks, ip_priority, include_additional))
    totals = blocks.select("source_path", "file_size", "file_lines", "ends_with_lf", "last_size", "last_header").distinct()
    return entries if include_incomplete else entries.where("is_complete_line"), totals


def read_ranges(spark: SparkSession, ranges: Sequence[dict], *, include_additional: bool = False, ip_priority: Sequence[str] = CLIENT_IP_PRIORITY) -> DataFrame:
    """Entries of byte ranges ``[{path, offset, line, header, stop}]``: what was appended to files that are known."""
    spark.dataSource.register(RangeSource)
    lines = spark.read.format("w3c_ranges").option("ranges", json.dumps(list(ranges))).load()
    return parse_ranged(lines, include_additional=include_additional, ip_priority=ip_priority)


def parse_ranged(lines: DataFrame, *, include_additional: bool = False, ip_priority: Sequence[str] = CLIENT_IP_PRIORITY) -> DataFrame:
    """Entries of lines that carry their header's text."""
    lines = lines.where(F.col("header").isNotNull() & (F.lower(F.substring("text", 1, 8)) != "#fields:"))
    return parse_lines(lines.withColumn("layout", layout(F.col("header"), ip_priority, include_additional)))
