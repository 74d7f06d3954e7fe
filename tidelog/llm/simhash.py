"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint holds, bit by bit, the majority over its word shingles' XXH64 hashes.
Fingerprints are cut into segments. Two of them within ``max_bits`` agree on at least one
segment up to ``max_bits // segments`` bits, so probing one table per segment with the small
Hamming ball around each segment value meets every partner; complete distances are verified
inside the join.

Only distinct fingerprints are linked, never copies. A segment value that more than
``bucket`` distinct fingerprints share would yield pairs in the square of their number; such
buckets leave the join and take another exact way: two fingerprints are within ``2 t`` bits if
and only if their balls of radius ``t`` share a point, so each fingerprint lists the points of its
own ball and each point links what meets there to its least member. That is linear in the
fingerprints, and no point gathers more than one ball's worth of them.

By default texts are linked by the Jaccard similarity of their sets of five-word shingles, 0.8 or
more. Sets at 0.8 differ in some ten of 64 bits, where no segment's ball is small, so a second
fingerprint, bands of min-hashes, proposes pairs beside those within ``max_bits`` of one another, and each pair's sets
are compared in full. Rows with equal sets are one node. ``similarity=None`` links fingerprints alone, as the query op4 does.

Pairs inside what is already one component say nothing new. So each node is compared with one hub first, then the
members of small bands, and those of large ones with some hubs, across components only. What large bands still hold apart is joined exactly,
by the rarest of each set's differences from what most of them have.

Defined results: null and blank texts have fingerprint zero, or the empty set, and are linked like any other; texts
shorter than a shingle hash their whole word sequence; long texts are hashed whole; repeated rows share a fingerprint and a
component; a null id never names a component unless all ids in it are null; an empty
table gives an empty result; other columns of the input may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import ascii_lower, dealt, durable, each_batch, free_name, let, words_of
from tidelog.llm.graph import components
from tidelog.llm.learning import chosen

#: Hashes whose bits are unpacked at a time: 64 bytes each.
CHUNK = 1 << 17
#: Two sets of similarity 0.8 miss all bands of the second fingerprint once in 20 000 times: (1 - 0.8 ** 5) ** 25.
BANDS, BAND_ROWS = 25, 5
#: Nodes of a large band that its others are compared with before the rest is joined by differences.
HUBS, HUB_SEED = 4, 29
#: Rows of ids and hashes that may be broadcast: 24 bytes each.
BROADCAST_IDS = 2_000_000
#: Hashes in lists, or rows of two or three hashes, up to which Spark may take a table for one to broadcast.
BROADCAST_HASHES = 500_000


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of every shingle in order, repeats included, as ``array<bigint>``."""

    def body(w: Column) -> Column:
        parts = lambda x, i: F.concat(x, *(p for k in range(1, words) for p in (F.lit(" "), F.get(w, i + k))))
        grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(parts(x, i))), F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(grams)

    return let(words_of(ascii_lower(text)), body)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run ``hashes[offsets[i]:offsets[i+1]]`` the 64-bit word of bits set in over half of it."""
    n = len(offsets) - 1
    sums = np.zeros((n, 64), np.int64)
    sizes = np.diff(offsets)
    raw = np.ascontiguousarray(hashes, dtype="<u8")
    full = np.flatnonzero(sizes)
    starts = offsets[:-1][full]
    for at in range(0, len(raw), CHUNK):
        end = min(at + CHUNK, len(raw))
        bits = np.unpackbits(raw[at:end].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end, "left")
        cuts = np.maximum(starts[first:last], at) - at
        sums[full[first:last]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _to_fingerprints(batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The last column, hashes, replaced by the fingerprint or, with ``keep``, followed by it."""
    for b in each_batch(batches):
        col = b.column(b.num_columns - 1)
        offsets = col.offsets.to_numpy().astype(np.int64)
        hashes = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64) if len(col.values) else np.empty(0, np.uint64)
        fp = majority_bits(hashes, offsets - offsets[0]) if b.num_rows else np.empty(0, np.uint64)
        held = b.num_columns if keep else b.num_columns - 1
        yield pa.RecordBatch.from_arrays([*b.columns[:held], pa.array(fp.view(np.int64))], names=[*b.schema.names[:held], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` for every row; hashing stays in the JVM, bits are counted by numpy on Arrow arrays."""
    hashed = docs.select(F.col(id_col), shingle_hashes(F.col(text), words).alias("hashes"))
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return hashed.mapInArrow(_to_fingerprints, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def _segment(lo: int, hi: int, radius: int) -> tuple[Column, Column]:
    """The bits ``lo`` to ``hi`` of a fingerprint, and the masks that lead to the values around it."""
    value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(_signed((1 << (hi - lo)) - 1)))
    masks = F.array(*(F.lit(_signed(m)) for m in ball(hi - lo, radius)))
    if radius == 1:  # of two values one bit apart, one has the bit: that one finds the other
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) == m)
    return value, masks


def _around(s: int, value: Column, masks: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(F.lit(s).alias("seg"), value.bitwiseXOR(m).alias("key")))


def _bit_distance() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, bucket: int = 64) -> DataFrame:
    """``(src, dst)`` pairs of distinct fingerprints whose closure joins all that are within ``max_bits``.

    ``fps`` has distinct values in ``fp``. Every pair returned is within ``max_bits``.
    """
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    radius = max_bits // segments
    rows, probes = [], []
    for s in range(segments):
        value, masks = _segment(cuts[s], cuts[s + 1], radius)
        rows.append(F.struct(F.lit(s).alias("seg"), value.alias("key")))
        probes.append(_around(s, value, masks))
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*rows)).alias("at")).select("at.*", "b")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("at")).select("at.*", "a")
    shared = held.groupBy("seg", "key").agg(F.count("*").alias("n"), F.min("b").alias("least"))
    # most probes meet nothing but the fingerprint that sent them; those end here
    hits = durable(dealt(asked).join(shared, ["seg", "key"]).where("n > 1 OR least <> a").select("seg", "key", "a", "n"), "hits")
    found = hits.where(F.col("n") <= bucket).join(dealt(held), ["seg", "key"]).where((F.col("a") != F.col("b")) & (_bit_distance() <= max_bits))
    found = found.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    hot = hits.where(F.col("n") > bucket)
    if not hot.isEmpty():
        found = found.unionByName(_meeting(hot.select("a").distinct(), max_bits))
    return found.distinct()


def _meeting(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links among ``crowd(a)`` through the points that their balls share."""
    inner, outer = max_bits // 2, (max_bits + 1) // 2
    points = lambda r: F.explode(F.array(*(F.lit(_signed(m)) for m in ball(64, r))))
    listed = crowd.select(F.col("a").alias("b"), points(outer).alias("m")).select("b", F.col("b").bitwiseXOR(F.col("m")).alias("point"), (F.bit_count("m") <= inner).alias("inner"))
    hubs = listed.where("inner").groupBy("point").agg(F.min("b").alias("a"), F.count("*").alias("n"))
    if inner == outer:
        hubs = hubs.where("n > 1")
    return dealt(listed).join(hubs, "point").where("a <> b").where(_bit_distance() <= max_bits).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _to_sets(words: int, with_sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprint, the hash of the set of shingles and its size, and the bands of least values under fixed multipliers or the set."""
    odd = np.random.default_rng(words).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _to_fingerprints(batches, keep=True):
            col, n = b.column(b.num_columns - 2), b.num_rows
            offsets = col.offsets.to_numpy().astype(np.int64)
            hashes = col.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(col.values) else np.empty(0, np.uint64)
            sets = [np.unique(hashes[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = np.array([len(x) for x in sets], np.int64)
            flat, at = np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum(sizes)))
            full = np.flatnonzero(sizes)
            node, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
            if len(full):
                mixed = (flat ^ (flat >> np.uint64(31))) * odd[0]
                node[full] = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), at[full])
                for k, m in enumerate(odd if not with_sets else ()):
                    low = np.minimum.reduceat(flat * m, at[full])
                    bands[full, k // BAND_ROWS] = (bands[full, k // BAND_ROWS] ^ low) * odd[0] ^ (low >> np.uint64(32))
            if with_sets:
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
            else:
                lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
            arrays = [b.column(b.num_columns - 1), pa.array(node.view(np.int64)), pa.array(sizes.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], names=[*b.schema.names[:-2], "fp", "node", "n", "list"])

    return run


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, with_sets: bool = False) -> DataFrame:
    """``(id, fp, node, n, list)`` for every row: ``node`` is the hash of its ``n`` distinct shingles, ``list`` has their bands or themselves."""
    hashed = docs.select(F.col(id_col), shingle_hashes(F.col(text), words).alias("hashes"))
    fields = [T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("list", T.ArrayType(T.LongType()))]
    return hashed.mapInArrow(_to_sets(words, with_sets), T.StructType([docs.schema[id_col], *fields]))


def _slight(df: DataFrame) -> DataFrame:
    """A durable table of ids and hashes, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _weighed(df: DataFrame, lists: str | None = None) -> DataFrame:
    """A durable table, dealt in joins if its rows, or the hashes in its column ``lists``, are many: a file of what
    repeats is far smaller than that is in memory.
    """
    held = df.agg(F.sum(F.size(lists))).first()[0] if lists else df.count()
    return dealt(df) if (held or 0) > BROADCAST_HASHES else df


def _across(rows: DataFrame, other: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """``(src, dst)`` of the nodes of ``rows`` and ``other`` that share ``key`` but no component; ``only`` may compare columns with those of ``other``, called ``other_...``."""
    met = rows.join(other.select(key, *(F.col(c).alias(f"other_{c}") for c in other.columns if c != key)), key).where("node <> other_node AND root <> other_root")
    met = met if only is None else met.where(only)
    return met.select(F.least("node", "other_node").alias("src"), F.greatest("node", "other_node").alias("dst"))


class _Linking:
    """Links between nodes whose sets are similar. Nodes of one root are known to be connected."""

    def __init__(self, sets: DataFrame, similarity: float):
        self.sets, self.similarity, self.edges, self.roots = sets, similarity, None, None

    def add(self, pairs: DataFrame) -> DataFrame:
        """Compare the sets of ``pairs(src, dst)``; those that are similar become edges, which are returned."""
        known = self.sets.select("node", "shingles")
        both = pairs.distinct().join(known.toDF("src", "x"), "src").join(known.toDF("dst", "y"), "dst")
        least, shared = F.lit(self.similarity), F.size(F.array_intersect("x", "y"))
        sized = F.least(F.size("x"), F.size("y")) >= least * F.greatest(F.size("x"), F.size("y")) - 1e-9
        same = sized & (shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9)
        new = durable(both.where(same).select("src", "dst"), "edges")
        self.edges = new if self.edges is None else self.edges.unionByName(new)
        return new

    def take_neighbours(self) -> None:
        """Each node takes its least neighbour, or itself, for its root: one pass that settles stars."""
        both = self.edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(self.edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        self.roots = durable(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "roots")

    def take_components(self) -> None:
        """The edges so far, between roots instead of nodes, make components; then they are done with.

        A crowd that is compared with many hubs has many edges to a node, but few between its roots. A node's root is its
        neighbour or itself at least, so an edge between them becomes one between that root and the root's own root, and roots connect as nodes do.
        """
        ends = self.edges
        for end in ("src", "dst"):
            ends = ends.join(self.roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        joined = components(durable(ends.where("src <> dst").distinct(), "between")).toDF("root", "least")
        own = [self.edges.select(F.col(end).alias("node"), F.col(end).alias("root")) for end in ("src", "dst")]
        known = self.roots.unionByName(own[0]).unionByName(own[1]).groupBy("node").agg(F.min("root").alias("root"))  # no root is above its node
        self.roots = durable(known.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "roots")
        self.edges = None

    def still_open(self, held: DataFrame) -> DataFrame:
        """The rows of ``held(key, node, many, hub)``, with ``root``, whose key has nodes of several roots."""
        rows = held.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        return _weighed(durable(rows.join(apart, "key", "left_semi"), "open"))


def _crowds(rows: DataFrame) -> DataFrame:
    """``rows(hub, node, root)`` with hubs that hold much the same nodes made one, so that few nodes are under several.

    A node's home is the largest of its hubs. A hub goes by the name of the home that most of its nodes have, if that is half of
    them at least. All of a hub's nodes get the same name, so nodes that shared a hub still do.
    """
    sizes = rows.groupBy("hub").agg(F.count("*").alias("m"))
    homes = rows.join(sizes, "hub").groupBy("node").agg(F.max(F.struct("m", "hub"))["hub"].alias("home"))
    shares = rows.join(homes, "node").groupBy("hub", "home").agg(F.count("*").alias("k"))
    named = shares.groupBy("hub").agg(F.max(F.struct("k", "home")).alias("most"), F.sum("k").alias("m"))
    named = named.select("hub", F.when(2 * F.col("most.k") >= F.col("m"), F.col("most.home")).otherwise(F.col("hub")).alias("crowd"))
    return rows.join(named, "hub").select(F.col("crowd").alias("hub"), "node", "root").distinct()


def _by_differences(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(src, dst)`` of all nodes of ``rows(hub, node, root)`` of one hub but different components that may be similar.

    What most nodes of a hub have is their core, and a node is described by its differences, the shingles that only it or only the
    core has. Two nodes x and y are similar if and only if ``2 |Dx & Dy| >= f(x) + f(y)``, where ``f(x)`` is
    ``|Dx| - c |x|`` with ``c = (1 - similarity) / (1 + similarity)``. So the node with the least f is similar to all whose
    f is at most the negative of its own, whatever their differences; only the others, far ones, need differences
    in common with whomever they are similar to. How many is bounded from below, and two sets that have so
    many in common share one of each one's rarest. Differences that no two components have in common, or no far node has, come before
    all others in that order and are only counted.
    """
    c = (1 - similarity) / (1 + similarity)
    members = rows.join(sets, "node")
    sizes = rows.groupBy("hub").agg(F.count("*").alias("m"))
    usual = members.select("hub", F.explode("shingles").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("df")).join(sizes, "hub").where("2 * df > m")
    core = usual.groupBy("hub").agg(F.collect_list("token").alias("core"))
    both = members.join(core, "hub", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    both = both.select("hub", "node", "root", F.size("shingles").alias("n"), F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles")).alias("d"))
    sides = durable(both.withColumn("f", F.size("d") - c * F.col("n")), "differences")
    centres = durable(sides.groupBy("hub").agg(F.min("f").alias("least"), F.min_by("node", "f").alias("centre")), "centres")
    longest = lambda bound: (F.size("d") - F.greatest(F.lit(1), F.ceil(bound / 2 - 1e-9)) + 1).cast("int")
    sides = sides.join(centres, "hub").withColumn("far", F.col("f") + F.col("least") > 1e-9)
    sides = sides.select("hub", "node", "root", "d", "f", "far", "centre", longest(F.col("f") + F.abs("least")).alias("short"), longest(F.col("f") + F.col("least")).alias("long"))
    sides = durable(sides, "sides")
    listed = sides.select("hub", "node", "root", "far", F.explode("d").alias("token"))
    counts = listed.groupBy("hub", "token").agg(F.count("*").alias("df"), F.min("root").alias("a"), F.max("root").alias("b"), F.max("far").alias("some"))
    counts = durable(counts.where("a <> b AND some").select("hub", "token", "df"), "counts")
    few = counts.count() <= BROADCAST_HASHES
    told = listed.select("hub", "node", "token")
    ranked = (told if few else dealt(told)).join(F.broadcast(counts) if few else counts, ["hub", "token"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    placed = sides.select("hub", "node", "root", "f", "far", "short", "long", F.size("d").alias("n")).join(ranked, ["hub", "node"]).withColumn("before", F.col("n") - F.size("ranked"))
    first = F.posexplode(F.slice("ranked", F.lit(1), F.greatest(F.when(F.col("far"), F.col("long")).otherwise(F.col("short")) - F.col("before"), F.lit(0)))).alias("at", "t")
    prefixes = placed.select("hub", "node", "root", "f", "far", "short", "n", "before", first).withColumn("at", F.col("before") + F.col("at"))
    prefixes = durable(prefixes.select(F.xxhash64("hub", "t.token").alias("key"), "node", "root", "f", "far", (F.col("n") - F.col("at")).alias("rest"), (F.col("at") < F.col("short")).alias("is_short")), "prefixes")
    apart = prefixes.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("far").alias("some")).where("a <> b AND some").select("key")
    prefixes = durable(prefixes.join(apart, "key", "left_semi"), "prefixes")
    distant, near = prefixes.where("far"), prefixes.where("not far")
    # no more than what follows the first one in common can be in common
    enough = F.least("rest", "other_rest") >= (F.col("f") + F.col("other_f")) / 2 - 1e-9
    found = _across(distant.where("is_short"), distant.where("is_short"), "key", enough).unionByName(_across(distant, near, "key", enough))
    return found.unionByName(sides.where("not far AND node <> centre").select(F.col("centre").alias("src"), F.col("node").alias("dst")))


def similar_components(nodes: DataFrame, proposed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, bucket: int = 16) -> DataFrame:
    """``(node, root)`` of the nodes that are linked: of ``nodes(node, keys)`` that share a key, and of ``proposed(src, dst)``, those whose sets have the similarity.

    ``sets_of`` gives ``(node, shingles)``. No pair across components goes without comparison.
    """
    rows = nodes.select("node", F.posexplode("keys").alias("seg", "key")).select(F.xxhash64("seg", "key").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("hub")).where("many > 1")
    held = durable(dealt(rows).join(shared, "key"), "held")
    proposed = durable(proposed, "proposed")
    wanted = held.select("node").unionByName(proposed.select(F.col("src").alias("node"))).unionByName(proposed.select(F.col("dst").alias("node"))).distinct()
    state = _Linking(_weighed(durable(sets_of(durable(wanted, "wanted")), "sets"), "shingles"), similarity)
    state.add(held.groupBy("node").agg(F.min("hub").alias("hub")).where("node <> hub").toDF("dst", "src").select("src", "dst").unionByName(proposed))
    state.take_neighbours()
    rows = state.still_open(held)
    large = rows.where(F.col("many") > bucket)
    hubs = large.where(chosen(F.col("node"), HUBS / F.col("many"), HUB_SEED))  # by one hash: bands of one crowd have the same hubs
    small = rows.where(F.col("many") <= bucket)
    state.add(_across(small, small, "key").unionByName(_across(large, hubs, "key")))
    state.take_components()
    rows = state.still_open(held.where(F.col("many") > bucket))
    if not rows.isEmpty() and not state.add(_by_differences(durable(_crowds(rows.select("hub", "node", "root").distinct()), "crowds"), state.sets, similarity)).isEmpty():
        state.take_components()
    return state.roots


def _near_sets(docs: DataFrame, words: int, max_bits: int, segments: int, similarity: float) -> DataFrame:
    marked = durable(shingle_sets(docs, "id", "text", words), "fingerprints")
    # rows with equal sets are one node, which the least id stands for; their fingerprints, which count repeats, may differ
    nodes = durable(marked.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.first("list").alias("list")), "nodes")
    fps = durable(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct")
    a, b = (fps.select(F.col("fp").alias(x), F.col("node").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
    proposed = links(fps.select("fp"), max_bits, segments).join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        few = _slight(durable(nodes.join(wanted, "node").select(F.col("node").alias("wanted"), "least"), "few"))
        # ids may be repeated, so that the set tells which of their rows it was
        found = shingle_sets(docs.join(few, docs["id"].eqNullSafe(few["least"]), "left_semi"), "id", "text", words, with_sets=True)
        return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("list").alias("shingles"))

    roots = similar_components(nodes.select("node", F.concat("list", F.array("fp")).alias("keys")), proposed, sets_of, similarity)
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("id", "fp", "node").join(rooted.join(named, "root").select("node", "component_id"), "node").select("id", "fp", "component_id")


def _near_prints(docs: DataFrame, words: int, max_bits: int, segments: int, bucket: int) -> DataFrame:
    marked = durable(fingerprints(docs, "id", "text", words), "fingerprints")
    fps = durable(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(fps, max_bits, segments, bucket))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, max_bits: int = 2, segments: int = 2, bucket: int = 64, similarity: float | None = 0.8) -> DataFrame:
    """``(id, fp, component_id)`` for every row; the component is named by its least id.

    With ``similarity`` None fingerprints within ``max_bits`` are linked, else texts whose sets of shingles have that Jaccard similarity.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    found = _near_prints(rows, words, max_bits, segments, bucket) if similarity is None else _near_sets(rows, words, max_bits, segments, similarity)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the row with the least id of each component stays.

    Exact repeats of that row (same id and text) collapse into one. One join with the few ids that something is to be done
    about decides on every row; texts are shuffled, once, only where those ids are too many to broadcast.
    """
    found = durable(near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", "text", **kw), "components")
    ids = found.select("id", (~F.col("id").eqNullSafe(F.col("component_id"))).alias("gone"))
    state = ids.groupBy("id").agg(F.min("gone").alias("gone"), (F.count("*") > 1).alias("again"))
    odd = durable(state.where("gone or again"), "odd")
    mark, fate = free_name(docs.columns, "id"), free_name(docs.columns, "gone")
    judged = docs.join(_slight(odd).toDF(mark, fate, free_name(docs.columns, "again")), F.col(id_col).eqNullSafe(F.col(mark)), "left")
    out = judged.where(F.col(fate).isNull()).select(*docs.columns)
    if odd.where("again and not gone").isEmpty():
        return out
    return out.unionByName(judged.where(~F.col(fate)).select(*docs.columns).dropDuplicates([id_col, text]))
