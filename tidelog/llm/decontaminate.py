"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over consecutive words; the words at its blanks are ignored, so a hash over
the others still meets when ignored words were substituted. Every position of every text is
hashed under each mask and matched with the benchmark's hashes. Around each hit the two texts are
overlaid on the hit's diagonal, and of all stretches of which at least ``least_identity`` of the words
match the one with most matches is kept where these number ``least_words`` or ``least_share`` of the
item, whichever is less.

The benchmark is broken into blocks of about ``block_words`` words. Each block's seeds are sent to
the executors, and the texts' word hashes are passed over once a block, written first where there are several, so no text is shuffled and what is sent
never outgrows the block. Hits are taken up in bounded pieces, however many items share a seed. Items with the same words are one item, named by the least id.

Light masks, chosen by enumeration, see to it that at the default limits no overlay goes without a hit;
overlays with too few matches in all are ruled out together before any is looked at.

Defined results: null and blank texts match nothing; items of fewer than ``shortest`` words
are not searched; items of fewer than VERBATIM words are sought word for word; repeated rows are reported
each; null item ids and null document ids are reported as such, and a document that matches an item without an id goes;
an empty benchmark or an empty table gives no rows; long texts are searched whole, one at a time beyond CHUNK words; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, each_batch
from tidelog.llm.tokens import CHUNK, SeedTable, flat, pieces, seed_hashes, word_hashes

#: Words that count (1) and words that are ignored (0).
MASKS = ("11011011", "1101000110011", "110010100010111")
#: With 7 of 10 words matching, any overlay within the limits has a hit of one of these: items of LONG words and more, and of VERBATIM to LONG.
LIGHT, LIGHTEST = ("111011", "110100011", "1001111", "101100101", "1110101", "1110011"), ("111", "1011")
LONG, VERBATIM = 15, 5
OUT = (("item_id", T.LongType(), pa.int64()), ("matched", T.IntegerType(), pa.int32()), ("overlap", T.IntegerType(), pa.int32()), ("item_words", T.IntegerType(), pa.int32()), ("start_word", T.IntegerType(), pa.int32()), ("stop_word", T.IntegerType(), pa.int32()))


def offsets_of(mask: str) -> tuple[int, ...]:
    return tuple(k for k, c in enumerate(mask) if c == "1")


def best_stretch(same: np.ndarray, least_identity: float = 0.7) -> tuple[int, int, int]:
    """Start, stop and matches of the stretch with most matches of which ``least_identity`` matches; of equals the shortest, then the first."""
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0, 0
    p, q = Fraction(least_identity).limit_denominator(10**6).as_integer_ratio()
    # a stretch is within the limit if and only if these weights add up to zero or more
    total = np.concatenate(([0], np.cumsum(np.where(same, q - p, -p))))
    matches = np.concatenate(([0], np.cumsum(same)))
    later = np.maximum.accumulate(total[::-1])[::-1]
    stops = np.searchsorted(-later, -total[starts], "right") - 1
    matched = matches[stops] - matches[starts]
    stops = starts[matches[stops] - 1] + 1
    k = np.lexsort((starts, stops - starts, -matched))[0]
    return int(starts[k]), int(stops[k]), int(matched[k])


class Block:
    """A bounded part of the benchmark with its seed tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]], masks: tuple[str, ...] = MASKS, shortest: int = 1):
        items = [(i, w) for i, w in items if len(w) >= shortest]
        self.ids, words = [i for i, _ in items], [w for _, w in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        whole = sorted({n for n in self.sizes.tolist() if n < VERBATIM})
        wanted = [(offsets_of(m), self.sizes >= len(m)) for m in masks]
        wanted += [(offsets_of(m), self.sizes >= LONG) for m in LIGHT]
        wanted += [(offsets_of(m), (self.sizes >= VERBATIM) & (self.sizes < LONG)) for m in LIGHTEST]
        wanted += [(tuple(range(n)), self.sizes == n) for n in whole]
        self.tables = []
        for mask, among in wanted:
            chosen = np.flatnonzero(among)
            seeds = [seed_hashes(words[k], mask) for k in chosen]
            n = [len(x) for x in seeds]
            if sum(n):
                self.tables.append((mask, SeedTable(np.concatenate(seeds), np.repeat(chosen, n), np.concatenate([np.arange(k) for k in n]))))

    def _overlays(self, hashes: np.ndarray, offsets: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, start) of each overlay with a hit in which at least ``least`` of the item's words match."""
        found = [np.empty(0, np.int64)]
        longest = int(self.sizes.max(initial=0))
        width, n = len(hashes) + longest + 1, len(self.sizes)
        for mask, table in self.tables:
            for where, item, at in table.hits(seed_hashes(hashes, mask)):
                row = np.searchsorted(offsets, where, "right") - 1
                inside = where + mask[-1] < offsets[row + 1]  # a seed may not reach into the next text
                found.append(np.unique(((row * n + item) * width + where - at + longest)[inside]))
        keys = np.unique(np.concatenate(found))
        pairs, start = keys // width, keys % width - longest
        row, item = pairs // max(n, 1), pairs % max(n, 1)
        first, last = np.maximum(start, offsets[row]), np.minimum(start + self.sizes[item], offsets[row + 1])
        done = np.concatenate(([0], np.cumsum(last - first)))
        k = 0
        while k < len(keys):
            to = max(k + 1, int(np.searchsorted(done, done[k] + CHUNK, "right")) - 1)
            step = np.arange(done[to] - done[k]) - np.repeat(done[k:to] - done[k], last[k:to] - first[k:to])
            here = np.repeat(first[k:to], last[k:to] - first[k:to]) + step
            there = np.repeat(self.at[item[k:to]] + first[k:to] - start[k:to], last[k:to] - first[k:to]) + step
            matches = np.add.reduceat(hashes[here] == self.words[there], done[k:to] - done[k], dtype=np.int64)
            for x in np.flatnonzero(matches >= least[item[k:to]]) + k:
                yield int(row[x]), int(item[x]), int(start[x])
            k = to

    def search(self, hashes: np.ndarray, offsets: np.ndarray, least_words: int, least_share: float, least_identity: float) -> Iterator[tuple]:
        """(row, item id, matched, overlap, item words, start, stop): the best stretch for each row and item."""
        least = np.minimum(least_words, least_share * self.sizes)
        best: dict[tuple[int, int], tuple] = {}
        for row, item, start in self._overlays(hashes, offsets, least):
            words = self.words[self.at[item] : self.at[item + 1]]
            first, last = max(start, offsets[row]), min(start + len(words), offsets[row + 1])
            same = hashes[first:last] == words[first - start : last - start]
            a, b, matched = best_stretch(same, least_identity)
            if matched >= least[item]:
                at = int(first - offsets[row])
                best[row, item] = max(best.get((row, item), (0,)), (matched, -(b - a), -(at + a), at + b))
        for (row, item), (matched, size, a, b) in sorted(best.items()):
            yield row, self.ids[item], matched, -size, int(self.sizes[item]), -a, b


def _items(benchmark: DataFrame, item_col: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """``(item_id, words)`` and the number of blocks to break it into."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.col(text)).alias("words"))
    return items, -(-items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] // block_words)


def _blocks(items: DataFrame, n: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The distinct items, block by block; each brought to the driver alone."""
    for k in range(n):
        got = items.where(F.pmod(F.hash("words"), F.lit(n)) == k).groupBy("words").agg(F.min("item_id").alias("item_id")).toArrow()
        yield sorted(((i.as_py(), np.array(w.as_py(), np.int64).view(np.uint64)) for w, i in zip(got.column(0), got.column(1), strict=True)), key=lambda x: (x[0] is None, x[0] or 0))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 13, least_share: float = 0.7, least_identity: float = 0.7, shortest: int = 1, block_words: int = 2_000_000) -> DataFrame:
    """``(id, item_id, matched, overlap, item_words, start_word, stop_word)``, one row per text and item that overlap."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t, _ in OUT)])
    rows = docs.select(F.col(id_col), word_hashes(F.col(text)).alias("words"))
    known, n = _items(benchmark, item_col, item_text, block_words)
    rows, found = durable(rows, "word-hashes") if n > 1 else rows, []
    for items in _blocks(known, n):
        block = Block(items, shortest=shortest)

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for b in each_batch(batches):
                hashes, offsets = flat(b.column(1))
                for first, last in pieces(offsets):
                    part = hashes[offsets[first] : offsets[last]]
                    got = list(block.search(part, offsets[first : last + 1] - offsets[first], least_words, least_share, least_identity))
                    ids = b.column(0).take(pa.array([first + g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([g[k + 1] for g in got], t) for k, (_, _, t) in enumerate(OUT))], names=[id_col, *(n for n, _, _ in OUT)])

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def _cleanness(block: Block, *limits: float) -> Callable[[pa.Array], pa.Array]:
    """Word hashes of texts to whether each is free of the block's items."""

    def clean(words: pa.Array) -> pa.Array:
        hashes, offsets = flat(words)
        out = np.ones(len(words), bool)
        for first, last in pieces(offsets):
            part = hashes[offsets[first] : offsets[last]]
            out[[first + g[0] for g in block.search(part, offsets[first : last + 1] - offsets[first], *limits)]] = False
        pa.default_memory_pool().release_unused()
        return pa.array(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 13, least_share: float = 0.7, least_identity: float = 0.7, shortest: int = 1, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text overlaps no benchmark item. Only word hashes go to Python, and no row is shuffled."""
    kept = docs
    for items in _blocks(*_items(benchmark, item_col, item_text, block_words)):
        clean = _cleanness(Block(items, shortest=shortest), least_words, least_share, least_identity)
        kept = kept.where(F.arrow_udf(clean, "boolean")(word_hashes(F.col(text))))
    return kept
