"""Word hashes for matching: made in the JVM, handed to numpy as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Word hashes that are searched at a time.
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """XXH64 of each run of letters and digits, lower case, in order; empty for null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned hashes of all rows of a list column, and each row's offsets."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    if not len(col.values):
        return np.empty(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about CHUNK hashes; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def seed_hashes(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash per position at which the mask fits, over the words at the mask's offsets only."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _MIX
    for k in mask[1:]:
        out = (out ^ hashes[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class SeedTable:
    """Seed hashes of one mask with the (text, position) pairs they come from.

    A bit table rules out nearly all hashes before the sorted ones are searched.
    """

    BITS = 22

    def __init__(self, seeds: np.ndarray, texts: np.ndarray, at: np.ndarray):
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.texts, self.at = seeds[order], texts[order], at[order]
        self.bits: np.ndarray | None = None  # made where it is used, not sent

    def hits(self, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position in ``seeds``, text and position in it, for every match, in pieces of about CHUNK."""
        if self.bits is None:
            self.bits = np.zeros(1 << self.BITS, bool)
            self.bits[self.seeds >> np.uint64(64 - self.BITS)] = True
        maybe = np.flatnonzero(self.bits[seeds >> np.uint64(64 - self.BITS)])
        low, high = np.searchsorted(self.seeds, seeds[maybe], "left"), np.searchsorted(self.seeds, seeds[maybe], "right")
        n = high - low
        for a, b in pieces(np.concatenate(([0], np.cumsum(n)))):
            m = n[a:b]
            pick = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[a:b], m)
            yield np.repeat(maybe[a:b], m), self.texts[pick], self.at[pick]
