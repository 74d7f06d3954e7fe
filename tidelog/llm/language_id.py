"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams of a language, best first. A text is ranked
the same way over all of its words; the out-of-place distance to a profile adds up, over the
text's most frequent n-grams, how far each one's rank is from its rank in the profile, with
a fixed penalty for n-grams the profile lacks. The nearest profile wins.

N-grams of one to three letters are taken inside words padded with a blank on either side. They are packed into
integers (21 bits a letter), so that numpy sorts and counts them; batches arrive through Arrow.
Profiles come from a bounded sample: about ``most_per_language`` training texts of each
language, chosen by a seeded hash of the id. Every text is ranked whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; the score
otherwise is 1 minus the nearest distance over the largest possible one; ties go to the language
that sorts first; equally frequent n-grams rank by their code; rows with a null id or a null language never train; repeated rows are predicted alike.
Without any profile all texts are ``und``. Long texts are ranked whole, in numpy arrays some twenty times their size; other
columns of the input may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, each_batch
from tidelog.llm.learning import chosen, fold_of

PROFILE = 300
BLANK = 32
#: Languages whose sampling shares may be broadcast: some tens of bytes each.
BROADCAST_LANGUAGES = 100_000


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text of letters and single blanks, and how often each occurs."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4").astype(np.int64)
    letter = c != BLANK
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    parts = (c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]])
    codes = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The ``most`` most frequent codes, best first; ``codes`` ascend, so ties stay in order of code."""
    if len(codes) > 4 * most:  # only counts that may matter are sorted; ties at the edge all stay
        edge = np.partition(counts, -most)[-most]
        codes, counts = codes[counts >= edge], counts[counts >= edge]
    return codes[np.argsort(-counts, kind="stable")[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, code) within a task's batch, added up before the shuffle."""
    for b in each_batch(batches):
        lang, total = b.column(0).to_pylist(), {}
        for name, text in zip(lang, b.column(1), strict=True):
            total.setdefault(name, []).append(grams_of(text.as_py()))
        for name, found in total.items():
            codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])


def learn_profiles(docs: DataFrame, id_col: str, text: str, lang: str, folds: int, held_out: int, most_per_language: int, seed: int, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to ranked codes. What reaches the driver is ``size`` codes a language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold_of(F.col("id"), folds) != held_out))
    sizes = durable(known.groupBy("lang").agg(F.least(F.lit(1.0), most_per_language / F.count("*")).alias("share")), "languages")
    if sizes.count() <= BROADCAST_LANGUAGES:  # no text is shuffled by its language
        sizes = F.broadcast(sizes)
    picked = known.join(sizes, "lang").where(chosen(F.col("id"), F.col("share"), seed))
    picked = picked.select("lang", F.trim(_plain("text")).alias("letters")).where("letters <> ''")
    counts = picked.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = _top(durable(counts, "grams"), size)
    return {name: np.array(codes, np.int64) for name, codes in best}


def _top(counts: DataFrame, size: int) -> list[tuple[str, list[int]]]:
    """Each language's most frequent codes; a language has no more codes than its sample of texts."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, size)
    rows = counts.groupBy("lang").agg(F.transform(best, lambda x: x["code"]).alias("codes")).collect()  # one row a language
    return sorted((r["lang"], r["codes"]) for r in rows)


def _plain(text: str) -> Column:
    """The text in lower case with one blank for each run of anything but letters and their marks; empty without a letter."""
    return F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.regexp_replace(F.col(text), r"[^\p{L}\p{M}]+", " "))).otherwise("")


class Profiles:
    """All profiles as one lookup: a sorted array of codes and each language's rank of them."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[n]), k] = np.arange(len(profiles[n]))

    def predict(self, letters: str) -> tuple[str, float]:
        if not self.names or not letters.strip():
            return "und", 0.0
        top = ranked(*grams_of(letters.strip()), self.size)
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        ranks = self.ranks[at]
        away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(0)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.size * len(top)))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, most_per_language: int = 1000, seed: int = 23) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` per row of ``docs``; languages of fold ``held_out`` are never read."""
    profiles = Profiles(learn_profiles(docs.select(id_col, text, lang), id_col, text, lang, folds, held_out, most_per_language, seed))
    rows = docs.select(F.col(id_col), F.coalesce(fold_of(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), _plain(text).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            found = [profiles.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
