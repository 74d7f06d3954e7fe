"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic examples and unlabelled texts, never confirmed clean ones. With
class prior ``p`` the risk of a linear classifier is ``p R+(1) + max(0, Ru(0) - p R+(0))``, R+ over
the toxic and Ru over the unlabelled examples, with the sigmoid loss, which is bounded; where the second part turns negative the step goes
the other way, so the model cannot fit toxic texts among the unlabelled ones as clean. A text's
features are the hashes of its distinct words and of their leading four and five letters, which
an inflected word shares with its kin. They come from the JVM; numpy trains and scores.

The toxic side is a sample of at most about ``most_toxic`` texts, chosen by a seeded hash of the id. The unlabelled side
is every text outside the held-out fold: one pass counts the features that toxic texts have, the ``keep``
features most lifted among these (by over LIFT standard errors) become the model's, and a second pass reduces every text to those. What
the risk needs of the unlabelled texts is how often each such reduced text occurs; up to LOCAL_PATTERNS different ones are summed by
the driver, more by Spark, a job a step. Weights are kept from falling below zero: a word may speak for toxicity,
its presence never for cleanness, so that long clean passages do not hide a toxic one. The bias is learnt with the weights
and then set where the same risk is least.

The class prior is estimated unless it is given: texts are ranked by how much more often their features occur in half of the toxic texts than in
the unlabelled ones; of the texts above a threshold, the unlabelled ones' share over that of the other toxic half bounds the prior, and
the least such bound is taken. A model trained on that half with this prior ranks again and may lower the bound.

Defined results: a null text counts as empty and scores as a text without any known word;
repeated rows score alike; rows with a null id are scored but never train; labels
that contradict one another are ignored; long texts are read whole; other columns may have any name. Without a toxic example, or
without an unlabelled one, every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import durable, each_batch, let
from tidelog.llm.learning import agreed_labels, fold_of, hash_sample

BITS = 20
#: Standard errors of lift, and the bias below which the loss is too flat for steps.
LIFT, FLOOR = 5.0, -3.0
#: Different reduced texts that the driver may hold, and tasks that add up a step's gradient beyond that.
LOCAL_PATTERNS, STEP_TASKS = 200_000, 64


def features(text: Column) -> Column:
    """``array<int>`` of hashed words and word beginnings; a word counts once per text."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"))
    code = lambda kind, x: F.shiftrightunsigned(F.xxhash64(F.lit(kind), x), 64 - BITS).cast("int")
    begins = lambda w, k: F.array_distinct(F.transform(F.filter(w, lambda x: F.length(x) >= k), lambda x: F.substring(x, 1, k)))
    whole = F.filter(words, lambda x: x != "")
    return let(
        whole,
        lambda w: F.concat(F.transform(w, lambda x: code(0, x)), F.transform(begins(w, 4), lambda x: code(4, x)), F.transform(begins(w, 5), lambda x: code(5, x))),
    )


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Rows:
    """Reduced texts, each a list of places in the model's features, that stand for ``counts`` texts each."""

    places: np.ndarray
    offsets: np.ndarray
    counts: np.ndarray

    def part(self, k: int) -> Rows:
        """Every second text, from the ``k``-th on; all of them if there is but one."""
        rows = range(k, len(self.counts), 2) if len(self.counts) > 1 else range(len(self.counts))
        lists = [self.places[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        return Rows(np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists]))), self.counts[list(rows)])

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + _row_sums(w[self.places], self.offsets)

    def terms(self, w: np.ndarray, b: float) -> np.ndarray:
        """The sum of the sigmoids of the logits, then its derivatives by the weights and the bias."""
        p = _squash(self.logits(w, b))
        slope = self.counts * p * (1 - p)
        by_weight = np.bincount(self.places, np.repeat(slope, np.diff(self.offsets)), minlength=len(w))
        return np.concatenate(([self.counts @ p], by_weight, [slope.sum()]))


def risk(w: np.ndarray, b: float, toxic: Rows, rest: Callable[[np.ndarray, float], np.ndarray], n_rest: float, prior: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk, its clean part before it is held at zero, and the direction of steepest ascent.

    The sigmoid loss of a text is 1 - s for target 1 and s for target 0, s being its score. Where the clean part is negative, the
    direction is that in which it falls further: a step the other way gives back what was fitted too well.
    """
    t, u = toxic.terms(w, b) / toxic.counts.sum(), rest(w, b) / n_rest
    clean = u - prior * t
    if clean[0] >= 0:
        return prior * (1 - t[0]) + clean[0], clean[0], clean[1:] - prior * t[1:]
    return prior * (1 - t[0]), clean[0], -clean[1:]


def descend(size: int, toxic: Rows, rest: Callable[[np.ndarray, float], np.ndarray], n_rest: float, prior: float, rounds: int = 300, rate: float = 0.1, decay: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam, weights held at zero or above and the bias at FLOOR or above."""
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        grad = risk(w, b, toxic, rest, n_rest, prior)[2]
        grad[:-1] += decay * w / size
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), max(b - move[-1], FLOOR)
    return w, float(b)


def prior_bound(toxic: np.ndarray, shares: Callable[[np.ndarray], np.ndarray], n_rest: float) -> float:
    """The least ratio, over thresholds that half of the ``toxic`` logits reach, of the unlabelled share that reaches them to the toxic share.

    ``shares`` gives the unlabelled shares. Standard errors count in favour of the larger ratio.
    """
    cuts = np.unique(np.quantile(toxic, np.linspace(0, 0.5, 26), method="lower"))
    t, u = np.array([(toxic >= c).mean() for c in cuts]), shares(cuts)
    high, low = u + np.sqrt(u * (1 - u) / n_rest), t - np.sqrt(t * (1 - t) / len(toxic))
    return float(np.min(high / np.maximum(low, 0.01)))


def lift(seen_toxic: np.ndarray, n: int, seen_rest: np.ndarray, m: int) -> np.ndarray:
    """By how many standard errors each feature's share among the toxic texts exceeds that among the others; 0 if only one toxic text has it."""
    share_t, share_u = seen_toxic / n, (seen_rest + 0.5) / (m + 1)
    return np.where(seen_toxic >= 2, (share_t - share_u) / np.sqrt(share_u * (1 - np.minimum(share_u, 1)) / n + 1e-12), 0)


def lifted(seen_toxic: np.ndarray, n: int, seen_rest: np.ndarray, m: int, keep: int) -> np.ndarray:
    """The codes, sorted, of the ``keep`` features lifted most, and by more than LIFT."""
    found = lift(seen_toxic, n, seen_rest, m)
    best = np.argsort(-found, kind="stable")[:keep]
    return np.sort(best[found[best] > LIFT]).astype(np.int32)


def _reduced(codes: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's places in ``chosen``, ascending, and offsets."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[codes]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at >= 0]
    at = at[at >= 0]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])))[: len(at)]  # two features may share a code
    return at[once], np.concatenate(([0], np.cumsum(np.bincount(row[once], minlength=len(offsets) - 1))))


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The feature arrays of a bounded table, brought to the driver."""
    col = rows.toArrow().column(rows.columns[-1]).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    return _flat(col) if len(col) else (np.empty(0, np.int32), np.zeros(1, np.int64))


def _counted(docs: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """How many texts ``docs(codes)`` has, and how many have each of the codes that are ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(1 << BITS, np.int64)
        for b in each_batch(batches):
            codes, _ = _flat(b.column(0))
            n += b.num_rows
            seen += np.bincount(codes, minlength=1 << BITS)
        some = np.flatnonzero(seen * known).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, np.int32(-1))), pa.array(np.append(seen[some], n))], names=["code", "n"])

    found = docs.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # the toxic sample's codes at most
    total, seen = 0, np.zeros(1 << BITS, np.int64)
    for code, n in zip(found.column(0).to_numpy(), found.column(1).to_numpy(), strict=True):
        if code < 0:
            total = int(n)
        else:
            seen[code] = n
    return total, seen


class _Patterns:
    """The unlabelled texts as ``patterns(places, n)``: held here if there are few, added up by Spark if many."""

    def __init__(self, patterns: DataFrame, size: int):
        self.frame, self.size, self.rows = patterns, size, None
        if patterns.count() <= LOCAL_PATTERNS:
            places, offsets = _collected(patterns.select("places"))
            self.rows = Rows(places.astype(np.intp), offsets, patterns.select("n").toArrow().column(0).to_numpy().astype(float))

    def _summed(self, f: Callable[[Rows], np.ndarray], width: int) -> np.ndarray:
        if self.rows is not None:
            return f(self.rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in each_batch(batches):
                total += f(Rows(*_flat(b.column(0)), b.column(1).to_numpy().astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

        parts = self.frame.select("places", "n").coalesce(STEP_TASKS).mapInArrow(run, "sums array<double>").collect()  # STEP_TASKS rows at most
        return np.sum([p["sums"] for p in parts], axis=0)

    def terms(self, w: np.ndarray, b: float) -> np.ndarray:
        return self._summed(lambda rows: rows.terms(w, b), self.size + 2)

    def scored(self, w: np.ndarray, biases: np.ndarray) -> np.ndarray:
        """The sum of the scores under each of ``biases``."""

        def sums(rows: Rows) -> np.ndarray:
            z = rows.logits(w, 0.0)
            return np.array([rows.counts @ _squash(z + b) for b in biases])

        return self._summed(sums, len(biases))

    def reaching(self, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Texts whose logit without bias reaches each of ``cuts``."""

        def sums(rows: Rows) -> np.ndarray:
            z = rows.logits(w, 0.0)
            return np.array([rows.counts[z >= c].sum() for c in cuts], float)

        return self._summed(sums, len(cuts))


@dataclass(frozen=True)
class CueModel:
    """A sparse linear classifier: sorted feature codes, their weights and a bias, and the class prior it was trained with."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of reduced texts."""
        return _squash(self.bias + _row_sums(self.weights[places], offsets)) if len(self.weights) else np.zeros(len(offsets) - 1)


NONE = CueModel(np.empty(0, np.int32), np.empty(0), 0.0, 0.0)


def fit(codes: np.ndarray, toxic: Rows, patterns: _Patterns, n_rest: int, usual: np.ndarray, prior: float | None) -> CueModel:
    """Train on reduced texts; ``usual`` counts the unlabelled ones that have each feature."""
    if prior is None:
        half = toxic.part(0)
        seen = np.bincount(half.places, minlength=len(codes))
        own = lift(seen, len(half.counts), usual, n_rest) > LIFT  # the other half had no say in these
        bound = lambda w: min(max(prior_bound(toxic.part(1).logits(w * own, 0.0), lambda cuts: patterns.reaching(w * own, cuts) / n_rest, n_rest), 1e-6), 0.9)
        prior = bound(np.maximum(np.log((seen + 0.5) / (len(half.counts) + 1) / ((usual + 0.5) / (n_rest + 1))), 0))
        prior = min(prior, bound(descend(len(codes), half, patterns.terms, n_rest, prior)[0]))
    w, _ = descend(len(codes), toxic, patterns.terms, n_rest, prior)
    # steps in the bias die out where the loss is flat, so it is sought at the end where the risk is least
    biases = np.linspace(-12, 4, 321)
    t = np.array([_squash(toxic.logits(w, b)).mean() for b in biases])
    risks = prior * (1 - t) + np.maximum(patterns.scored(w, biases) / n_rest - prior * t, 0)
    return CueModel(codes, w, float(biases[np.argmin(risks)]), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_out: int = 2, prior: float | None = None, most_toxic: int = 3000, keep: int = 4000, seed: int = 17) -> DataFrame:
    """``(id, held_out, score)`` per row of ``docs``; labels of fold ``held_out`` are never read."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold_of(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    known = agreed_labels(labels, id_col, label).where((fold_of(F.col(id_col), folds) != held_out) & (F.col("y") == 1)).select(F.col(id_col).alias("id"))
    some = hash_sample(known, "id", most_toxic / max(known.count(), 1), seed)  # about most_toxic ids
    picked = _collected(rows.join(F.broadcast(some), "id").select(features(F.col("text")).alias("codes")))
    n, seen = len(picked[1]) - 1, np.bincount(picked[0], minlength=1 << BITS)
    unlabelled = F.col("id").isNotNull() & ~F.col("held_out")
    total, seen_rest = _counted(rows.where(unlabelled).select(features(F.col("text")).alias("codes")), seen >= 2) if n else (0, seen)
    codes = lifted(seen, n, seen_rest, total, keep) if n and total else NONE.codes

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            places, offsets = _reduced(*_flat(b.column(2)), codes)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "held_out", "places"])

    fields = [T.StructField("held_out", T.BooleanType()), T.StructField("places", T.ArrayType(T.IntegerType()))]
    kept = rows.select("id", "held_out", features(F.col("text")).alias("codes")).mapInArrow(reduce_, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *fields]))
    kept, model = durable(kept, "reduced"), NONE
    if len(codes):
        patterns = durable(kept.where(unlabelled).groupBy("places").agg(F.count("*").alias("n")), "patterns")
        model = fit(codes, Rows(*_reduced(*picked, codes), np.ones(n)), _Patterns(patterns, len(codes)), total, seen_rest[codes], prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            score = model.scores(*_flat(b.column(2))) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["id", "held_out", "score"])

    scored = kept.mapInArrow(run, T.StructType([*kept.schema.fields[:2], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "held_out", "score")
