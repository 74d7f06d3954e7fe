"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text are transformed to be closer to normal. Each class has a mean and a
covariance that is shrunk towards the pooled covariance (``toward_pooled``) and towards a scaled
identity (``toward_identity``). Counts, sums and cross products of all labelled training rows
come from one Spark aggregation, so nothing is sampled and two rows reach the driver. Scores
are the posterior of class 1 from the difference of the Mahalanobis log-densities; the inverse
Cholesky factors are computed once and cached in the model.

Defined results: a null text counts as empty and is scored like any text; repeated rows score
alike; ids that are null are scored but never train; labels that contradict one another
are ignored. If a class has no training row, every score is the add-one share of class 1. A score equal to the
threshold is kept; long texts are measured whole; an empty table gives no rows; only the id, the text and the label are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import WORD_CHAR, durable, each_batch, let, words_of
from tidelog.llm.learning import agreed_labels, fold_of, hash_sample
from tidelog.llm.quality_rules import STOP_WORDS, SYMBOLS

#: Words of a usual text, a sixth of them stop words and five letters long, that are added to each text's counts.
PRIOR_WORDS = 12.0

FEATURES = ("length", "word_length", "symbols", "stop_words", "capitals", "echoes", "variety", "marks", "digits", "line_repeats", "line_length")


def statistics(text: Column) -> Column:
    """``array<double>`` of transformed statistics in the order of FEATURES."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))

    def body(w: Column) -> Column:
        n = F.size(w).cast("double") + PRIOR_WORDS  # shares of short texts lean towards a usual text's
        chars = F.length(text).cast("double") + 1.0
        without = lambda junk: F.length(text) - F.length(F.translate(text, junk, ""))
        share = lambda part, whole: F.asinh(F.lit(20.0) * part / whole)
        return let(
            lines,
            lambda rows: F.array(
                F.log1p(n),
                F.log1p((F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) + 5.0 * PRIOR_WORDS) / n),
                share(without(SYMBOLS), n),
                share(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))) + 0.17 * PRIOR_WORDS, n),
                share(F.size(F.filter(w, lambda x: (F.lower(x) != x) & (F.length(x) > 1) & ~x.rlike(r"\p{Ll}"))), n),
                share(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n),
                F.log1p(F.size(F.array_distinct(w)).cast("double")) / F.log1p(n),
                share(without("!?;:\"'()[]{}=+~^_/\\@`"), n),
                share(without("0123456789"), chars),
                share(F.size(rows) - F.size(F.array_distinct(rows)), F.size(rows) + 1),
                F.log1p(chars / (F.size(rows) + 1)),
            ),
        )

    return let(words_of(text), body)


@dataclass(frozen=True)
class QuadraticModel:
    """Per class: mean, inverse Cholesky factor, log of prior times normalising constant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    share: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        logs = [o - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -36, 36)))

    def expression(self, x: Column) -> Column:
        """The score as a Spark expression, for filters that should stay in the JVM."""
        if self.share is not None:
            return F.lit(self.share)

        def log_density(x: Column, k: int) -> Column:
            m, f = self.means[k], self.factors[k]
            terms = [sum(F.lit(float(f[i, j])) * (x[j] - float(m[j])) for j in range(i + 1)) for i in range(len(m))]
            return F.lit(float(self.offsets[k])) - 0.5 * sum(t * t for t in terms)

        return let(x, lambda v: 1 / (1 + F.exp(F.greatest(F.least(log_density(v, 0) - log_density(v, 1), F.lit(36.0)), F.lit(-36.0)))))


def train(examples: DataFrame, dims: int, toward_pooled: float = 0.1, toward_identity: float = 0.01) -> QuadraticModel:
    """A model from all rows of ``examples(x array<double>, y 0 or 1)``."""
    upper = [(i, j) for i in range(dims) for j in range(i, dims)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dims)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"c{i}_{j}") for i, j in upper]
    got = {r["y"]: r for r in examples.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}  # two rows at most
    n = [got[y]["n"] if y in got else 0 for y in (0, 1)]
    if not all(n):
        return QuadraticModel(*(np.empty(0),) * 3, share=(n[1] + 1) / (sum(n) + 2))
    means, scatter = [], []
    for y in (0, 1):
        m = np.array([got[y][f"s{i}"] for i in range(dims)]) / n[y]
        c = np.zeros((dims, dims))
        for i, j in upper:
            c[i, j] = c[j, i] = got[y][f"c{i}_{j}"] / n[y] - m[i] * m[j]
        means.append(m)
        scatter.append(c)
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    factors, offsets = [], []
    for y in (0, 1):
        c = (1 - toward_pooled) * scatter[y] + toward_pooled * pooled
        c = (1 - toward_identity) * c + toward_identity * max(np.trace(c) / dims, 1e-6) * np.eye(dims)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n[y] / sum(n)) - np.log(np.diag(low)).sum())
    return QuadraticModel(np.array(means), np.array(factors), np.array(offsets))


def score_rows(model: QuadraticModel, rows: DataFrame, dims: int) -> DataFrame:
    """``rows(..., x)`` with ``x`` replaced by ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x))], names=[*b.schema.names[:-1], "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0, **kw) -> DataFrame:
    """``(id, held_out, score)`` per row of ``docs``; rows of fold ``held_out`` never train."""
    measured = docs.select(F.col(id_col), F.coalesce(fold_of(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), statistics(F.col(text)).alias("x"))
    measured = durable(measured, "statistics")
    examples = measured.where("not held_out").join(agreed_labels(labels, id_col, label), id_col).select("x", "y")
    return score_rows(train(examples, len(FEATURES), **kw), measured, len(FEATURES))


def keep_good(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.3, folds: int = 5, held_out: int = 0, most_examples: int = 50_000, seed: int = 29, **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, whose own text scores ``least`` or more; none are shuffled.

    Training takes about ``most_examples`` labelled rows of ``examples`` (``docs`` unless given), so that
    their ids can be broadcast.
    """
    known = agreed_labels(labels, id_col, label).where(fold_of(F.col(id_col), folds) != held_out)
    known = hash_sample(known, id_col, most_examples / max(known.count(), 1), seed)
    labelled = (docs if examples is None else examples).select(id_col, text).join(F.broadcast(known), id_col)
    model = train(labelled.select(statistics(F.col(text)).alias("x"), "y"), len(FEATURES), **kw)
    return docs.where(model.expression(statistics(F.col(text))) >= least)
