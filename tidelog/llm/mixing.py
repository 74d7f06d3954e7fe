"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all text over its present share. Each
document's number of copies inverts the Poisson distribution with that mean at a uniform number
hashed from seed and id, so it depends on nothing else and any rate, whole or not, is met in
expectation. Copies are exploded and shuffled globally: a second hash deals them to tasks by its leading bits, and each task sorts.

The distribution function is tabulated once a source, not once a document; means above
``STEP`` are drawn as sums of equal smaller ones. All of it is built-in expressions.

Defined results: a null source is a source of its own; null texts weigh nothing and are repeated at
their source's rate, at 1 if the source has no text at all; sources without a given weight are not
drawn; weights of sources that are absent are ignored and the rest scaled up; rows with a null id
draw by their text; rows that repeat an id draw alike and stay apart; an added column whose name is taken gets a trailing ``_``; long
texts are only carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import durable, free_name, let

#: Sources whose rates may be broadcast: about 1 kB each.
BROADCAST_SOURCES = 10_000
#: Largest mean that is drawn at once, and the terms beyond which its tail is below 2**-53.
STEP, TERMS = 32, 110
#: Bits of a shuffle key, and letters of text that a task of the final sort takes.
KEY_BITS, TASK_CHARS = 60, 200_000_000


def _uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _distribution(mean: Column) -> Column:
    """Poisson distribution function at 0, 1, 2 and so on, as far as it is below 1."""
    odds = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.array(F.exp(-mean)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * mean / k)))
    sums = F.aggregate(odds, F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p)))
    return F.filter(F.slice(sums, 2, TERMS + 1), lambda c: c < 1 - 2.0**-53)


def source_rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None, alpha: float, total: float) -> DataFrame:
    """``(source, parts, cdf, chars)``: the mean split into equal parts, and one part's distribution."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(float(alpha)))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        weight = F.coalesce(*pairs, F.lit(0.0))
    sizes = durable(sizes.select("source", "chars", F.when(F.col("chars") > 0, weight).otherwise(0.0).alias("weight")), "sources")
    chars, wanted = sizes.agg(F.coalesce(F.sum("chars"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.when(F.col("chars") > 0, F.lit(chars * total / wanted if wanted else 0.0) * F.col("weight") / F.col("chars")).otherwise(1.0)
    parts = F.greatest(F.ceil(rate / STEP), F.lit(1)).cast("int")
    return durable(sizes.select("source", parts.alias("parts"), (rate / parts).alias("mean"), "chars").select("source", "parts", _distribution(F.col("mean")).alias("cdf"), "chars"), "rates")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 11) -> DataFrame:
    """All columns of ``docs`` with ``replica`` (1, 2, ...) and ``shuffle_key``, in the order of the latter.

    ``weights`` are target shares of the text by source; without them shares go with the power
    ``alpha`` of a source's size. ``total`` is the size of the result over that of the input.
    """
    rates = source_rates(docs, source, text, weights, alpha, total)
    names, chars = rates.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0.0))).first()
    replica, order = free_name(docs.columns, "replica"), free_name(docs.columns, "shuffle_key")
    own = {c: free_name([*docs.columns, replica, order], c) for c in ("rate_source", "rate_parts", "rate_cdf", "rate_n")}
    rates = rates.select("source", "parts", "cdf").toDF(*list(own.values())[:3])
    if names <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    parts, cdf, n = (F.col(own[c]) for c in ("rate_parts", "rate_cdf", "rate_n"))
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    draw = lambda j: let(_uniform(F.concat_ws(":", F.lit(seed), name, j)), lambda u: F.size(F.filter(cdf, lambda c: c < u)))
    count = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda sum_, j: sum_ + draw(j))
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col(own["rate_source"])), "left").withColumn(own["rate_n"], count).where(n > 0)
    copies = drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), n)).alias(replica))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col(replica))), 1, KEY_BITS // 4), 16, 10).cast("long")
    # keys are uniform, so equal ranges of them are equal shares of the rows: sorting them needs no sample first
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(chars * total / TASK_CHARS) + 1)
    half = KEY_BITS // 2
    range_ = F.shiftright(F.shiftright(F.col(order), half) * tasks, KEY_BITS - half).cast("int")
    return copies.withColumn(order, key).repartitionById(tasks, range_).sortWithinPartitions(order, id_col, replica)


#: DuckDB SQL for the rows of query op6.
ORACLE = """
WITH s AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source),
w AS (SELECT source, chars, CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END AS weight FROM s),
r AS (SELECT source, CASE WHEN chars > 0 THEN (SELECT sum(chars) / sum(weight) FROM w) * weight / chars ELSE 1 END AS rate FROM w),
p AS (SELECT source, parts, rate / parts AS mean FROM (SELECT *, greatest(ceil(rate / 32), 1) AS parts FROM r)),
c AS (SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p, range(0, 111) t(k)),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
u AS (SELECT rid, d.source, j, (CAST('0x' || substr(md5('11:' || name || ':' || j), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u
  FROM (SELECT rid, d.source, name, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS j FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source) d),
n AS (SELECT u.rid, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u AND c.cdf < 1 - power(2.0, -53) GROUP BY u.rid)
SELECT doc_id, source, text, CAST(i AS INTEGER) AS replica, CAST('0x' || substr(md5('11:order:' || name || ':' || i), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, source, text, name, unnest(range(1, n + 1)) AS i FROM d JOIN n USING (rid))"""
