"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop_table, durable


def _toward_least(pairs: DataFrame) -> DataFrame:
    """For each node ``u`` of ``pairs(u, v)``: every ``v`` beside the least of ``u`` and all its ``v``.

    The least is aggregated before the shuffle and joined back, so a hub's neighbours are never
    gathered in one place and the join may be split where a hub is hot.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; the root is the least node reachable.

    Self-loops, repeated and reversed edges are harmless; rows with a null end are ignored.
    Each round is written to the shared folder, so lineage does not grow.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    now = durable(edges.where("src <> dst").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = durable(small, "edges")
        drop_table(now)
        now = then
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
