"""Filtering, the global result order, top-k and result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import display_status, display_url
from tidelog.plans.predicate import to_predicate
from tidelog.plans.request import SearchRequest


def result_order() -> list[Column]:
    """Newest first, entries without a time last, then path and line descending."""
    return [F.desc_nulls_last("timestamp_utc"), F.desc("source_path"), F.desc("line_number")]


def matching(entries: DataFrame, request: SearchRequest) -> DataFrame:
    """The entries that meet the request, in no order and without limit: what analyses work on."""
    return entries.where(to_predicate(request, entries))


def search(entries: DataFrame, request: SearchRequest) -> DataFrame:
    """The first ``max_results`` matching entries in result order; none if it is not positive."""
    found = matching(entries, request)
    if request.max_results is None:
        return found.orderBy(*result_order())
    return found.orderBy(*result_order()).limit(max(request.max_results, 0))


def page(results: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number``, from 0, of ordered results."""
    return results.orderBy(*result_order()).offset(number * size).limit(size)


def statistics(results: DataFrame) -> DataFrame:
    """One row: results found, lines and files scanned as far as known, completeness."""
    n = F.count("*")
    return results.agg(n.alias("result_count"), n.alias("scanned_lines"), F.lit(0).cast("long").alias("scanned_files"), F.lit(True).alias("is_complete"))


def union_distinct(raw: DataFrame, indexed: DataFrame) -> DataFrame:
    """Both inputs, one row for each (source, path, line); the raw copy wins."""
    both = raw.withColumn("is_indexed", F.lit(False)).unionByName(indexed.withColumn("is_indexed", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("source_id", F.lower("source_path"), "line_number").orderBy("is_indexed")
    copy = "copy"
    while copy in both.columns:
        copy += "_"
    return both.withColumn(copy, F.row_number().over(w)).where(F.col(copy) == 1).drop(copy)


def grid(results: DataFrame) -> DataFrame:
    """The columns of the result grid and of the exports."""
    optional = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("int")
    return results.select(
        "timestamp_utc",
        display_status(F.col("status_code"), optional("sub_status_code")).alias("status"),
        "method",
        "resolved_client_ip",
        display_url(F.col("uri_stem"), F.col("uri_query")).alias("url"),
        "time_taken_ms",
        "user_agent",
        F.element_at(F.split("source_path", "/"), -1).alias("source_file"),
        "line_number",
        "raw_line",
    )


def detail_json(results: DataFrame) -> DataFrame:
    """Each row whole as one JSON object, nulls included."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
