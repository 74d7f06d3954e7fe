"""Ready-made analyses. Each returns small DataFrames; texts group without regard to case and
show the spelling whose last use is latest, the greater spelling of equally late ones.

Spellings are counted first, with numbers alone as state, so that Spark aggregates by hashing; only
the distinct spellings are then brought together by their upper case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import blank, display_status, display_url
from tidelog.operators.search import result_order
from tidelog.storage import durable

TOP, TIMELINE = 20, 500


def with_url(entries: DataFrame) -> DataFrame:
    return entries.withColumn("url", display_url(F.col("uri_stem"), F.col("uri_query")))


def address() -> Column:
    """The resolved address, or else the connection's."""
    return F.coalesce("resolved_client_ip", "client_ip")


def by_spelling(entries: DataFrame, key: Column, name: str, *more: Column) -> DataFrame:
    """``(name, count, last_seen, more...)`` of each key as it is spelt; ``more`` are aggregates of numbers."""
    return entries.groupBy(key.alias(name)).agg(F.count("*").alias("count"), F.max("timestamp_utc").alias("last_seen"), *more)


def shown(name: str) -> Column:
    """The spelling to show for a group of them."""
    return F.max_by(name, F.struct("last_seen", name)).alias(name)


def top_by_count(entries: DataFrame, key: Column, name: str, most: int = TOP, keep_blank: bool = False) -> DataFrame:
    """``(name, count)`` of the most frequent keys; ties go by upper-case key."""
    spelt = by_spelling(entries, key, name)
    spelt = spelt if keep_blank else spelt.where(~blank(F.col(name)))
    groups = spelt.groupBy(F.upper(name).alias("u")).agg(shown(name), F.sum("count").alias("count"))
    return groups.orderBy(F.desc("count"), "u").limit(most).select(name, "count")


def distribution(entries: DataFrame, column: str) -> DataFrame:
    """``(column, count)`` of all values that are not null, most frequent first."""
    return entries.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def timeline(entries: DataFrame, limit: int = TIMELINE) -> DataFrame:
    """The last ``limit`` entries of the result order, that is the oldest ones."""
    oldest = [F.asc_nulls_first("timestamp_utc"), F.asc("source_path"), F.asc("line_number")]
    return entries.orderBy(*oldest).limit(limit)


@dataclass(frozen=True)
class IpReport:
    summary: DataFrame
    top_urls: DataFrame
    user_agents: DataFrame
    methods: DataFrame
    statuses: DataFrame
    timeline: DataFrame


def ip_summary(rows: DataFrame) -> DataFrame:
    url = F.upper(F.nullif("url", F.lit("")))
    return rows.agg(
        F.count("*").alias("request_count"),
        F.min("timestamp_utc").alias("first_seen"),
        F.max("timestamp_utc").alias("last_seen"),
        F.count_distinct(url).alias("unique_urls"),
        F.count_if(F.col("status_code") == 404).alias("not_found_count"),
        F.count_if(F.col("status_code").between(500, 599)).alias("server_error_count"),
        F.coalesce(F.avg("time_taken_ms"), F.lit(0.0)).alias("average_time_taken_ms"),
    )


def of_ip(entries: DataFrame, ip: str) -> DataFrame:
    same = lambda c: F.coalesce(F.upper(c) == ip.upper(), F.lit(False))
    return with_url(entries.where(same("resolved_client_ip") | same("client_ip")))


def analyze_ip(entries: DataFrame, ip: str) -> IpReport:
    """Everything about one address."""
    rows = of_ip(entries, ip)
    agents = by_spelling(rows.where(~blank(F.col("user_agent"))), F.col("user_agent"), "user_agent")
    agents = agents.groupBy(F.upper("user_agent").alias("u")).agg(shown("user_agent"), F.max("last_seen").alias("at"))
    items = timeline(rows).orderBy(F.asc_nulls_first("timestamp_utc"), "source_path", "line_number")
    sub = F.col("sub_status_code") if "sub_status_code" in rows.columns else F.lit(None).cast("int")
    return IpReport(
        ip_summary(rows),
        top_by_count(rows, F.col("url"), "url"),
        agents.orderBy(F.desc_nulls_last("at"), "u").limit(TOP).select("user_agent"),
        distribution(rows.withColumn("method", F.upper("method")), "method"),
        distribution(rows, "status_code"),
        items.select("timestamp_utc", "method", "url", display_status(F.col("status_code"), sub).alias("status")),
    )


@dataclass(frozen=True)
class ErrorReport:
    summary: DataFrame
    top_urls: DataFrame
    top_ips: DataFrame
    statuses: DataFrame
    timeline: DataFrame


def errors_of(entries: DataFrame) -> DataFrame:
    return with_url(entries.where(F.col("status_code").between(400, 599)))


def analyze_errors(entries: DataFrame) -> ErrorReport:
    """Client and server errors."""
    rows = errors_of(entries)
    return ErrorReport(
        rows.agg(F.count("*").alias("total_errors")),
        top_by_count(rows, F.col("url"), "url"),
        top_by_count(rows, address(), "ip"),
        distribution(rows, "status_code"),
        timeline(rows).orderBy(*result_order()),
    )


@dataclass(frozen=True)
class SlowReport:
    summary: DataFrame
    top_urls: DataFrame


def slow_summary(rows: DataFrame, threshold_ms: int) -> DataFrame:
    """Count, mean, maximum and nearest-rank percentiles of the durations.

    Equal durations are counted before the percentiles are taken, so what meets in
    one task is a row for each distinct duration.
    """
    counts = rows.groupBy("time_taken_ms").agg(F.count("*").alias("n"))
    at = lambda p: F.coalesce(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("time_taken_ms"))), F.lit(0)).cast("double")
    ranked = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("time_taken_ms")), "total": F.sum("n").over(Window.partitionBy())})
    return ranked.agg(
        F.lit(threshold_ms).alias("threshold_ms"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("request_count"),
        F.coalesce(F.sum(F.col("time_taken_ms") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("average_duration_ms"),
        at(0.95).alias("p95"),
        at(0.99).alias("p99"),
        F.coalesce(F.max("time_taken_ms"), F.lit(0)).cast("long").alias("max_duration_ms"),
    )


def slow_of(entries: DataFrame, threshold_ms: int) -> DataFrame:
    return with_url(entries.where(F.col("time_taken_ms") >= threshold_ms))


def slow_urls(rows: DataFrame) -> DataFrame:
    spelt = by_spelling(rows, F.col("url"), "url", F.sum("time_taken_ms").alias("ms"))
    groups = spelt.groupBy(F.upper("url").alias("u")).agg(shown("url"), F.sum("ms").alias("ms"), F.sum("count").alias("count"))
    groups = groups.select("u", "url", (F.col("ms") / F.col("count")).alias("average_ms"), "count")
    return groups.orderBy(F.desc("average_ms"), "u").limit(TOP).select("url", "average_ms", "count")


def analyze_slow(entries: DataFrame, threshold_ms: int = 1000) -> SlowReport:
    """Requests that took ``threshold_ms`` or longer."""
    rows = slow_of(entries, threshold_ms)
    return SlowReport(slow_summary(rows, threshold_ms), slow_urls(rows))


@dataclass(frozen=True)
class TrafficReport:
    summary: DataFrame
    top_urls: DataFrame
    top_ips: DataFrame
    top_agents: DataFrame
    statuses: DataFrame
    trend: DataFrame


def traffic_summary(entries: DataFrame) -> DataFrame:
    """Requests, distinct addresses and requests a minute of the time spanned, one minute at least."""
    ip = address()
    span = F.timestamp_diff("MICROSECOND", F.min("timestamp_utc"), F.max("timestamp_utc")).cast("double") / 60_000_000
    return entries.agg(
        F.count("*").alias("total_requests"),
        F.count_distinct(F.upper(F.when(~blank(ip), ip))).alias("unique_ips"),
        (F.count("*") / F.greatest(F.lit(1.0).cast("double"), F.coalesce(span, F.lit(1.0).cast("double")))).alias("requests_per_minute"),
    )


def trend_unit(entries: DataFrame) -> str:
    """Buckets of a minute; of an hour from a span of two days, of a day from one of sixty."""
    span = F.timestamp_diff("MICROSECOND", F.min("timestamp_utc"), F.max("timestamp_utc"))
    return _unit(entries.agg(span.alias("s")).first()["s"])


def trend(entries: DataFrame, unit: str | None = None) -> DataFrame:
    """``(bucket, count)`` in order of time; empty buckets are not listed."""
    unit = unit or trend_unit(entries)
    kind = entries.schema["timestamp_utc"].dataType
    rows = entries.where(F.col("timestamp_utc").isNotNull()).groupBy(F.date_trunc(unit, "timestamp_utc").cast(kind).alias("bucket"))
    return rows.agg(F.count("*").alias("count")).orderBy("bucket")


def _unit(span_us: float | None) -> str:
    days = (span_us or 0) / 86_400_000_000
    return "day" if days >= 60 else "hour" if days >= 2 else "minute"


def analyze_traffic(entries: DataFrame) -> TrafficReport:
    """All requests.

    One pass over the entries counts URLs, addresses, agents and, by minute, statuses, into one table from which all parts are
    made. It is written to the shared folder, so that no part reads the entries again.
    """
    rows, time = with_url(entries), F.col("timestamp_utc")
    name = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"), F.lit(None).cast(entries.schema["status_code"].dataType).alias("status_code"), F.lit(None).cast(entries.schema["timestamp_utc"].dataType).alias("minute"))
    minute = F.struct(F.lit("minute").alias("kind"), F.lit(None).cast("string").alias("name"), "status_code", F.date_trunc("minute", time).cast(entries.schema["timestamp_utc"].dataType).alias("minute"))
    each = rows.select("timestamp_utc", F.explode(F.array(name("url", F.col("url")), name("ip", address()), name("agent", F.col("user_agent")), minute)).alias("t"))
    tally = durable(each.groupBy("t.kind", "t.name", "t.status_code", "t.minute").agg(F.count("*").alias("count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")), "traffic")

    def top(kind: str, column: str) -> DataFrame:
        spelt = tally.where((F.col("kind") == kind) & ~blank(F.col("name"))).withColumnRenamed("name", column)
        groups = spelt.groupBy(F.upper(column).alias("u")).agg(shown(column), F.sum("count").alias("count"))
        return groups.orderBy(F.desc("count"), "u").limit(TOP).select(column, "count")

    minutes = tally.where("kind = 'minute'")
    span = F.timestamp_diff("MICROSECOND", F.min("first_seen"), F.max("last_seen")).cast("double")
    ips = F.count_distinct(F.when((F.col("kind") == "ip") & ~blank(F.col("name")), F.upper("name")))
    total = F.coalesce(F.sum(F.when(F.col("kind") == "minute", F.col("count"))), F.lit(0))
    summary = tally.agg(total.alias("total_requests"), ips.alias("unique_ips"), (total / F.greatest(F.lit(1.0).cast("double"), F.coalesce(span / 60_000_000, F.lit(1.0).cast("double")))).alias("requests_per_minute"))
    unit = _unit(minutes.agg(span.alias("s")).first()["s"])
    buckets = minutes.where("minute IS NOT NULL").groupBy(F.date_trunc(unit, "minute").cast(entries.schema["timestamp_utc"].dataType).alias("bucket")).agg(F.sum("count").alias("count")).orderBy("bucket")
    statuses = minutes.where("status_code IS NOT NULL").groupBy("status_code").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "status_code")
    return TrafficReport(summary, top("url", "url"), top("ip", "ip"), top("agent", "user_agent"), statuses, buckets)
