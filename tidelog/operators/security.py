"""Rule-based security analysis: findings, per-address aggregates and a heuristic score.

Rules are compiled into one expression over each entry, so matching is a projection; neither a
join nor a shuffle is made for it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import blank
from tidelog.operators.analyze import address, with_url
from tidelog.operators.search import result_order

MAX_FINDINGS = 5000


@dataclass(frozen=True)
class SecurityRule:
    id: str
    category: str
    pattern: str
    match: str = "contains"
    score: int = 0
    enabled: bool = True
    title: str = ""


#: The rules that are used unless others are given, in the order of their evaluation.
DEFAULT_RULES = (
    SecurityRule("SENSITIVE_ENV", "SensitiveFileProbe", "/.env", "contains", 15, True, "Sensitive environment file probe"),
    SecurityRule("SENSITIVE_GIT", "SensitiveFileProbe", "/.git/config", "contains", 15, True, "Git configuration probe"),
    SecurityRule("SENSITIVE_GIT_HEAD", "SensitiveFileProbe", "/.git/HEAD", "contains", 15, True, "Git metadata probe"),
    SecurityRule("SENSITIVE_WEB_CONFIG", "SensitiveFileProbe", "/web.config", "contains", 15, True, "Web configuration probe"),
    SecurityRule("SENSITIVE_APPSETTINGS", "SensitiveFileProbe", "/appsettings.json", "contains", 15, True, "Application settings probe"),
    SecurityRule("SENSITIVE_PHPINFO", "SensitiveFileProbe", "/phpinfo.php", "contains", 15, True, "PHP information probe"),
    SecurityRule("SENSITIVE_WP", "SensitiveFileProbe", "/wp-admin", "contains", 15, True, "WordPress administration probe"),
    SecurityRule("SENSITIVE_SWAGGER", "SensitiveFileProbe", "/swagger", "contains", 15, True, "Swagger endpoint probe"),
    SecurityRule("TRAVERSAL", "PathTraversal", "../", "contains", 25, True, "Potential path traversal"),
    SecurityRule("TRAVERSAL_ENCODED", "PathTraversal", "%2e%2e", "contains", 25, True, "Encoded path traversal indicator"),
    SecurityRule("SQL_INJECTION", "SqlInjectionIndicator", "union select", "contains", 20, True, "SQL Injection Indicator"),
    SecurityRule("SQL_SCHEMA", "SqlInjectionIndicator", "information_schema", "contains", 20, True, "SQL metadata indicator"),
    SecurityRule("SQL_DELAY", "SqlInjectionIndicator", "waitfor delay", "contains", 20, True, "SQL delay indicator"),
    SecurityRule("XSS_SCRIPT", "XssIndicator", "<script", "contains", 20, True, "XSS Indicator"),
    SecurityRule("XSS_JAVASCRIPT", "XssIndicator", "javascript:", "contains", 20, True, "JavaScript injection indicator"),
    SecurityRule("XSS_EVENT", "XssIndicator", "onerror=", "contains", 20, True, "HTML event handler indicator"),
    SecurityRule("METHOD_TRACE", "SuspiciousMethod", "TRACE", "method", 5, True, "Suspicious HTTP method TRACE"),
    SecurityRule("METHOD_TRACK", "SuspiciousMethod", "TRACK", "method", 5, True, "Suspicious HTTP method TRACK"),
    SecurityRule("METHOD_CONNECT", "SuspiciousMethod", "CONNECT", "method", 5, True, "Suspicious HTTP method CONNECT"),
    SecurityRule("METHOD_PROPFIND", "SuspiciousMethod", "PROPFIND", "method", 5, True, "WebDAV method PROPFIND"),
    SecurityRule("METHOD_PUT", "SuspiciousMethod", "PUT", "method", 3, True, "HTTP method PUT"),
    SecurityRule("METHOD_DELETE", "SuspiciousMethod", "DELETE", "method", 3, True, "HTTP method DELETE"),
    SecurityRule("SENSITIVE_WP_LOGIN", "SensitiveFileProbe", "/wp-login.php", "contains", 15, True, "WordPress login probe"),
    SecurityRule("SENSITIVE_SERVER_STATUS", "SensitiveFileProbe", "/server-status", "contains", 15, True, "Server status probe"),
    SecurityRule("SENSITIVE_ACTUATOR", "SensitiveFileProbe", "/actuator", "contains", 15, True, "Actuator endpoint probe"),
    SecurityRule("SENSITIVE_SWAGGER_INDEX", "SensitiveFileProbe", "/swagger/index.html", "contains", 15, True, "Swagger UI probe"),
    SecurityRule("TRAVERSAL_BACKSLASH", "PathTraversal", "..\\", "contains", 25, True, "Backslash path traversal indicator"),
    SecurityRule("TRAVERSAL_DOUBLE_ENCODED", "PathTraversal", "%252e", "contains", 25, True, "Double encoded traversal indicator"),
    SecurityRule("TRAVERSAL_ENCODED_SLASH", "PathTraversal", "%2f", "contains", 25, True, "Encoded slash traversal indicator"),
    SecurityRule("TRAVERSAL_ENCODED_BACKSLASH", "PathTraversal", "%5c", "contains", 25, True, "Encoded backslash traversal indicator"),
    SecurityRule("SQL_SLEEP", "SqlInjectionIndicator", "sleep(", "contains", 20, True, "SQL delay indicator"),
    SecurityRule("SQL_BOOLEAN", "SqlInjectionIndicator", "or\\s*\\+?.*'1'='1", "regex", 20, True, "Boolean-based SQL Injection Indicator"),
    SecurityRule("SQL_BENCHMARK", "SqlInjectionIndicator", "benchmark(", "contains", 20, True, "SQL benchmark indicator"),
    SecurityRule("SQL_XP_CMDSHELL", "SqlInjectionIndicator", "xp_cmdshell", "contains", 20, True, "SQL command execution indicator"),
    SecurityRule("XSS_ENCODED_SCRIPT", "XssIndicator", "%3cscript", "contains", 20, True, "Encoded XSS indicator"),
)

_KEYS = {"Id": "id", "Category": "category", "Pattern": "pattern", "Match": "match", "Score": "score", "Enabled": "enabled", "Title": "title"}


def load_rules(path: str | Path) -> tuple[SecurityRule, ...]:
    """Rules from a JSON list with keys Id, Category, Pattern, Match, Score, Enabled, Title; none if it is missing or malformed."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        return tuple(SecurityRule(**{_KEYS[k]: v for k, v in r.items() if k in _KEYS}) for r in found)
    except (OSError, ValueError, TypeError, AttributeError):
        return ()


def rules_frame(spark: SparkSession, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([asdict(r) for r in rules], "id string, category string, pattern string, match string, score int, enabled boolean, title string")


def severity_of(category: str) -> str:
    return "High" if any(x in category.lower() for x in ("traversal", "injection", "xss")) else "Medium"


def match_text() -> Column:
    """What contains and regex rules look at."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("url", "uri_query", "raw_line")))


def _holds(rule: SecurityRule, text: Column, lowered: Column) -> Column:
    if rule.match.lower() == "regex":
        return text.rlike("(?i)" + rule.pattern)
    if rule.match.lower() == "method":
        return F.coalesce(F.upper("method") == rule.pattern.upper(), F.lit(False))
    return F.contains(lowered, F.lit(rule.pattern.lower()))


def matched_rules(rules: Sequence[SecurityRule], text: Column) -> Column:
    """Ordinals of the enabled rules that hold, in rule order."""
    tests = [(k, r) for k, r in enumerate(rules) if r.enabled]
    if not tests:
        return F.array().cast("array<int>")
    pair = F.array(F.struct(text.alias("t"), F.lower(text).alias("l")))
    found = F.transform(pair, lambda p: F.array_compact(F.array(*(F.when(_holds(r, p["t"], p["l"]), F.lit(k)) for k, r in tests))))
    return F.get(found, F.lit(0))


def with_rules(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> DataFrame:
    """Entries with ``url`` and ``rules``, the ordinals of the rules that they match."""
    return with_url(entries).withColumn("rules", matched_rules(rules, match_text()))


def match_rules(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> DataFrame:
    """One finding for each entry and rule that it matches, without limit."""
    known = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title if r.title.strip() else r.category).alias("title"), F.lit(severity_of(r.category)).alias("severity"), F.lit(f"matches rule {r.pattern}; a heuristic sign, not proof of an attack").alias("reason")) for r in rules)) if rules else None
    # exploding the expression itself, unlike a column that a filter looks at too, matches each text once
    rows = with_url(entries).select("*", F.explode(matched_rules(rules, match_text())).alias("ordinal"))
    if known is None:
        known = F.array(F.struct(*(F.lit("").alias(n) for n in ("rule_id", "title", "severity", "reason"))))
    rule = F.get(known, F.col("ordinal"))
    return rows.select(rule["rule_id"].alias("rule_id"), rule["title"].alias("title"), rule["severity"].alias("severity"), rule["reason"].alias("reason"), address().alias("client_ip"), F.col("url").alias("uri"), "timestamp_utc", F.col("id").alias("log_entry_id"), "source_path", "line_number", "ordinal")


def findings(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES, most: int = MAX_FINDINGS) -> DataFrame:
    """The first ``most`` findings in result order, then rule order."""
    return match_rules(entries, rules).orderBy(*result_order(), "ordinal").limit(most).drop("source_path", "line_number", "ordinal")


def _chosen(rules: Sequence[SecurityRule], test) -> Column:
    """The matched rules that pass ``test``."""
    wanted = [k for k, r in enumerate(rules) if test(r)]
    return F.filter("rules", lambda x: x.isin(wanted) if wanted else F.lit(False))


def _sensitive(rules: Sequence[SecurityRule]) -> list[int]:
    return [k for k, r in enumerate(rules) if "sensitive" in r.category.lower()]


def _by_address_and_url(entries: DataFrame, rules: Sequence[SecurityRule], more: dict[str, Column]) -> DataFrame:
    """Figures of each address, null if it has none, and URL; ``more`` are further aggregates over ``rules``, ``status_code`` and ``user_agent``.

    Grouping by address and URL first lets a busy address be counted by many tasks.
    """
    rows = with_rules(entries, rules).select("*", F.when(~blank(address()), F.upper(address())).alias("ip"))
    hits = F.size(_chosen(rules, lambda r: "sensitive" in r.category.lower()))
    figures = {"requests": F.count("*"), "not_found": F.count_if(F.col("status_code") == 404), "first_seen": F.min("timestamp_utc"), "last_seen": F.max("timestamp_utc"), "sensitive_hits": F.sum(hits)}
    return rows.groupBy("ip", F.upper("url").alias("u")).agg(*(c.alias(n) for n, c in (figures | more).items()))


def _by_address(urls: DataFrame, more: dict[str, Column]) -> DataFrame:
    figures = {"requests": F.sum("requests"), "not_found": F.sum("not_found"), "unique_urls": F.count("*"), "first_seen": F.min("first_seen"), "last_seen": F.max("last_seen"), "sensitive_hits": F.sum("sensitive_hits")}
    return urls.groupBy("ip").agg(*(c.alias(n) for n, c in (figures | more).items()))


def ip_aggregates(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> DataFrame:
    """Per address: requests, 404s, distinct URLs, time span and matches of sensitive rules."""
    return _by_address(_by_address_and_url(entries, rules, {}).where("ip IS NOT NULL"), {})


def _scans() -> Column:
    """Over a hundred URLs, over four fifths of the requests 404, a sensitive path, all within five minutes."""
    brief = F.timestamp_diff("MICROSECOND", "first_seen", "last_seen") <= 300_000_000
    return (F.col("unique_urls") > 100) & (F.col("not_found") / F.col("requests") > 0.8) & (F.col("sensitive_hits") > 0) & F.coalesce(brief, F.lit(False))


def scanners(per_ip: DataFrame) -> DataFrame:
    """Addresses that look like scanners."""
    return per_ip.where(_scans())


#: What known browsers' user agents contain.
BROWSER = r"(?i)mozilla|chrome|firefox|safari|edg/"


def score(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> DataFrame:
    """One row: ``score`` 0 to 100, ``severity``, ``likely_scanner`` and ``reasons``.

    One flow: figures by address and URL, of these by address, of these over all; each entry is matched once.
    """
    named = {n: F.coalesce(F.max(F.size(_chosen(rules, lambda r, part=part: part in r.id.upper())) > 0), F.lit(False)) for n, part in (("traversal", "TRAVERSAL"), ("sql", "SQL"), ("xss", "XSS"), ("method", "METHOD"))}
    kept = {f"r{k}": F.max(F.array_contains("rules", k)) for k in _sensitive(rules)}
    flags = named | kept | {"browser": F.coalesce(F.max(F.col("user_agent").rlike(BROWSER)), F.lit(False))}
    ok = F.count_if(F.col("status_code").between(200, 399))
    per_ip = _by_address(_by_address_and_url(entries, rules, flags | {"ok": ok}), {n: F.max(n) for n in flags} | {"ok": F.sum("ok")})
    real = F.col("ip").isNotNull()
    one = per_ip.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("not_found"), F.lit(0)).alias("nf"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"),
        F.coalesce(F.sum("sensitive_hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.max(F.when(real, F.col("sensitive_hits"))), F.lit(0)).alias("most"),
        F.coalesce(F.max(real & _scans()), F.lit(False)).alias("likely_scanner"),
        *(F.coalesce(F.max(n), F.lit(False)).alias(n) for n in flags),
    )
    kinds = sum((F.col(n).cast("int") for n in kept), F.lit(0))
    many404 = (F.col("total") > 0) & (F.col("nf") / F.greatest("total", F.lit(1)) > 0.8)
    parts = [
        (F.col("hits") > 0, 15, "Sensitive files or suspicious paths were requested"),
        ((F.col("most") > 1) | (kinds > 1), 20, "Several sensitive paths were requested"),
        (many404, 15, "Nearly all requests ended in 404"),
        (F.col("likely_scanner"), 20, "An address behaves like a scanner: many URLs, mostly 404, in a short time, sensitive paths among them"),
        (F.col("traversal"), 25, "Signs of path traversal"),
        (F.col("sql"), 20, "Signs of SQL injection"),
        (F.col("xss"), 20, "Signs of cross-site scripting"),
        (F.col("method"), 5, "HTTP methods that deserve a look"),
    ]
    points = sum((F.when(c, n).otherwise(0) for c, n, _ in parts), F.lit(0)) - F.when(F.col("browser"), 5).otherwise(0) - F.when(F.col("ok") > 0, 10).otherwise(0)
    value = F.greatest(F.least(points, F.lit(100)), F.lit(0))
    reasons = F.array_compact(F.array(F.lit("Heuristic: the log holds suspicious signs; none proves an attack"), *(F.when(c, F.lit(t)) for c, _, t in parts)))
    band = F.when(value >= 75, "Critical").when(value >= 50, "High").when(value >= 25, "Medium").otherwise("Low")
    return one.select(value.cast("int").alias("score"), band.alias("severity"), "likely_scanner", reasons.alias("reasons"))


@dataclass(frozen=True)
class SecurityReport:
    score: DataFrame
    findings: DataFrame
    ips: DataFrame


def analyze_security(entries: DataFrame, rules: Sequence[SecurityRule] = DEFAULT_RULES) -> SecurityReport:
    return SecurityReport(score(entries, rules), findings(entries, rules), ip_aggregates(entries, rules))
