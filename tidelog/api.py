"""The library's entry points in one place."""

from tidelog.operators.analyze import analyze_errors, analyze_ip, analyze_slow, analyze_traffic
from tidelog.operators.export import export_csv, export_json, write_csv, write_json
from tidelog.operators.search import matching, page, search, statistics
from tidelog.operators.security import DEFAULT_RULES, SecurityRule, analyze_security, load_rules, match_rules
from tidelog.operators.store import LogStore
from tidelog.plans.predicate import to_predicate
from tidelog.plans.request import SearchRequest, day_range, detect_intent, quick_range
from tidelog.settings import EngineSettings
from tidelog.sources.files import LogSource, list_log_files
from tidelog.sources.sites import discover_sites, site_sources
from tidelog.sources.w3c import read_ranges, read_w3c
from tidelog.streaming.tail import follow, live_trend, tail

__all__ = [
    "DEFAULT_RULES", "EngineSettings", "LogSource", "LogStore", "SearchRequest", "SecurityRule",
    "analyze_errors", "analyze_ip", "analyze_security", "analyze_slow", "analyze_traffic", "day_range", "detect_intent", "discover_sites",
    "export_csv", "export_json", "follow", "list_log_files", "live_trend", "load_rules", "match_rules", "matching", "page", "quick_range",
    "read_ranges", "read_w3c", "search", "site_sources", "statistics", "tail", "to_predicate", "write_csv", "write_json",
]
