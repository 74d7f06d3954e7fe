"""What to search for."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

from tidelog.sources.files import LogSource

#: Request methods that a keyword may name.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT", "PROPFIND", "TRACK")
MAX_RESULTS = 10_000


@dataclass(frozen=True)
class SearchRequest:
    """All given conditions must hold; blank strings and None do not restrict. ``max_results`` None is no limit."""

    source: LogSource | None = None
    keyword: str | None = None
    from_utc: datetime | None = None
    to_utc: datetime | None = None
    time_from: timedelta | None = None
    time_to: timedelta | None = None
    method: str | None = None
    status_code: int | None = None
    client_ip: str | None = None
    url_contains: str | None = None
    user_agent_contains: str | None = None
    min_time_taken_ms: int | None = None
    max_time_taken_ms: int | None = None
    username: str | None = None
    page_size: int = 200
    max_results: int | None = MAX_RESULTS

    @classmethod
    def from_strings(cls, source: LogSource | None = None, **given: str | None) -> SearchRequest:
        """From what a user typed: trimmed; numbers and times that cannot be read do not restrict."""
        trimmed = {k: (v or "").strip() or None for k, v in given.items()}
        ints = {k: parse_int(trimmed.pop(k, None)) for k in ("status_code", "min_time_taken_ms", "max_time_taken_ms")}
        times = {k: parse_time_span(trimmed.pop(k, None)) for k in ("time_from", "time_to")}
        return cls(source=source, **trimmed, **ints, **times)

    def in_range(self, bounds: tuple[datetime | None, datetime | None]) -> SearchRequest:
        return replace(self, from_utc=bounds[0], to_utc=bounds[1])

    def unlimited(self) -> SearchRequest:
        return replace(self, max_results=None)


def parse_int(value: str | None) -> int | None:
    """A 32-bit integer with optional sign and blanks around it, or None."""
    if value is None or not re.fullmatch(r"\s*[+-]?[0-9]+\s*", value):
        return None
    n = int(value)
    return n if -(2**31) <= n < 2**31 else None


def parse_time_span(value: str | None) -> timedelta | None:
    """``[-][d.]hh:mm[:ss[.fff]]``; a lone number counts days."""
    m = re.fullmatch(r"\s*(-?)(?:(\d+)|(?:(\d+)\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,7}))?)?)\s*", value or "")
    if not m:
        return None
    if m[2] is not None:
        span = timedelta(days=int(m[2]))
    else:
        hours, minutes, seconds = int(m[4]), int(m[5]), int(m[6] or 0)
        if hours > 23 or minutes > 59 or seconds > 59:
            return None
        span = timedelta(days=int(m[3] or 0), hours=hours, minutes=minutes, seconds=seconds, microseconds=int((m[7] or "0").ljust(7, "0")[:6]))
    return -span if m[1] else span


#: Named ranges that end now.
RECENT = {"last_15_minutes": timedelta(minutes=15), "last_hour": timedelta(hours=1), "last_24_hours": timedelta(hours=24), "last_7_days": timedelta(days=7)}
_TICK = timedelta(microseconds=1)


def quick_range(name: str, now: datetime, zone: str = "UTC") -> tuple[datetime, datetime]:
    """UTC bounds, both inclusive, of a named range; ``today`` and ``yesterday`` are days of ``zone``."""
    if name in RECENT:
        return (now - RECENT[name]).astimezone(ZoneInfo("UTC")), now.astimezone(ZoneInfo("UTC"))
    shift = {"today": 0, "yesterday": 1}[name]
    day = now.astimezone(ZoneInfo(zone)).date() - timedelta(days=shift)
    return day_range(datetime.combine(day, time()), datetime.combine(day, time()), zone)


def day_range(first: datetime | None, last: datetime | None, zone: str = "UTC") -> tuple[datetime | None, datetime | None]:
    """UTC bounds from the start of the first day to the end of the last, both days of ``zone``."""
    at = lambda d: datetime.combine(d.date(), time(), ZoneInfo(zone)).astimezone(ZoneInfo("UTC"))
    return at(first) if first else None, at(last + timedelta(days=1)) - _TICK if last else None


def detect_intent(keyword: str | None) -> str:
    """``ip_address``, ``http_status``, ``http_method``, ``uri`` or ``general_keyword``."""
    k = keyword or ""
    if "." in k or ":" in k:
        try:
            ipaddress.ip_address(k.strip())
            return "ip_address"
        except ValueError:
            pass
    n = parse_int(k)
    if "." not in k and n is not None and 100 <= n <= 599:
        return "http_status"
    if k.strip().upper() in METHODS:
        return "http_method"
    return "uri" if "/" in k or "?" in k else "general_keyword"
