"""The real client's address behind proxies.

Addresses are recognised by pattern: dotted quads with octets up to 255 and the forms of IPv6,
also bracketed with a port or with a zone. Shorthand such as ``1`` or ``1.2`` is not an address here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import strip, value_or_null

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = r"[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Eight groups, or fewer around one double colon, the last two of which may be a dotted quad."""
    tail = rf"(?:{_GROUP}:{_GROUP}|{IPV4})"
    forms = [rf"(?:{_GROUP}:){{6}}{tail}", rf"(?:{_GROUP}:){{7}}:", rf"::(?:{_GROUP}:){{0,5}}{tail}", rf"::{_GROUP}", "::"]
    for before in range(1, 7):
        room = 7 - before  # groups that may follow the double colon
        forms.append(rf"(?:{_GROUP}:){{{before - 1}}}{_GROUP}::(?:{_GROUP}:){{0,{room - 1}}}{_GROUP}")
        if room >= 2:
            forms.append(rf"(?:{_GROUP}:){{{before - 1}}}{_GROUP}::(?:{_GROUP}:){{0,{room - 2}}}{IPV4}")
        forms.append(rf"(?:{_GROUP}:){{{before - 1}}}{_GROUP}::")
    return "|".join(forms)


IPV6 = _ipv6()
V4 = rf"^{IPV4}$"
V6 = rf"^(?:(?:{IPV6})(?:%[^\s%]+)?|\[(?:{IPV6})\](?::[0-9]{{1,5}})?)$"


def is_ip(x: Column) -> Column:
    return F.coalesce(F.when(F.contains(x, F.lit(":")), x.rlike(V6)).otherwise(x.rlike(V4)), F.lit(False))


def _items(value: Column) -> Column:
    """The parts of a comma-separated list; none for a missing value."""
    parts = F.transform(F.split(value, ","), strip)
    return F.when(value_or_null(value).isNotNull(), parts).otherwise(F.array().cast("array<string>"))


def first_valid_ip(value: Column) -> Column:
    """The first address of a comma-separated list, as written; null if there is none."""
    return F.get(F.filter(_items(value), is_ip), F.lit(0))


def resolve(candidates: Column) -> Column:
    """The first address in an array of header values in order of trust, the connection's own last."""
    return F.get(F.filter(F.flatten(F.transform(candidates, _items)), is_ip), F.lit(0))
