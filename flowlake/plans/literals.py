"""Durations, dates, numbers, ports and protocols as written in queries."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from .ast import QueryError

# Fixed values.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}
PORTS = {"http": 80, "https": 443, "dns": 53, "ssh": 22, "ftp": 21, "smtp": 25, "ntp": 123, "snmp": 161, "bgp": 179, "ldap": 389, "rdp": 3389, "mysql": 3306, "postgres": 5432}
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1, "gre": 47, "sctp": 132, "esp": 50, "ah": 51}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_SCALE = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}

_DURATION = re.compile(r"(?:\d+[smhdwM])+")


def is_duration(text: str) -> bool:
    return bool(_DURATION.fullmatch(text))


def duration(text: str, at: int = 0) -> int:
    """Seconds of 1h30m and the like."""
    if not is_duration(text):
        raise QueryError(f"not a duration: {text!r}", at)
    return sum(int(n) * SECONDS[u] for n, u in re.findall(r"(\d+)([smhdwM])", text))


def instant(text: str, at: int = 0) -> int:
    """Epoch milliseconds of an ISO date or time; UTC where no zone is given."""
    try:
        found = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"not a date: {text!r}", at) from None
    found = found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return int(found.timestamp() * 1000)


def is_day(text: str) -> bool:
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text))


def clock(text: str, at: int = 0) -> int:
    """Minutes of the day."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", text)
    if not m or int(m[1]) > 24 or int(m[2]) > 59:
        raise QueryError(f"not a time of day: {text!r}", at)
    return int(m[1]) * 60 + int(m[2])


def number(text: str, at: int = 0) -> int:
    m = re.fullmatch(r"(\d+)([A-Za-z]*)", text)
    if not m or m[2].lower() not in _SCALE:
        raise QueryError(f"not a number: {text!r}", at)
    return int(m[1]) * _SCALE[m[2].lower()]


def port(text: str, at: int = 0) -> tuple[int, int]:
    """Least and greatest port of 80, 80-90, 1024- or a name (0 if unknown)."""
    m = re.fullmatch(r"(\d+)(?:-(\d*))?", text)
    if m:
        lo = int(m[1])
        return (lo, lo) if m[2] is None else (lo, int(m[2] or 65535))
    known = PORTS.get(text.lower(), 0)
    return known, known


def protocol(text: str) -> int:
    return int(text) if text.isdigit() else PROTOCOLS.get(text.lower(), 0)
