"""The values of filters: paths, extensions, kinds, limits, sizes and dates. Each returns None for what it can't read."""

from __future__ import annotations

import os
import re
from datetime import datetime, timedelta

from .ast import Kind, Modified, Size

MOST_ROWS = 10_000
LARGEST = (1 << 63) - 1
UNITS = {"": 0, "b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4}


def absolute_path(value: str) -> str | None:
    path = os.path.expanduser(value)
    if not path.startswith("/"):
        return None
    return path if path == "/" else path.removesuffix("/")


def extensions(value: str) -> tuple[str, ...] | None:
    names = tuple(part.strip(".") for part in value.split(","))
    return names if all(names) else None


def kind(value: str) -> Kind | None:
    names = {"file": False, "files": False, "folder": True, "folders": True, "directory": True, "directories": True}
    return Kind(names[value.lower()]) if value.lower() in names else None


def limit(value: str) -> int | None:
    return min(int(value), MOST_ROWS) if re.fullmatch(r"\+?[0-9]+", value) and int(value) > 0 else None


def byte_count(value: str) -> int | None:
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)([kmgt]?b)?", value.lower())
    n = int(float(m[1]) * 1024 ** UNITS[m[2] or ""]) if m else None
    return n if n is not None and n <= LARGEST else None


def size(value: str) -> Size | None:
    low, dots, high = value.partition("..")
    if dots:
        a, b = byte_count(low), byte_count(high)
        return Size(a, b) if a is not None and b is not None and a <= b else None
    sign, number = re.fullmatch(r"([<>]=?|=|)(.*)", value, re.DOTALL).groups()
    n = byte_count(number)
    if n is None:
        return None
    return {">=": Size(n, None), "<=": Size(None, n), ">": Size(n + 1, None), "<": Size(None, n - 1)}.get(sign, Size(n, n))


def _day(value: str) -> datetime | None:
    try:
        return datetime.strptime(value, "%Y-%m-%d") if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else None
    except ValueError:
        return None


def modified(value: str, now: datetime | None = None) -> Modified | None:
    """Bounds in epoch seconds. Days are local to ``now`` (its zone, or the system's); ``Nd`` counts back from its very time."""
    now = now or datetime.now().astimezone()
    seconds = lambda d: int((d.replace(tzinfo=now.tzinfo) if d.tzinfo is None else d).timestamp())
    whole = lambda first, last: Modified(seconds(first), seconds(last + timedelta(days=1)) - 1)
    if value.lower() == "today":
        day = now.replace(hour=0, minute=0, second=0, microsecond=0)
        return whole(day, day)
    if m := re.fullmatch(r"([0-9]+)d", value.lower()):
        try:
            return Modified(seconds(now - timedelta(days=int(m[1]))), None)
        except OverflowError:
            return None
    first, dots, last = value.partition("..")
    a, b = _day(first), _day(last if dots else first)
    return whole(a, b) if a and b and a <= b else None
