"""Checks on caller-supplied parameters. All of them raise ``ValueError``."""

from __future__ import annotations

import datetime as dt
import re

PERIODS = ("monthly", "quarterly", "yearly")
MODES = ("append", "overwrite")

_ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def check_date(value: dt.date | str, name: str) -> dt.date:
    """Accept a ``datetime.date`` or ISO ``YYYY-MM-DD`` text."""
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    if isinstance(value, str) and _ISO_DATE.fullmatch(value):
        try:
            return dt.date.fromisoformat(value)
        except ValueError as exc:
            raise ValueError(f"{name}: {value!r} is not a calendar date") from exc
    raise ValueError(f"{name}: expected a date or 'YYYY-MM-DD' text, got {value!r}")


def check_range(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    """Both ends are required; a start after the end is a valid, empty range."""
    return check_date(start, "start_date"), check_date(end, "end_date")


def check_choice(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name}: {value!r} is not one of {', '.join(allowed)}")
    return value


def check_limit(limit: int | None) -> int | None:
    """None, zero and negative numbers all mean "no limit"."""
    if limit is None:
        return None
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError(f"limit: expected a whole number, got {limit!r}")
    return limit if limit > 0 else None
