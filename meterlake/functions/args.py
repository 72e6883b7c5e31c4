"""Parsing of report arguments (plain Python, runs once per report on the driver)."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

# Weekday names (fixed values), numbered from Sunday = 0.
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def parse_date(text: str | date | None) -> date | None:
    """``YYYY-MM-DD``, or ``YYYY-MM`` for the first day of that month."""
    if text is None or isinstance(text, date):
        return text
    match = re.fullmatch(r"(\d{1,4})-(\d{1,2})(?:-(\d{1,2}))?", text)
    if not match:
        raise ValueError(f"Invalid date format '{text}', expected YYYY-MM-DD or YYYY-MM")
    year, month, day = match.groups()
    try:
        return date(int(year), int(month), int(day or 1))
    except ValueError as error:
        raise ValueError(f"Invalid date '{text}': {error}") from None


def parse_month(text: str | date | None) -> tuple[int, int] | None:
    day = parse_date(text)
    return None if day is None else (day.year, day.month)


def parse_weekday(text: str) -> int:
    """Number of a weekday from Sunday = 0; full or three-letter names, any case."""
    wanted = text.lower()
    for number, name in enumerate(WEEKDAYS):
        if wanted in (name, name[:3]):
            return number
    raise ValueError(f"Invalid weekday '{text}'. Expected one of: {', '.join(WEEKDAYS)}")


def parse_zone(name: str | None) -> str:
    """Checks an IANA zone name; no name means UTC."""
    if not name:
        return "UTC"
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        raise ValueError(f"Invalid time zone '{name}'. Use a name like 'America/New_York' or 'UTC'") from None
    return name


def parse_instant(value: str | datetime) -> datetime:
    """An explicit "now"; a value without a zone is taken as UTC."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def duration_micros(hours: float) -> int:
    """Block length in microseconds; negative (also -0.0), NaN and infinite lengths are errors."""
    if math.copysign(1.0, hours) < 0:
        raise ValueError(f"Session duration cannot be negative: {hours}")
    if not math.isfinite(hours):
        raise ValueError(f"Invalid session duration: {hours}")
    return round(hours * 3_600_000_000)


def parse_token_limit(text: str, approx_max_tokens: float) -> tuple[float, str]:
    """Threshold and its wording, from a count (``"500000"``) or a share (``"80%"``)."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    if text.endswith("%"):
        share_text = text.rstrip("%")
        if not re.fullmatch(number, share_text):
            raise ValueError(f"Invalid token limit: {text}")
        share = float(share_text) / 100.0
        threshold = approx_max_tokens * share
        return threshold, f"{max(int(share * 100.0), 0)}% (~{threshold:.0f} tokens)"
    if not re.fullmatch(r"\+?\d+", text) or int(text) > 2**64 - 1:
        raise ValueError(f"Invalid token limit: {text}")
    return float(int(text)), f"{int(float(int(text)))} tokens"
