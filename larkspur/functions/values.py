"""Numbers, labels and intervals of the log queries."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
#: spans a time chart may take by itself, in milliseconds (fixed values)
SPANS = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 600_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000)


def round4(x: Column) -> Column:
    """Four decimals, halves away from zero, the same on every engine."""
    return F.signum(x) * F.floor(F.abs(x) * 10000 + 0.5) / 10000


def number_text(x: Column) -> Column:
    """A number as text, whole ones without decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def number_of_text(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def as_number(value: str) -> float | None:
    return float(value) if re.match(NUMBER.replace("(?i:inf|infinity|nan)", "(?:inf|infinity|nan)"), value, re.I) else None


def as_integer(value: str) -> int | None:
    return int(value) if re.fullmatch(r"[+-]?\d+", value) and -(1 << 63) <= int(value) < 1 << 63 else None


# Names of levels and what they are called, and the weights of alerts.
LEVELS = {"WARNING": "WARN", "CRITICAL": "FATAL"} | {x: x for x in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")}
WEIGHTS = {"high": "high", "critical": "high", "error": "high", "medium": "medium", "warn": "medium", "warning": "medium"}


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key]


def level(text: Column) -> Column:
    """A level's usual name, in any case; null for other texts."""
    return _named(F.upper(text), LEVELS)


def weight(severity: Column) -> Column:
    """high, medium or low of an alert's severity."""
    return F.coalesce(_named(F.lower(F.trim(severity)), WEIGHTS), F.lit("low"))


def bucket(ts_ms: Column, span_ms: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(span_ms))


def label(ts_ms: Column, span_ms: int = 1) -> Column:
    """UTC, to the second where the span is whole seconds, else to the millisecond."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss'Z'" if span_ms % 1000 == 0 else "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return F.date_format(F.timestamp_millis(ts_ms), pattern)


def interval_ms(text: str, bare: bool = False) -> int:
    """`5m`, `250ms`; a bare number is milliseconds where bare is set, else an error."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|[smhd])?\s*", text)
    if not m or not (m[2] or bare) or not int(m[1]):
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * UNITS[m[2] or "ms"]


def time_bound(text: str | None, now_ms: int) -> int | None:
    """`now`, `-1h`, epoch milliseconds or RFC 3339; anything else is no bound."""
    text = (text or "").strip()
    if text == "now":
        return now_ms
    if m := re.fullmatch(r"-(\d+)([smhd])", text):
        return now_ms - int(m[1]) * UNITS[m[2]]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int(at.timestamp() * 1000) if at.tzinfo else None


def default_span(start_ms: int | None, end_ms: int | None) -> int:
    """A sixtieth of the window, rounded up to a customary span; an hour for open windows."""
    if start_ms is None or end_ms is None:
        return UNITS["h"]
    return next((s for s in SPANS if s >= (end_ms - start_ms) / 60), SPANS[-1])


def auto_interval(start_ms: int | None, end_ms: int | None) -> int:
    """A histogram's span where none is given, about a sixtieth of the window in whole tens of seconds, minutes or hours;
    an open window counts as an hour."""
    window = 3600 if start_ms is None or end_ms is None else max(60, (end_ms - start_ms) // 1000)
    step = window // 60
    if step < 60:
        return 1000 * max(10, (step + 5) // 10 * 10)
    return UNITS["m"] * (step // 60) if step < 3600 else UNITS["h"] * (step // 3600)


def iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
