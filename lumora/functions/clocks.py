"""Time parameters of both HTTP surfaces."""

from __future__ import annotations

import math
import re
from datetime import datetime, timezone
from decimal import Decimal

from lumora.functions.durations import INT64_MAX, INT64_MIN, duration_ms, duration_ns
from lumora.functions.errors import QueryError
from lumora.functions.numbers import parse_float

MAX_POINTS, DEFAULT_POINTS, DEFAULT_LIMIT = 11_000, 250, 100
HOUR_NS = 3_600 * 10**9
_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?:Z|([+-])(\d\d):(\d\d))")


def iso_ns(text: str) -> int | None:
    """Nanoseconds of an RFC 3339 instant; None if it is none."""
    m = _ISO.fullmatch(text)
    if not m:
        return None
    try:
        moment = datetime(*(int(x) for x in m.groups()[:6]), tzinfo=timezone.utc)
    except ValueError:
        return None
    offset = 0
    if m[8]:
        if int(m[9]) > 23 or int(m[10]) > 59:
            return None
        offset = (int(m[9]) * 3600 + int(m[10]) * 60) * (1 if m[8] == "+" else -1)
    whole = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).days * 86_400 + moment.hour * 3600 + moment.minute * 60 + moment.second
    return (whole - offset) * 10**9 + int((m[7] or "")[:9].ljust(9, "0"))


def _half_away(x: float) -> float:
    return math.copysign(math.floor(abs(x) + 0.5), x) if math.isfinite(x) and abs(x) < 2**52 else x


def _millis(seconds: float, text: str) -> int:
    ms = _half_away(seconds * 1000) if math.isfinite(seconds) else seconds
    if math.isnan(ms) or not -(2.0**63) <= ms < 2.0**63:
        raise QueryError(f"time out of range: {text!r}")
    return int(ms)


def metric_time_ms(text: str) -> int:
    """Float seconds or RFC 3339."""
    try:
        seconds = parse_float(text)
    except QueryError:
        ns = iso_ns(text)
        if ns is None:
            raise QueryError(f"not a time: {text!r}") from None
        return ns // 10**6
    return _millis(seconds, text)


def metric_step_ms(text: str) -> int:
    """Float seconds or a duration."""
    try:
        seconds = parse_float(text)
    except QueryError:
        return duration_ms(text)
    return _millis(seconds, text)


def _in_range(ns: int, text: str) -> int:
    if not INT64_MIN <= ns <= INT64_MAX:
        raise QueryError(f"time out of range: {text!r}")
    return ns


def log_time_ns(text: str) -> int:
    """With a point: float seconds, to the millisecond. Up to 10 characters: seconds. Longer: nanoseconds. Else RFC 3339."""
    if "." in text:
        try:
            value = parse_float(text)
        except QueryError:
            value = None
        if value is not None:
            if not math.isfinite(value) or abs(value) > INT64_MAX // 10**9:
                raise QueryError(f"time out of range: {text!r}")
            fraction, whole = math.modf(value)
            return _in_range(int(whole) * 10**9 + int(Decimal(int(_half_away(fraction * 1000))) * 10**6), text)
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return _in_range(int(text) if len(text) > 10 else int(text) * 10**9, text)
    ns = iso_ns(text)
    if ns is None:
        raise QueryError(f"not a time: {text!r}")
    return _in_range(ns, text)


def log_step_ns(text: str | None, start: int, end: int) -> int:
    """A given step, or by default one for about DEFAULT_POINTS points; never over MAX_POINTS."""
    span = min(end - start, INT64_MAX)
    if not text:
        return max(1, span // 10**9 // DEFAULT_POINTS) * 10**9
    try:
        value = parse_float(text) * 1e9
        if math.isnan(value) or not -(2.0**63) <= value < 2.0**63:
            raise QueryError("step out of range")
        step = int(value)
    except QueryError:
        step = duration_ns(text)
    if step <= 0:
        raise QueryError("step must be above 0")
    if span // step > MAX_POINTS:
        raise QueryError(f"a query may have {MAX_POINTS} points a series at most; use a longer step")
    return step


def log_window(now: int, start: str | None = None, end: str | None = None, since: str | None = None) -> tuple[int, int]:
    """(start, end): by default the hour before now; ``since`` counts back from the earlier of end and now."""
    last = log_time_ns(end) if end else now
    anchor = min(last, now)
    if start:
        first = log_time_ns(start)
    else:
        first = anchor - (duration_ns(since) if since else HOUR_NS)
        if first < INT64_MIN:
            raise QueryError("'since' reaches too far back")
    if last < first:
        raise QueryError("end lies before start")
    return first, last


def log_limit(text: str | None) -> int:
    if not text:
        return DEFAULT_LIMIT
    if not re.fullmatch(r"[+-]?[0-9]+", text) or not 0 < int(text) <= INT64_MAX:
        raise QueryError(f"limit must be a positive integer, not {text!r}")
    return int(text)


def log_backward(text: str | None) -> bool:
    said = (text or "backward").lower()
    if said not in ("backward", "forward"):
        raise QueryError(f"direction is forward or backward, not {text!r}")
    return said == "backward"
