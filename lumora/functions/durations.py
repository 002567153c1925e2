"""Durations of both query languages, in whole nanoseconds."""

from __future__ import annotations

import re
from fractions import Fraction

from lumora.functions.errors import QueryError

INT64_MAX, INT64_MIN = 2**63 - 1, -(2**63)
#: Units of the calendar-free duration grammar, from the longest.
UNITS = {"y": 365 * 86_400 * 10**9, "w": 7 * 86_400 * 10**9, "d": 86_400 * 10**9, "h": 3_600 * 10**9, "m": 60 * 10**9, "s": 10**9, "ms": 10**6}
#: Units of the decimal duration grammar.
DECIMAL_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3_600 * 10**9}

_STEPWISE = re.compile("".join(rf"(?:(?P<{u}>[0-9]+){u})?" for u in UNITS))
_DECIMAL = re.compile(r"(?P<n>[0-9]+\.?[0-9]*|\.[0-9]+)(?P<u>ns|us|µs|μs|ms|s|m|h)")


def duration_ns(text: str) -> int:
    """``1h30m``: units from long to short, each once; ``0`` needs none."""
    if text == "0":
        return 0
    found = _STEPWISE.fullmatch(text)
    if not text or not found:
        raise QueryError(f"not a duration: {text!r}")
    parts = {u: int(n) for u, n in found.groupdict().items() if n is not None}
    total = sum(n * UNITS[u] for u, n in parts.items())
    if total > INT64_MAX:
        raise QueryError(f"duration {text!r} is too long")
    return total


def duration_ms(text: str) -> int:
    return duration_ns(text) // 10**6


def decimal_duration_ns(text: str) -> int:
    """``1.5h`` or ``150ns``, with a sign, units in any order."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    if rest == "0":
        return 0
    total, at = 0, 0
    for m in _DECIMAL.finditer(rest):
        if m.start() != at:
            break
        total += int(Fraction(m["n"].rstrip(".") if m["n"].endswith(".") else m["n"]) * DECIMAL_UNITS[m["u"]])
        at = m.end()
    if not rest or at != len(rest) or not INT64_MIN <= sign * total <= INT64_MAX:
        raise QueryError(f"not a duration: {text!r}")
    return sign * total


def log_range_ns(text: str) -> int:
    """A log range: the stepwise grammar, else the decimal one; above 0."""
    try:
        ns = duration_ns(text)
    except QueryError:
        ns = decimal_duration_ns(text)
    if ns <= 0:
        raise QueryError(f"a range must be longer than 0, not {text!r}")
    return ns
