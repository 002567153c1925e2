"""IEEE numbers: parsing, arithmetic that never raises, and shortest fixed notation."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from lumora.functions.errors import QueryError

_PLAIN = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_HEX = re.compile(r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+")
_WORD = re.compile(r"[+-]?(?:inf|infinity)|nan", re.IGNORECASE)


def parse_float(text: str) -> float:
    """A float literal, decimal or hexadecimal, or inf and nan in any case. Decimal overflow is an error."""
    if _PLAIN.fullmatch(text):
        value = float(text)
    elif _HEX.fullmatch(text):
        try:
            value = float.fromhex(text)
        except OverflowError:
            value = math.inf
    elif _WORD.fullmatch(text):
        return float(text)
    else:
        raise QueryError(f"not a number: {text!r}")
    if math.isinf(value):
        raise QueryError(f"number out of range: {text!r}")
    return value


def divide(a: float, b: float) -> float:
    if b != 0 or math.isnan(b):
        return a / b
    if a == 0 or math.isnan(a):
        return math.nan
    return math.copysign(math.inf, a) * math.copysign(1.0, b)


def arithmetic(op: str, a: float, b: float) -> float:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b)}[op]()


def format_value(v: float) -> str:
    """Shortest digits that read back as ``v``, without exponent."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == 0:
        return "-0" if math.copysign(1.0, v) < 0 else "0"
    text = format(Decimal(repr(v)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
