"""The data model: dimensions of label sets, and facts that refer to them by id.

``series``: sid BIGINT, name STRING, labels MAP, labels_key STRING; ``samples``: sid, ts_ms BIGINT, value
DOUBLE, gen BIGINT (write order; the highest wins at a time). ``streams``: stream_id BIGINT, labels MAP,
labels_key STRING; ``entries``: stream_id, ts_ns BIGINT, line STRING, seq BIGINT (arrival order).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = "sid BIGINT, ts_ms BIGINT, value DOUBLE, gen BIGINT"
SERIES = "sid BIGINT, name STRING, labels MAP<STRING, STRING>, labels_key STRING"
ENTRIES = "stream_id BIGINT, ts_ns BIGINT, line STRING, seq BIGINT"
STREAMS = "stream_id BIGINT, labels MAP<STRING, STRING>, labels_key STRING"
#: Limits of label sets and lines, in bytes.
NAME_BYTES, VALUE_BYTES, LABELS, LINE_BYTES = 255, 65_535, 255, 262_144
_LABEL, _METRIC = r"[a-zA-Z_][a-zA-Z0-9_]*", r"[a-zA-Z_:][a-zA-Z0-9_:]*"


@dataclass(frozen=True)
class Metrics:
    series: DataFrame
    samples: DataFrame


@dataclass(frozen=True)
class Logs:
    streams: DataFrame
    entries: DataFrame


def labels_key(labels: Column) -> Column:
    """``{a="b", ...}`` by name, the text that stands for a label set in joins, groups and sorts."""

    def quoted(v: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            v = F.replace(v, F.lit(plain), F.lit(escaped))
        return v

    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def check_labels(labels: dict[str, str], metric: bool) -> str | None:
    """What is wrong with a label set, or None."""
    if metric and not re.fullmatch(_METRIC, labels.get("__name__", "")):
        return "__name__: not a metric name"
    if not labels:
        return "labels: at least one is needed"
    if len(labels) > LABELS:
        return f"labels: more than {LABELS}"
    for name, value in labels.items():
        if not re.fullmatch(_LABEL, name) or len(name.encode("utf-8", "surrogatepass")) > NAME_BYTES:
            return f"labels.{name}: not a label name"
        if name.startswith("__") and name != "__name__":
            return f"labels.{name}: names with __ are reserved"
        try:
            if len(value.encode()) > VALUE_BYTES:
                return f"labels.{name}: value too long"
        except UnicodeEncodeError:
            return f"labels.{name}: value is not UTF-8"
    return None


def valid_labels(labels: Column, metric: bool) -> Column:
    """The same rules as a column."""
    name = lambda k: k.rlike(f"^{_LABEL}\\z") & (F.octet_length(k) <= NAME_BYTES) & (~k.startswith("__") | (k == "__name__"))
    ok = (F.size(labels) >= 1) & (F.size(labels) <= LABELS) & F.forall(F.map_keys(labels), name) & F.forall(F.map_values(labels), lambda v: v.isNotNull() & (F.octet_length(v) <= VALUE_BYTES))
    if metric:
        ok &= F.coalesce(F.element_at(labels, "__name__").rlike(f"^{_METRIC}\\z"), F.lit(False))
    return F.coalesce(ok, F.lit(False))

