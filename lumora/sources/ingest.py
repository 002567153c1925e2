"""Validated ingest of JSON bodies: all rows of a body or none.

``metric_rows`` and ``log_rows`` check one body on the driver, as a request handler does, and name its errors.
``metric_frame`` and ``log_frame`` check columns of bodies as DataFrame plans, for files and streams, by the
same rules; a body with any error gives no rows. Bodies are parsed as VARIANT values, which keep their JSON
types, so that nothing is coerced; a body is wrapped with its own digest behind it, which is read back only
if the body was one JSON value and nothing more.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.durations import INT64_MAX, INT64_MIN
from lumora.functions.errors import QueryError
from lumora.sources.model import LINE_BYTES, check_labels, labels_key, valid_labels

#: Largest bodies, in bytes.
METRIC_BODY, LOG_BODY = 1 << 20, 4 << 20
#: More entries than such a body can hold: write order is (order of the body) * PLACES + place in the body.
PLACES, LOG_PLACES = 1 << 15, 1 << 19
#: A surrogate escape without its other half; an even number of backslashes before it escapes nothing.
_LONE = r"(?<!\\)(?:\\\\)*+\\u[dD](?:[89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|[c-fC-F][0-9a-fA-F]{2})"
_PAIRED = r"(?<!\\)((?:\\\\)*+)\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"


class IngestError(QueryError):
    """A rejected body; ``errors`` has its index, field and message each."""

    def __init__(self, errors: list[dict]):
        super().__init__("; ".join(f"{e['field']}: {e['message']}" for e in errors))
        self.errors = errors


def _fail(message: str, field: str = "body", index: int = 0):
    raise IngestError([{"index": index, "field": field, "message": message}])


def _body(raw: bytes, most: int) -> dict:
    if len(raw) > most:
        _fail("too large")
    try:
        text = raw.decode("utf-8")
        data = json.loads(text, parse_constant=lambda c: _fail(f"{c} is not JSON"))
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        _fail(f"not JSON in UTF-8: {e}")
    if re.search(_LONE, re.sub(_PAIRED, "", text)):
        _fail("a surrogate stands alone")
    if not isinstance(data, dict):
        _fail("one JSON object is expected")
    return data


def _finite(value: int | float) -> bool:
    try:
        return math.isfinite(float(value))
    except OverflowError:
        return False


def metric_rows(raw: bytes) -> list[tuple[dict[str, str], int, float]]:
    """(labels with __name__, ts_ms, value) of ``{"metrics": [{name, labels, timestamp_ms, value}]}``."""
    found = _body(raw, METRIC_BODY).get("metrics")
    if not isinstance(found, list) or not found:
        _fail("must not be empty", "metrics")
    rows, errors = [], []
    for i, m in enumerate(found):
        problem = None
        if not isinstance(m, dict):
            problem = "metrics", "an object is expected"
        else:
            labels, ts, value = m.get("labels"), m.get("timestamp_ms"), m.get("value")
            sound = labels is None or isinstance(labels, dict)
            labels = dict(labels or {}) if sound else {}
            labels["__name__"] = m.get("name") if m.get("name") is not None else ""
            if not sound or not all(isinstance(v, str) for v in labels.values()):
                problem = "labels", "an object of strings is expected"
            elif ts is None or value is None:
                problem = ("timestamp_ms" if ts is None else "value"), "required"
            elif isinstance(ts, bool) or not isinstance(ts, int) or not INT64_MIN <= ts <= INT64_MAX:
                problem = "timestamp_ms", "a 64-bit integer is expected"
            elif isinstance(value, bool) or not isinstance(value, (int, float)) or not _finite(value):
                problem = "value", "a number is expected"
            elif wrong := check_labels(labels, True):
                problem = tuple(wrong.split(": ", 1))
            else:
                rows.append((labels, ts, float(value)))
        if problem:
            errors.append({"index": i, "field": problem[0], "message": problem[1]})
    if errors:
        raise IngestError(errors)
    return rows


def log_rows(raw: bytes, content_type: str | None = None) -> list[tuple[dict[str, str], int, str]]:
    """(labels, ts_ns, line) of ``{"streams": [{"stream": {...}, "values": [["ns", "line"], ...]}]}``."""
    if content_type not in (None, "", "application/json"):
        _fail("application/json is expected", "content-type")
    streams = _body(raw, LOG_BODY).get("streams")
    if not isinstance(streams, list) or not streams:
        _fail("must not be empty", "streams")
    rows = []
    for i, s in enumerate(streams):
        labels, values = (s.get("stream"), s.get("values")) if isinstance(s, dict) else (None, None)
        if not isinstance(labels, dict) or not all(isinstance(v, str) for v in labels.values()):
            _fail("labels must be strings", "stream", i)
        if wrong := check_labels(labels, False):
            _fail(wrong, "stream", i)
        if values is not None and not isinstance(values, list):
            _fail("a list is expected", "values", i)
        for entry in values or []:
            if not isinstance(entry, list) or len(entry) != 2 or not all(isinstance(x, str) for x in entry):
                _fail("an entry is a time and a line", "values", i)
            if not re.fullmatch(r"[+-]?[0-9]+", entry[0]) or not 0 < int(entry[0]) <= INT64_MAX:
                _fail("times are positive nanoseconds", "values", i)
            if len(entry[1].encode()) > LINE_BYTES:
                _fail("line too long", "values", i)
            rows.append((labels, int(entry[0]), entry[1]))
    return rows


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once; a column is computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _checked(text: Column, most: int) -> Column:
    """The parsed body as VARIANT, or null if it is not one JSON value in UTF-8 of bounded size."""
    paired = ~text.contains("\\u") | ~F.regexp_replace(text, _PAIRED, "$1").rlike(_LONE)
    sound = (F.octet_length(text) <= most) & F.is_valid_utf8(text) & paired
    both = lambda mark: F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    whole = lambda mark: lambda x: F.when(F.try_variant_get(x, "$[1]", "string").eqNullSafe(mark), F.try_variant_get(x, "$[0]", "variant"))
    return F.when(sound, _once(F.sha2(text, 256), lambda mark: _once(both(mark), whole(mark))))


def _objects(text: Column, most: int, name: str) -> Column:
    """List ``name`` of a body: a map for each object in it, null for any other value."""
    return F.try_variant_get(_checked(text, most), f"$.{name}", "array<map<string, variant>>")


def _parts(m: Column, *names: str) -> list[Column]:
    return [F.try_element_at(m, F.lit(n)).alias(n) for n in names]


def _type(x: Column) -> Column:
    """JSON type of a variant: null where there is no value at all. For a list or object all that is in it is read."""
    return F.schema_of_variant(x)


def _absent(x: Column) -> Column:
    return x.isNull() | (_type(x) == "VOID")


def _text(x: Column) -> Column:
    """The string that a variant is, else null."""
    return F.when(_type(x) == "STRING", x.try_cast("string"))


def _text_map(x: Column) -> Column:
    """The map that an object of strings is, else null."""
    texts = lambda m: F.when(F.forall(F.map_values(m), lambda v: _type(v) == "STRING"), F.transform_values(m, lambda _, v: v.try_cast("string")))
    return _once(x.try_cast("map<string, variant>"), texts)


def _if_all(rows: Column, good) -> Column:
    """A list of one or more that are all good, else null."""
    return _once(rows, lambda x: F.when((F.size(x) > 0) & F.forall(x, lambda r: F.coalesce(good(r), F.lit(False))), x))


def metric_frame(bodies: DataFrame, column: str = "value", gen: Column | None = None) -> DataFrame:
    """labels, labels_key, ts_ms, value, gen of valid bodies. ``gen`` orders bodies; places in a body come after it.

    Without ``gen`` all bodies count as written at once, each in its own order.
    """
    bodies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last one counts
    found = bodies.select(F.col(column).alias("_text"), (gen if gen is not None else F.lit(0).cast("long")).alias("_gen"))
    parts = lambda m, i: F.struct(m.isNotNull().alias("sound"), *_parts(m, "name", "labels", "timestamp_ms", "value"), i.cast("long").alias("place"))
    none = F.create_map().cast("map<string, string>")
    named = lambda given, name: F.map_concat(F.map_filter(given, lambda k, _: k != "__name__"), F.create_map(F.lit("__name__"), F.when(_absent(name), "").otherwise(_text(name))))
    labels = lambda p: _once(F.coalesce(_text_map(p["labels"]), F.when(_absent(p["labels"]), none)), lambda given: named(given, p["name"]))
    number = lambda v: _once(_type(v), lambda t: F.when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), v.try_cast("double")))
    time = lambda t: F.when(_type(t) == "BIGINT", t.try_cast("long"))
    row = lambda p: F.struct(p["sound"].alias("sound"), labels(p).alias("labels"), time(p["timestamp_ms"]).alias("ts_ms"), number(p["value"]).alias("value"), p["place"].alias("place"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = lambda r: r["sound"] & valid_labels(r["labels"], True) & r["ts_ms"].isNotNull() & finite(r["value"])
    rows = _if_all(F.transform(F.transform(_objects(F.col("_text"), METRIC_BODY, "metrics"), parts), row), good)
    # an inner explode would bring filters that compute all of it again
    rows = found.select("_gen", F.explode_outer(rows).alias("r")).where("r is not null")
    return rows.select("r.labels", labels_key(F.col("r.labels")).alias("labels_key"), "r.ts_ms", "r.value", (F.col("_gen") * F.lit(PLACES) + F.col("r.place")).alias("gen"))


def log_frame(bodies: DataFrame, column: str = "value", seq: Column | None = None) -> DataFrame:
    """labels, labels_key, ts_ns, line, seq of valid bodies. ``seq`` orders bodies as ``gen`` does those of metrics."""
    bodies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = bodies.select(F.col(column).alias("_text"), (seq if seq is not None else F.lit(0).cast("long")).alias("_seq"))
    # times have a plus sign and leading zeros, if they like, and are positive 64-bit numbers
    time = lambda t: F.when(t.rlike(r"^[+]?0*[1-9][0-9]{0,18}\z"), F.regexp_replace(t, "^[+]?0*", "").try_cast("long"))
    pair = lambda e: F.when((F.size(e) == 2) & F.forall(e, lambda v: _type(v) == "STRING"), F.struct(_once(F.get(e, F.lit(0)).try_cast("string"), time).alias("ts_ns"), F.get(e, F.lit(1)).try_cast("string").alias("line")))
    entries = lambda v: F.coalesce(v.try_cast("array<array<variant>>"), F.when(_absent(v), F.array().cast("array<array<variant>>")))
    parts = lambda m: F.struct(m.isNotNull().alias("sound"), *_parts(m, "stream", "values"))
    stream = lambda p: F.struct(p["sound"].alias("sound"), _text_map(p["stream"]).alias("labels"), F.transform(entries(p["values"]), pair).alias("values"))
    entry_ok = lambda e: F.coalesce(e["ts_ns"].isNotNull() & (F.octet_length(e["line"]) <= LINE_BYTES), F.lit(False))
    good = lambda s: s["sound"] & s["values"].isNotNull() & valid_labels(s["labels"], False) & F.forall(s["values"], entry_ok)
    streams = _if_all(F.transform(F.transform(_objects(F.col("_text"), LOG_BODY, "streams"), parts), stream), good)
    flat = F.flatten(F.transform(streams, lambda s: F.transform(s["values"], lambda e: F.struct(s["labels"].alias("labels"), e["ts_ns"].alias("ts_ns"), e["line"].alias("line")))))
    rows = found.select("_seq", F.posexplode_outer(flat).alias("place", "r")).where("r is not null")
    return rows.select("r.labels", labels_key(F.col("r.labels")).alias("labels_key"), "r.ts_ns", "r.line", (F.col("_seq") * F.lit(LOG_PLACES) + F.col("place")).alias("seq"))
