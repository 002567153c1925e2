"""The HTTP surfaces as functions: parameters in, a status and a JSON-ready body out.

A request that is wrong is answered with 400, one that fails while it runs with 500. Answers are one JSON
document each, so their rows meet on the driver; a result of more than ``MOST_ROWS`` points or lines is an
error that says so, never a cut result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import wraps

from pyspark.sql import DataFrame

from lumora.functions import clocks
from lumora.functions.errors import QueryError
from lumora.functions.numbers import format_value
from lumora.operators import discovery
from lumora.operators.head import LogHead, MetricHead
from lumora.operators.logs import LogEngine
from lumora.operators.metrics import MetricEngine, Scalar
from lumora.plans.logql import NotMetric, is_log_query, parse_constant, parse_log, parse_metric
from lumora.plans.promql import Number, parse
from lumora.sources.ingest import IngestError, log_rows, metric_rows

Answer = tuple[int, object]
#: Points or lines of one answer.
MOST_ROWS = 1_000_000


def health() -> Answer:
    return 200, {"status": "ok"}


def ready(*heads: MetricHead | LogHead) -> Answer:
    """Whether all stores can be written."""
    try:
        for head in heads:
            head.probe()
    except Exception as e:  # whatever the file system has to say
        return 503, {"status": "unavailable", "error": str(e)}
    return 200, {"status": "ready"}


def _answers(bad: Callable[[str], Answer], failed: Callable[[str], Answer]):
    """Errors of a request as answers: 400 where the request is wrong, else 500."""
    def add(f):
        @wraps(f)
        def call(*args, **kw):
            try:
                return f(*args, **kw)
            except QueryError as e:
                return bad(str(e))
            except RecursionError:
                return bad("the query is nested too deeply")
            except Exception as e:
                return failed(str(e))
        return call
    return add


def _rows(rows: DataFrame) -> list:
    found = rows.limit(MOST_ROWS + 1).collect() if rows is not None else []
    if len(found) > MOST_ROWS:
        raise QueryError(f"the result has more than {MOST_ROWS} rows: narrow the query")
    return found


def _ok(data) -> Answer:
    return 200, {"status": "success", "data": data, "warnings": []}


def _bad(message: str) -> Answer:
    return 400, {"status": "error", "errorType": "bad_data", "error": message}


_metric = _answers(_bad, lambda message: (500, {"status": "error", "errorType": "execution", "error": message}))
_log = _answers(lambda message: (400, message), lambda message: (500, message))


def _log_ok(kind: str, result) -> Answer:
    return 200, {"status": "success", "data": {"resultType": kind, "result": result, "stats": {}}}


def _matrix(rows: DataFrame, tick: str, unit: float) -> list[dict]:
    out: dict[str, dict] = {}
    for r in sorted(_rows(rows), key=lambda r: (r["labels_key"], r[tick])):
        series = out.setdefault(r["labels_key"], {"metric": dict(r["labels"]), "values": []})
        series["values"].append([r[tick] / unit, format_value(r["value"])])
    return list(out.values())


class MetricApi:
    """Over an engine, or over a head whose bodies and blocks are looked up anew for each query."""

    def __init__(self, engine: MetricEngine | None = None, head: MetricHead | None = None):
        self._engine, self.head = engine, head

    @property
    def engine(self) -> MetricEngine:
        return self._engine or MetricEngine(self.head.data())

    @_metric
    def ingest(self, body: bytes) -> Answer:
        """204 once the body is stored."""
        try:
            if self.head is None:
                metric_rows(body)
                return 500, {"status": "error", "errorType": "execution", "error": "there is no store to write to"}
            self.head.append(body)
        except IngestError as e:
            return 400, {"errors": e.errors}
        return 204, None

    @_metric
    def query(self, form: Mapping[str, str]) -> Answer:
        t = clocks.metric_time_ms(form["time"]) if form.get("time") else int(time.time() * 1000)
        out = self.engine.query(form.get("query", ""), t)
        if isinstance(out, Scalar):
            return _ok({"resultType": "scalar", "result": [t / 1000, format_value(out.value)]})
        found = [{"metric": dict(r["labels"]), "value": [r["ts_ms"] / 1000, format_value(r["value"])]} for r in sorted(_rows(out), key=lambda r: r["labels_key"])]
        return _ok({"resultType": "vector", "result": found})

    @_metric
    def query_range(self, form: Mapping[str, str]) -> Answer:
        for name in ("query", "start", "end", "step"):
            if not form.get(name):
                raise QueryError(f"parameter {name!r} is missing")
        start, end = clocks.metric_time_ms(form["start"]), clocks.metric_time_ms(form["end"])
        rows = self.engine.query_range(form["query"], start, end, clocks.metric_step_ms(form["step"]))
        result = _matrix(rows, "tick_ms", 1000.0)
        if isinstance(parse(form["query"]), Number):
            result = [r | {"metric": {}} for r in result]
        return _ok({"resultType": "matrix", "result": result})

    def _series(self, match: Sequence[str], form: Mapping[str, str]) -> DataFrame:
        bound = {k: clocks.metric_time_ms(form[k]) for k in ("start", "end") if form.get(k)}
        if len(bound) == 2 and bound["end"] < bound["start"]:
            raise QueryError("end lies before start")
        return discovery.chosen_series(self.engine.data, match, bound.get("start"), bound.get("end"))

    @_metric
    def series(self, match: Sequence[str], form: Mapping[str, str] | None = None) -> Answer:
        if not match:
            raise QueryError("a match[] is needed")
        return _ok([dict(r["labels"]) for r in _rows(discovery.ordered_series(self._series(match, form or {})))])

    @_metric
    def labels(self, match: Sequence[str] = (), form: Mapping[str, str] | None = None) -> Answer:
        return _ok([r[0] for r in _rows(discovery.label_names(self._series(match, form or {})))])

    @_metric
    def label_values(self, name: str, match: Sequence[str] = (), form: Mapping[str, str] | None = None) -> Answer:
        return _ok([r[0] for r in _rows(discovery.label_values(self._series(match, form or {}), name))])

    def self_metrics(self) -> str:
        """Gauges, and the head's counters and histogram, in the text exposition format."""
        c = discovery.cardinality(self.engine.data.series).first()
        blocks = self.head.blocks if self.head else None
        values = {"active_series": c["series"], "label_names_total": c["label_names"], "label_pairs_total": c["label_pairs"], "blocks_total": len(blocks.blocks()) if blocks else 0, "blocks_bytes": blocks.size() if blocks else 0}
        return "".join(f"# TYPE obs_{k} gauge\nobs_{k} {v}\n" for k, v in values.items()) + (self.head.counters.text() if self.head else "")


class LogApi:
    """Over an engine, or over a head whose bodies and blocks are looked up anew for each query."""

    def __init__(self, engine: LogEngine | None = None, now=time.time_ns, head: LogHead | None = None):
        self._engine, self.now, self.head = engine, now, head

    @property
    def engine(self) -> LogEngine:
        return self._engine or LogEngine(self.head.data())

    @_log
    def push(self, body: bytes, content_type: str | None = None) -> Answer:
        """204 once the body is stored."""
        if self.head is None:
            log_rows(body, content_type)
            return 500, "there is no store to write to"
        self.head.append(body, content_type)
        return 204, None

    @_log
    def query_range(self, form: Mapping[str, str]) -> Answer:
        try:
            text = form.get("query", "")
            limit, backward = clocks.log_limit(form.get("limit")), clocks.log_backward(form.get("direction"))
            logs = is_log_query(text)
            parse_log(text) if logs else parse_metric(text)  # before any time is looked at
            if form.get("interval"):
                raise QueryError("interval is not supported")
            start, end = clocks.log_window(self.now(), form.get("start"), form.get("end"), form.get("since"))
            step = clocks.log_step_ns(form.get("step"), start, end)
            if logs:
                return _log_ok("streams", _streams(self.engine.query_range(text, start, end, limit, backward)))
            return _log_ok("matrix", _matrix(self.engine.metric_range(text, start, end, step), "tick_ns", 1e9))
        except NotMetric:
            raise QueryError("constant expressions are for instant queries") from None

    @_log
    def query(self, form: Mapping[str, str]) -> Answer:
        text = form.get("query", "")
        limit, backward = clocks.log_limit(form.get("limit")), clocks.log_backward(form.get("direction"))
        t = clocks.log_time_ns(form["time"]) if form.get("time") else self.now()
        if is_log_query(text):
            return _log_ok("streams", _streams(self.engine.query(text, t, limit, backward)))
        try:
            rows = sorted(_rows(self.engine.metric(text, t)), key=lambda r: r["labels_key"])
            return _log_ok("vector", [{"metric": dict(r["labels"]), "value": [t / 1e9, format_value(r["value"])]} for r in rows])
        except NotMetric:
            found = parse_constant(text)
            pair = [t / 1e9, format_value(found.value)]
            return _log_ok("vector", [{"metric": {}, "value": pair}]) if found.vector else _log_ok("scalar", pair)

    @_log
    def labels(self) -> Answer:
        return 200, {"status": "success", "data": [r[0] for r in _rows(discovery.label_names(self.engine.data.streams))]}

    @_log
    def label_values(self, name: str) -> Answer:
        return 200, {"status": "success", "data": [r[0] for r in _rows(discovery.label_values(self.engine.data.streams, name))]}


def _streams(rows: DataFrame) -> list[dict]:
    """Label sets in the order of their first entry, each with its entries in order."""
    out: dict[str, dict] = {}
    for r in sorted(_rows(rows), key=lambda r: (r["group_ord"], r["ord"])):
        out.setdefault(r["labels_key"], {"stream": dict(r["labels"]), "values": []})["values"].append([str(r["ts_ns"]), r["line"]])
    return list(out.values())
