import random

import pytest
from pyspark.sql import functions as F

from lumora.functions.fingerprint import fingerprint
from lumora.operators import discovery
from lumora.operators.logs import LogEngine
from lumora.operators.metrics import MetricEngine, Scalar
from lumora.sources.model import ENTRIES, SAMPLES, Logs, Metrics, labels_key


def metrics(spark, rows):
    """rows: (labels, [(ts, value), ...]) in order of writing."""
    series = [(i, labels.get("__name__"), labels) for i, (labels, _) in enumerate(rows)]
    samples = [(i, t, float(v), g + 1) for i, (_, points) in enumerate(rows) for g, (t, v) in enumerate(points)]
    return Metrics(spark.createDataFrame(series, "sid long, name string, labels map<string,string>").withColumn("labels_key", labels_key(F.col("labels"))), spark.createDataFrame(samples, SAMPLES))


def logs(spark, rows):
    """rows: (labels, ts, line) in order of arrival."""
    ids: dict = {}
    for labels, _, _ in rows:
        ids.setdefault(tuple(sorted(labels.items())), len(ids))
    streams = [(i, dict(k)) for k, i in ids.items()]
    entries = [(ids[tuple(sorted(labels.items()))], t, line, n) for n, (labels, t, line) in enumerate(rows)]
    return Logs(spark.createDataFrame(streams, "stream_id long, labels map<string,string>").withColumn("labels_key", labels_key(F.col("labels"))), spark.createDataFrame(entries, ENTRIES))


def points(frame, time):
    return sorted((r["labels_key"], r[time], round(r["value"], 9)) for r in frame.collect())


def test_small_metric_fixtures(spark):
    engine = MetricEngine(metrics(spark, [
        ({"__name__": "cpu"}, [(1000, 1), (3000, 3)]), ({"__name__": "total"}, [(0, 100), (60000, 160)]), ({"__name__": "one"}, [(60000, 100)]), ({"__name__": "reset"}, [(0, 10), (30000, 2)]),
        ({"__name__": "req", "env": "prod"}, [(1000, 3)]), ({"__name__": "req"}, [(1000, 7)]), ({"__name__": "twice"}, [(5, 1), (5, 999)]), ({"__name__": "z", "l1": "x", "l2": "y\0z"}, [(0, 3)]), ({"__name__": "z", "l1": "x\0y", "l2": "z"}, [(0, 7)]),
    ]))
    assert points(engine.query("cpu", 1500), "ts_ms") == [('{__name__="cpu"}', 1000, 1.0)]
    assert points(engine.query("cpu", 10**9), "ts_ms") == [('{__name__="cpu"}', 3000, 3.0)]
    assert engine.query("cpu", 999).count() == 0
    assert [p[1:] for p in points(engine.query_range("cpu", 1000, 3000, 1000), "tick_ms")] == [(1000, 1.0), (2000, 1.0), (3000, 3.0)]
    assert points(engine.query("rate(total[60s])", 60000), "ts_ms") == [('{__name__="total"}', 60000, 1.0)]
    assert engine.query("rate(one[60s])", 60000).count() == 0
    assert points(engine.query("rate(reset[30s])", 30000), "ts_ms")[0][2] == round(-8 / 30, 9)
    assert points(engine.query("sum by (env)(req)", 1000), "ts_ms") == [('{env=""}', 1000, 7.0), ('{env="prod"}', 1000, 3.0)]
    assert engine.query('req{env=""}', 1000).count() == 0
    assert points(engine.query("twice", 10), "ts_ms")[0][2] == 999.0
    assert engine.query("sum by (l1,l2)(z)", 0).count() == 2
    assert engine.query("sum(nothing)", 0).count() == 0 and engine.query_range("sum(nothing)", 0, 10, 5).count() == 0
    assert engine.query("10/4", 7) == Scalar(7, 2.5)
    assert points(engine.query_range("1+1", 0, 10, 5), "tick_ms") == [("{}", 0, 2.0), ("{}", 5, 2.0), ("{}", 10, 2.0)]
    assert points(engine.query("sum by (x)(1)", 3), "ts_ms") == [('{x=""}', 3, 1.0)]
    for bad in ((5, 4, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            engine.query_range("cpu", *bad)


def test_ranges_against_brute_force(spark):
    rng = random.Random(5)
    rows = [({"__name__": "m", "i": str(i)}, [(rng.randrange(-50, 300), rng.randrange(100)) for _ in range(rng.randrange(0, 40))]) for i in range(6)]
    engine = MetricEngine(metrics(spark, rows))
    for start, end, step, w in ((0, 200, 7, 30), (-20, 250, 50, 10), (3, 3, 1, 400), (0, 100, 3, 3)):
        level, rate = [], []
        for labels, written in rows:
            last = dict(written)
            key = f'{{__name__="m", i="{labels["i"]}"}}'
            for t in range(start, end + 1, step):
                past = [x for x in last if x <= t]
                if past:
                    level.append((key, t, float(last[max(past)])))
                inside = [x for x in past if x >= t - w]
                if len(inside) > 1:
                    rate.append((key, t, round((last[max(inside)] - last[min(inside)]) / (w / 1000), 9)))
        assert points(engine.query_range("m", start, end, step), "tick_ms") == sorted(level)
        assert points(engine.query_range(f"rate(m[{w}ms])", start, end, step), "tick_ms") == sorted(rate)


S = 10**9


def test_small_log_fixtures(spark):
    api = {"service": "api"}
    engine = LogEngine(logs(spark, [(api, 100 * S, "a"), (api, 160 * S, "b"), (api, 200 * S, "c")]))
    assert points(engine.metric_range('count_over_time({service="api"}[60s])', 160 * S, 200 * S, 40 * S), "tick_ns") == [('{service="api"}', 160 * S, 1.0), ('{service="api"}', 200 * S, 2.0)]
    engine = LogEngine(logs(spark, [(api, 10 * S, "abc"), (api, 10 * S, "dé"), (api, 10 * S, "dé"), ({"service": "empty"}, 10 * S, "")]))
    for op, value in (("count_over_time", 2), ("bytes_over_time", 6), ("rate", 0.2), ("bytes_rate", 0.6)):
        assert points(engine.metric(op + '({service="api"}[10s])', 10 * S), "tick_ns")[0][2] == value
    assert points(engine.metric('bytes_over_time({service="empty"}[10s])', 10 * S), "tick_ns")[0][2] == 0.0
    rows = [({"service": "api", "level": "info"}, 10 * S, "x"), ({"service": "api", "level": "error"}, 10 * S, "x"), ({"service": "api", "level": ""}, 10 * S, "x"), ({"service": "api", "region": "eu"}, 10 * S, "x")]
    engine = LogEngine(logs(spark, rows))
    query = lambda t: [(p[0], p[2]) for p in points(engine.metric(t, 10 * S), "tick_ns")]
    assert query('sum by (level) (count_over_time({service="api"}[5s]))') == [('{level="error"}', 1.0), ('{level="info"}', 1.0), ("{}", 2.0)]
    assert query('sum(count_over_time({service="api"}[5s]))') == [("{}", 4.0)]
    assert query('sum without (level) (count_over_time({service="api"}[5s]))') == [('{region="eu", service="api"}', 1.0), ('{service="api"}', 3.0)]
    assert len(query('count_over_time({service="api"}[5s])')) == 4


def test_log_order_limit_and_drop(spark):
    rows = [({"stream": "a"}, 10, "a10"), ({"stream": "b"}, 20, "b20"), ({"stream": "a"}, 30, "a30"), ({"stream": "b"}, 40, "b40"), ({"stream": "a"}, 40, "tie"), ({"stream": "a"}, 50, "end")]
    rows = [({**labels, "app": "x"}, t, line) for labels, t, line in rows]
    engine = LogEngine(logs(spark, rows))
    lines = lambda f: [r["line"] for r in f.orderBy("ord").collect()]
    first = sorted(({"stream": s, "app": "x"} for s in "ab"), key=fingerprint)[0]["stream"]
    tied = ["b40", "tie"] if first == "b" else ["tie", "b40"]
    assert lines(engine.query_range('{app="x"}', 0, 50, 3)) == [*tied, "a30"]
    assert lines(engine.query_range('{app="x"}', 0, 50, 0, False)) == ["a10", "b20", "a30", *tied]
    assert lines(engine.query('{app="x"}', 50, 1)) == ["end"]
    merged = engine.query_range('{app="x"} | drop stream', 0, 51, 100, False).collect()
    assert {r["labels_key"] for r in merged} == {'{app="x"}'} and {r["group_ord"] for r in merged} == {1}
    assert lines(engine.query_range('{app="x"} |= "a" != "30"', 0, 50, 9, False)) == ["a10"]


def test_log_windows_against_brute_force(spark):
    rng = random.Random(6)
    base = 1_700_000_000 * S
    rows = [({"s": rng.choice("abc")}, base + rng.randrange(0, 400), rng.choice(["", "x", "yy", "é"])) for _ in range(120)]
    engine = LogEngine(logs(spark, rows))
    once = {(labels["s"], t, line) for labels, t, line in rows}
    for start, end, step, w in ((0, 400, 13, 40), (50, 300, 100, 7), (-30, 500, 5, 200), (0, 0, 1, 500)):
        text = f'{{s="a"}}[{w}ns]'
        want = []
        for t in range(base + start, base + end + 1, step):
            hit = [line for s, at, line in once if s == "a" and t - w < at <= t]
            if hit:
                want.append(('{s="a"}', t, float(sum(len(x.encode()) for x in hit)), float(len(hit))))
        assert points(engine.metric_range(f"bytes_over_time({text})", base + start, base + end, step), "tick_ns") == [x[:3] for x in want]
        assert points(engine.metric_range(f"count_over_time({text})", base + start, base + end, step), "tick_ns") == [(x[0], x[1], x[3]) for x in want]


def test_discovery(spark):
    data = metrics(spark, [({"__name__": "b", "x": "1"}, [(10, 1)]), ({"__name__": "a", "y": "2"}, [(20, 1)]), ({"__name__": "a", "x": "1"}, [(30, 1)]), ({"__name__": "a"}, [])])
    keys = lambda f: [r["labels_key"] for r in f.collect()]
    assert keys(discovery.ordered_series(discovery.chosen_series(data))) == ['{__name__="a"}', '{__name__="a", x="1"}', '{__name__="a", y="2"}', '{__name__="b", x="1"}']
    assert keys(discovery.ordered_series(discovery.chosen_series(data, ["b", '{y="2"}']))) == ['{__name__="a", y="2"}', '{__name__="b", x="1"}']
    assert keys(discovery.ordered_series(discovery.chosen_series(data, (), 20, 30))) == ['{__name__="a", x="1"}', '{__name__="a", y="2"}']
    assert [r[0] for r in discovery.label_names(data.series).collect()] == ["__name__", "x", "y"]
    assert [r[0] for r in discovery.label_values(data.series, "x").collect()] == ["1"] and discovery.label_values(data.series, "q").count() == 0
    assert tuple(discovery.cardinality(data.series).first()) == (4, 3, 4)
