import json
import os

import pytest
from pyspark.sql import functions as F

from lumora import api as surfaces
from lumora.api import LogApi, MetricApi, health, ready
from lumora.functions.errors import QueryError
from lumora.operators.head import LogHead, MetricHead
from lumora.operators.logs import LogEngine
from lumora.operators.maintenance import Block, BlockStore, FlushPolicy, LogStore, compaction_ranges, expired, plan_compaction
from lumora.operators.metrics import MetricEngine
from lumora.sources import ingest
from lumora.sources.model import SAMPLES
from lumora.streaming import ingest as streaming
from tests.test_engines import logs, metrics


def body(*rows):
    return json.dumps({"metrics": [{"name": n, "labels": labels, "timestamp_ms": t, "value": v} for n, labels, t, v in rows]}).encode()


SURROGATES = ("\\ud800", "\\ud83d\\ude00\\udc00", "\\udc00\\ud800", "\\\\\\ud800", "\\ud800\\\\udc00")


def good_metrics():
    return [
        (body(("m", {"a": "1"}, 5, 2.5), ("m", {"__name__": "other"}, 6, 1)), [('{__name__="m", a="1"}', 5, 2.5), ('{__name__="m"}', 6, 1.0)]),
        (b' {"metrics":[{"name":"n","labels":null,"timestamp_ms":-7,"value":1e3,"more":[1]}],"x":{}} \n', [('{__name__="n"}', -7, 1000.0)]),
        (b'{"metrics":[{"name":"n","labels":{"a":"\\ud83d\\ude00 \\\\ud800"},"timestamp_ms":9223372036854775807,"value":0.1}]}', [('{__name__="n", a="\U0001f600 \\\\ud800"}', 2**63 - 1, 0.1)]),
        (b'{"metrics":[{"name":"n","timestamp_ms":1,"value":1,"value":12345678901234567890123456789012345678901234567890}]}', [('{__name__="n"}', 1, 12345678901234567890123456789012345678901234567890.0)]),
    ]


def bad_metrics():
    one = lambda **x: json.dumps({"metrics": [{"name": "m", "timestamp_ms": 1, "value": 1} | x]}).encode()
    raw = lambda x: b'{"metrics":[{"name":"m","timestamp_ms":1,"value":' + x + b"}]}"
    good = one()
    return [
        body(), b"{}", b"x", b"[]", b"", b"null", body(("0m", {}, 1, 1)), body(("m", {"__x": "1"}, 1, 1)), body(("m", {}, None, 1)), body(("m", {}, 1, None)), b'{"metrics":[]} {}', b'{"metrics":{}}', b'{"metrics":[1]}', b'{"metrics":[null]}',
        good + b" {}", good + b"x", good + b"]", good + b',{"a":1}', b"\xef\xbb\xbf" + good, one(timestamp_ms=1.5), one(timestamp_ms=1.0), one(timestamp_ms="1"), one(timestamp_ms=True), one(timestamp_ms=2**63), one(value="1"), one(value=True), one(value=[]),
        one(labels={"a": 1}), one(labels={"a": None}), one(labels={"a": {"b": "c"}}), one(labels=[["a", "b"]]), one(labels=""), one(labels=0), one(labels={"1a": "x"}), one(labels={"a": "x" * 65_536}), one(labels={f"a{i}": "" for i in range(255)}), one(name=None), one(name=5), one(name=["m"]),
        raw(b"NaN"), raw(b"Infinity"), raw(b"-Infinity"), raw(b"1e400"), raw(b"1" * 400), raw(b"01"), raw(b"/**/1"), b"{'metrics':[]}", b"{" + b" " * (1 << 20) + b"}", b"[" * 100_000, body(("m", {}, 1, 1), ("0", {}, 1, 1)),
        *[b'{"metrics":[{"name":"m","labels":{"a":"' + x.encode() + b'"},"timestamp_ms":1,"value":1}]}' for x in SURROGATES],
    ]


def test_metric_bodies(spark):
    good, bad = good_metrics(), bad_metrics()
    for raw, want in good:
        assert [(t, v) for _, t, v in ingest.metric_rows(raw)] == [x[1:] for x in want]
    for raw in bad:
        with pytest.raises(ingest.IngestError):
            ingest.metric_rows(raw)
    with pytest.raises(ingest.IngestError):
        ingest.metric_rows(b'{"metrics":[{"name":"m\xff","timestamp_ms":1,"value":1}]}')
    frame = lambda raws: ingest.metric_frame(spark.createDataFrame([(x.decode(),) for x in raws], "value string"))
    for raw in bad:
        assert frame([raw]).collect() == [], raw[:80]
    got = frame([x for x, _ in good]).collect()
    assert sorted((r["labels_key"], r["ts_ms"], r["value"]) for r in got) == sorted(x for _, want in good for x in want)
    assert ingest.metric_frame(spark.createDataFrame([(b'{"metrics":[{"name":"m","labels":{"a":"\xff"},"timestamp_ms":1,"value":1}]}',)], "v binary").selectExpr("cast(v as string) AS value")).count() == 0
    with pytest.raises(ingest.IngestError) as e:
        ingest.metric_rows(body(("m", {}, 1, 1), ("0", {}, 1, 1), ("m", {}, None, 1)))
    assert [x["index"] for x in e.value.errors] == [1, 2]


def test_log_bodies(spark):
    push = lambda values, labels={"a": "b"}: json.dumps({"streams": [{"stream": labels, "values": values}]}).encode()  # noqa: E731, B006
    good = [(push([["5", "x"], ["+006", ""]]), [(5, "x"), (6, "")]), (push([]), []), (push(None), []), (b'{"streams":[{"stream":{"a":"b"},"values":[["00000000000000000000000000000009223372036854775807","\\ud83d\\ude00"]]},{"stream":{"c":""}}]}', [(2**63 - 1, "\U0001f600")])]
    for raw, want in good:
        assert [x[1:] for x in ingest.log_rows(raw, "application/json")] == want
    bad = [
        push([["0", "x"]]), push([["-1", "x"]]), push([["x", "x"]]), push([["1.0", "x"]]), push([[" 1", "x"]]), push([["1", None]]), push([[1, "x"]]), push([["1", 5]]), push([["1", "x", {}]]), push([["1"]]), push([["1", "x"]], {}), push([["1", "x"]], {"1": "x"}), push([["1", "x"]], {"a": 1}),
        push([["1", "x"]], None), push([["1", "x"]], [["a", "b"]]), push([["1", "x" * 262_145]]), push([["9" * 19, "x"]]), push({}), push(""), push(0), push(["1x"]), push([{"0": "1"}]), b'{"streams":[]}', b'{"streams":[5]}', b"", push([]) + b"{}", push([]) + b"]", push([["1", "x"], ["0", "y"]]),
        *[b'{"streams":[{"stream":{"a":"b"},"values":[["1","' + x.encode() + b'"]]}]}' for x in SURROGATES],
    ]
    for raw in [*bad, b"\xff"]:
        with pytest.raises(ingest.IngestError):
            ingest.log_rows(raw)
    with pytest.raises(ingest.IngestError):
        ingest.log_rows(good[0][0], "text/plain")
    frame = lambda raws: ingest.log_frame(spark.createDataFrame([(x.decode(),) for x in raws], "value string"))
    for raw in bad:
        assert frame([raw]).collect() == [], raw[:80]
    assert sorted((r["ts_ns"], r["line"]) for r in frame([x for x, _ in good]).collect()) == sorted(x for _, want in good for x in want)


def test_places_in_a_body_fit():
    # the shortest entries of the largest bodies
    assert ingest.METRIC_BODY // len('{"name":"m","timestamp_ms":1,"value":1},') < ingest.PLACES and ingest.LOG_BODY // len('["1",""],') < ingest.LOG_PLACES


def test_compaction_plan():
    blocks = [Block("a", 0, 40, 1), Block("b", 50, 90, 1), Block("c", 100, 390, 1)]
    assert [b.id for b in plan_compaction(blocks, [100, 400])] == ["a", "b"]
    assert [b.id for b in plan_compaction([Block("m", 0, 90, 2, 2), blocks[2]], [100, 400])] == ["m", "c"]
    assert plan_compaction([Block("x", -10, 10, 1), Block("y", -20, -10, 1)], [100]) == []
    assert compaction_ranges() == [7_200_000, 28_800_000, 115_200_000]
    for bad in ((0, 4, 3), (1, 1, 3), (1, 2, 0)):
        with pytest.raises(QueryError):
            compaction_ranges(*bad)
    assert [b.id for b in expired(blocks, 141, 100)] == ["a"] and expired(blocks, 10**9, 0) == []


def test_block_store(spark, tmp_path):
    store = BlockStore(spark, f"file://{tmp_path}/store")
    frame = lambda rows: spark.createDataFrame(rows, SAMPLES)
    assert store.flush(frame([])) is None and store.scan().count() == 0
    store.flush(frame([(1, 10, 1.0, 1), (1, 20, 2.0, 2)]))
    store.flush(frame([(1, 10, 5.0, 9), (2, 30, 3.0, 3)]))
    before = sorted(map(tuple, store.latest().collect()))
    store.maintain(0, ranges=[100])
    assert len(store.blocks()) == 1 and store.blocks()[0].level == 2 and store.blocks()[0].samples == 3
    assert sorted(map(tuple, store.latest().collect())) == before == [(1, 10, 5.0), (1, 20, 2.0), (2, 30, 3.0)]
    assert store.scan(15, 25).count() == 1 and store.scan(31).count() == 0
    store.maintain(1000, retention=10)
    assert store.blocks() == []
    with pytest.raises(QueryError):
        store.compact([])


def test_log_store(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/logs")
    for rows in ([(1, 5, "a", 1), (1, 5, "b", 2)], [(1, 5, "a", 3), (2, 9, "c", 4)]):
        store.flush(spark.createDataFrame(rows, LogStore.SCHEMA))
    assert sorted(map(tuple, store.latest().collect())) == [(1, 5, "a", 1), (1, 5, "b", 2), (2, 9, "c", 4)]
    assert store.scan(6, 9).count() == 1 and store.due(["x" * (8 << 20)]) and not store.due(["x"])
    for call in (lambda: store.compact([]), lambda: store.maintain(0)):
        with pytest.raises(QueryError):
            call()


def test_flush_policy():
    policy = FlushPolicy()
    assert not policy.due(119_999, 0, 5, 0) and policy.due(120_000, 0, 1, 0) and policy.due(0, 0, 1000, 0) and policy.due(0, 0, 0, 64 << 20) and not policy.due(10**9, 0, 0, 0)
    with pytest.raises(QueryError):
        FlushPolicy(chunks=0)
    assert health()[0] == 200


def test_stream_restarts_where_it_ended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: streaming.ingest(streaming.read_bodies(spark, f"{tmp_path}/in"), "metrics", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in" / "1.json").write_bytes(body(("m", {}, 1, 1.0)))
    run()
    (tmp_path / "in" / "2.json").write_bytes(body(("m", {}, 1, 2.0), ("m", {}, 86_400_001, 3.0)) + b"\n" + body(("0", {}, 1, 1)))
    run()
    run()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 3
    assert rows.groupBy("ts_ms").agg(F.max_by("value", "gen").alias("v")).where("ts_ms = 1").first()["v"] == 2.0


def test_batches_number_their_bodies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):  # eight bodies of one series and time, in four files
        (tmp_path / "in" / f"{k}.json").write_bytes(body(("m", {}, 1, 2 * k)) + b"\n" + body(("m", {}, 1, 2 * k + 1)))
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    streaming.ingest(streaming.read_bodies(spark, f"{tmp_path}/in"), "metrics", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r["value"] for r in sorted(rows, key=lambda r: r["gen"])] == [float(i) for i in range(8)]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda *rows: json.dumps({"streams": [{"stream": {"a": "b"}, "values": [[str(t), x] for t, x in rows]}]}).encode()
    (tmp_path / "in" / "1.json").write_bytes(line((5, "x"), (5, "y"), (5, "x")) + b"\n" + line((0, "bad")) + b"\n" + line((7, "z")))
    for _ in range(2):
        streaming.ingest(streaming.read_bodies(spark, f"{tmp_path}/in"), "logs", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["ts_ns"], r["line"]) for r in sorted(rows, key=lambda r: r["seq"])] == [(5, "x"), (5, "y"), (5, "x"), (7, "z")]


def test_continuous_counts(spark, tmp_path):
    schema = "level string, ts_ns long, at timestamp"
    rows = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", 7, 2), ("b", 30, 3)], "level string, ts_ns long, s int").selectExpr("level", "ts_ns", "timestamp_seconds(s) AS at")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = streaming.once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", "1 hour", "level", "ts_ns")
    query = streaming.counts_by_window(seen, "level", 5, 0, 20, 5).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == [("a", 5, 1), ("a", 10, 1)]


def test_metrics_are_stored_before_they_are_answered(spark, tmp_path):
    root = f"file://{tmp_path}/metrics"
    api = MetricApi(head=MetricHead(spark, root))
    ask = lambda a, q="m": {tuple(sorted(r["metric"].items())): r["value"][1] for r in a.query({"query": q, "time": "100"})[1]["data"]["result"]}
    assert api.ingest(body(("m", {"a": "1"}, 1000, 1), ("m", {"a": "2"}, 1000, 5)))[0] == 204
    assert api.ingest(body(("m", {"a": "1"}, 1000, 2), ("0", {}, 1, 1)))[0] == 400
    one, two = (("__name__", "m"), ("a", "1")), (("__name__", "m"), ("a", "2"))
    assert ask(api) == {one: "1", two: "5"}
    assert api.ingest(body(("m", {"a": "1"}, 1000, 3), ("m", {"a": "1"}, 1000, 4)))[0] == 204 and ask(api) == {one: "4", two: "5"}
    # a store that starts anew holds the same, and goes on counting
    again = MetricHead(spark, root)
    assert again.next == 3 and ask(MetricApi(head=again)) == {one: "4", two: "5"}
    again.maintain(again.last_flush + 1000)
    assert again.counters.done["flushes"] == 0 and len(again._bodies()) == 2
    again.maintain(again.last_flush + 120_000)
    api = MetricApi(head=again)
    assert again._bodies() == [] and len(again.blocks.blocks()) == 1 and ask(api) == {one: "4", two: "5"}
    assert api.ingest(body(("m", {"a": "1"}, 1000, 9)))[0] == 204 and MetricHead(spark, root).next == 4 and ask(api) == {one: "9", two: "5"}
    again.maintain(last=True)
    assert len(again.blocks.blocks()) == 1 and again.blocks.blocks()[0].level == 2 and ask(api) == {one: "9", two: "5"}
    text = api.self_metrics()
    assert "obs_flushes_total 2\n" in text and "obs_compactions_total 1\n" in text and "obs_blocks_total 1\n" in text and 'obs_maintenance_seconds_count{phase="flush"} 2\n' in text
    again.maintain(10**12, retention=1000)
    assert ask(api) == {} and api.series(["m"])[1]["data"] == [] and again.counters.done["blocks_retired"] == 1
    assert ready(again)[0] == 200


def test_a_flush_that_is_cut_short_is_repeated(spark, tmp_path):
    head = MetricHead(spark, f"file://{tmp_path}/m")
    head.append(body(("m", {}, 1, 1)))
    head.append(body(("m", {}, 1, 2)))
    series, samples = head._frames(head._held(head._bodies()))
    head.blocks.flush(samples, series)  # and then the process ends
    head = MetricHead(spark, f"file://{tmp_path}/m")
    assert head.next == 3
    head.maintain(last=True)
    data = head.data()
    assert head._bodies() == [] and data.series.count() == 1
    assert MetricEngine(data).query("m", 10).first()["value"] == 2.0


def test_logs_are_stored_before_they_are_answered(spark, tmp_path):
    head = LogHead(spark, f"file://{tmp_path}/logs")
    api = LogApi(head=head, now=lambda: 10**11)
    line = lambda *rows: json.dumps({"streams": [{"stream": {"a": "b"}, "values": [[str(t), x] for t, x in rows]}]}).encode()
    assert api.push(line((5 * 10**9, "x"), (6 * 10**9, "y")), "application/json")[0] == 204 and api.push(line((0, "x")))[0] == 400
    ask = lambda: api.query_range({"query": '{a="b"}', "start": "1", "end": "10", "direction": "forward"})[1]["data"]["result"]
    want = [{"stream": {"a": "b"}, "values": [[str(5 * 10**9), "x"], [str(6 * 10**9), "y"]]}]
    assert ask() == want
    head.maintain(last=True)
    assert head._bodies() == [] and ask() == want
    assert api.push(line((5 * 10**9, "x")))[0] == 204 and ask() == want  # repeated, across block and log
    assert api.labels()[1]["data"] == ["a"] and LogApi(head=LogHead(spark, f"file://{tmp_path}/logs"), now=lambda: 10**11).label_values("a")[1]["data"] == ["b"]


def test_failures_are_answers(spark, monkeypatch):
    class Broken:
        @property
        def data(self):
            raise OSError("the disk is gone")

        def query(self, *_):
            raise OSError("the disk is gone")

        probe = query

    broken = MetricApi(Broken())
    assert broken.query({"query": "m", "time": "1"}) == (500, {"status": "error", "errorType": "execution", "error": "the disk is gone"})
    assert broken.labels()[0] == 500 and LogApi(Broken()).labels() == (500, "the disk is gone") and LogApi(Broken()).query({"query": '{a="b"}', "time": "1"}) == (500, "the disk is gone")
    assert ready(Broken()) == (503, {"status": "unavailable", "error": "the disk is gone"})
    monkeypatch.setattr(surfaces, "MOST_ROWS", 1)
    api = MetricApi(MetricEngine(metrics(spark, [({"__name__": "m", "a": "1"}, [(1000, 99)]), ({"__name__": "m", "a": "2"}, [(1000, 99)])])))
    assert api.query({"query": "m", "time": "2"})[0] == 400 and api.query({"query": "sum(m)", "time": "2"})[0] == 200


def test_manifest_is_rebuilt(spark, tmp_path):
    store = BlockStore(spark, f"file://{tmp_path}/store")
    frame = lambda rows: spark.createDataFrame(rows, SAMPLES)
    blocks = [store.flush(frame([(1, 10, 1.0, 1)])), store.flush(frame([(1, 20, 2.0, 2)]))]
    store.spark.range(1).write.parquet(f"file://{tmp_path}/store/data/unfinished")
    store._drop(blocks[:1])
    (tmp_path / "store" / "manifest" / f"{blocks[1].id}.json").unlink()
    assert store.blocks() == [] and store.rebuild() == [blocks[1]] == store.blocks() and store.rebuild() == []
    store.check(blocks[1])
    with pytest.raises(RuntimeError):
        store.check(Block(blocks[1].id, 0, 20, 1))
    # a compaction that ended before its sources went
    third = store.flush(frame([(1, 30, 3.0, 3)]))
    made = store._write(store.scan(), 2, (blocks[1].id, third.id))
    store.maintain(0)
    assert store.blocks() == [made] and store.scan().count() == 2


def test_metric_api(spark):
    api = MetricApi(MetricEngine(metrics(spark, [({"__name__": "m", "a": "1"}, [(1000, 99), (3000, 2.5)])])))
    assert api.query({"query": "m", "time": "2"}) == (200, {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {"__name__": "m", "a": "1"}, "value": [1.0, "99"]}]}, "warnings": []})
    assert api.query({"query": "1/0", "time": "2"})[1]["data"] == {"resultType": "scalar", "result": [2.0, "+Inf"]}
    assert api.query({"query": "avg(m)", "time": "2"})[0] == 400 and api.query({"query": "m", "time": "x"})[1]["errorType"] == "bad_data"
    got = api.query_range({"query": "m", "start": "1", "end": "3", "step": "1s"})
    assert got[1]["data"]["result"] == [{"metric": {"__name__": "m", "a": "1"}, "values": [[1.0, "99"], [2.0, "99"], [3.0, "2.5"]]}]
    for bad in ({"query": "m", "start": "3", "end": "1", "step": "1"}, {"query": "m", "start": "1", "end": "3", "step": "0"}, {"query": "m", "start": "1", "end": "3"}):
        assert api.query_range(bad)[0] == 400
    assert api.series(["m"])[1]["data"] == [{"__name__": "m", "a": "1"}] and api.series([])[0] == 400
    assert api.labels()[1]["data"] == ["__name__", "a"] and api.label_values("a", ["m"], {"start": "10"})[1]["data"] == []
    assert "obs_active_series 1\n" in api.self_metrics() and api.ingest(body(("m", {}, 1, 1)))[0] == 500 and api.ingest(b"{}")[0] == 400
    assert api.query({"query": "(" * 5000 + "m" + ")" * 5000, "time": "2"})[0] == 400


def test_log_api(spark):
    s = 10**9
    api = LogApi(LogEngine(logs(spark, [({"a": "1"}, 5 * s, "one"), ({"a": "2"}, 6 * s, "two"), ({"a": "1"}, 7 * s, "three")])), now=lambda: 100 * s)
    got = api.query_range({"query": '{a="1"}', "start": "1", "end": "10", "direction": "forward"})
    assert got == (200, {"status": "success", "data": {"resultType": "streams", "result": [{"stream": {"a": "1"}, "values": [[str(5 * s), "one"], [str(7 * s), "three"]]}], "stats": {}}})
    got = api.query_range({"query": 'count_over_time({a="1"}[2s])', "start": "5", "end": "7", "step": "1"})
    assert got[1]["data"]["result"] == [{"metric": {"a": "1"}, "values": [[5.0, "1"], [6.0, "1"], [7.0, "1"]]}]
    assert api.query({"query": "vector(1)+1", "time": "5"})[1]["data"] == {"resultType": "vector", "result": [{"metric": {}, "value": [5.0, "2"]}], "stats": {}}
    assert api.query({"query": "1+1", "time": "5"})[1]["data"]["resultType"] == "scalar"
    for bad in ({"query": "vector(1)"}, {"query": '{a="1"}', "interval": "5s"}, {"query": '{a="1"}', "limit": "0"}, {"query": '{a="1"}', "direction": "up"}, {"query": '{a="1"}', "start": "10", "end": "5"}, {"query": "{}"}):
        assert api.query_range(bad)[0] == 400
    assert api.labels()[1]["data"] == ["a"] and api.label_values("a")[1]["data"] == ["1", "2"]
    assert api.push(b'{"streams":[{"stream":{"a":"b"},"values":[["1","x"]]}]}')[0] == 500 and api.push(b"{}")[0] == 400
