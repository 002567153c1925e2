"""Plans that do each step once, so that the work grows no faster than the input."""

import json

from pyspark.sql import functions as F

from lumora import catalog
from lumora.operators.logs import LogEngine
from lumora.sources import ingest, tables
from lumora.streaming import ingest as streaming


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def metric_body(*rows):
    return json.dumps({"metrics": [{"name": "m", "labels": {"event_type": "a", "user": u}, "timestamp_ms": t, "value": v} for u, t, v in rows]})


def test_bodies_are_parsed_once(spark):
    bodies = spark.createDataFrame([("{}",)], "value string")
    for frame in (ingest.metric_frame(bodies), ingest.log_frame(bodies)):
        assert optimized(frame).count("parseJson") == 1


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), streaming.metric_frame

    def count(v):
        seen.add(1)
        return v

    monkeypatch.setattr(streaming, "metric_frame", lambda *a, **k: real(*a, **k).withColumn("value", F.udf(count, "double")("value")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(metric_body((str(u), 1, 1.0), (str(u), 86_400_001, 2.0)) for u in range(20)))
    streaming.ingest(streaming.read_bodies(spark, f"{tmp_path}/in"), "metrics", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40 and seen.value == 40


def test_last_writes_take_their_labels_along(spark):
    bodies = spark.createDataFrame([(0, metric_body(("1", 5, 1.0), ("2", 5, 2.0))), (1, metric_body(("1", 5, 3.0), ("1", 5, 4.0), ("1", 6, 5.0)))], "turn long, value string")
    last = catalog._last_written(ingest.metric_frame(bodies, gen=F.col("turn")))
    assert optimized(last).count("parseJson") == 1 and "Join" not in optimized(last)
    assert sorted(map(tuple, last.collect())) == [("a", "1", 5, 4.0), ("a", "1", 6, 5.0), ("a", "2", 5, 2.0)]


def test_entries_are_not_dealt_out_by_few_streams(spark):
    data = tables_with_unknown_size(spark)
    for frame in (LogEngine(data).query_range('{app="chat"}', 0, 10**9, 0), LogEngine(data).metric('count_over_time({app="chat"}[1s])', 10**9)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted((r["labels"]["role"], r["ts_ns"]) for r in LogEngine(data).query_range('{app="chat"}', 0, 10**9, 0).collect()) == [("a", 1), ("a", 3), ("b", 2)]


def tables_with_unknown_size(spark):
    """Streams of which Spark does not know that they are few, as with a dimension that is gathered from facts."""
    rows = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 2), ("a", 3, "z", 3)], "role string, ts_ns long, line string, seq long")
    rows = rows.union(rows).mapInArrow(lambda batches: batches, rows.schema)
    return tables._logs(rows, tables._labels(app=F.lit("chat"), role=F.col("role")), lambda d: d)
