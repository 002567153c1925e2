"""Named queries over the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.fingerprint import with_fingerprint
from lumora.operators import discovery
from lumora.operators.logs import LogEngine
from lumora.operators.maintenance import BlockStore, LogStore
from lumora.operators.metrics import MetricEngine, latest_writes
from lumora.operators.ticks import Ticks
from lumora.plans.logql import parse_constant
from lumora.sources import generators, ingest, tables
from lumora.sources.model import SERIES, valid_labels
from lumora.sources.shared import new_folder
from lumora.streaming import ingest as streaming

HOUR, DAY = 3_600_000, 86_400_000
START = 1_704_153_600_000  # 2024-01-02
END = START + 25 * DAY
STEP = 6 * HOUR
NS = 1_000_000
DOCS = 1_700_000_000 * 10**9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _label(name: str, alias: str | None = None) -> Column:
    return F.element_at("labels", name).alias(alias or name)


def _number(name: str = "value") -> Column:
    return F.round(name, 6).alias(name)


# --- SQL pieces

EV = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) * 1000 AS ts_ns, event_type, CAST(user_id AS VARCHAR) AS usr, value, 'user=' || user_id || ' ' || props AS line FROM events)"
CNT = f"{EV}, cnt AS (SELECT event_type, ts_ms, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, event_id) AS DOUBLE) AS value FROM ev), lww AS (SELECT event_type, ts_ms, arg_max(value, event_id) AS value FROM cnt GROUP BY ALL)"
GAUGE = f"{EV}, lww AS (SELECT event_type, usr, ts_ms, arg_max(value, event_id) AS value FROM ev GROUP BY ALL)"
TICKS = f"ticks AS (SELECT unnest(range({START}, {END} + 1, {STEP})) AS tick_ms)"


def _rate_sql(window: int) -> str:
    return f"rates AS (SELECT event_type, tick_ms, (arg_max(value, ts_ms) - arg_min(value, ts_ms)) / {window / 1000.0} AS value FROM ticks JOIN lww ON ts_ms BETWEEN tick_ms - {window} AND tick_ms GROUP BY ALL HAVING count(*) >= 2)"


# --- metric queries

@_query(f"WITH {GAUGE} SELECT event_type, usr, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM lww WHERE ts_ms <= {START + 9 * DAY} AND event_type = 'click' GROUP BY ALL")
def promql_instant_selector(spark, sf_dir):
    out = MetricEngine(tables.event_values(spark, sf_dir)).query('event_value{event_type="click"}', START + 9 * DAY)
    return out.select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query("SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE false")
def promql_absent_label(spark, sf_dir):
    out = MetricEngine(tables.event_counters(spark, sf_dir)).query('events_total{region=""}', END)
    return out.groupBy().agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {GAUGE}, {TICKS} SELECT usr, tick_ms, arg_max(value, ts_ms) AS value FROM ticks JOIN lww ON ts_ms <= tick_ms WHERE event_type = 'purchase' GROUP BY ALL")
def promql_range_selector(spark, sf_dir):
    out = MetricEngine(tables.event_values(spark, sf_dir)).query_range('event_value{event_type="purchase"}', START, END, STEP)
    return out.select(_label("user", "usr"), "tick_ms", "value")


@_query(f"WITH {CNT} SELECT event_type, CAST({START + DAY} AS BIGINT) AS ts_ms, round((arg_max(value, ts_ms) - arg_min(value, ts_ms)) / 86400.0, 6) AS value FROM lww WHERE ts_ms BETWEEN {START} AND {START + DAY} GROUP BY ALL HAVING count(*) >= 2")
def promql_rate_instant(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query("rate(events_total[1d])", START + DAY).select(_label("event_type"), "ts_ms", _number())


@_query(f"WITH {CNT}, {TICKS}, {_rate_sql(DAY)} SELECT event_type, tick_ms, round(value, 6) AS value FROM rates")
def promql_rate_range(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query_range("rate(events_total[1d])", START, END, STEP).select(_label("event_type"), "tick_ms", _number())


@_query(f"WITH {CNT}, {TICKS}, {_rate_sql(2 * HOUR)} SELECT event_type, tick_ms, round(value, 6) AS value FROM rates")
def promql_rate_range_gaps(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query_range("rate(events_total[2h])", START, END, STEP).select(_label("event_type"), "tick_ms", _number())


@_query(f"WITH {CNT}, {TICKS}, {_rate_sql(DAY)} SELECT event_type, tick_ms, round(sum(value), 6) AS value FROM rates GROUP BY ALL")
def promql_sum_by_rate_range(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query_range("sum by (event_type)(rate(events_total[1d]))", START, END, STEP).select(_label("event_type"), "tick_ms", _number())


@_query(f"WITH {GAUGE} SELECT CAST({END} AS BIGINT) AS ts_ms, round(sum(value), 4) AS value FROM (SELECT event_type, usr, arg_max(value, ts_ms) AS value FROM lww WHERE ts_ms <= {END} GROUP BY ALL) HAVING count(*) > 0")
def promql_sum_instant(spark, sf_dir):
    return MetricEngine(tables.event_values(spark, sf_dir)).query("sum(event_value)", END).select("ts_ms", F.round("value", 4).alias("value"))


@_query(f"WITH {GAUGE} SELECT event_type, '' AS region, CAST({END} AS BIGINT) AS ts_ms, round(sum(value), 4) AS value FROM (SELECT event_type, usr, arg_max(value, ts_ms) AS value FROM lww WHERE ts_ms <= {END} GROUP BY ALL) GROUP BY ALL")
def promql_sum_by_absent_label(spark, sf_dir):
    return MetricEngine(tables.event_values(spark, sf_dir)).query("sum by (event_type, region) (event_value)", END).select(_label("event_type"), _label("region"), "ts_ms", F.round("value", 4).alias("value"))


@_query(f"WITH {CNT}, {TICKS}, {_rate_sql(DAY)} SELECT tick_ms, round(sum(value) * 86400, 3) AS value FROM rates GROUP BY ALL")
def promql_nested_sum(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query_range("sum(sum by (event_type)(rate(events_total[1d])))", START, END, STEP).select("tick_ms", F.round(F.col("value") * 86400, 3).alias("value"))


@_query(f"WITH {TICKS} SELECT tick_ms, CAST(2.5 AS DOUBLE) AS value FROM ticks")
def promql_scalar_range(spark, sf_dir):
    return MetricEngine(tables.event_counters(spark, sf_dir)).query_range("10 / 4", START, END, STEP).select("tick_ms", "value")


@_query(f"SELECT CAST({END} AS BIGINT) AS ts_ms, CAST('Infinity' AS DOUBLE) AS value")
def promql_scalar_instant(spark, sf_dir):
    out = MetricEngine(tables.event_counters(spark, sf_dir)).query("1 / 0", END)
    return spark.createDataFrame([(out.ts_ms, out.value)], "ts_ms long, value double")


@_query(f"WITH {EV} SELECT event_type, usr, ts_ms // {HOUR} * {HOUR} AS ts_ms, arg_max(value, event_id) AS value FROM ev GROUP BY ALL")
def metric_last_write_wins(spark, sf_dir):
    data = tables.event_values(spark, sf_dir, rounded_ms=HOUR)
    return latest_writes(data.samples).join(data.series, "sid").select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query(f"WITH {EV} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ev WHERE ts_ms BETWEEN {START} AND {END} GROUP BY ALL")
def metric_time_range(spark, sf_dir):
    data = tables.event_values(spark, sf_dir)
    return data.samples.where(F.col("ts_ms").between(START, END)).join(data.series, "sid").groupBy(_label("event_type")).agg(F.count(F.lit(1)).alias("n"))


# --- log queries

def _found(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.select(*[_label(n) for n in labels], "ts_ns", "line", "ord", "group_ord")


def _log_sql(where: str, order: str, limit: int, group: str, columns: str) -> str:
    return f"WITH {EV}, pick AS (SELECT event_type AS level, 'events' AS service, ts_ns, line, row_number() OVER (ORDER BY ts_ns {order}) AS ord FROM (SELECT DISTINCT event_type, ts_ns, line FROM ev WHERE {where}) ORDER BY ts_ns {order} LIMIT {limit}) SELECT {columns}, ts_ns, line, ord, min(ord) OVER (PARTITION BY {group}) AS group_ord FROM pick"


@_query(_log_sql(f"ts_ns >= {START * NS} AND ts_ns < {END * NS}", "DESC", 500, "level", "level, service"))
def logql_range_backward(spark, sf_dir):
    return _found(LogEngine(tables.event_logs(spark, sf_dir)).query_range('{service="events"}', START * NS, END * NS, 500), "level", "service")


@_query(_log_sql(f"event_type = 'click' AND ts_ns >= {START * NS} AND ts_ns < {END * NS}", "ASC", 50, "level", "level, service"))
def logql_range_forward(spark, sf_dir):
    return _found(LogEngine(tables.event_logs(spark, sf_dir)).query_range('{service="events", level="click"}', START * NS, END * NS, 50, False), "level", "service")


@_query(_log_sql(f"ts_ns BETWEEN 0 AND {(START + 5 * DAY) * NS}", "DESC", 100, "level", "level, service"))
def logql_instant(spark, sf_dir):
    return _found(LogEngine(tables.event_logs(spark, sf_dir)).query('{service="events"}', (START + 5 * DAY) * NS), "level", "service")


@_query(_log_sql(f"ts_ns >= {START * NS} AND ts_ns < {END * NS}", "ASC", 200, "service", "service"))
def logql_drop_regroup(spark, sf_dir):
    return _found(LogEngine(tables.event_logs(spark, sf_dir)).query_range('{service="events"} | drop level', START * NS, END * NS, 200, False), "service")


@_query(_log_sql(f"contains(line, 'user=1') AND NOT contains(line, 'user=10') AND regexp_matches(line, 'user=[0-9]{{2,3}} ') AND NOT regexp_matches(line, '7 ')", "DESC", 300, "level", "level, service"))
def logql_line_filters(spark, sf_dir):
    text = '{service="events"} |= "user=1" != "user=10" |~ "user=[0-9]{2,3} " !~ `7 `'
    return _found(LogEngine(tables.event_logs(spark, sf_dir)).query_range(text, 0, (END + 100 * DAY) * NS, 300), "level", "service")


DOC = f"doc AS (SELECT lang, source, (doc_id + 1700000000) * 1000000000 AS ts_ns, text AS line FROM documents)"


@_query(f"WITH {DOC} SELECT lang, source, ts_ns, octet_length(encode(line)) AS bytes FROM doc WHERE lang = 'en' AND regexp_matches(line, '(?i)licen[sc]e.*\\.$') ORDER BY ts_ns DESC LIMIT 400")
def logql_regex_end_anchor(spark, sf_dir):
    out = LogEngine(tables.document_logs(spark, sf_dir)).query_range('{lang="en"} |~ "(?i)licen[sc]e.*\\\\.$"', DOCS, DOCS + 10**18, 400)
    return out.select(_label("lang"), _label("source"), "ts_ns", F.octet_length("line").cast("long").alias("bytes"))


@_query("SELECT role, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT role, (conv_id * 100 + turn + 1700000000) * 1000000000 AS t, text FROM conversations) GROUP BY role")
def log_dedup(spark, sf_dir):
    data = tables.conversation_logs(spark, sf_dir)
    twice = type(data)(data.streams, data.entries.unionByName(data.entries))
    rows = LogEngine(twice).query_range('{app="chat"}', DOCS, DOCS + 10**18, 0)
    return rows.groupBy(_label("role")).agg(F.count(F.lit(1)).alias("n"))


# --- log metrics

LOG_TICKS = f"ticks AS (SELECT unnest(range({START * NS}, {END * NS} + 1, {STEP * NS})) AS tick_ns)"


def _log_metric_sql(keys: str, value: str, window: int, where: str = "true") -> str:
    return f"WITH {EV}, once AS (SELECT DISTINCT event_type AS level, 'events' AS service, ts_ns, line FROM ev WHERE {where}), {LOG_TICKS} SELECT {keys}tick_ns, round({value}, 6) AS value FROM ticks JOIN once ON ts_ns > tick_ns - {window * NS} AND ts_ns <= tick_ns GROUP BY ALL"


def _log_metric(spark, sf_dir, text: str, *labels: str) -> DataFrame:
    rows = LogEngine(tables.event_logs(spark, sf_dir)).metric_range(text, START * NS, END * NS, STEP * NS)
    return rows.select(*[_label(n) for n in labels], "tick_ns", _number())


@_query(_log_metric_sql("level, service, ", "CAST(count(*) AS DOUBLE)", DAY))
def logql_count_over_time(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'count_over_time({service="events"}[1d])', "level", "service")


@_query(_log_metric_sql("level, service, ", "CAST(count(*) AS DOUBLE)", HOUR // 4))
def logql_count_over_time_gaps(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'count_over_time({service="events"}[15m])', "level", "service")


@_query(_log_metric_sql("level, service, ", "count(*) / 86400.0", DAY, "contains(line, '1')"))
def logql_rate(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'rate({service="events"} |= "1" [1d])', "level", "service")


@_query(_log_metric_sql("level, ", "CAST(sum(octet_length(encode(line))) AS DOUBLE)", 12 * HOUR))
def logql_bytes_over_time(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'sum by (level) (bytes_over_time({service="events"}[12h]))', "level")


@_query(_log_metric_sql("service, ", "sum(octet_length(encode(line))) / 43200.0", 12 * HOUR))
def logql_bytes_rate(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'sum without (level) (bytes_rate({service="events"}[12h]))', "service")


@_query(_log_metric_sql("", "CAST(count(*) AS DOUBLE)", DAY))
def logql_sum(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'sum(count_over_time({service="events"}[1d]))')


@_query(_log_metric_sql("service, ", "CAST(count(*) AS DOUBLE)", DAY))
def logql_drop_collision(spark, sf_dir):
    return _log_metric(spark, sf_dir, 'count_over_time({service="events"} | drop level [1d])', "service")


@_query(f"WITH {DOC} SELECT lang, CAST({DOCS + 10**18} AS BIGINT) AS tick_ns, CAST(sum(octet_length(encode(line))) AS DOUBLE) AS value FROM (SELECT DISTINCT * FROM doc) WHERE lang = 'fr' GROUP BY ALL")
def logql_metric_instant(spark, sf_dir):
    """A window that spans all ids of the table."""
    out = LogEngine(tables.document_logs(spark, sf_dir)).metric('sum by (lang) (bytes_over_time({lang="fr"}[1000000001s]))', DOCS + 10**18)
    return out.select(_label("lang"), "tick_ns", "value")


@_query("SELECT CAST(7 AS DOUBLE) AS value, true AS vector UNION ALL SELECT CAST(-6 AS DOUBLE), true UNION ALL SELECT CAST(2.5 AS DOUBLE), false")
def logql_constants(spark, sf_dir):
    found = [parse_constant(t) for t in ("vector(1)+vector(2)*vector(3)", "vector(2) * -vector(3)", "10/(1+3)")]
    return spark.createDataFrame([(c.value, c.vector) for c in found], "value double, vector boolean")


# --- discovery

@_query("SELECT DISTINCT 'event_value' AS name, event_type, CAST(user_id AS VARCHAR) AS usr FROM events WHERE event_type IN ('click', 'view') OR user_id = 7")
def discover_series(spark, sf_dir):
    found = discovery.chosen_series(tables.event_values(spark, sf_dir), ['event_value{event_type="click"}', '{event_type="view"}', 'event_value{user="7"}'])
    return discovery.ordered_series(found).select("name", _label("event_type"), _label("user", "usr"))


@_query(f"WITH {EV} SELECT DISTINCT event_type, usr FROM ev WHERE ts_ms BETWEEN {START} AND {START + DAY}")
def discover_active_series(spark, sf_dir):
    return discovery.chosen_series(tables.event_values(spark, sf_dir), (), START, START + DAY).select(_label("event_type"), _label("user", "usr"))


@_query("SELECT unnest(['__name__', 'event_type', 'user']) AS name")
def discover_label_names(spark, sf_dir):
    return discovery.label_names(tables.event_values(spark, sf_dir).series)


@_query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click'")
def discover_label_values(spark, sf_dir):
    return discovery.label_values(discovery.chosen_series(tables.event_values(spark, sf_dir), ['{event_type="click"}']), "user")


@_query("SELECT unnest(['lang', 'source']) AS name")
def discover_log_labels(spark, sf_dir):
    return discovery.label_names(tables.document_logs(spark, sf_dir).streams)


@_query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL")
def discover_log_label_values(spark, sf_dir):
    return discovery.label_values(tables.document_logs(spark, sf_dir).streams, "source")


@_query("SELECT CAST(count(DISTINCT (event_type, user_id)) AS BIGINT) AS series, CAST(3 AS BIGINT) AS label_names, CAST(1 + count(DISTINCT event_type) + count(DISTINCT user_id) AS BIGINT) AS label_pairs FROM events")
def discover_cardinality(spark, sf_dir):
    return discovery.cardinality(tables.event_values(spark, sf_dir).series)


# --- ingest and storage

def _entry(name: Column):
    return lambda m: F.struct(name.alias("name"), F.create_map(F.lit("event_type"), m["event_type"], F.lit("user"), F.col("user_id").cast("string")).alias("labels"), m["ms"].alias("timestamp_ms"), m["value"].alias("value"))


def _metric_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body for each day and user; users divisible by 50 send one with a metric name that is not allowed."""
    ms = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000))
    rows = tables.table(spark, sf_dir, "events").select("user_id", F.call_function("div", ms, F.lit(DAY)).alias("day"), F.struct("event_id", ms.alias("ms"), "event_type", "value").alias("m"))
    found = rows.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("m")).alias("all"))
    name = F.when(F.col("user_id") % 50 == 0, "0bad").otherwise("event_value")
    return found.select("day", F.to_json(F.struct(F.transform("all", _entry(name)).alias("metrics"))).alias("value"))


@_query(f"WITH {EV} SELECT event_type, usr, ts_ms, value FROM ev WHERE CAST(usr AS BIGINT) % 50 <> 0")
def ingest_metrics_json(spark, sf_dir):
    return ingest.metric_frame(_metric_bodies(spark, sf_dir)).select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query("SELECT role, (conv_id * 100 + turn + 1700000000) * 1000000000 AS ts_ns, text AS line FROM conversations WHERE conv_id % 10 <> 3")
def ingest_log_push(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations")
    ns = F.when(F.col("conv_id") % 10 == 3, F.lit("-5")).otherwise(((F.col("conv_id") * 100 + F.col("turn") + 1_700_000_000) * 10**9).cast("string"))
    bodies = rows.groupBy("conv_id").agg(F.collect_list(F.struct(F.create_map(F.lit("role"), F.col("role")).alias("stream"), F.array(F.array(ns, F.col("text"))).alias("values"))).alias("streams"))
    return ingest.log_frame(bodies.select(F.to_json(F.struct("streams")).alias("value"))).select(_label("role"), "ts_ns", "line")


@_query("SELECT CAST(count(*) FILTER (WHERE user_id % 3 = 0) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE user_id % 3 <> 0) AS BIGINT) AS bad FROM events")
def label_validation(spark, sf_dir):
    name = F.when(F.col("user_id") % 3 == 0, "ok_name").when(F.col("user_id") % 3 == 1, "__reserved").otherwise("1bad")
    ok = valid_labels(F.create_map(name, F.lit("v")), False)
    return tables.table(spark, sf_dir, "events").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


_FNV = """
WITH s AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS usr FROM events),
x AS (SELECT *, list_aggregate(list_transform(['__name__', 'event_value', 'event_type', event_type, 'user', usr], lambda p: lower(printf('%016x', octet_length(encode(p))) || hex(encode(p)))), 'string_agg', '') AS x FROM s),
b AS (SELECT *, list_transform(range(len(x) // 2), lambda i: CAST(CAST('0x' || substr(x, 2 * i + 1, 2) AS INT) AS HUGEINT)) AS b FROM x),
h AS (SELECT *, list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], b), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) AS h FROM b)
SELECT '{__name__="event_value", event_type="' || event_type || '", user="' || usr || '"}' AS labels_key, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS fingerprint FROM h
"""


@_query(_FNV)
def series_fingerprints(spark, sf_dir):
    return with_fingerprint(tables.event_values(spark, sf_dir).series).select("labels_key", "fingerprint")


#: Of the writes of an hour the last one counts: by body (the event's number modulo 3), then by place in it.
_REWRITTEN = f"WITH {EV} SELECT event_type, usr, ts_ms // {HOUR} * {HOUR} AS ts_ms, arg_max(value, (event_id % 3) * 1000000000000 + event_id) AS value FROM ev GROUP BY ALL"


def _rewriting_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of samples at full hours, with the order in which they are written."""
    ms = F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000))
    hour = F.call_function("div", ms, F.lit(HOUR)) * F.lit(HOUR)
    rows = tables.table(spark, sf_dir, "events").select("user_id", F.call_function("div", ms, F.lit(DAY)).alias("day"), (F.col("event_id") % 3).alias("turn"), F.struct("event_id", hour.alias("ms"), "event_type", "value").alias("m"))
    found = rows.groupBy("user_id", "day", "turn").agg(F.array_sort(F.collect_list("m")).alias("all"))
    return found.select("turn", F.to_json(F.struct(F.transform("all", _entry(F.lit("event_value"))).alias("metrics"))).alias("value"))


def _last_written(rows: DataFrame) -> DataFrame:
    samples = rows.select(F.xxhash64("labels_key").alias("sid"), _label("event_type"), _label("user", "usr"), "ts_ms", "value", "gen")
    return latest_writes(samples, "event_type", "usr").select("event_type", "usr", "ts_ms", "value")


@_query(_REWRITTEN)
def ingest_last_write_wins(spark, sf_dir):
    return _last_written(ingest.metric_frame(_rewriting_bodies(spark, sf_dir), gen=F.col("turn")))


@_query(_REWRITTEN)
def streaming_last_write_wins(spark, sf_dir):
    """Three batches, one after the other; within a batch, bodies by file and line."""
    folder = new_folder(spark, "rewrites")
    bodies = _rewriting_bodies(spark, sf_dir)
    for turn in range(3):
        bodies.where(F.col("turn") == turn).select("value").write.mode("append").text(f"{folder}/in")
        streaming.ingest(streaming.read_bodies(spark, f"{folder}/in"), "metrics", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _last_written(spark.read.parquet(f"{folder}/out"))


@_query("SELECT event_type AS level, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, epoch_us(ts) FROM events) GROUP BY ALL")
def streaming_dedup(spark, sf_dir):
    """Every event comes twice, in two batches; the delay spans all of them."""
    folder = new_folder(spark, "once")
    rows = tables.table(spark, sf_dir, "events").select("event_type", "user_id", "ts")
    read = lambda: spark.readStream.schema("event_type string, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = lambda: streaming.once(read(), "ts", "365 days", "event_type", "user_id", "ts").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        rows.select("event_type", "user_id", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("event_type").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[BlockStore, DataFrame]:
    data = tables.event_values(spark, sf_dir, rounded_ms=HOUR)
    store = BlockStore(spark, new_folder(spark, "blocks"))
    for part in range(3):  # three blocks of the same days, as late rows make them
        store.flush(data.samples.where(F.col("gen") % 3 == part))
    return store, data.series


_STORED_SQL = f"WITH {EV} SELECT event_type, usr, ts_ms // {HOUR} * {HOUR} AS ts_ms, arg_max(value, event_id) AS value FROM ev GROUP BY ALL"


@_query(_STORED_SQL)
def storage_flush_and_scan(spark, sf_dir):
    store, series = _stored(spark, sf_dir)
    return store.latest().join(series, "sid").select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query(_STORED_SQL)
def storage_compaction(spark, sf_dir):
    store, series = _stored(spark, sf_dir)
    store.maintain(0, ranges=[128 * HOUR, 40_000 * HOUR])
    return store.scan().join(series, "sid").select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query(f"WITH {EV} SELECT event_type, usr, CAST(count(*) AS BIGINT) AS n FROM ev WHERE ts_ms >= {START + 9 * DAY} GROUP BY ALL")
def storage_retention(spark, sf_dir):
    """Blocks of three spans of time: the first is too old, the second has a sample that is young enough. Label sets go with the blocks."""
    data = tables.event_values(spark, sf_dir)
    store = BlockStore(spark, new_folder(spark, "blocks"))
    for low, high in ((0, START + 9 * DAY), (START + 9 * DAY, START + 18 * DAY), (START + 18 * DAY, END + 400 * DAY)):
        store.flush(data.samples.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < high)), data.series)
    store.maintain(END, retention=14 * DAY)
    return store.scan().join(store.labels(SERIES), "sid").groupBy(_label("event_type"), _label("user", "usr")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {EV} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL")
def storage_manifest_rebuild(spark, sf_dir):
    """All manifest rows are lost and found again beside the data."""
    data = tables.event_values(spark, sf_dir)
    store = BlockStore(spark, new_folder(spark, "blocks"))
    for part in range(2):
        store.flush(data.samples.where(F.col("gen") % 2 == part), data.series)
    store._fs.delete(store._path(f"{store.root}/manifest"), True)
    store = BlockStore(spark, store.root)
    store.rebuild()
    return store.scan().join(store.labels(SERIES), "sid").groupBy(_label("event_type")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT 'events' AS service, event_type AS level, epoch_us(ts) * 1000 AS ts_ns, 'user=' || user_id || ' ' || props AS line FROM events")
def storage_log_blocks(spark, sf_dir):
    data = tables.event_logs(spark, sf_dir)
    store = LogStore(spark, new_folder(spark, "log-blocks"))
    store.flush(data.entries.where("seq % 2 = 0"))
    store.flush(data.entries.where("seq % 3 <> 0"))
    store.flush(data.entries.where("seq % 6 = 3"))
    return store.latest().join(data.streams, "stream_id").select(_label("service"), _label("level"), "ts_ns", "line")


@_query(f"WITH {EV} SELECT event_type, usr, ts_ms, value FROM ev WHERE CAST(usr AS BIGINT) % 50 <> 0")
def streaming_metric_ingest(spark, sf_dir):
    folder = new_folder(spark, "stream")
    _metric_bodies(spark, sf_dir).select("value").write.text(f"{folder}/in")
    streaming.ingest(streaming.read_bodies(spark, f"{folder}/in"), "metrics", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(_label("event_type"), _label("user", "usr"), "ts_ms", "value")


@_query(_log_metric_sql("level, ", "CAST(count(*) AS BIGINT)", DAY).replace("round(CAST(count(*) AS BIGINT), 6) AS value", "CAST(count(*) AS BIGINT) AS n").replace("SELECT DISTINCT event_type", "SELECT event_type"))
def streaming_window_counts(spark, sf_dir):
    """The plan of the continuous count, run over a finished table."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("level"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    return streaming.counts_by_window(rows, "level", DAY * NS, START * NS, END * NS, STEP * NS)


def _noise_sql(seed: int, n: int) -> str:
    return f"((i % 2147483648 * 1103515245 + {seed} * 12345 + 12345) % 2147483648 // 65536 % {n})"


@_query(f"SELECT 'i-' || i % 100 AS instance, ['api', 'worker', 'web'][i % 100 % 3 + 1] AS service, i // 100 * 1000 AS ts_ms, CAST(i // 100 * 10 + {_noise_sql(1, 10)} AS DOUBLE) AS value, i + 1 AS gen FROM (SELECT unnest(range(10000)) AS i)")
def generated_metrics(spark, sf_dir):
    return generators.request_metrics(spark, 10_000).select(_label("instance"), _label("service"), "ts_ms", "value", "gen")


@_query(f"WITH g AS (SELECT i, CASE WHEN {_noise_sql(1, 100)} < 80 THEN 'info' WHEN {_noise_sql(1, 100)} < 92 THEN 'warn' ELSE 'error' END AS level FROM (SELECT unnest(range(5000)) AS i)) SELECT level, ['api', 'worker'][{_noise_sql(2, 2)} + 1] AS service, 1700000000000000000 + i * 250000000 AS ts_ns, level || ' request ' || i || ' took ' || {_noise_sql(0, 500)} || ' ms' AS line FROM g")
def generated_logs(spark, sf_dir):
    return generators.application_logs(spark, 5_000).select(_label("level"), _label("service"), "ts_ns", "line")


@_query(f"WITH {TICKS} SELECT tick_ms FROM ticks")
def tick_table(spark, sf_dir):
    return Ticks(START, END, STEP).table(spark, "tick_ms")
