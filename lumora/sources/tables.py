"""Metrics and logs out of the star-schema test tables.

Ids are hashes of the rendered label set, computed alike for dimension and facts, so building either needs
no join. A dimension is gathered from its table once and kept while the session lasts and the table stays as
it is: it is small, and every query needs it. Label values in these tables are plain words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.sources.model import Logs, Metrics, labels_key

SECOND = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_dimensions: dict[tuple, DataFrame] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, kind: str, made: DataFrame) -> DataFrame:
    """``made``, a dimension of a table, or the one that was made before from the same files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    about = fs.getContentSummary(path)
    key = (spark.sparkContext.applicationId, str(path), kind, about.getLength(), about.getFileCount(), fs.getFileStatus(path).getModificationTime())
    if key not in _dimensions:
        for old in [k for k in _dimensions if k[0] != key[0] or k[1:3] == key[1:3]]:
            gone = _dimensions.pop(old)
            if old[0] == key[0]:
                gone.unpersist()
        _dimensions[key] = made.persist()
    return _dimensions[key]


def _labels(**pairs: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def _metrics(rows: DataFrame, labels: Column, keep) -> Metrics:
    """rows: ts_ms, value, gen and what the labels need; ``keep`` keeps the dimension."""
    rows = rows.withColumn("labels", labels)
    rows = rows.withColumn("labels_key", labels_key(F.col("labels"))).withColumn("sid", F.xxhash64("labels_key"))
    series = rows.groupBy("sid", "labels_key").agg(F.first("labels").alias("labels"))
    return Metrics(keep(series.select("sid", F.element_at("labels", "__name__").alias("name"), "labels", "labels_key")), rows.select("sid", "ts_ms", "value", "gen"))


def _logs(rows: DataFrame, labels: Column, keep) -> Logs:
    """rows: ts_ns, line, seq and what the labels need; ``keep`` keeps the dimension."""
    rows = rows.withColumn("labels", labels)
    rows = rows.withColumn("labels_key", labels_key(F.col("labels"))).withColumn("stream_id", F.xxhash64("labels_key"))
    streams = rows.groupBy("stream_id", "labels_key").agg(F.first("labels").alias("labels"))
    return Logs(keep(streams.select("stream_id", "labels", "labels_key")), rows.select("stream_id", "ts_ns", "line", "seq"))


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _millis() -> Column:
    return F.call_function("div", _micros(), F.lit(1000))


def event_values(spark: SparkSession, sf_dir: str, rounded_ms: int = 1) -> Metrics:
    """Gauge ``event_value{event_type, user}``; rounded times make repeated writes."""
    ts = F.call_function("div", _millis(), F.lit(rounded_ms)) * F.lit(rounded_ms)
    rows = table(spark, sf_dir, "events").select(ts.alias("ts_ms"), "value", F.col("event_id").alias("gen"), "event_type", F.col("user_id").cast("string").alias("user"))
    return _metrics(rows, _labels(__name__=F.lit("event_value"), event_type=F.col("event_type"), user=F.col("user")), lambda d: _kept(spark, sf_dir, "events", "values", d))


def event_counters(spark: SparkSession, sf_dir: str) -> Metrics:
    """Counter ``events_total{event_type}``."""
    count = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("double")
    rows = table(spark, sf_dir, "events").select(_millis().alias("ts_ms"), count.alias("value"), F.col("event_id").alias("gen"), "event_type")
    return _metrics(rows, _labels(__name__=F.lit("events_total"), event_type=F.col("event_type")), lambda d: _kept(spark, sf_dir, "events", "counters", d))


def event_logs(spark: SparkSession, sf_dir: str) -> Logs:
    rows = table(spark, sf_dir, "events").select((_micros() * 1000).alias("ts_ns"), F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" "), F.col("props")).alias("line"), F.col("event_id").alias("seq"), "event_type")
    return _logs(rows, _labels(service=F.lit("events"), level=F.col("event_type")), lambda d: _kept(spark, sf_dir, "events", "logs", d))


def document_logs(spark: SparkSession, sf_dir: str) -> Logs:
    rows = table(spark, sf_dir, "documents").select(((F.col("doc_id") + 1_700_000_000) * SECOND).alias("ts_ns"), F.col("text").alias("line"), F.col("doc_id").alias("seq"), "lang", "source")
    return _logs(rows, _labels(lang=F.col("lang"), source=F.col("source")), lambda d: _kept(spark, sf_dir, "documents", "logs", d))


def conversation_logs(spark: SparkSession, sf_dir: str) -> Logs:
    rows = table(spark, sf_dir, "conversations").select(((F.col("conv_id") * 100 + F.col("turn") + 1_700_000_000) * SECOND).alias("ts_ns"), F.col("text").alias("line"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "role")
    return _logs(rows, _labels(app=F.lit("chat"), role=F.col("role")), lambda d: _kept(spark, sf_dir, "conversations", "logs", d))
