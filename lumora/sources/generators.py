"""Synthetic metrics and logs of realistic shape, seeded and generated where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("api", "worker", "web")


def _noise(n: int, seed: int = 0):
    """0 to n - 1, from the high bits of one step of a linear congruential generator."""
    step = (F.pmod("id", F.lit(1 << 31)) * F.lit(1103515245) + F.lit(seed * 12345 + 12345)) % F.lit(1 << 31)
    return F.call_function("div", step, F.lit(1 << 16)) % F.lit(n)


def _pick(values: tuple[str, ...], seed: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_noise(len(values), seed) + 1).cast("int"))


def request_metrics(spark: SparkSession, rows: int, series: int = 100, step_ms: int = 1000, start_ms: int = 0, seed: int = 1) -> DataFrame:
    """labels, ts_ms, value, gen: counters ``http_requests_total{service, instance}``, round robin over series."""
    number = F.pmod("id", F.lit(series))
    turn = F.call_function("div", F.col("id"), F.lit(series))
    service = F.element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.pmod(number, F.lit(len(SERVICES))) + 1).cast("int"))
    labels = F.create_map(F.lit("__name__"), F.lit("http_requests_total"), F.lit("service"), service, F.lit("instance"), F.concat(F.lit("i-"), number.cast("string")))
    value = (turn * 10 + _noise(10, seed)).cast("double")
    return spark.range(rows).select(labels.alias("labels"), (F.lit(start_ms) + turn * step_ms).alias("ts_ms"), value.alias("value"), (F.col("id") + 1).alias("gen"))


def application_logs(spark: SparkSession, rows: int, step_ns: int = 250_000_000, start_ns: int = 1_700_000_000 * 10**9, seed: int = 1) -> DataFrame:
    """labels, ts_ns, line, seq: streams {service, level, env}, of which 80 % info, 12 % warn and 8 % error."""
    p = _noise(100, seed)
    level = F.when(p < 80, "info").when(p < 92, "warn").otherwise("error")
    labels = F.create_map(F.lit("service"), _pick(SERVICES[:2], seed + 1), F.lit("level"), level, F.lit("env"), F.lit("demo"))
    line = F.concat(level, F.lit(" request "), F.col("id").cast("string"), F.lit(" took "), _noise(500).cast("string"), F.lit(" ms"))
    return spark.range(rows).select(labels.alias("labels"), (F.lit(start_ns) + F.col("id") * step_ns).alias("ts_ns"), line.alias("line"), F.col("id").alias("seq"))
