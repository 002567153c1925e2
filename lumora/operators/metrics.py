"""Metric queries as DataFrame plans.

A range query never meets a table of ticks. Samples are first reduced to the one that matters for the first
tick they can answer (a partial aggregate, so a shuffle carries a row for each series and tick at most),
which also settles repeated writes of a time; these few rows are then spread to the ticks up to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.ticks import Ticks, until_next
from lumora.plans.promql import Expr, Number, Rate, Select, Sum, parse
from lumora.sources.model import Metrics, labels_key


@dataclass(frozen=True)
class Scalar:
    ts_ms: int
    value: float


def matching(dimension: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows whose labels hold every pair; an absent label matches nothing, not even an empty value."""
    for name, value in pairs:
        column = F.col("name") if name == "__name__" and "name" in dimension.columns else F.element_at("labels", name)
        dimension = dimension.where(column == F.lit(value))
    return dimension


def latest_writes(samples: DataFrame, *same: str) -> DataFrame:
    """One value for each series and time: the last written. Columns ``same``, which are alike for all of a series, stay."""
    return samples.groupBy("sid", "ts_ms", *same).agg(F.max_by("value", "gen").alias("value"))


def _newest() -> Column:
    return F.max_by(F.struct("ts_ms", "value"), F.struct("ts_ms", "gen"))


def _oldest() -> Column:
    return F.min_by(F.struct("ts_ms", "value"), F.struct(F.col("ts_ms"), -F.col("gen")))


class MetricEngine:
    def __init__(self, data: Metrics):
        self.data = data
        self.spark: SparkSession = data.samples.sparkSession

    def query(self, text: str, ts_ms: int) -> DataFrame | Scalar:
        """At one time: labels, labels_key, ts_ms, value; a number gives a Scalar."""
        expr = parse(text)
        if isinstance(expr, Number):
            return Scalar(ts_ms, expr.value)
        out = self._instant(expr, ts_ms)
        return self._labelled(out, "ts_ms")

    def query_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """At every tick: labels, labels_key, tick_ms, value."""
        ticks = Ticks(start, end, step)
        out = self._range(parse(text), ticks)
        return self._labelled(out.withColumn("tick_ms", ticks.at(F.col("k"))), "tick_ms")

    @staticmethod
    def _labelled(rows: DataFrame, time: str) -> DataFrame:
        return rows.select("labels", labels_key(F.col("labels")).alias("labels_key"), time, "value")

    def _chosen(self, select: Select) -> tuple[DataFrame, DataFrame]:
        """Matching series and their samples. Only the ids meet the samples; labels are joined to results."""
        series = matching(self.data.series, select.pairs())
        return series, self.data.samples.join(series.select("sid"), "sid", "left_semi")

    # one time

    def _instant(self, expr: Expr, t: int) -> DataFrame:
        if isinstance(expr, Number):
            return self.spark.createDataFrame([({}, t, expr.value)], "labels map<string,string>, ts_ms long, value double")
        if isinstance(expr, Sum):
            return self._summed(self._instant(expr.inner, t), expr.by).withColumn("ts_ms", F.lit(t))
        if isinstance(expr, Rate):
            series, samples = self._chosen(expr.select)
            pair = samples.where(F.col("ts_ms").between(t - expr.window_ms, t)).groupBy("sid").agg(_oldest().alias("a"), _newest().alias("b")).where("a.ts_ms < b.ts_ms")
            rows = pair.select("sid", F.lit(t).alias("ts_ms"), _rate(F.col("a.value"), F.col("b.value"), expr.window_ms).alias("value"))
        else:
            series, samples = self._chosen(expr)
            rows = samples.where(F.col("ts_ms") <= t).groupBy("sid").agg(_newest().alias("b")).select("sid", "b.ts_ms", "b.value")
        return rows.join(series.select("sid", "labels"), "sid").select("labels", "ts_ms", "value")

    # ticks

    def _range(self, expr: Expr, ticks: Ticks) -> DataFrame:
        if isinstance(expr, Number):
            return self.spark.range(ticks.last + 1).select(F.expr("cast(map() as map<string, string>)").alias("labels"), F.col("id").alias("k"), F.lit(expr.value).alias("value"))
        if isinstance(expr, Sum):
            return self._summed(self._range(expr.inner, ticks), expr.by, "k")
        if isinstance(expr, Rate):
            series, samples = self._chosen(expr.select)
            w = expr.window_ms
            near = samples.where(F.col("ts_ms").between(ticks.start - w, ticks.end))
            last = self._last_at(near, ticks)
            first = near.withColumn("k", ticks.last_until(F.col("ts_ms"), w)).where("k >= 0").groupBy("sid", "k").agg(_oldest().alias("a"))
            first = until_next(first, ["sid"], "k", ticks.last, backward=True)
            both = last.join(first, ["sid", "k"]).where("a.ts_ms < b.ts_ms")
            rows = both.select("sid", "k", _rate(F.col("a.value"), F.col("b.value"), w).alias("value"))
        else:
            series, samples = self._chosen(expr)
            rows = self._last_at(samples.where(F.col("ts_ms") <= ticks.end), ticks).select("sid", "k", "b.value")
        return rows.join(series.select("sid", "labels"), "sid").select("labels", "k", "value")

    @staticmethod
    def _last_at(samples: DataFrame, ticks: Ticks) -> DataFrame:
        """The latest sample at or before every tick."""
        first = samples.withColumn("k", ticks.first_from(F.col("ts_ms"))).where(F.col("k") <= ticks.last)
        return until_next(first.groupBy("sid", "k").agg(_newest().alias("b")), ["sid"], "k", ticks.last)

    @staticmethod
    def _summed(rows: DataFrame, by: tuple[str, ...], *keys: str) -> DataFrame:
        """Groups by label values, absent ones as empty; nothing in, nothing out."""
        names = list(dict.fromkeys(by))
        made = {f"_by{i}": F.coalesce(F.element_at("labels", n), F.lit("")) for i, n in enumerate(names)}
        grouped = rows.select(*keys, "value", *[c.alias(n) for n, c in made.items()], F.lit(1).alias("_all")).groupBy("_all", *keys, *made).agg(F.sum("value").alias("value"))
        labels = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"_by{i}"))]) if names else F.expr("cast(map() as map<string, string>)")
        return grouped.select(labels.alias("labels"), *keys, "value")


def _rate(a: Column, b: Column, window_ms: int) -> Column:
    return (b - a) / F.lit(window_ms / 1000.0)
