"""Series, label names, label values and cardinality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.plans.promql import parse_selector
from lumora.sources.model import Metrics


def chosen_series(data: Metrics, match: Sequence[str] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """Series that match any of the selectors (all without one) and, with a bound, have a sample in start..end."""
    series = data.series.dropDuplicates(["sid"])
    if match:
        hit = F.lit(False)
        for text in match:
            ok = F.lit(True)
            for name, value in parse_selector(text).pairs():
                ok = ok & F.coalesce(F.element_at("labels", name) == F.lit(value), F.lit(False))
            hit = hit | ok
        series = series.where(hit)
    if start is not None or end is not None:
        active = data.samples
        active = active.where(F.col("ts_ms") >= start) if start is not None else active
        active = active.where(F.col("ts_ms") <= end) if end is not None else active
        series = series.join(active.select("sid"), "sid", "left_semi")
    return series


def ordered_series(series: DataFrame) -> DataFrame:
    """By metric name, then by the other pairs."""
    others = F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != "__name__")))
    return series.orderBy("name", others)


def label_names(dimension: DataFrame) -> DataFrame:
    return dimension.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def label_values(dimension: DataFrame, name: str) -> DataFrame:
    return dimension.select(F.element_at("labels", name).alias("value")).where("value is not null").distinct().orderBy("value")


def cardinality(dimension: DataFrame, key: str = "sid") -> DataFrame:
    """One row: series, label_names, label_pairs."""
    pairs = dimension.select(F.col(key).alias("_key"), F.explode_outer("labels").alias("k", "v"))
    return pairs.agg(F.countDistinct("_key").alias("series"), F.countDistinct("k").alias("label_names"), F.countDistinct("k", "v").alias("label_pairs"))
