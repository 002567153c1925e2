"""Ticks ``start, start + step, ... <= end`` and integer arithmetic on them.

All columns are BIGINT and all divisions exact: epoch nanoseconds do not fit a double.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.durations import INT64_MAX, INT64_MIN
from lumora.functions.errors import QueryError


@dataclass(frozen=True)
class Ticks:
    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0:
            raise QueryError("step must be above 0")
        if self.end < self.start:
            raise QueryError("end lies before start")

    @property
    def last(self) -> int:
        """Number of the last tick; the first is 0."""
        return (self.end - self.start) // self.step

    def at(self, k: Column) -> Column:
        return F.lit(self.start) + k * F.lit(self.step)

    def first_from(self, ts: Column, shift: int = 0) -> Column:
        """Number of the first tick at or after ``ts + shift``, 0 at least, last + 1 at most."""
        # compared against ts itself, so that no sum leaves the 64-bit range
        low, high = _clamp(self.start - shift), _clamp(self.start + self.last * self.step - shift)
        d = ts - F.lit(low)
        return F.when(ts <= low, F.lit(0)).when(ts > high, F.lit(self.last + 1)).otherwise(_div(d + F.pmod(-d, F.lit(self.step)), self.step)).cast("long")

    def last_until(self, ts: Column, shift: int = 0) -> Column:
        """Number of the last tick at or before ``ts + shift``, -1 if none, last at most."""
        low, high = _clamp(self.start - shift), _clamp(self.start + self.last * self.step - shift)
        d = ts - F.lit(low)
        return F.when(ts < low, F.lit(-1)).when(ts >= high, F.lit(self.last)).otherwise(_div(d - F.pmod(d, F.lit(self.step)), self.step)).cast("long")

    def table(self, spark: SparkSession, name: str = "tick") -> DataFrame:
        return spark.range(self.last + 1).select(self.at(F.col("id")).alias(name))


def _clamp(x: int) -> int:
    return max(INT64_MIN, min(INT64_MAX, x))


def _div(x: Column, by: int) -> Column:
    """Integer division of a multiple."""
    return F.call_function("div", x, F.lit(by))


def until_next(rows: DataFrame, key: list[str], k: str, last: int, backward: bool = False) -> DataFrame:
    """Spreads a row over the ticks that it answers: from its own to before the key's next one, or after its previous one to its own."""
    order = Window.partitionBy(*key).orderBy(k)
    if backward:
        low, high = F.coalesce(F.lag(k).over(order) + 1, F.lit(0)), F.col(k)
    else:
        low, high = F.col(k), F.coalesce(F.lead(k).over(order) - 1, F.lit(last))
    rows = rows.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    return rows.withColumn(k, F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
