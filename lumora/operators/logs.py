"""Log queries as DataFrame plans.

Selectors run on the stream dimension. A metric query turns entries into changes of running counts at the
ticks where they enter and leave the window, adds these up by output series and tick, and reads the counts
off by a running sum: its cost does not depend on how many windows an entry is in, and counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.durations import INT64_MIN
from lumora.functions.fingerprint import with_fingerprint
from lumora.operators.metrics import matching
from lumora.operators.ticks import Ticks, until_next
from lumora.plans.logql import BYTES, RANGE_OPS, LogMetric, LogSelect, parse_log, parse_metric
from lumora.sources.model import Logs, labels_key


def passes(line: Column, select: LogSelect) -> Column:
    """Whether a line passes all filters."""
    ok = F.lit(True)
    for f in select.filters:
        hit = line.rlike(f.java()) if "~" in f.op else line.contains(f.value)
        ok = ok & (~hit if f.op[0] == "!" else hit)
    return ok


def without(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*names)) if names else labels


def distinct_entries(entries: DataFrame) -> DataFrame:
    """A line of a stream and time once, with its first arrival."""
    return entries.groupBy("stream_id", "ts_ns", "line").agg(F.min("seq").alias("seq"))


#: Label sets, and bytes of them, that are sent to all executors at most.
SENT_SETS, SENT_BYTES = 200_000, 32 << 20


def beside(streams: DataFrame):
    """What a dimension goes through before it meets facts: few streams are sent to all executors, since facts that are dealt out by few ids lie in few tasks."""
    n, size = streams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("labels_key")), F.lit(0))).first()
    return F.broadcast if n <= SENT_SETS and size <= SENT_BYTES else lambda rows: rows


class LogEngine:
    def __init__(self, data: Logs):
        self.data = data

    def _chosen(self, select: LogSelect):
        """Matching streams, their entries, and how the streams meet these."""
        streams = matching(self.data.streams, select.matchers)
        sent = beside(streams)
        entries = self.data.entries.where(passes(F.col("line"), select))
        return streams, entries.join(sent(streams.select("stream_id")), "stream_id", "left_semi"), sent

    def query_range(self, text: str, start: int, end: int, limit: int = 100, backward: bool = True) -> DataFrame:
        """Entries with start <= time < end: labels, labels_key, ts_ns, line, ord, group_ord."""
        return self._entries(parse_log(text), (F.col("ts_ns") >= start) & (F.col("ts_ns") < end), limit, backward)

    def query(self, text: str, ts_ns: int, limit: int = 100, backward: bool = True) -> DataFrame:
        """Entries from time 0 to ts_ns, both included."""
        return self._entries(parse_log(text), F.col("ts_ns").between(0, ts_ns), limit, backward)

    def _entries(self, select: LogSelect, time: Column, limit: int, backward: bool) -> DataFrame:
        """Ordered by time, then unsigned stream identity, then arrival; streams that are alike after ``drop`` merge.

        ``ord`` numbers the entries in this order; ``group_ord`` is that of the first entry of its label set.
        A limit of 0 or less is none.
        """
        streams, entries, sent = self._chosen(select)
        streams = with_fingerprint(streams).withColumn("_rank", F.col("fingerprint").bitwiseXOR(F.lit(INT64_MIN)))
        near = entries.where(time)
        if limit > 0:
            near = self._nearest_times(near, limit, backward)
        rows = distinct_entries(near).join(sent(streams.select("stream_id", "_rank")), "stream_id")
        order = [F.desc("ts_ns") if backward else F.asc("ts_ns"), F.asc("_rank"), F.asc("seq")]
        if limit > 0:
            # at most ``limit`` rows are left to number
            rows = rows.orderBy(*order).limit(limit).withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))
        else:
            rows = rows.orderBy(*order).withColumn("ord", F.monotonically_increasing_id())
        named = streams.select("stream_id", without(F.col("labels"), select.drop).alias("labels"))
        named = named.withColumn("labels_key", labels_key(F.col("labels")))
        out = rows.join(sent(named), "stream_id")
        firsts = out.groupBy("labels_key").agg(F.min("ord").alias("group_ord"))
        return out.join(sent(firsts), "labels_key").select("labels", "labels_key", "ts_ns", "line", "ord", "group_ord")

    @staticmethod
    def _nearest_times(entries: DataFrame, limit: int, backward: bool) -> DataFrame:
        """The entries of the first ``limit`` different times: the first ``limit`` entries are among them, whatever repeats.

        Only times travel to find the last of these; lines are read again for what lies before it.
        """
        edge = entries.select("ts_ns").distinct().orderBy(F.desc("ts_ns") if backward else F.asc("ts_ns")).limit(limit)
        last = edge.agg(F.min("ts_ns") if backward else F.max("ts_ns")).first()[0]
        return entries.where(F.lit(False) if last is None else F.col("ts_ns") >= last if backward else F.col("ts_ns") <= last)

    def metric_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """At every tick whose window (tick - range, tick] has entries: labels, labels_key, tick_ns, value."""
        return self._metric(parse_metric(text), Ticks(start, end, step))

    def metric(self, text: str, ts_ns: int) -> DataFrame:
        return self._metric(parse_metric(text), Ticks(ts_ns, ts_ns, 1))

    def _metric(self, query: LogMetric, ticks: Ticks) -> DataFrame:
        what, by_second = RANGE_OPS[query.op]
        w = query.range_ns
        streams, entries, sent = self._chosen(query.select)
        low = max(INT64_MIN, ticks.start - w)
        near = entries.where((F.col("ts_ns") > low) & (F.col("ts_ns") <= ticks.end))
        # lines are told apart by 128 bits of hash, so that texts stay out of the shuffle
        once = near.groupBy("stream_id", "ts_ns", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.max(F.octet_length("line")).cast("long").alias("size"))
        enter = ticks.first_from(F.col("ts_ns"))
        leave = ticks.first_from(F.col("ts_ns"), w)
        change = F.array(F.struct(enter.alias("k"), F.lit(1).alias("sign")), F.struct(leave.alias("k"), F.lit(-1).alias("sign")))
        changes = once.select("stream_id", "size", F.explode(change).alias("c")).where(F.col("c.k") <= ticks.last)
        changes = changes.groupBy("stream_id", F.col("c.k").alias("k")).agg(F.sum(F.col("c.sign").cast("long")).alias("n"), F.sum(F.col("c.sign") * F.col("size")).alias("b"))
        named = streams.select("stream_id", self._output(F.col("labels"), query).alias("labels")).withColumn("labels_key", labels_key(F.col("labels")))
        grouped = changes.join(sent(named), "stream_id").groupBy("labels_key", "k").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("labels").alias("labels"))
        run = Window.partitionBy("labels_key").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = grouped.select("labels_key", "labels", "k", F.sum("n").over(run).alias("n"), F.sum("b").over(run).alias("b"))
        spread = until_next(held, ["labels_key"], "k", ticks.last).where("n > 0")
        value = F.col("b" if what == BYTES else "n").cast("double")
        return spread.select("labels", "labels_key", ticks.at(F.col("k")).alias("tick_ns"), (value * F.lit(1e9 / w) if by_second else value).alias("value"))

    @staticmethod
    def _output(labels: Column, query: LogMetric) -> Column:
        """The labels of the output series; ``sum`` leaves out empty values, which count as absent."""
        labels = without(labels, query.select.drop)
        if not query.sum:
            return labels
        if query.without:
            return F.map_filter(labels, lambda k, v: ~k.isin(*query.by) & (v != ""))
        if query.by:
            return F.map_filter(labels, lambda k, v: k.isin(*query.by) & (v != ""))
        return F.expr("cast(map() as map<string, string>)")
