"""The write path: bodies are stored before they are answered, and become blocks when a flush is due.

A body that passes its checks is written as a file of its own, whole or not at all, under the number that says
when it came; that is the write-ahead log. What is queried is the blocks and the bodies that no block holds
yet. A store that starts anew finds both. One writer at a time owns a store.
"""

from __future__ import annotations

import time
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.maintenance import BlockStore, FlushPolicy, LogStore, compaction_ranges, expired, plan_compaction
from lumora.sources import ingest
from lumora.sources.model import SERIES, STREAMS, Logs, Metrics

#: Bounds of the histogram of maintenance times, in seconds.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Counters:
    """What a store did since it started."""

    def __init__(self):
        self.done = {k: 0 for k in ("appended", "flushes", "compactions", "blocks_retired", "failures")}
        self.spent: dict[str, list] = {}

    def timed(self, what: str, seconds: float) -> None:
        row = self.spent.setdefault(what, [[0] * (len(SECONDS) + 1), 0.0])
        row[0][bisect_left(SECONDS, seconds)] += 1
        row[1] += seconds

    def text(self) -> str:
        """In the text exposition format."""
        out = "".join(f"# TYPE obs_{k}_total counter\nobs_{k}_total {v}\n" for k, v in self.done.items())
        if self.spent:
            out += "# TYPE obs_maintenance_seconds histogram\n"
        for what, (counts, total) in sorted(self.spent.items()):
            held = 0
            for bound, n in zip((*SECONDS, "+Inf"), counts, strict=True):
                held += n
                out += f'obs_maintenance_seconds_bucket{{phase="{what}",le="{bound}"}} {held}\n'
            out += f'obs_maintenance_seconds_sum{{phase="{what}"}} {total}\nobs_maintenance_seconds_count{{phase="{what}"}} {held}\n'
        return out


class _Head:
    """Bodies and blocks under a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, policy: FlushPolicy | None = None):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy or FlushPolicy()
        self.blocks = self.STORE(spark, f"{self.root}/blocks")
        self.blocks._fs.mkdirs(self.blocks._path(f"{self.root}/wal"))
        self.counters, self.last_flush = Counters(), int(time.time() * 1000)
        held = [int(n.split("-")[0]) for n in self._bodies()]
        self.next = max([0, *held, self._flushed()]) + 1

    def _bodies(self) -> list[str]:
        """Names (number-bytes.json) of the bodies in the log."""
        names = [s.getPath().getName() for s in self.blocks._fs.listStatus(self.blocks._path(f"{self.root}/wal"))]
        return sorted(n for n in names if n.endswith(".json"))

    def _flushed(self) -> int:
        """The number up to which bodies are in blocks; a body of such a number is left over from a flush."""
        return max([0, *(int(n.split("-")[1].split(".")[0]) for n in self._marks())])

    def _marks(self) -> list[str]:
        names = [s.getPath().getName() for s in self.blocks._fs.listStatus(self.blocks._path(self.root))]
        return [n for n in names if n.startswith("flushed-") and n.endswith(".json")]

    def append(self, raw: bytes, content_type: str | None = None) -> int:
        """Checks and stores a body; the number of its rows. IngestError if it is rejected, and nothing is stored."""
        rows = self.rows(raw, content_type)
        if rows:
            self.blocks._put(f"{self.root}/wal/{self.next:012d}-{len(raw)}.json", raw)
            self.next += 1
            self.counters.done["appended"] += len(rows)
        return len(rows)

    def probe(self) -> None:
        """Fails where the store cannot be written."""
        self.blocks._put(f"{self.root}/probe", b"")
        self.blocks._fs.delete(self.blocks._path(f"{self.root}/probe"), False)

    def _held(self, names: list[str]) -> DataFrame | None:
        if not names:
            return None
        bodies = self.spark.read.text([f"{self.root}/wal/{n}" for n in names], wholetext=True)
        return bodies.select("value", F.regexp_extract("_metadata.file_name", "^([0-9]+)", 1).cast("long").alias("_number"))

    def flush(self) -> bool:
        """Makes a block of all bodies in the log. A flush that is cut short is repeated: rows are told apart by their write order."""
        number = lambda name: int(name.split("-")[0])
        done = self._flushed()
        names = [n for n in self._bodies() if number(n) > done]
        if names:
            dimension, facts = self._frames(self._held(names))
            self.blocks.flush(facts, dimension)
            old, done = self._marks(), number(names[-1])
            self.blocks._put(f"{self.root}/flushed-{done:012d}.json", b"")
            for n in old:  # there is a mark at any time, so numbers never start anew
                self.blocks._fs.delete(self.blocks._path(f"{self.root}/{n}"), False)
            self.counters.done["flushes"] += 1
        for n in self._bodies():
            if number(n) <= done:
                self.blocks._fs.delete(self.blocks._path(f"{self.root}/wal/{n}"), False)
        return bool(names)

    def maintain(self, now: int | None = None, retention: int = 0, last: bool = False) -> None:
        """One round: a flush if it is due (or ``last``), then what the blocks need. A round that fails is counted, and the next one tries again."""
        now = int(time.time() * 1000) if now is None else now
        names = self._bodies()
        size = sum(int(n.split("-")[1].split(".")[0]) for n in names)
        if names and (last or self.policy.due(now, self.last_flush, len(names), size)):
            self._timed("flush", self.flush)
            self.last_flush = now
        self._rounds(now, retention)

    def _rounds(self, now: int, retention: int) -> None:
        pass

    def _timed(self, what: str, work) -> None:
        began = time.perf_counter()
        try:
            work()
        except Exception:
            self.counters.done["failures"] += 1
            raise
        finally:
            self.counters.timed(what, time.perf_counter() - began)


class MetricHead(_Head):
    STORE = BlockStore

    @staticmethod
    def rows(raw: bytes, content_type: str | None = None) -> list:
        return ingest.metric_rows(raw)

    @staticmethod
    def _frames(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = ingest.metric_frame(bodies, gen=F.col("_number")).withColumn("sid", F.xxhash64("labels_key"))
        series = rows.select("sid", F.element_at("labels", "__name__").alias("name"), "labels", "labels_key").dropDuplicates(["sid"])
        return series, rows.select("sid", "ts_ms", "value", "gen")

    def data(self) -> Metrics:
        """Series and samples of all that was stored."""
        series, samples = self.blocks.labels(SERIES), self.blocks.scan()
        if held := self._held(self._bodies()):
            more, facts = self._frames(held)
            series, samples = series.unionByName(more).dropDuplicates(["sid"]), samples.unionByName(facts)
        return Metrics(series, samples)

    def _rounds(self, now: int, retention: int) -> None:
        self.blocks.reconcile()
        while group := plan_compaction(self.blocks.blocks(), compaction_ranges()):
            self._timed("compaction", lambda group=group: self.blocks.compact(group))
            self.counters.done["compactions"] += 1
        if old := expired(self.blocks.blocks(), now, retention):
            self._timed("retention", lambda: self.blocks._drop(old))
            self.counters.done["blocks_retired"] += len(old)


class LogHead(_Head):
    STORE = LogStore

    @staticmethod
    def rows(raw: bytes, content_type: str | None = None) -> list:
        return ingest.log_rows(raw, content_type)

    @staticmethod
    def _frames(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = ingest.log_frame(bodies, seq=F.col("_number")).withColumn("stream_id", F.xxhash64("labels_key"))
        return rows.select("stream_id", "labels", "labels_key").dropDuplicates(["stream_id"]), rows.select("stream_id", "ts_ns", "line", "seq")

    def data(self) -> Logs:
        """Streams and entries of all that was stored; entries stored twice are settled by queries."""
        streams, entries = self.blocks.labels(STREAMS), self.blocks.scan()
        if held := self._held(self._bodies()):
            more, facts = self._frames(held)
            streams, entries = streams.unionByName(more).dropDuplicates(["stream_id"]), entries.unionByName(facts)
        return Logs(streams, entries)
