"""Blocks of metric samples: flush, compaction, retention, and the plans that decide on them.

A block is a folder of Parquet files under the store's root with a row in the manifest. Data files are
written first, then a copy of the row beside them, and the manifest row by an atomic file of its own, so a
block is seen whole or not at all, and a lost manifest is rebuilt from the folders. A block may have a table
of its label sets, which goes when it goes: no series outlives its samples.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.errors import QueryError
from lumora.operators.logs import distinct_entries
from lumora.operators.metrics import latest_writes

HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Block:
    id: str
    min_ts: int
    max_ts: int
    samples: int
    level: int = 1
    sources: tuple[str, ...] = field(default=())


def compaction_ranges(base: int = 2 * HOUR_MS, multiplier: int = 4, levels: int = 3) -> list[int]:
    if base <= 0 or multiplier < 2 or levels < 1:
        raise QueryError("compaction needs a positive base, a multiplier of 2 or more, and a level")
    return [base * multiplier**i for i in range(levels)]


def plan_compaction(blocks: Iterable[Block], ranges: Sequence[int]) -> list[Block]:
    """The first group of two blocks or more that lie in one aligned window of the smallest range and are shorter than it."""
    ordered = sorted(blocks, key=lambda b: (b.min_ts, b.max_ts, b.id))
    for size in sorted(ranges):
        windows: dict[int, list[Block]] = {}
        for b in ordered:
            if b.max_ts - b.min_ts < size and b.min_ts // size == b.max_ts // size:
                windows.setdefault(b.min_ts // size, []).append(b)
        for key in sorted(windows):
            if len(windows[key]) > 1:
                return windows[key]
    return []


def expired(blocks: Iterable[Block], now: int, retention: int) -> list[Block]:
    """Blocks whose last sample is older than the retention; 0 keeps all."""
    return [b for b in blocks if retention > 0 and b.max_ts < now - retention]


@dataclass(frozen=True)
class FlushPolicy:
    """When the rows written since the last flush become a block: whichever bound is met first."""

    interval_ms: int = 120_000
    chunks: int = 1000
    log_bytes: int = 64 << 20

    def __post_init__(self):
        if min(self.interval_ms, self.chunks, self.log_bytes) <= 0:
            raise QueryError("a flush policy has positive bounds")

    def due(self, now: int, last_flush: int, chunks: int, log_bytes: int) -> bool:
        return chunks > 0 and (now - last_flush >= self.interval_ms or chunks >= self.chunks) or log_bytes >= self.log_bytes


class BlockStore:
    """Samples (sid, ts_ms, value, gen) in blocks under a root that all executors share."""

    KEY, TIME = "sid", "ts_ms"
    COLUMNS = ("sid", "ts_ms", "value", "gen")
    SCHEMA = "sid long, ts_ms long, value double, gen long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def blocks(self) -> list[Block]:
        out = []
        for status in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            name = status.getPath().getName()
            if name.endswith(".json"):
                data = json.loads(self._get(f"{self.root}/manifest/{name}"))
                out.append(Block(**data | {"sources": tuple(data["sources"])}))
        return sorted(out, key=lambda b: (b.min_ts, b.id))

    def _put(self, path: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        hidden = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(data))
        stream.close()
        if not self._fs.rename(hidden, self._path(path)):
            self._fs.delete(hidden, False)
            raise OSError(f"{path} could not be written")

    def _get(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _publish(self, block: Block) -> None:
        row = json.dumps(asdict(block)).encode()
        self._put(f"{self.root}/data/{block.id}/_block.json", row)
        self._put(f"{self.root}/manifest/{block.id}.json", row)

    def rebuild(self) -> list[Block]:
        """Restores the manifest rows that are lost from the blocks' folders; unfinished folders are no blocks."""
        known, found = {b.id for b in self.blocks()}, []
        for name in self._names("data"):
            if name not in known and self._fs.exists(self._path(f"{self.root}/data/{name}/_block.json")):
                row = json.loads(self._get(f"{self.root}/data/{name}/_block.json"))
                found.append(Block(**row | {"sources": tuple(row["sources"])}))
                self._put(f"{self.root}/manifest/{name}.json", json.dumps(row).encode())
        return found

    def check(self, block: Block) -> None:
        """Fails where a block's data are not what its manifest row says."""
        found = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/data/{block.id}").agg(F.min(self.TIME), F.max(self.TIME), F.count(F.lit(1))).first()
        if tuple(found) != (block.min_ts, block.max_ts, block.samples):
            raise RuntimeError(f"block {block.id} does not match its manifest row")

    def reconcile(self) -> None:
        """Drops blocks that a living block was made of: a compaction that ended between its two steps."""
        blocks = self.blocks()
        used = {s for b in blocks for s in b.sources}
        self._drop([b for b in blocks if b.id in used])

    def size(self) -> int:
        path = self._path(f"{self.root}/data")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def _write(self, samples: DataFrame, level: int, sources: tuple[str, ...], labels: DataFrame | None = None) -> Block | None:
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        samples.repartitionByRange(self.KEY, self.TIME).sortWithinPartitions(self.KEY, self.TIME).write.parquet(folder)
        written = self.spark.read.schema(self.SCHEMA).parquet(folder)
        low, high, n = written.agg(F.min(self.TIME), F.max(self.TIME), F.count(F.lit(1))).first()
        if not n:
            self._fs.delete(self._path(folder), True)
            return None
        if labels is not None:
            labels.join(written.select(self.KEY).distinct(), self.KEY, "left_semi").write.parquet(f"{self.root}/labels/{name}")
        block = Block(name, low, high, n, level, sources)
        self._publish(block)
        return block

    def labels(self, schema: str) -> DataFrame:
        """The label sets of all blocks, each once."""
        have = set(self._names("labels"))
        found = [f"{self.root}/labels/{b.id}" for b in self.blocks() if b.id in have]
        rows = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        return rows.dropDuplicates([self.KEY])

    def flush(self, samples: DataFrame, labels: DataFrame | None = None) -> Block | None:
        return self._write(samples.select(*self.COLUMNS), 1, (), labels)

    def scan(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows of all blocks that overlap start..end."""
        found = [b for b in self.blocks() if (end is None or b.min_ts <= end) and (start is None or b.max_ts >= start)]
        if not found:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/data/{b.id}" for b in found])
        rows = rows.where(F.col(self.TIME) >= start) if start is not None else rows
        return rows.where(F.col(self.TIME) <= end) if end is not None else rows

    def _drop(self, blocks: Iterable[Block]) -> None:
        for b in blocks:
            # the row beside the data goes before them, so that no rebuild finds what is left of a dropped block
            for path, deep in ((f"manifest/{b.id}.json", False), (f"data/{b.id}/_block.json", False), (f"data/{b.id}", True), (f"labels/{b.id}", True)):
                self._fs.delete(self._path(f"{self.root}/{path}"), deep)

    def compact(self, group: Sequence[Block]) -> Block:
        """One block for two or more: of each time the last write. The sources go once the result is published."""
        if len(group) < 2:
            raise QueryError("compaction takes two blocks or more")
        for b in group:
            self.check(b)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/data/{b.id}" for b in group])
        kept = rows.groupBy("sid", "ts_ms").agg(F.max_by("value", "gen").alias("value"), F.max("gen").alias("gen"))
        have = set(self._names("labels")) & {b.id for b in group}
        labels = self.spark.read.parquet(*[f"{self.root}/labels/{i}" for i in sorted(have)]).dropDuplicates([self.KEY]) if have else None
        made = self._write(kept, max(b.level for b in group) + 1, tuple(b.id for b in group), labels)
        merged = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/data/{made.id}").select("sid", "ts_ms", F.col("gen").alias("kept"))
        lost = rows.join(merged, ["sid", "ts_ms"], "left").where("kept is null or kept < gen").limit(1).count()
        if lost:
            self._drop([made])
            raise RuntimeError("a compacted block lacks samples of its sources")
        self._drop(group)
        return made

    def maintain(self, now: int, retention: int = 0, ranges: Sequence[int] | None = None) -> None:
        """Compacts until nothing is left to, then drops what is too old."""
        self.reconcile()
        while group := plan_compaction(self.blocks(), ranges or compaction_ranges()):
            self.compact(group)
        self._drop(expired(self.blocks(), now, retention))

    def latest(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return latest_writes(self.scan(start, end))


class LogStore(BlockStore):
    """Log entries in blocks. Logs are neither compacted nor dropped; entries written twice are settled when read."""

    KEY, TIME = "stream_id", "ts_ns"
    COLUMNS = ("stream_id", "ts_ns", "line", "seq")
    SCHEMA = "stream_id long, ts_ns long, line string, seq long"
    #: Bytes of times and lines at which the entries since the last flush become a block, and most of a block.
    FLUSH_BYTES, BLOCK_BYTES = 8 << 20, 128 << 20

    def due(self, lines: Iterable[str]) -> bool:
        return sum(8 + len(x.encode()) for x in lines) >= self.FLUSH_BYTES

    def flush(self, samples: DataFrame, labels: DataFrame | None = None) -> Block | None:
        """The last of the blocks made: entries of more than BLOCK_BYTES go to several, by stream."""
        size = samples.agg(F.sum(8 + F.octet_length("line"))).first()[0] or 0
        parts, last = max(1, -(-size // self.BLOCK_BYTES)), None
        for i in range(parts):
            part = samples if parts == 1 else samples.where(F.pmod(F.xxhash64("stream_id", "ts_ns"), F.lit(parts)) == i)
            last = self._write(part.select(*self.COLUMNS), 1, (), labels) or last
        return last

    def compact(self, group: Sequence[Block]) -> Block:
        raise QueryError("logs are not compacted")

    def maintain(self, now: int, retention: int = 0, ranges: Sequence[int] | None = None) -> None:
        raise QueryError("logs have no retention")

    def latest(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Each line of a stream and time once."""
        return distinct_entries(self.scan(start, end))
