"""Continuous ingest and continuous counts with Structured Streaming.

The checkpoint is the write-ahead log: a restarted query goes on after the last batch that was committed.
Rows of any age are accepted; what repeats is settled when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumora.operators.ticks import Ticks
from lumora.sources.ingest import log_frame, metric_frame


#: What orders bodies besides their place in a file.
_FILE = ("file_modification_time", "file_path", "file_block_start")
#: Bodies of a batch, more than any trigger takes in.
BODIES = 1 << 24


def read_bodies(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON bodies, one a line, with the file that each is from."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select("value", *[F.col(f"_metadata.{c}").alias(c) for c in _FILE])


def sorted_bodies(batch: DataFrame) -> DataFrame:
    """A finished batch by file time, file and place in the file, with column ``_id``: task and place in the task. It is kept until it is unpersisted."""
    files = [c for c in _FILE if c in batch.columns]
    rows = batch.withColumn("_read", F.monotonically_increasing_id()).orderBy(*files, "_read")
    return rows.drop("_read").withColumn("_id", F.monotonically_increasing_id()).persist()


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted bodies with column ``_body``: 0, 1, 2 ... over all tasks. The sizes of the tasks before are added to the place in a task."""
    sizes = {r[0]: r[1] for r in rows.groupBy(F.shiftright("_id", 33).alias("task")).count().collect()}
    if sum(sizes.values()) > BODIES:
        raise ValueError(f"a batch has more than {BODIES} bodies: lower files_per_batch")
    before, held = {}, 0
    for task in sorted(sizes):
        before[task] = held
        held += sizes[task]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in (before or {0: 0}).items() for x in pair]), F.shiftright("_id", 33))
    return rows.withColumn("_body", offset + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def _append(kind: str, out: str):
    def write(batch: DataFrame, number: int) -> None:
        order = F.lit(number).cast("long") * F.lit(BODIES) + F.col("_body")
        held, rows = sorted_bodies(batch), None
        try:
            if kind == "metrics":
                rows = metric_frame(numbered(held), gen=order)
                rows = rows.withColumn("day", F.call_function("div", F.col("ts_ms"), F.lit(86_400_000)))
            else:
                rows = log_frame(numbered(held), seq=order)
                rows = rows.withColumn("day", F.call_function("div", F.col("ts_ns"), F.lit(86_400 * 10**9)))
            # finding the ranges reads all rows before they are dealt out: they are kept, so that bodies are parsed once
            rows = rows.persist()
            # a batch that is repeated after a failure replaces its own folder
            rows.repartitionByRange("day", "labels_key").sortWithinPartitions("labels_key").write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={number}")
        finally:
            if rows is not None:
                rows.unpersist()
            held.unpersist()
    return write


def once(entries: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """A stream of entries without those that repeat ``keys`` within ``delay`` of event time.

    The state is bounded by the delay, so a repetition that comes later passes; queries settle repeated
    entries whenever they were written, and stay the authority.
    """
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest(bodies: DataFrame, kind: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes validated rows of ``kind`` metrics or logs to ``out``; ``once`` takes what is there and ends."""
    writer = bodies.writeStream.foreachBatch(_append(kind, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def counts_by_window(entries: DataFrame, labels_key: str, range_ns: int, start: int, end: int, step: int) -> DataFrame:
    """Entries in (tick - range, tick] by label set and tick, as a stream in update mode: labels_key, tick_ns, n."""
    ticks = Ticks(start, end, step)
    rows = entries.withColumn("_from", ticks.first_from(F.col("ts_ns"))).withColumn("_to", F.least(ticks.first_from(F.col("ts_ns"), range_ns) - 1, F.lit(ticks.last)))
    rows = rows.where("_from <= _to").withColumn("k", F.explode(F.sequence("_from", "_to")))
    return rows.groupBy(labels_key, ticks.at(F.col("k")).alias("tick_ns")).agg(F.count(F.lit(1)).alias("n"))
