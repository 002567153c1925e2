"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target beyond whole passes is fitted
on these counts: each length first gives its proportional share, then a bounded-knapsack dynamic programme
over the lengths left closes the remaining budget. Which documents of a length are taken follows a seeded
hash, so reruns agree; hash ranges split a length that very many documents share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm import _text as T
from lumora.llm._shared import columns, small_batches, written

#: Budget in words that the dynamic programme closes.
REACH = 1 << 16
#: A plan (a row per source and length) of up to so many rows goes to every task; a larger one is joined by shuffle.
PLAN_ROWS = 200_000
#: Parts of a source and length in such a join, so that none is hot.
SALTS = 16


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source: by weight, but at most ``most`` times its size, what is over going to the others."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            total -= out[i]
            open_.remove(i)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take (0 to its count) for a sum close to ``budget``."""
    order = np.argsort(-lengths, kind="stable")
    length, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((length * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    take = np.array([int(c) * budget // total for c in count], np.int64)
    left, rest = count - take, budget - int((length * take).sum())
    for i, n in enumerate(length):
        if rest > REACH:
            more = min(int(left[i]), (rest - REACH) // int(n))
            take[i] += more
            left[i] -= more
            rest -= more * int(n)
    take += _knapsack(length, left, rest)
    out = np.zeros(len(lengths), np.int64)
    out[order] = take
    return out


def _knapsack(length: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: the reachable sum closest to ``rest``, the smaller of two as close."""
    # sums past twice the rest are no closer than none at all
    size = rest + 1 + min(rest, int(length[left > 0].max()) if (left > 0).any() else 0)
    reached, first = np.zeros(size, bool), np.full(size, -1, np.int32)
    reached[0] = True
    for i, n in enumerate(length):
        n = int(n)
        if reached[rest]:
            break
        if n >= size or not left[i]:
            continue
        new = reached.copy()
        for _ in range(int(left[i])):
            moved = np.zeros(size, bool)
            moved[n:] = new[: size - n]
            new = moved & ~reached
            if not new.any():
                break
            first[new] = i
            reached |= new
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    out = np.zeros(len(length), np.int64)
    while at:
        i = int(first[at])
        out[i] += 1
        at -= int(length[i])
    return out


def _plan(table: pa.Table) -> pa.Table:
    """Of one source: how many of each length to take beyond whole passes."""
    length, count = table["size"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(length)
    take = fit(length[order], count[order], table["budget"][0].as_py())
    return pa.table([table["key"].take(pa.array(order)), pa.array(length[order]), pa.array(take), table["passes"].take(pa.array(order))], ["key", "size", "take", "passes"])


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    """All columns of ``documents`` in ``_row``, with source, size, h and key."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("_row")) if documents.columns else documents
    rows = rows.select("_row", F.col("_row.source").cast("string").alias("source"), F.col("_row.text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.col("_row.doc_id").cast("string"), "source", "text"))

    def run(batches):
        for batch in batches:
            column = T.plain(batch.column(2))
            n = [np.diff(T.words(column.slice(a, b - a)).ptr) for a, b in T.slices(column)]
            size = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), batch.column(3)], ["_row", "source", "size", "h"])

    kind = rows.schema["_row"].dataType.simpleString()
    sized = rows.mapInArrow(run, f"_row {kind}, source string, size long, h long")
    return sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))


def _plans(small: DataFrame, weights, share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """By (key, size): passes and the last hash of one more; by key: size and target. ``small`` has key, size, h."""
    spark = small.sparkSession
    small = small.withColumn("slot", F.shiftright("h", 56))
    counts = written(small.groupBy("key", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    sums = [(r[0], int(r[1])) for r in counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    sums.sort(key=lambda x: (x[0] == "", x[0].encode("utf-8")))
    aims = targets([s for _, s in sums], [weights[i % len(weights)] for i in range(len(sums))], share, most)
    known = []
    for (key, size), aim in zip(sums, aims, strict=True):
        passes = min(most, int(aim // size)) if size else 0
        known.append((key, size, float(aim), passes, round(aim - passes * size) if passes < most else 0))
    known = written(spark.createDataFrame(known, "key string, source_size long, target double, passes long, budget long"), "mixing-sources")
    counts = counts.where("size > 0")
    plan = counts.groupBy("key", "size").agg(F.sum("n").alias("n")).join(known.select("key", "passes", "budget"), "key")
    plan = plan.groupBy("key").applyInArrow(_plan, "key string, size long, take long, passes long")
    # the range of hashes in which a length's last document lies, then the part of it: few rows are ranked, however many share a length
    first = _cut(counts.join(plan.where("take > 0").select("key", "size", F.col("take").alias("left")), ["key", "size"]), ["key", "size"], "slot")
    inside = small.join(first, ["key", "size", "slot"]).withColumn("part", F.shiftright("h", 40).bitwiseAND(0xFFFF))
    parts = inside.groupBy("key", "size", "slot", "part", "left").agg(F.count(F.lit(1)).alias("n"))
    second = _cut(parts, ["key", "size", "slot"], "part").withColumnRenamed("left", "here")
    ranked = inside.join(second, ["key", "size", "slot", "part"]).withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "slot", "part").orderBy("h")))
    last = ranked.where("rank = here").select("key", "size", F.col("h").alias("last"))
    return written(plan.select("key", "size", "passes").join(last, ["key", "size"], "left"), "mixing-plan"), known.select("key", "source_size", "target")


def _cut(counts: DataFrame, by: list[str], cell: str) -> DataFrame:
    """By ``by``: the cell in which the ``left``-th document lies, and how many of that cell's (``left``) that leaves."""
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.where("before < left and left <= before + n").select(*by, cell, (F.col("left") - F.col("before")).alias("left"))


def _decided(sized: DataFrame, plan: DataFrame) -> DataFrame:
    times = F.coalesce(F.col("passes") + F.when(F.col("h") <= F.col("last"), 1).otherwise(0), F.lit(0))
    if plan.count() <= PLAN_ROWS:
        return sized.join(F.broadcast(plan), ["key", "size"], "left").withColumn("times", times)
    salted = sized.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["key", "size", "salt"], "left").withColumn("times", times).drop("salt")


def mixture(documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """Per row of ``documents(doc_id, source, text)``: doc_id, source, size, source_size, target, taken.

    Size is a text's words (null text: 0). Sources by code point, null last, weigh ``weights``, repeating.
    ``taken`` is 0, size, and so on up to ``most`` times size. Rows of size 0 take nothing. Rows equal in id,
    source and text share a hash and are taken alike. Sources' totals are gathered on the driver: a row per
    source. Other columns are not read. Empty in, empty out.
    """
    sized = _sized(columns(documents, "doc_id", "source", "text"), seed)
    sized = written(sized.select(F.col("_row.doc_id").alias("doc_id"), "source", "size", "h", "key"), "mixing-sizes")
    plan, known = _plans(sized.select("key", "size", "h"), weights, share, most)
    out = _decided(sized, plan).join(known, "key")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed(documents: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """The mixture itself: the rows of ``documents`` with all their columns, each as often as it is taken.

    Rows without words (null and empty texts) are not taken; a null source is a source of its own; an empty
    table gives an empty one.
    """
    sized = _sized(documents, seed)
    small = written(sized.select("key", "size", "h"), "mixing-sizes")
    plan, _ = _plans(small, weights, share, most)
    taken = _decided(sized, plan).where("times > 0")
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
