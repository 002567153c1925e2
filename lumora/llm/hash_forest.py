"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a string of 64 sign bits of random projections and holds the strings of a block of
vectors in a sorted array. A query descends every tree to its longest prefix match by binary search, then all
trees ascend together, a bit at a time, each step taking in the longer ranges of shorter prefixes, until the
ranges hold enough candidates and enough different ones. Candidates are ranked by their exact inner product in double precision.

Vectors are dealt in blocks once and written; a block's forest is built, searched and dropped within a task.
Queries go to the tasks in portions of a bounded size. A portion is one pass over the written blocks, without
a shuffle of vectors; a task keeps each query's best of its blocks, and those of all tasks are merged by a
grouped top-k.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm._shared import columns, written

U64 = np.uint64
TREES, BITS, SEED = 40, 64, 5
#: Share of a block that a query's ranges hold, and least number, before the ascent ends (repeats counted).
SHARE, LEAST = 1.1, 400
BLOCK_ROWS = 8192
#: Query vectors in one portion.
PORTION_BYTES = 32 << 20


def projections(size: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((size, trees * bits))


def strings(x: np.ndarray, planes: np.ndarray, trees: int, bits: int = BITS) -> np.ndarray:
    """Hash strings (trees x rows) as unsigned numbers, the first bit highest."""
    out = np.zeros((trees, len(x)), np.uint64)
    place = (U64(1) << np.arange(bits - 1, -1, -1).astype(np.uint64))
    for t in range(trees):
        out[t] = ((x @ planes[:, t * bits : (t + 1) * bits]) > 0).astype(np.uint64) @ place
    return out


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.x, self.trees = x, trees
        self.planes = projections(x.shape[1], trees, seed=seed)
        h = strings(x, self.planes, trees)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def candidates(self, q: np.ndarray, share: float = SHARE, least: int = LEAST, rows: np.ndarray | int = 0):
        """Row numbers in the block for each query vector: at least ``rows`` (for each) different ones, or all."""
        want = min(len(self.x) * self.trees, max(least, int(share * len(self.x))))
        h = strings(q, self.planes, self.trees)
        low = np.zeros((BITS + 1, self.trees, len(q)), np.int32)
        high = np.zeros_like(low)
        for d in range(BITS + 1):  # prefixes of d bits
            mask = U64(((1 << d) - 1) << (BITS - d))
            for t in range(self.trees):
                at = h[t] & mask
                low[d, t] = np.searchsorted(self.sorted[t], at)
                high[d, t] = np.searchsorted(self.sorted[t], at | ~mask, side="right")
        held = (high - low).sum(axis=1, dtype=np.int64)
        depth = BITS - np.argmax(held[::-1] >= want, axis=0)  # the deepest level with enough
        seen = np.zeros(len(self.x), bool)
        rows = np.broadcast_to(rows, len(q))
        for i, d in enumerate(depth):
            seen[:] = False
            while True:
                for t in range(self.trees):
                    seen[self.order[t, low[d, t, i] : high[d, t, i]]] = True
                found = np.flatnonzero(seen)
                if d == 0 or len(found) >= rows[i]:
                    break
                d -= 1
            yield found


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, by score and then smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one vector, each summed in the same order for equal rows."""
    return np.einsum("ij,j->i", x, q)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _search(queries, k: int, trees: int, share: float, least: int, block_rows: int):
    """The best of a task's blocks for each query. Rows come block by block."""
    def run(batches):
        ids, own, q, by_id = queries.value
        best = np.full((len(ids), k), -np.inf)
        who = np.full((len(ids), k), np.iinfo(np.int64).max)

        def block(x, vec_id, row):
            names, mine = (vec_id, ids) if by_id else (row, own)
            ranked = np.sort(names)  # a query's own rows are no candidates
            need = k + np.searchsorted(ranked, mine, side="right") - np.searchsorted(ranked, mine)
            for i, rows in enumerate(Forest(x, trees).candidates(q, share, least, need)):
                rows = rows[names[rows] != mine[i]]
                score, found = np.concatenate((best[i], exact(x[rows], q[i]))), np.concatenate((who[i], vec_id[rows]))
                top = _best(score, found, k)
                best[i, : len(top)], who[i, : len(top)] = score[top], found[top]

        held, rows, now = [], 0, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # a block that outgrows its size, of rows that are all alike, say, is searched in parts
                if held and (number[a] != now or rows >= 2 * block_rows):
                    block(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, rows = [], 0
                part, now = batch.slice(a, b - a), number[a]
                held.append((_matrix(part.column(3)), part.column(1).to_numpy(), part.column(2).to_numpy()))
                rows += b - a
        if held:
            block(*(np.concatenate(c) for c in zip(*held, strict=True)))
        at, rank = np.nonzero(best > -np.inf)
        for i in range(0, len(at), 50_000):
            a, r = at[i : i + 50_000], rank[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(ids[a]), pa.array(who[a, r]), pa.array(best[a, r])], ["query_row", "query_id", "vec_id", "score"])
    return run


def valid(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not zero and has only finite components."""
    rows = columns(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    sound = F.expr("forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))") & F.expr("exists(embedding, v -> v <> 0)")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(embeddings: DataFrame, queries: DataFrame | str, k: int = 20, trees: int = TREES, share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest found in ``embeddings(vec_id, embedding)`` for each query: query_id, rank, vec_id, score.

    ``queries`` is a condition on vec_id that picks rows of ``embeddings``: each is a query by itself, and all
    rows but its own are candidates. Or it is a table of the same columns: each of its rows is a query, and
    rows of ``embeddings`` with its id are no candidates. Nearness is the largest inner product, ties go to the
    smaller vec_id. Repeated rows are candidates each. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part, nor do rows without an id. Vectors of another length than the query's
    take no part in its search. Other columns are not read. Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    numbered = lambda df, name: written(valid(df).withColumn("size", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), name)
    rows = numbered(embeddings, "forest-vectors")
    by_id = isinstance(queries, DataFrame)
    asked = numbered(queries, "forest-queries") if by_id else rows.where(F.expr(queries))
    have = {r[0]: r[1] for r in rows.groupBy("size").count().collect()}
    sizes = [tuple(r) for r in asked.groupBy("size").count().orderBy("size").collect()]
    out = None
    for size, n in sizes:
        if size not in have:
            continue
        blocks = max(1, ceil(have[size] / block_rows))
        dealt = rows.where(F.col("size") == size).select(F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "row", "embedding")
        dealt = written(dealt.repartition("block").sortWithinPartitions("block", "row"), "forest-blocks")
        portions = max(1, ceil(n * size * 8 / PORTION_BYTES))
        for p in range(portions):
            part = asked.where((F.col("size") == size) & (F.pmod(F.xxhash64("row"), F.lit(portions)) == p)).select("vec_id", "row", "embedding").orderBy("row").toArrow()
            if not part.num_rows:
                continue
            shared = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), part["row"].to_numpy(), _matrix(part["embedding"]), by_id))
            found = dealt.mapInArrow(_search(shared, k, trees, share, least, block_rows), "query_row long, query_id long, vec_id long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
