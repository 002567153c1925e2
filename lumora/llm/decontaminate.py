"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over word positions: of the words under it only those at its 1s are hashed, so a
substituted word at a 0 does not disturb a hit. The four masks below together hit every run of WINDOW words
in which any two are substituted (tests verify this). A hit of a document on an item fixes a diagonal;
around it, document and item are compared word by word, and the overlap counts if some WINDOW aligned words
of it agree in at least 80 %. Shorter items (of SHORTEST words or more) are sought by SHORT_MASK and must
agree over their whole length but for one word; those below SHORTEST words are sought by a hash of the whole
item and must agree in every word.

Equal items are one. The hashes of a benchmark of up to ``block_chars`` characters go to every task, and
documents are read once and never shuffled. Hashes of a larger one are joined by shuffle with those of the
documents that pass a bit map of the benchmark's, and only texts with such a meeting are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm import _text as T
from lumora.llm._shared import columns, small_batches, written

U64 = np.uint64
WINDOW, AGREE, SHORTEST = 13, 0.8, 8
#: Positions of the 1s.
MASKS = ((0, 1, 5, 6, 7, 8, 9), (0, 1, 3, 4, 5, 7, 8), (0, 3, 4, 6, 9, 10, 11), (0, 1, 2, 3, 6, 8, 10))
SHORT_MASK = (0, 1, 2, 3)
#: Characters of a benchmark whose index is sent to every task.
BLOCK_CHARS = 4_000_000
#: Hits that are looked at together.
MOST_HITS = 2_000_000
_FILTER_BITS, _JOIN_BITS = 24, 27


def _masks() -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least words, most words) of the items that each is for; the last ones take items whole."""
    out = [(m, WINDOW, 1 << 60) for m in MASKS] + [(SHORT_MASK, SHORTEST, WINDOW - 1)]
    return out + [(tuple(range(n)), n, n) for n in range(1, SHORTEST)]


def seed_hashes(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash under a mask at each position where it fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, U64(salt * 0x2545F4914F6CDD1D + 1 & (1 << 64) - 1))
        for j, at in enumerate(mask):
            total = total * U64(T._STEPS[j]) + h[at : at + n]
        return T.mix(total)


@dataclass
class Index:
    """Seed hashes of some items, sorted, with the item and position of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]
    filters: list[np.ndarray]


def build_index(ids: list[int], texts: list[str | None]) -> Index:
    w = T.words(T.plain(pa.array(texts, pa.string())))
    each = [w.hashes[a:b] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
    seeds, filters = [], []
    for k, (mask, least, most) in enumerate(_masks()):
        found = [(seed_hashes(h, mask, k), i) for i, h in enumerate(each) if least <= len(h) <= most]
        hashes = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(f[0]), f[1]) for f in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(f[0])) for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        seeds.append((mask, hashes[order], item[order], place[order]))
        bits = np.zeros(1 << _FILTER_BITS - 3, np.uint8)
        low = (hashes & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)
        np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
        filters.append(bits)
    return Index(np.array(ids, np.int64), each, seeds, filters)


def _diagonals(index: Index, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Distinct rows (text, item, place of the item's first word in the text) of all seed hits; hits are listed in bounded numbers."""
    out = []
    for k, (mask, hashes, item, place) in enumerate(index.seeds):
        if not len(hashes):
            continue
        mine = seed_hashes(h, mask, k)
        low = (mine & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)
        at = np.flatnonzero(index.filters[k][low >> 3] >> (low & 7).astype(np.uint8) & 1)
        a, b = np.searchsorted(hashes, mine[at]), np.searchsorted(hashes, mine[at], side="right")
        n = b - a
        total = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + MOST_HITS, side="right")))
            m = n[i:j]
            where = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a[i:j], m)
            pos = np.repeat(at[i:j], m)
            text = np.searchsorted(ptr, pos, side="right") - 1
            out.append(np.unique(np.stack((text, item[where], pos - ptr[text] - place[where]), 1), axis=0))
            i = j
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(start in the document, words, agreeing words) of what an item leaves in a document on a diagonal."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    window = min(WINDOW, len(item))
    if b - a < window:
        return None
    same = doc[a:b] == item[a - shift : b - shift]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = sums[window:] - sums[:-window] >= (ceil(AGREE * window) if len(item) >= WINDOW else window - 1 if len(item) >= SHORTEST else window)
    at = np.flatnonzero(good)
    if not len(at):
        return None
    covered = np.zeros(b - a + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return a + int(at[0]), int(inside.sum()), int((same & inside).sum())


def matches(index: Index, w: T.Words) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, words, agreeing words): the best overlap of each text with each item."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, s in _diagonals(index, w.hashes, w.ptr):
        got = overlap(w.hashes[w.ptr[t] : w.ptr[t + 1]], index.words[i], int(s))
        if got:
            best = found.get((int(t), int(i)))
            if best is None or (got[2], -got[0]) > (best[2], -best[0]):
                found[int(t), int(i)] = got
    for (t, i), got in sorted(found.items()):
        yield t, i, *got


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct (item_id, iid), distinct (iid, item) and the characters of the latter."""
    rows = columns(benchmark, "item_id", "text").where("text is not null").select("item_id", "text", F.xxhash64("text").alias("iid"))
    texts = rows.groupBy("iid").agg(F.first("text").alias("item"))
    return rows.select("item_id", "iid").distinct(), texts, texts.agg(F.sum(F.length("item"))).first()[0] or 0


def _shared_index(texts: DataFrame):
    part = texts.orderBy("iid").toArrow()
    return texts.sparkSession.sparkContext.broadcast(build_index(part["iid"].to_pylist(), part["item"].to_pylist()))


_SEEDS = "hash long, who long, place long"


def _seeds(bits=None):
    """Seed hashes of texts (column 0) by their ids (column 1); with ``bits``, those that the map lets pass."""
    def run(batches):
        for batch in batches:
            column, ids = T.plain(batch.column(0)), batch.column(1).to_numpy()
            for a, b in T.slices(column):
                w = T.words(column.slice(a, b - a))
                size = np.diff(w.ptr)
                for k, (mask, least, most) in enumerate(_masks()):
                    h = seed_hashes(w.hashes, mask, k)
                    at = np.arange(len(h))
                    if bits is not None:
                        low = (h >> U64(64 - _JOIN_BITS)).astype(np.int64)
                        at = np.flatnonzero(bits.value[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                    text = np.searchsorted(w.ptr, at, side="right") - 1
                    ok = at + mask[-1] < w.ptr[text + 1]
                    if bits is None:
                        ok &= (size[text] >= least) & (size[text] <= most)
                    at, text = at[ok], text[ok]
                    for i in range(0, len(at), 100_000):
                        x, t = at[i : i + 100_000], text[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64)), pa.array(ids[a:b][t]), pa.array(x - w.ptr[t])], ["hash", "who", "place"])
    return run


def _map(batches):
    bits = np.zeros(1 << _JOIN_BITS - 3, np.uint8)
    for batch in batches:
        low = (batch.column(0).to_numpy().view(np.uint64) >> U64(64 - _JOIN_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


def _compared(batches):
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            doc, item = (T.words(T.plain(batch.column(i).slice(k, 1))).hashes for i in (1, 3))
            best = None
            for shift in batch.column(4)[k].as_py():
                got = overlap(doc, item, shift)
                if got and (best is None or (got[2], -got[0]) > (best[2], -best[0])):
                    best = got
            if best:
                out.append((batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), *best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["did", "iid", "start_word", "n_words", "n_agree"])


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """did, iid, start_word, n_words, n_agree for ``texts(text, did)`` and ``items(iid, item)``, by a join of hashes."""
    spark = texts.sparkSession
    seeds = written(items.select("item", "iid").mapInArrow(_seeds(), _SEEDS), "bench-seeds")
    merged = np.zeros(1 << _JOIN_BITS - 3, np.uint8)
    for r in seeds.select("hash").coalesce(8).mapInArrow(_map, "bits binary").toLocalIterator():
        merged |= np.frombuffer(r[0], np.uint8)
    bits = spark.sparkContext.broadcast(merged)
    hits = texts.select("text", "did").mapInArrow(_seeds(bits), _SEEDS).withColumnsRenamed({"who": "did", "place": "at"})
    met = hits.join(seeds.withColumnRenamed("who", "iid"), "hash").select("did", "iid", (F.col("at") - F.col("place")).alias("shift")).distinct()
    met = written(met.groupBy("did", "iid").agg(F.collect_list("shift").alias("shifts")), "bench-meetings").withColumnsRenamed({"did": "d", "iid": "i"})
    pairs = texts.groupBy("did").agg(F.first("text").alias("text")).join(met, F.col("did") == F.col("d")).join(items, F.col("iid") == F.col("i"))
    return pairs.select("did", "text", "iid", "item", "shifts").mapInArrow(_compared, "did long, iid long, start_word long, n_words long, n_agree long")


def contaminations(documents: DataFrame, benchmark: DataFrame, block_chars: int | None = None) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, start_word, n_words, n_agree (counts are long).

    ``documents(doc_id, text)``, ``benchmark(item_id, text)``; other columns are not read. Texts that are
    null, empty or shorter than an item's window match nothing; a null doc_id or item_id stays null, and an
    item_id keeps its type; repeated documents are reported each, repeated items once an id. Of several places
    the one that agrees in most words counts, of equal ones the first. Either table empty: no rows.
    """
    ids, items, size = _items(benchmark)
    rows = columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    if size > (BLOCK_CHARS if block_chars is None else block_chars):
        rows = rows.where("text is not null").withColumn("did", F.xxhash64("text"))
        found = _joined(rows.select("text", "did"), items).withColumnRenamed("did", "d")
        found = rows.select("doc_id", "did").join(found, F.col("did") == F.col("d"))
    else:
        shared = _shared_index(items)

        def run(batches):
            index = shared.value
            for batch in batches:
                column, found = T.plain(batch.column(1)), []
                for a, b in T.slices(column):
                    found += [(a + t, int(index.ids[i]), *rest) for t, i, *rest in matches(index, T.words(column.slice(a, b - a)))]
                if found:
                    who, item, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(x, pa.int64()) for x in (item, *rest))], ["doc_id", "iid", "start_word", "n_words", "n_agree"])

        found = rows.mapInArrow(run, "doc_id long, iid long, start_word long, n_words long, n_agree long")
    return found.join(ids.withColumnRenamed("iid", "i"), F.col("iid") == F.col("i")).select("doc_id", "item_id", "start_word", "n_words", "n_agree")


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", block_chars: int | None = None) -> DataFrame:
    """The rows of ``documents`` in which no item is found, with all their columns.

    Rows without text stay; repeated rows stay or go alike; an empty benchmark leaves all, an empty table none.
    """
    small_batches(documents.sparkSession)
    _, items, size = _items(benchmark)
    if size > (BLOCK_CHARS if block_chars is None else block_chars):
        rows = columns(documents, text).select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumn("did", F.xxhash64("text"))
        found = _joined(rows, items).select("did").distinct()
        return documents.join(found, F.xxhash64(documents[f"`{text}`"]) == F.col("did"), "left_anti")
    at = documents.columns.index(text)
    shared = _shared_index(items)

    def run(batches):
        index = shared.value
        for batch in batches:
            column, keep = T.plain(batch.column(at)), np.ones(batch.num_rows, bool)
            for a, b in T.slices(column):
                keep[[a + m[0] for m in matches(index, T.words(column.slice(a, b - a)))]] = False
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
