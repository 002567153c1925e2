"""Substring dedup by compact windows.

Every 5-word shingle gets ``HASHES`` hash values. For one hash, the runs of shingles that share their least
value form a compact window: the run's least shingle and how far it reaches to both sides, which is a node
of the Cartesian tree over the values with its subtree. Only windows that hold a passage of ``LEAST`` words
matter; there are about 2 n / LEAST of them. Two passages that agree meet in their least shingle under every
hash, near-duplicates under most.

1. Windows meet by key, across all texts. The key of a plain hash is the least shingle. The first hash has two
   keys in its place: the ``CONTEXT`` shingles from the least one on, and those up to it. Each two texts of a key
   are a pair. A text that repeats itself has each of its windows tied to the one before.
2. Pairs of texts that share a context, or the least shingles of ``ENOUGH`` plain hashes on about the same
   diagonal, are verified on the shingles themselves: first those with the least text of a key, then the others,
   unless both texts are tied to that one around the key.
3. A key of more than ``TOGETHER`` windows is solved as a group, on the shingles around it: every member that is not
   in the largest class is held against all members outside its own class, so no two classes are left that a verified
   pair would tie. Members that share too few shingles with another one for a passage are told apart by counting.
4. Exact passages: every run of LEAST words around a tied least shingle that no verified passage of its text with a
   lesser one covers is hashed whole, and equal runs are tied. An exact passage lies in windows whose contexts agree
   to one side at least; its runs are therefore either verified or hashed here: no exact passage is lost, whatever
   else shares its words.

Equal texts count as one text.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm import _text as T
from lumora.llm._shared import columns, written

U64 = np.uint64
SHINGLE, LEAST, HASHES, ENOUGH = 5, 50, 5, 2
#: Shingles of the shortest passage, and of a context: of a passage's shingles, so many lie to one side of any of them.
RUN = LEAST - SHINGLE + 1
CONTEXT = RUN // 2
#: Words by which near-duplicate passages may be displaced against each other within their windows.
SLACK, DIAGONALS = 16, 64
#: Windows of a key that are paired each with each; more are solved as a group, on REACH shingles to both sides of the
#: least one. Groups above BLOCK windows are solved in pairs of blocks.
TOGETHER, REACH, BLOCK = 24, 96, 10_000
FLUSH_WINDOWS = 200_000
#: Windows of a bucket, as estimated from the number of words.
BUCKET_WINDOWS = 200_000
#: Bits of pairs: the contexts from and up to the least shingle, and whole runs; the plain hashes are between.
AFTER, BEFORE, WHOLE = 0, HASHES, HASHES + 1
_EXACT = 1 << AFTER | 1 << BEFORE | 1 << WHOLE
_SEEDS = [U64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917)]


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the least value, first, last) of every maximal window of ``width`` or more; 0 separates texts."""
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    bits = U64(max(1, int(n - 1).bit_length()))
    v = np.where(values == 0, U64(0), ((values | U64(1 << 63)) >> bits << bits) | np.arange(n, dtype=np.uint64))
    levels = [v]  # least value of each run of 1, 2, 4 ... places
    w = 1
    while w * 2 <= n and (w * 2 <= width or levels[-1].any()):
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
        w *= 2
    k = width.bit_length() - 1
    least = np.minimum(levels[k][: n - width + 1], levels[k][width - (1 << k) :])
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    least = least[least > 0]
    at = (least & U64((1 << int(bits)) - 1)).astype(np.int64)
    first, last = at.copy(), at + 1
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        to = first - step
        ok = (to >= 0) & (level[np.maximum(to, 0)] > least)
        first = np.where(ok, to, first)
        ok = (last + step <= n) & (level[np.minimum(last, len(level) - 1)] > least)
        last = np.where(ok, last + step, last)
    return at, first, last - 1


def _runs(w: T.Words) -> np.ndarray:
    """A shingle hash at every word that starts one within its text, else 0."""
    runs = np.zeros(len(w.hashes), np.uint64)
    if len(runs) >= SHINGLE:
        runs[: len(runs) - SHINGLE + 1] = T.grams(w.hashes, SHINGLE) | U64(1)
        for back in range(1, SHINGLE):
            ends = w.ptr[1:] - back
            runs[ends[ends >= 0]] = 0
    return runs


def _sums(runs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(runs * T._power_table(T._RATIO, len(runs)), dtype=np.uint64)))


def _spans(runs: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` shingles from a place on; 0 where they do not lie in one text."""
    n = len(runs) - width + 1
    if n <= 0:
        return np.zeros(len(runs), np.uint64)
    with np.errstate(over="ignore"):
        sums = _sums(runs)
        got = T.mix((sums[width:] - sums[:-width]) * T._power_table(T._INVERSE, len(runs))[:n]) | U64(1)
    breaks = np.concatenate(([0], np.cumsum(runs == 0)))
    out = np.zeros(len(runs), np.uint64)
    out[:n] = np.where(breaks[width:] == breaks[:-width], got, U64(0))
    return out


def _new(key, text, at, left, right, sums) -> np.ndarray:
    """False for a window whose words within REACH an earlier window of its text and key has as well, around the same shingle."""
    order = np.lexsort((at, text, key))
    k, t, a = key[order], text[order], at[order]
    left, right = np.minimum(left[order], REACH), np.minimum(right[order], REACH)
    again = np.flatnonzero((k[1:] == k[:-1]) & (t[1:] == t[:-1])) + 1
    again = again[(left[again] <= left[again - 1]) & (right[again] <= right[again - 1])]
    a0, a1, l, r = a[again - 1], a[again], left[again], right[again] + 1
    with np.errstate(over="ignore"):
        scale = T._power_table(T._INVERSE, len(sums))
        same = (sums[a0 + r] - sums[a0 - l]) * scale[a0 - l] == (sums[a1 + r] - sums[a1 - l]) * scale[a1 - l]
    out = np.ones(len(key), bool)
    out[order[again[same]]] = False
    return out


def _windows(batches):
    """Portions of windows: key, text, place, reach to the left and to the right, bit, and whether it travels."""
    held: list[tuple] = []
    seen: set[int] = set()
    count = 0
    for batch in batches:
        column, tids = T.plain(batch.column(0)), batch.column(1).to_numpy()
        for a, b in T.slices(column):
            w = T.words(column.slice(a, b - a))
            tid = tids[a:b]
            fresh = np.array([int(t) not in seen and not seen.add(int(t)) for t in tid], bool)
            runs = _runs(w)
            spans = _spans(runs, CONTEXT)
            sums = _sums(runs)
            for j in range(HASHES):
                with np.errstate(over="ignore"):
                    mixed = T.mix(runs ^ _SEEDS[j])
                at, first, last = compact_windows(np.where(runs == 0, U64(0), mixed), RUN)
                text = np.searchsorted(w.ptr, at, side="right") - 1
                ok = fresh[text]
                at, first, last, text = at[ok], first[ok], last[ok], text[ok]
                if j == 0:
                    after, before = np.flatnonzero(last - at >= CONTEXT - 1), np.flatnonzero(at - first >= CONTEXT - 1)
                    keys = [(AFTER, after, spans[at[after]]), (BEFORE, before, T.mix(spans[at[before] - CONTEXT + 1]))]
                else:
                    keys = [(j, slice(None), mixed[at])]
                for bit, i, key in keys:
                    left, right = at[i] - first[i], last[i] - at[i]
                    held.append((key >> U64(8), tid[text[i]], at[i] - w.ptr[text[i]], left, right, np.full(len(key), bit), _new(key, text[i], at[i], left, right, sums)))
                    count += len(key)
            if count >= FLUSH_WINDOWS:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, seen, count = [], set(), 0
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


_PAIR = ["text", "other", "shift", "low", "high", "hashes", "first", "last", "via"]
_PAIR_TYPE = "text long, other long, shift int, low int, high int, hashes int, first int, last int, via long"


def _tie(key, tid, at, left, right, j):
    """Ties equal runs to that of the least text, and repeats in one text to those before: pairs, and the places of
    the runs that stand for their keys. A pair's first and last are the run's place."""
    order = np.lexsort((at, tid, key))
    k, t = key[order], tid[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    head = np.flatnonzero(new)
    lead = np.repeat(head, np.diff(np.append(head, len(k))))
    again = np.concatenate(([False], ~new[1:] & (t[1:] == t[:-1])))
    lead = np.where(again, np.arange(len(k)) - 1, lead)
    tied = ~new & ((t != t[lead]) | (at[order] != at[order[lead]]))
    # a text of several portions: its windows come again at the same places
    tied &= ~(again & (at[order] == at[order[lead]]))
    m, lead = order[tied], order[lead[tied]]
    return _tied(m, lead, tid, at, left, right, j), order[head]


def _repeats(key, tid, at, left, right, j, new):
    """Ties each window of a text to the one before of its key: pairs, and the windows that travel."""
    order = np.lexsort((at, tid, key))
    k, t = key[order], tid[order]
    m = np.flatnonzero((k[1:] == k[:-1]) & (t[1:] == t[:-1])) + 1
    return _tied(order[m], order[m - 1], tid, at, left, right, j), order[new[order]]


def _tied(m, lead, tid, at, left, right, j) -> tuple:
    shift = at[lead] - at[m]
    low = np.maximum(at[m] - left[m], at[lead] - left[lead] - shift)
    high = np.minimum(at[m] + right[m], at[lead] + right[lead] - shift)
    return tid[m], tid[lead], shift, low, high, 1 << j[m], at[m], at[m], tid[lead]


def _groups(key, tid, at, left, right, j) -> tuple[tuple, tuple]:
    """All pairs of texts that share a key, via the first of these texts, and instead of those of a large group its
    windows, as rows like pairs: text, key, place, reach to the left and to the right, less than 0 the bit, twice the
    place again, and how far words right of it count.

    Windows of a text and key that start within RUN words of each other are one, up to REACH words together.
    """
    order = np.lexsort((at, tid, key))
    k, t, a, right = key[order], tid[order], at[order], right[order]
    # a text of several portions: its windows come again at the same places
    near = np.concatenate(([False], (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (a[1:] <= a[:-1] + RUN)))
    head = np.flatnonzero(~near)
    part = (a - np.repeat(a[head], np.diff(np.append(head, len(k))))) // REACH
    head = np.flatnonzero(~near | np.concatenate(([True], part[1:] != part[:-1])))
    spread = a[np.append(head[1:], len(k)) - 1] - a[head]
    counts = np.maximum.reduceat(a + np.minimum(right, REACH), head) - a[head]
    right = np.maximum.reduceat(a + right, head) - a[head] + spread
    k, tid, at, left, j = k[head], t[head], a[head], left[order[head]], j[order[head]]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(k)))
    texts = np.add.reduceat(np.concatenate(([True], new[1:] | (tid[1:] != tid[:-1]))).astype(np.int64), head)
    rank = np.arange(len(k)) - np.repeat(head, size)
    rank[np.repeat((texts < 2) | (size > TOGETHER), size)] = 0
    m = np.repeat(np.arange(len(k)), rank)
    lead = m - 1 - (np.arange(len(m)) - np.repeat(np.cumsum(rank) - rank, rank))
    ok = tid[m] != tid[lead]
    m, lead = m[ok], lead[ok]
    pairs = (*_tied(m, lead, tid, at, left, right, j)[:-1], np.repeat(tid[head], size)[m])
    i = np.flatnonzero(np.repeat((texts > 1) & (size > TOGETHER), size))
    return pairs, (tid[i], k[i].view(np.int64), at[i], left[i], right[i], -(1 << j[i]), at[i], at[i], counts[i])


def _merge(pairs: tuple) -> list[np.ndarray]:
    """One row for each pair of texts and diagonal."""
    text, other, shift, low, high, hashes, first, last, via = (np.asarray(x, np.int64) for x in pairs)
    if not len(text):
        return [text, other, *(x.astype(np.int32) for x in (shift, low, high, hashes, first, last)), via]
    order = np.lexsort((shift, other, text))
    text, other, shift, low, high, hashes, first, last, via = (x[order] for x in (text, other, shift, low, high, hashes, first, last, via))
    head = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1]))))
    least, most = (lambda x: np.minimum.reduceat(x, head)), (lambda x: np.maximum.reduceat(x, head))
    return [text[head], other[head], *(x.astype(np.int32) for x in (shift[head], least(low), most(high), np.bitwise_or.reduceat(hashes, head), least(first), most(last))), most(via)]


def _pack(arrays: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    return b"".join(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for a, w in zip(arrays, widths, strict=True))


def _unpack(data: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n, out, done = len(raw) // sum(widths), [], 0
    for w in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = raw[done : done + n * w].reshape(w, n).T
        out.append(full.view("<i8").ravel())
        done += n * w
    return out


_WINDOW, _PAIRS = (7, 8, 4, 4, 4, 1), (8, 8, 8, 8, 8, 1, 8, 8, 8)


def _deal(buckets: int, source=_windows, merge=_merge, tie=_repeats):
    """The windows of a portion that travel, by bucket (kind 0), and the pairs made in it (kind 1)."""
    def run(batches):
        for portion in source(batches):
            key, tid, at, left, right, j = portion[:6]
            pairs, kept = tie(*portion)
            cols = [np.asarray(x)[kept] for x in (key.view(np.int64), tid, at, left, right, j)]
            bucket = ((cols[0] >> 32) * buckets) >> 24
            groups = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            rows = [(int(bucket[a]), 0, _pack([c[a:b] for c in cols], _WINDOW)) for a, b in zip(groups, np.append(groups[1:], len(bucket)), strict=True)] if len(bucket) else []
            merged = merge(pairs)
            for i in range(0, len(merged[0]), 20_000):
                rows.append(((i // 20_000 + int(tid[0])) % buckets, 1, _pack([x[i : i + 20_000] for x in merged], _PAIRS)))
            for i in range(0, len(rows), 16):
                part = list(zip(*rows[i : i + 16], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary())], ["bucket", "kind", "data"])
    return run


def _met(table: pa.Table) -> tuple[list, list]:
    """The pairs that portions made, and the windows that travelled."""
    kinds = table["kind"].to_numpy()
    pairs, each = ([_unpack(table["data"][int(i)].as_py(), widths) for i in np.flatnonzero(kinds == kind)] for kind, widths in ((1, _PAIRS), (0, _WINDOW)))
    return pairs, [np.concatenate(x) for x in zip(*each, strict=True)]


def _rows(parts: list) -> pa.Table:
    parts = [[np.asarray(x, np.int64 if i in (0, 1, 8) else np.int32) for i, x in enumerate(p)] for p in parts or [((),) * 9]]
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], _PAIR)


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of a bucket, and the windows of its large groups."""
    out, windows = _met(table)
    large = []
    if windows:
        pairs, group = _groups(*windows)
        out.append([np.asarray(x, np.int64) for x in pairs])
        large.append(group)
    return _rows([_merge(tuple(np.concatenate(x) for x in zip(*out, strict=True))), *large] if out else [])


def _each(pairs: tuple) -> list[np.ndarray]:
    """All pairs as they are, with the types of ``_merge``."""
    return [np.asarray(x, np.int64 if i in (0, 1, 8) else np.int32) for i, x in enumerate(pairs)]


def _meet_each(table: pa.Table) -> pa.Table:
    out, windows = _met(table)
    return _rows([*out, _tie(*windows)[0]] if windows else out)


def _exact(documents: DataFrame, buckets: int) -> DataFrame:
    """Exact passages from equal runs: those on one diagonal that overlap or touch are one."""
    met = documents.mapInArrow(_deal(buckets, _uncovered, _each, _tie), "bucket int, kind int, data binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet_each, _PAIR_TYPE)
    by = Window.partitionBy("text", "other", "shift").orderBy("first")
    starts = met.select("text", "other", "shift", "first").distinct().withColumn("new", F.coalesce(F.col("first") > F.lag("first").over(by) + RUN, F.lit(True)).cast("int"))
    spans = starts.withColumn("span", F.sum("new").over(by)).groupBy("text", "other", "shift", "span").agg(F.min("first").alias("a"), F.max("first").alias("b"))
    n = (F.col("b") - F.col("a") + LEAST).cast("long")
    return spans.select("text", F.col("a").cast("long").alias("start"), n.alias("n"), "other", (F.col("a") + F.col("shift")).cast("long").alias("other_start"), n.alias("other_n"), F.lit(1.0).alias("jaccard"))


def _uncovered(batches):
    """Portions of whole runs, as windows: those that start in a text's spots and lie in no passage of its."""
    held: list[tuple] = []
    count = 0
    for batch in batches:
        tids, data, spots, covers = (batch.column(i) for i in range(4))
        for tid, raw, low_high, known in zip(tids.to_pylist(), data, spots.to_pylist(), covers.to_pylist(), strict=True):
            runs = np.frombuffer(raw.as_py(), np.uint32).astype(np.uint64)
            spans = _spans(T.mix(runs), RUN)
            wanted = np.zeros(len(runs) + 1, np.int64)
            for spot in low_high:
                a, b = min(len(runs), max(0, spot["low"])), min(len(runs), spot["high"] + 1)
                if a < b:
                    wanted[a] += 1
                    wanted[b] -= 1
            at = np.flatnonzero((np.cumsum(wanted[:-1]) > 0) & (spans != 0))
            if known and len(at):
                begin = np.array([c["low"] for c in known])
                order = np.argsort(begin, kind="stable")
                end = np.maximum.accumulate(np.array([c["high"] for c in known])[order])
                i = np.searchsorted(begin[order], at, side="right") - 1
                at = at[(i < 0) | (end[np.maximum(i, 0)] < at + RUN - 1)]
            if len(at):
                none = np.zeros(len(at), np.int64)
                held.append((spans[at] >> U64(8), np.full(len(at), tid, np.int64), at, none, none + RUN - 1, none + WHOLE))
                count += len(at)
            if count >= FLUSH_WINDOWS:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, count = [], 0
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _wanted_runs(ids):
    """Shingles of the wanted texts, 32 bits of each hash: enough to compare two texts, and half the bytes to move."""
    def run(batches):
        want = ids.value if ids is not None else None
        for batch in batches:
            column, tids, have = T.plain(batch.column(0)), batch.column(1).to_numpy(), set()
            keep = np.ones(len(tids), bool) if want is None else want[np.minimum(np.searchsorted(want, tids), len(want) - 1)] == tids
            for a, b in T.slices(column):
                rows = [i for i in np.flatnonzero(keep[a:b]) + a if int(tids[i]) not in have and not have.add(int(tids[i]))]
                if rows:
                    w = T.words(column.take(pa.array(rows)))
                    runs = _runs(w)
                    short = np.where(runs > 0, (runs >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                    yield pa.RecordBatch.from_arrays([pa.array(tids[rows]), pa.array([short[x:y].tobytes() for x, y in zip(w.ptr[:-1], w.ptr[1:], strict=True)], pa.binary())], ["tid", "runs"])
    return run


def alike(mine: np.ndarray, theirs: np.ndarray, shifts: tuple[int, ...] = (), anywhere: bool = True, num: int = 4, den: int = 5):
    """(first, last, first in theirs, last in theirs, Jaccard similarity) of the stretches of ``mine`` that ``theirs`` repeats.

    First on the diagonals ``shifts`` (place in theirs less place in mine), then, with ``anywhere``, wherever
    in theirs a shingle comes first.
    """
    done = np.zeros(len(mine), bool)
    for shift in shifts:
        place = np.arange(shift, len(mine) + shift)
        a = max(0, -shift)
        b = max(a, min(len(mine), len(theirs) - shift))
        same = np.zeros(len(mine), bool)
        same[a:b] = (theirs[a + shift : b + shift] == mine[a:b]) & (mine[a:b] != 0) & ~done[a:b]
        for got in _stretches(mine, theirs, place, same, num, den):
            done[got[0] : got[1] + 1] = True
            yield got
    if anywhere and len(theirs) and len(mine) - int(done.sum()) >= RUN * num // den:
        where = np.argsort(theirs, kind="stable")
        ranked = theirs[where]
        at = np.minimum(np.searchsorted(ranked, mine), len(ranked) - 1)
        yield from _stretches(mine, theirs, where[at], (ranked[at] == mine) & (mine != 0) & ~done, num, den)


def exact_runs(mine: np.ndarray, theirs: np.ndarray, shift: int):
    """(first, last) of the longest runs of RUN shingles or more that both have on a diagonal."""
    a, b = max(0, -shift), min(len(mine), len(theirs) - shift)
    if b - a < RUN:
        return
    same = np.concatenate(([False], (mine[a:b] == theirs[a + shift : b + shift]) & (mine[a:b] != 0), [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    for first, end in zip(edge[::2], edge[1::2], strict=True):
        if end - first >= RUN:
            yield int(a + first), int(a + end - 1)


def _longest(same: np.ndarray, gap: int) -> tuple[int, int]:
    """(first, last) of the longest stretch with at least ``gap`` matches for each gap, a match at both ends."""
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1, -gap))))
    floor = np.minimum.accumulate(gain)
    start = np.searchsorted(-floor, -gain)  # the first place from which an end is no loss
    end = int(np.argmax(np.arange(len(gain)) - start))
    inside = np.flatnonzero(same[start[end] : end])
    return (int(start[end] + inside[0]), int(start[end] + inside[-1])) if len(inside) else (0, -1)


def _best(same: np.ndarray, gap: int) -> tuple[int, int]:
    """(first, last) of the stretch with the most matches, less ``gap`` for each gap."""
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1, -gap))))
    end = int(np.argmax(gain[1:] - np.minimum.accumulate(gain)[:-1]))
    return int(np.argmin(gain[: end + 1])), end


def _stretches(mine, theirs, place, same, num: int, den: int):
    """Two stretches of n shingles that share m are alike if m >= num / den * (2 n - m): enough matches for each gap."""
    same, gap = same.copy(), 2 * num // (den - num)
    while int(same.sum()) >= RUN * num // den:
        found = _longest(same, gap)
        if found[1] - found[0] + 1 < RUN:
            return
        for start, end in (found, _best(same[found[0] : found[1] + 1], gap)):
            if (start, end) != found:
                start, end = start + found[0], end + found[0]
            got = _similar(mine, theirs, place, same, start, end) if end - start + 1 >= RUN else None
            if got and den * got[1] >= num * got[2]:
                yield start, end, got[0], got[3], got[1] / got[2]
                break
        same[start : end + 1] = False


def _similar(mine, theirs, place, same, start: int, end: int) -> tuple[int, int, int, int] | None:
    """(first in theirs, shared shingles, all shingles, last in theirs) of a stretch and what it repeats."""
    inside = np.flatnonzero(same[start : end + 1]) + start
    hit = place[inside]
    if not len(hit):
        return None
    shifts = np.sort(hit - inside)
    shift = (shifts[(len(shifts) - 1) // 2] + shifts[len(shifts) // 2]) / 2  # the median
    hit = hit[(hit >= start + shift - SLACK) & (hit <= end + shift + SLACK)]
    if not len(hit) or hit.max() - hit.min() < RUN - 1:
        return None
    low, high = int(hit.min()), int(hit.max())
    a, b = _distinct(mine[start : end + 1]), _distinct(theirs[low : high + 1])
    each = np.sort(np.concatenate((a, b)))
    both = int(np.count_nonzero(each[1:] == each[:-1]))
    return low, both, len(a) + len(b) - both, high


def _distinct(shingles: np.ndarray) -> np.ndarray:
    """As ``np.unique`` without 0, which is slow on few values."""
    s = np.sort(shingles)
    return s[np.concatenate((s[:1] > 0, s[1:] != s[:-1]))] if len(s) else s


_FOUND = "text long, start long, n long, other long, other_start long, other_n long, jaccard double, exact boolean"


def _verify(batches):
    """Passages of candidate pairs, each with the stretches of both texts in question, and their exact runs (exact)."""
    for batch in batches:
        out: list[tuple] = []
        text, other, low, near, far, begin = (batch.column(i).to_pylist() for i in range(6))
        for i in range(batch.num_rows):
            mine, theirs = (np.frombuffer(batch.column(k)[i].as_py(), np.uint32) for k in (6, 7))
            base = low[i] - begin[i]
            shifts = tuple(sorted({near[i] + base, far[i] + base}))
            for a, b, c, d, s in alike(mine, theirs, shifts, text[i] != other[i]):
                out.append((text[i], low[i] + a, b - a + SHINGLE, other[i], begin[i] + c, d - c + SHINGLE, s, False))
            for shift in shifts if text[i] != other[i] else ():
                for a, b in exact_runs(mine, theirs, shift):
                    out.append((text[i], low[i] + a, b - a + SHINGLE, other[i], begin[i] + a + shift, b - a + SHINGLE, 1.0, True))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.float64(), pa.bool_()], strict=True)], ["text", "start", "n", "other", "other_start", "other_n", "jaccard", "exact"])


def _verified(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``pairs``: text, other, low, high, near, far. Both texts' stretches meet in one row; hot partners are salted."""
    salts = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("salts"))
    told = pairs.join(salts, "other").withColumn("salt", F.pmod(F.xxhash64("text"), "salts").cast("int")).drop("salts")
    theirs = runs.join(salts.withColumnRenamed("other", "o"), F.col("tid") == F.col("o")).select("o", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.col("runs").alias("whole"))
    mine = told.join(runs, F.col("text") == F.col("tid")).withColumn("begin", F.greatest(F.lit(0), F.col("low") + F.col("near") - SLACK))
    mine = mine.select("text", "other", "salt", "low", "high", "near", "far", "begin", F.expr("substring(runs, low * 4 + 1, (high - low + 1) * 4)").alias("mine"))
    both = mine.join(theirs, (F.col("other") == F.col("o")) & (F.col("salt") == F.col("s")))
    size = f"(greatest(begin, high + far + {SLACK} + 1) - begin) * 4"
    both = both.select("text", "other", "low", "near", "far", "begin", "mine", F.expr(f"substring(whole, begin * 4 + 1, {size})").alias("theirs"))
    return both.mapInArrow(_verify, _FOUND)


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs by texts and diagonal. Two grids of diagonals: what lies half a grid apart is together in one of them.

    ``here`` is a shared least shingle: its places in both texts. The windows of large groups stay as they are
    (``large``): near and far are their place, low and high the reach.
    """
    cell = lambda off: F.floor((F.col("shift") + off) / DIAGONALS).cast("int")
    whole = F.array(F.struct(F.lit(3).alias("grid"), F.col("shift").alias("cell")))
    grids = F.when(F.col("hashes") < 0, whole).when(F.col("text") == F.col("other"), F.array(F.struct(F.lit(2).alias("grid"), F.col("shift").alias("cell"))))
    grids = grids.otherwise(F.array(*[F.struct(F.lit(g).alias("grid"), cell(g * DIAGONALS // 2).alias("cell")) for g in (0, 1)]))
    met = met.withColumn("d", F.explode(grids))
    exact = F.abs("hashes").bitwiseAND(_EXACT) != 0
    bounds = (F.min("low").alias("low"), F.max("high").alias("high"), F.min("shift").alias("near"), F.max("shift").alias("far"), F.bit_or("hashes").alias("hashes"), F.max("via").alias("via"))
    here = F.min(F.shiftleft(F.col("first").cast("long"), 32) + F.col("first") + F.col("shift")).alias("here")
    pairs = met.groupBy("text", "other", "d.grid", "d.cell").agg(*bounds, here, F.min(F.when(exact, F.col("first"))).alias("first"), F.max(F.when(exact, F.col("last"))).alias("last"))
    good = (F.col("hashes").bitwiseAND(_EXACT) != 0) | (F.bit_count("hashes") >= ENOUGH) | (F.col("grid") >= 2)
    pairs = pairs.where(good).withColumn("large", F.col("grid") == 3).drop("grid", "cell", "hashes").distinct()
    wide = lambda c, x: F.when(F.col("large"), F.col(c)).otherwise(x)
    return pairs.withColumn("low", wide("low", F.greatest(F.lit(0), F.col("low") - SLACK))).withColumn("high", wide("high", F.col("high") + SLACK))


def _open(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pairs`` that are not tied by passages which both texts share, around the same shingle, with the one they are paired via."""
    seen = found.where("not exact").select(F.col("text").alias("t"), F.col("other").alias("o"), F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))
    at = lambda text, place: (F.col(text) == F.col("t")) & (F.col("via") == F.col("o")) & (F.expr(place) >= F.col("s")) & (F.expr(place) < F.col("e"))
    mine, theirs = at("text", "shiftright(here, 32)"), at("other", "here & 4294967295")
    return pairs.join(seen, mine, "left_anti").unionByName(pairs.join(seen, mine, "left_semi").join(seen, theirs, "left_anti"))


class _Group:
    """Windows of one key: shingles around the least one, which stands in column REACH."""

    def __init__(self, tid, left, stretches):
        self.tid = tid
        self.runs = np.zeros((len(tid), 3 * REACH + 1), np.uint32)
        for i, x in enumerate(stretches):
            begin = REACH - min(int(left[i]), REACH)
            got = np.frombuffer(x, np.uint32)
            self.runs[i, begin : begin + len(got)] = got
        real = self.runs != 0
        row = np.nonzero(real)[0]
        values, flat = np.unique(self.runs[real], return_inverse=True)
        #: Numbers of shingles, the last one of none.
        self.ids = np.full(self.runs.shape, len(values), np.int32)
        self.ids[real] = flat
        self.has = np.zeros(len(values) + 1, bool)
        held = np.sort(flat.astype(np.int64) * len(tid) + row)
        held = held[np.concatenate((np.ones(min(1, len(held)), bool), held[1:] != held[:-1]))]
        shingle, self.owner = held // len(tid), (held % len(tid)).astype(np.int32)
        self.ptr = np.searchsorted(shingle, np.arange(len(values) + 1))
        #: Different shingles of any RUN ones at least; no row without RUN ones.
        count = real.sum(axis=1)
        self.least = np.where(count < RUN, 1 << 30, RUN)
        again = np.flatnonzero((np.bincount(self.owner, minlength=len(tid)) < count) & (count >= RUN))
        if len(again):
            order = np.argsort(self.ids[again], axis=1, kind="stable")
            ranked = np.take_along_axis(self.ids[again], order, axis=1)
            before = np.full(order.shape, -1, np.int16)
            np.put_along_axis(before, order[:, 1:], np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1).astype(np.int16), axis=1)
            for a in range(order.shape[1] - RUN + 1):
                whole = real[again, a] & real[again, a + RUN - 1]
                self.least[again] = np.minimum(self.least[again], np.where(whole, (before[:, a : a + RUN] < a).sum(axis=1), RUN))
        #: Members with so many shingles that others have as well that they may be alike to one.
        self.some = 5 * np.bincount(self.owner, np.diff(self.ptr)[shingle] > 1, len(tid)) >= 4 * self.least

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that may be alike to member ``i``: no other one shares shingles enough, in a stretch with few
        gaps, and repeats by them a stretch of ``i`` with few gaps."""
        values, first, column = np.unique(self.ids[i], return_index=True, return_inverse=True)
        real = values[: np.searchsorted(values, len(self.ptr) - 1)]
        begin, end = self.ptr[real], self.ptr[real + 1]
        several = np.flatnonzero(end - begin > 1)
        if not len(several):
            return among[:0]
        owner = np.concatenate([self.owner[a:b] for a, b in zip(begin[several].tolist(), end[several].tolist(), strict=True)])
        shared = np.bincount(owner, minlength=len(self.tid))
        among = among[5 * shared[among] >= 4 * np.maximum(self.least[among], self.least[i])]
        if not len(among):
            return among
        mine, shingle = values[several], np.repeat(several, (end - begin)[several])
        # a shingle of ``i`` that the other one does not have counts once, where it comes first.
        lost = np.zeros(self.ids.shape[1], np.int16)
        lost[first[: len(real)]] = -4
        self.has[mine] = True
        row = np.full(len(self.tid), -1, np.int32)
        out = []
        for a in range(0, len(among), 2000):
            part = among[a : a + 2000]
            same = self.has[self.ids[part]]
            wide = same.shape[1] - same[:, ::-1].argmax(axis=1) - same.argmax(axis=1) >= RUN
            part = part[wide]
            part = part[self.dense(same[wide], np.int16(-8))] if len(part) else part
            if len(part):
                row[part] = np.arange(len(part))
                met = np.zeros((len(part), len(values)), bool)
                ours = row[owner] >= 0
                met[row[owner[ours]], shingle[ours]] = True
                row[part] = -1
                part = part[self.dense(met[:, column], lost)]
            out.append(part)
        self.has[mine] = False
        return np.concatenate(out)

    def dense(self, same: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """Rows with RUN places or more from one match to another in which the matches make up for what gaps lose."""
        gain = np.zeros((len(same), same.shape[1] + 1), np.int16)
        np.cumsum(np.where(same, np.int16(1), lost), axis=1, out=gain[:, 1:])
        start = np.minimum.accumulate(np.where(same, gain[:, :-1], np.int16(32767)), axis=1)[:, : 1 - RUN]
        return (same[:, RUN - 1 :] & (gain[:, RUN:] >= start)).any(axis=1)

    def exact(self, i: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns from and up to which members are equal to ``i`` around the key."""
        differ = (self.runs[among] != self.runs[i]) | (self.runs[i] == 0)
        left, right = differ[:, REACH::-1], differ[:, REACH:]
        reach = lambda x: np.where(x.any(axis=1), np.argmax(x, axis=1), x.shape[1])
        return REACH + 1 - reach(left), REACH - 1 + reach(right)

    def forest(self):
        """(m, lead, stretches) of verified pairs that tie all members which verified pairs tie, directly or through others.

        Of members that are not tied to each other one is outside the largest class, and each of those is held
        against all members but those of its class.
        """
        n = len(self.tid)
        root = np.arange(n)
        size = np.ones(n, np.int64)
        for i in np.flatnonzero(self.some):
            if size.max() > 1 and root[i] == int(np.argmax(size)):
                continue
            among = np.flatnonzero(self.some & (root != root[i]) & (self.tid != self.tid[i]))
            among = self.near(i, among) if len(among) else among
            if not len(among):
                continue
            first, last = self.exact(i, among)
            long = last - first + 1
            for o in np.argsort(-long, kind="stable"):
                k = int(among[o])
                if root[k] == root[i]:
                    continue
                if long[o] >= RUN:
                    span = int(first[o]), int(last[o])
                    got = [(*span, *span, 1.0, exact) for exact in (False, True)]
                else:
                    got = [(*x, False) for x in alike(self.runs[k], self.runs[i], (0,))]
                if got:
                    yield k, i, got
                    into, gone = (root[i], root[k]) if size[root[i]] >= size[root[k]] else (root[k], root[i])
                    root[root == gone] = into
                    size[into] += size[gone]
                    size[gone] = 0


_TIES = _FOUND + ", low int, high int, near int"


def _solve(table: pa.Table) -> pa.Table:
    """Verified pairs of a large group, with the stretches that their windows have in common."""
    tid, at, left, right = (table[c].to_numpy().astype(np.int64) for c in ("text", "at", "left", "right"))
    order = np.lexsort((at, tid))
    stretches = table["mine"].to_pylist()
    tid, at, left, right = tid[order], at[order], left[order], right[order]
    group, out = _Group(tid, left, [stretches[i] for i in order]), []
    for m, lead, got in group.forest():
        _, _, shift, low, high, *_ = _tied(m, lead, tid, at, left, right, np.zeros(len(tid), np.int64))
        for a, b, c, d, s, exact in got:
            out.append((tid[m], at[m] + a - REACH, b - a + SHINGLE, tid[lead], at[lead] + c - REACH, d - c + SHINGLE, s, exact, low, high, shift))
    cols = list(zip(*out, strict=True)) if out else [()] * 11
    types = [pa.int64()] * 6 + [pa.float64(), pa.bool_()] + [pa.int32()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _TIES.split(", ")])


def _solved(large: DataFrame, runs: DataFrame, block: int) -> DataFrame:
    """``large``: text, other (the key), near (the place), low, high and via (the reach). Each pair of a group's blocks is one task's."""
    blocks = large.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = large.join(blocks, "other").withColumn("own", F.pmod(F.xxhash64("text", "near"), "blocks").cast("int"))
    each = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = dealt.withColumn("with", F.explode(each)).select("text", "other", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), F.col("near").alias("at"), F.col("low").alias("left"), F.col("high").alias("right"), "via")
    take = f"substring(runs, (at - least(left, {REACH})) * 4 + 1, (least(left, {REACH}) + via + 1) * 4)"
    told = dealt.join(runs, F.col("text") == F.col("tid")).select("text", "other", "x", "y", "at", "left", "right", F.expr(take).alias("mine"))
    return told.groupBy("other", "x", "y").applyInArrow(_solve, _TIES)


def _spots(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """By text: where runs around tied least shingles start, and what passages cover that it shares with a text of a lesser id.

    So of all texts that share a run the least one, at the end of every such chain, has its run hashed.
    """
    tied = pairs.where("first is not null")
    starts = tied.select(F.col("text").alias("t"), (F.col("first") - RUN + 1).alias("low"), F.col("last").alias("high"))
    starts = starts.unionByName(tied.where("not large").select(F.col("other").alias("t"), (F.col("first") + F.col("near") - RUN + 1).alias("low"), (F.col("last") + F.col("far")).alias("high")))
    starts = starts.groupBy("t", F.floor(F.col("low") / 64).alias("c")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    starts = starts.groupBy("t").agg(F.collect_list(F.struct("low", "high")).alias("spots"))
    covers = found.where("exact and other < text").select(F.col("text").alias("u"), F.col("start").alias("low"), (F.col("start") + F.col("n") - SHINGLE).alias("high"))
    covers = covers.groupBy("u", "low").agg(F.max("high").alias("high")).groupBy("u").agg(F.collect_list(F.struct("low", "high")).alias("covers"))
    return starts.join(covers, F.col("t") == F.col("u"), "left").select("t", "spots", F.coalesce("covers", F.expr("cast(array() as array<struct<low: bigint, high: bigint>>)")).alias("covers"))


def _told(found: DataFrame) -> DataFrame:
    """Every verified pair as a row of its text, and rows of a representative for words that no such row covers.

    The rows of the texts hold all links. One goes only where another one holds its passage, of the same text
    and the same partner on the same diagonal.
    """
    before = lambda *by: Window.partitionBy("text", *by).orderBy("start", F.desc("n"), "back", F.desc("jaccard")).rowsBetween(Window.unboundedPreceding, -1)
    reach = lambda *by: F.max(F.col("start") + F.col("n")).over(before(*by))
    rows = found.select("text", "start", "n", "other", "other_start", "jaccard", F.lit(False).alias("back"))
    rows = rows.withColumn("reach", reach("other", F.col("other_start") - F.col("start"))).where("reach is null or start + n > reach").drop("reach")
    theirs = F.struct(F.col("text").alias("other"), F.col("start").alias("other_start"), F.col("jaccard")).alias("a")
    back = found.select(F.col("other").alias("text"), F.col("other_start").alias("start"), F.col("other_n").alias("n"), theirs)
    # a text that very many others repeat has few different passages
    back = back.groupBy("text", "start", "n").agg(F.min("a").alias("a")).select("text", "start", "n", "a.other", "a.other_start", "a.jaccard", F.lit(True).alias("back"))
    return rows.unionByName(back).withColumn("reach", reach()).where("not back or reach is null or start + n > reach").drop("reach", "back")


def repeated_passages(documents: DataFrame, sets_per_broadcast: int = 4_000_000) -> DataFrame:
    """Passages of LEAST words or more that occur again in a row of ``documents(doc_id, text)``, or in its own text.

    A row: doc_id, start_word, n_words, first_doc_id, first_start, jaccard: the document shares a passage with
    the other one named (or with an earlier place of its own), with a Jaccard similarity of their distinct
    5-word shingles of 0.8 or more. Rows with equal texts are members of one text: the least doc_id stands
    for it, and each other member has one row (of LEAST words or more) that repeats it whole. Only those that
    stand for their texts have the rows of passages. Every verified pair of texts
    has a row; it is not told only where its passage lies within another one of the same text, partner and
    diagonal. A text that others are tied to has rows of its own for words that those do not cover.
    Words count from 0. An exact passage that texts share ties them all, directly or through others that hold
    it too, and so does a near-duplicate that shares a context or two least shingles with the other text, however
    many texts share these. Null, empty and shorter texts have no passages; a null doc_id stays null, rows equal in id
    and text are told once each but the first. Other columns are not read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tid"))
    texts = rows.select("text", "tid")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(T.word_counts(T.plain(batch.column(1))))], ["doc_id", "tid", "words"])

    ids = written(rows.mapInArrow(count, "doc_id long, tid long, words long"), "passages-ids")
    words = ids.agg(F.sum("words")).first()[0] or 0
    buckets = max(12, ceil(words * 0.26 / BUCKET_WINDOWS))
    met = texts.mapInArrow(_deal(buckets), "bucket int, kind int, data binary").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet, _PAIR_TYPE)
    tied = written(_candidates(met), "passages-pairs")
    direct, others, large = (tied.where(which) for which in ("not large and via = other", "not large and via <> other", "large"))

    needed = tied.select(F.col("text").alias("t")).unionByName(tied.where("not large").select(F.col("other").alias("t"))).distinct()
    n = needed.count()
    wanted = None
    if n <= sets_per_broadcast:
        wanted = spark.sparkContext.broadcast(np.sort(needed.toArrow()["t"].to_numpy()) if n else np.array([0], np.int64))
    runs = texts.mapInArrow(_wanted_runs(wanted), "tid long, runs binary")
    if wanted is None:
        runs = runs.join(needed, F.col("tid") == F.col("t"), "left_semi")
    runs = written(runs.groupBy("tid").agg(F.first("runs").alias("runs")), "passages-runs")

    ties = written(_solved(large, runs, BLOCK), "passages-ties")
    more = ties.groupBy("text", "other", F.floor(F.col("near") / DIAGONALS).alias("d")).agg(F.greatest(F.lit(0), F.min("low") - SLACK).alias("low"), (F.max("high") + SLACK).alias("high"), F.min("near").alias("near"), F.max("near").alias("far")).drop("d")
    pair = ("text", "other", "low", "high", "near", "far")
    found = written(_verified(direct.select(*pair).unionByName(more), runs), "passages-found").unionByName(ties.drop("low", "high", "near"))
    found = found.unionByName(written(_verified(written(_open(others, found).select(*pair), "passages-open"), runs), "passages-found"))
    spots = _spots(tied, found)
    rest = runs.join(spots, F.col("tid") == F.col("t")).select("tid", "runs", "spots", "covers")
    found = _told(found.where("not exact").drop("exact").unionByName(_exact(rest, buckets)))

    firsts = ids.groupBy("tid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("first"), F.count(F.lit(1)).alias("copies"))
    named = found.join(firsts.select(F.col("tid").alias("text"), F.col("first").alias("doc_id")), "text").join(firsts.select(F.col("tid").alias("other"), F.col("first").alias("first_doc_id")), "other")
    near = named.select("doc_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "first_doc_id", F.col("other_start").alias("first_start"), "jaccard")
    same = ids.where(F.col("words") >= LEAST).join(firsts.where("copies > 1").withColumnRenamed("tid", "t"), F.col("tid") == F.col("t")).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    same = same.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("n_words"), F.col("first").alias("first_doc_id"), F.lit(0).cast("long").alias("first_start"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)
