"""Exact n-gram Jaccard self-join of documents, by prefix lists and set relations.

1. Every document becomes its set of distinct word shingles (64-bit hashes); equal sets share a digest,
   so exact copies are one set from here on.
2. Rare-first prefixes. Shingles go in packed blocks to counting groups, which return how many sets hold
   each; shingles in one set only are dropped there. Ordered by that count, a set may stop once more of its
   shingles are unique than its partners could miss. Of sets above ``SMALL`` shingles only the low half of the
   hash space is counted: a partner misses at most as many of that half as of the whole, so nothing is lost. A
   set that has too few shingles there to tell is joined over the high half, too, and with it every set that
   could be its partner: those with at most 45 % of their shingles in the low half.
   Shingles that very many sets hold never travel by document: their counts are known to the map side.
3. Sets that share a prefix shingle are joined into candidate classes, which are exact supersets of the
   linked classes. A class is solved by ``linked_sets`` in memory; one above ``class_shingles`` is dealt in
   blocks by size, and every two blocks whose sizes are near enough for a link are solved together, so no
   class is ever gathered whole.
4. ``linked_sets`` finds links by two relations between sets: lists of prefix positions are cut where no
   later entry can reach the threshold (index skipping), which leaves a set's possible partners; their
   overlaps are counted one by one, or along the lists, or derived from those of a highly similar set through
   the few shingles in which both differ, whichever is the least work.

Digests have 64 bits; two different sets of one corpus meet in a digest with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm import _text as T
from lumora.llm._shared import columns, trim, trimmed, written
from lumora.llm.components import connected

U64 = np.uint64
#: Sets up to SMALL shingles are joined over all shingles, sets above 4/5 of REACH over the sampled half.
SMALL, REACH = 128, 160
FLUSH_SHINGLES, FLUSH_SETS = 1_000_000, 60_000
#: A shingle in more than this share of all documents, and in HOT_LEAST, is counted ahead. There are at most (shingles of an average document) / HOT_SHARE such.
HOT_SHARE, HOT_LEAST = 0.002, 1000
_SMALL_SPACE = U64(0x6A09E667F3BCC909)


def _least_partner(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return (n * num + den - 1) // den


def _setid(digests: np.ndarray) -> np.ndarray:
    """Digests as the names of sets; their last two bits number the spaces that a set is joined in."""
    return digests.view(np.int64) >> 2 << 2


def _join_spaces(sets: list[np.ndarray], digests: np.ndarray, small: int = SMALL, reach: int = REACH):
    """(virtual id, n, 56-bit keys) of each set in each of the spaces it is joined in."""
    for s, d in zip(sets, digests, strict=True):
        d = d & ~U64(3)
        if 0 < len(s) <= reach:
            yield d, len(s), np.unique(T.mix(s ^ _SMALL_SPACE) >> U64(8))
        if len(s) > small:
            cut = int(np.searchsorted(s, U64(1 << 63)))
            yield d | U64(1), len(s), np.unique(s[:cut] >> U64(8))
            # one with 1/5 of its shingles below the cut, or fewer, shares 4/5 with a partner of at most 5/4 its size
            if 20 * cut <= 9 * len(s):
                yield d | U64(2), len(s), np.unique(s[cut:] >> U64(8))


def _flushes(batches: Iterator[pa.RecordBatch], k: int):
    """Sets of a partition in portions of FLUSH_SETS at most: size and keys by virtual id, each set once a portion."""
    seen: dict[int, tuple[int, np.ndarray]] = {}
    held = 0
    for batch in batches:
        column = T.plain(batch.column(0))
        for a, b in T.slices(column):
            sets, digests = T.shingle_sets(T.words(column.slice(a, b - a)), k)
            for vid, n, keys in _join_spaces(sets, digests):
                if int(vid) not in seen:
                    seen[int(vid)] = n, keys
                    held += len(keys)
                if len(seen) >= FLUSH_SETS:  # a set's number within a portion has 16 bits
                    yield seen
                    seen, held = {}, 0
            if held >= FLUSH_SHINGLES:
                yield seen
                seen, held = {}, 0
    if seen:
        yield seen


def _portion(seen: dict[int, tuple[int, np.ndarray]]):
    vids = np.array(sorted(seen), np.uint64)
    n = np.array([seen[int(v)][0] for v in vids], np.int64)
    keys = [seen[int(v)][1] for v in vids]
    m = np.array([len(x) for x in keys], np.int64)
    return vids, n, m, np.concatenate(keys), np.repeat(np.arange(len(vids)), m)


def _counts_ahead(k: int):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(1), T.plain(batch.column(0))
            for a, b in T.slices(column):
                sets, digests = T.shingle_sets(T.words(column.slice(a, b - a)), k)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(_setid(digests), mask=n == 0)], ["doc_id", "n", "setid"])
    return trimmed(run)


def _frequent(k: int):
    """Shingles that are frequent within a portion, with their number of sets there."""
    def run(batches):
        for seen in _flushes(batches, k):
            vids, _, _, keys, _ = _portion(seen)
            keys.sort()
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            count = np.diff(np.append(at, len(keys)))
            often = count >= max(32, len(vids) // 200)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at[often]].view(np.int64)), pa.array(count[often].astype(np.int64))], ["key", "sets"])
    return trimmed(run)


def _planes(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted keys, one byte position after the other: the high ones compress to nothing."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


_BLOCK = "bucket int, portion long, kind int, keys binary, refs binary"


def _blocks(k: int, buckets: int, hot):
    """Each portion's keys by bucket; kind 1 holds what needs no counting: ids, sizes and the hot keys."""
    def run(batches):
        often = hot.value[0]
        for seen in _flushes(batches, k):
            vids, n, m, keys, ref = _portion(seen)
            with np.errstate(over="ignore"):
                portion = int(T.mix(vids).sum(dtype=np.uint64).view(np.int64))
            order = np.argsort(keys, kind="stable")
            keys, ref = keys[order], ref[order].astype(np.uint16)
            known = np.zeros(len(keys), bool)
            if len(often):
                known = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
            head = np.concatenate([np.array([len(vids), known.sum()], np.int64).view(np.uint8), vids.view(np.uint8), n.view(np.uint8), m.view(np.uint8), keys[known].view(np.uint8), ref[known].view(np.uint8)])
            rows = [(portion % buckets, portion, 1, head.tobytes(), b"")]
            keys, ref = keys[~known], ref[~known]
            bucket = ((keys >> U64(24)) * U64(buckets)) >> U64(32)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows.append((int(bucket[a]), portion, 0, _planes(keys[a:b], 7), _planes(ref[a:b].astype(np.uint64), 2)))
            for i in range(0, len(rows), 64):
                part = list(zip(*rows[i : i + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())], ["bucket", "portion", "kind", "keys", "refs"])
    return trimmed(run)


def _count_bucket(table: pa.Table) -> pa.Table:
    """For each portion of a bucket the keys that two sets hold, with the number of sets; single keys end here."""
    trim()
    portions, kinds = table["portion"].to_numpy(), table["kind"].to_numpy()
    data, refs = table["keys"], table["refs"]
    out: list[tuple] = [(int(portions[i]), 1, data[i].as_py(), b"", b"") for i in np.flatnonzero(kinds == 1)]
    rows = np.flatnonzero(kinds == 0)
    if len(rows):
        each = [_unplane(data[int(i)].as_py(), 7) for i in rows]
        ref = [_unplane(refs[int(i)].as_py(), 2) for i in rows]
        size = [len(x) for x in each]
        keys = np.concatenate(each)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        sets = np.repeat(np.diff(np.append(at, len(ranked))), np.diff(np.append(at, len(ranked))))
        count = np.empty(len(keys), np.int64)
        count[order] = sets
        done = 0
        for i, r, n in zip(rows, ref, size, strict=True):
            c = count[done : done + n]
            kept = c > 1
            if kept.any():
                out.append((int(portions[i]), 0, _planes(keys[done : done + n][kept], 7), _planes(r[kept], 2), np.minimum(c[kept], 2**32 - 1).astype("<u4").tobytes()))
            done += n
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["portion", "kind", "keys", "refs", "counts"])


_COUNTED = "portion long, kind int, keys binary, refs binary, counts binary"


def _prefixes(num: int, den: int, hot):
    """Prefix postings of one portion: key and set."""
    def run(table: pa.Table) -> pa.Table:
        trim()
        kinds = table["kind"].to_numpy()
        head = np.frombuffer(table["keys"][int(np.flatnonzero(kinds == 1)[0])].as_py(), np.uint8)
        s, h = head[:16].view(np.int64)
        vids, n, m = (head[16 + 8 * i * s : 16 + 8 * (i + 1) * s].view(np.uint64).astype(np.int64 if i else np.uint64) for i in range(3))
        rest = head[16 + 24 * s :]
        keys, refs = [rest[: 8 * h].copy().view(np.uint64)], [rest[8 * h :].copy().view(np.uint16).astype(np.int64)]
        often, times = hot.value
        counts = [times[np.searchsorted(often, keys[0])] + (1 << 40) if h else np.zeros(0, np.int64)]
        for i in np.flatnonzero(kinds == 0):
            keys.append(_unplane(table["keys"][int(i)].as_py(), 7))
            refs.append(_unplane(table["refs"][int(i)].as_py(), 2).astype(np.int64))
            counts.append(np.frombuffer(table["counts"][int(i)].as_py(), "<u4").astype(np.int64))
        keys, refs, counts = np.concatenate(keys), np.concatenate(refs), np.concatenate(counts)
        order = np.lexsort((keys, counts, refs))
        keys, refs = keys[order], refs[order]
        shared = np.bincount(refs, minlength=s)
        place = np.arange(len(keys)) - np.repeat(np.concatenate(([0], np.cumsum(shared)[:-1])), shared) + (m - shared)[refs]
        most = n - _least_partner(n, num, den)
        kept = place <= most[refs]
        return pa.table([pa.array(keys[kept].view(np.int64)), pa.array(_setid(vids[refs[kept]]))], ["key", "setid"])
    return run


class _Lists:
    """Sets of one class, numbered by size, and their shingles' lists."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(x) for x in sets])
        flat, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ptr = np.concatenate(([0], np.cumsum(size)))
        self.size, self.width = size, len(flat)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(self.ids, kind="stable")
        self.entries = owner[order]
        self.count = np.bincount(self.ids, minlength=self.width)
        self.at = np.concatenate(([0], np.cumsum(self.count)))
        rank = np.lexsort((self.ids, self.count[self.ids], owner))
        self.ranked = self.ids[rank]  # each set's shingles, rare ones first
        self.place, self.owner = np.arange(len(rank)) - np.repeat(self.ptr[:-1], size), owner

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.ptr[i] : self.ptr[i + 1]]

    def spread(self, sets: np.ndarray) -> np.ndarray:
        """The shingles of several sets, one set after the other."""
        n = self.size[sets]
        return self.ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ptr[sets], n)]

    def cost(self, ids: np.ndarray) -> int:
        return int(self.count[ids].sum())

    def overlaps(self, ids: np.ndarray) -> np.ndarray:
        """How many of ``ids`` each set holds."""
        n = self.count[ids]
        total = int(n.sum())
        if not total:
            return np.zeros(len(self.size), np.int64)
        where = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[ids], n)
        return np.bincount(self.entries[where], minlength=len(self.size))


def linked_sets(sets: list[np.ndarray], num: int = 4, den: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All links ``(i, j), i < j`` with den * |i & j| >= num * |i | j| among distinct sets of shingles."""
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_size = np.argsort([len(x) for x in sets], kind="stable")
    lists = _Lists([sets[i] for i in by_size])
    size = lists.size
    need = lambda a, b: (num * (a + b) + num + den - 1) // (num + den)  # noqa: E731  least overlap of a link
    # Index skipping: prefix entries by list and position; an entry past a partner's reach ends its list.
    most = size - _least_partner(size, num, den)
    early = lists.place <= most[lists.owner]
    key, who, place = lists.ranked[early], lists.owner[early], lists.place[early]
    order = np.lexsort((place, key))
    key, who, place = key[order], who[order], place[order]
    head = np.searchsorted(key, np.arange(lists.width + 1))
    left, right = [], []
    hub: tuple[np.ndarray, np.ndarray] | None = None
    held = np.zeros(lists.width, bool)
    for x in range(1, len(sets)):
        n = int(size[x])
        low = int(np.searchsorted(size, _least_partner(np.int64(n), num, den)))
        if low >= x:
            continue
        mine = lists.ranked[lists.ptr[x] : lists.ptr[x] + int(most[x]) + 1]
        near = []
        for pos, t in enumerate(mine):
            a, b = head[t], head[t + 1]
            if b - a < 2:
                continue
            # a smaller partner of size s has its first common shingle at s - need(n, s) or before, which grows with s
            b = a + np.searchsorted(place[a:b], n - need(n, n), side="right")
            y, at = who[a:b], place[a:b]
            # what is left of both from their first common shingle on must suffice
            near.append(y[(y < x) & (y >= low) & (np.minimum(n - pos, size[y] - at) >= need(n, size[y]))])
        y = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
        if not len(y):
            continue
        ids = lists.of(x)
        costs = [int(size[y].sum()), lists.cost(ids)]
        if hub is not None:
            gone, come = np.setdiff1d(hub[0], ids, assume_unique=True), np.setdiff1d(ids, hub[0], assume_unique=True)
            costs.append(lists.cost(gone) + lists.cost(come))
        cheapest = int(np.argmin(costs))
        if cheapest == 0:  # few partners are possible: only these are compared
            held[ids] = True
            both = np.add.reduceat(held[lists.spread(y)], np.concatenate(([0], np.cumsum(size[y])[:-1])), dtype=np.int64)
            held[ids] = False
        elif cheapest == 2:
            both = (hub[1] - lists.overlaps(gone) + lists.overlaps(come))[y]  # the other set's answers, brought up to date
        else:
            hub = ids, lists.overlaps(ids)
            both = hub[1][y]
        y = y[den * both >= num * (n + size[y] - both)]
        left.append(y)
        right.append(np.full(len(y), x))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = by_size[np.concatenate(left)], by_size[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def _sets_of(k: int, wanted):
    """Shingles of the wanted sets, each once a batch."""
    def run(batches):
        ids = wanted.value if wanted is not None else None
        for batch in batches:
            column, have = T.plain(batch.column(0)), set()
            for a, b in T.slices(column):
                sets, digests = T.shingle_sets(T.words(column.slice(a, b - a)), k)
                digests = _setid(digests)
                keep = np.array([len(s) > 0 for s in sets], bool)
                if ids is not None:
                    keep &= ids[np.minimum(np.searchsorted(ids, digests), len(ids) - 1)] == digests
                rows = [i for i in np.flatnonzero(keep) if int(digests[i]) not in have and not have.add(int(digests[i]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(digests[rows]), pa.array([sets[i].tobytes() for i in rows], pa.binary())], ["setid", "shingles"])
    return trimmed(run)


def _solve_classes(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        trim()
        root, setid, first, copies = (table[c].to_numpy() for c in ("root", "setid", "first", "copies"))
        order = np.argsort(root, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(root[order]) != 0, [True]))) if len(order) else [0]
        out = [[], [], []]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows = order[a:b]
            x, y = linked_sets([np.frombuffer(table["shingles"][int(i)].as_py(), np.uint64) for i in rows], num, den)
            n = copies[rows] - 1
            np.add.at(n, x, copies[rows][y])
            np.add.at(n, y, copies[rows][x])
            out[0].append(setid[rows])
            out[1].append(_roots(x, y, first[rows]))
            out[2].append(n)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table([pa.array(x) for x in flat], ["setid", "component", "links"])
    return run


def _roots(x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The smallest value in each set's component."""
    label = value.copy()
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == label).all():
            return label
        label = new


def _solve_blocks(num: int, den: int):
    """Links between two blocks of a large class, or within one."""
    def run(table: pa.Table) -> pa.Table:
        trim()
        setid, copies, block, i, j = (table[c].to_numpy() for c in ("setid", "copies", "block", "i", "j"))
        x, y = linked_sets([np.frombuffer(v.as_py(), np.uint64) for v in table["shingles"]], num, den)
        if len(i) and i[0] != j[0]:
            keep = block[x] != block[y]
            x, y = x[keep], y[keep]
        n = np.zeros(len(setid), np.int64)
        np.add.at(n, x, copies[y])
        np.add.at(n, y, copies[x])
        tied = _roots(x, y, setid)
        return pa.table([pa.array(setid), pa.array(tied), pa.array(n)], ["setid", "other", "links"])
    return run


def jaccard_classes(documents: DataFrame, num: int = 4, den: int = 5, k: int = 5, class_shingles: int = 1_500_000, sets_per_broadcast: int = 4_000_000) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_shingles, component_id, n_links (all long).

    Two rows link if den * |A & B| >= num * |A | B| for their sets of distinct ``k``-word shingles; the sets
    of rows with a null, empty or blank text are empty and link with nothing (component_id is their own
    doc_id). component_id is the smallest doc_id that links reach; n_links counts linked rows, copies
    included. Rows with equal doc_id and equal text count as copies. A null doc_id stays null and is never a
    component's name unless no member has another. Other columns are not read. Empty in, empty out.
    """
    spark = documents.sparkSession
    text, both = columns(documents, "text"), columns(documents, "text", "doc_id")
    both = both.select("text", F.col("doc_id").cast("long"))
    meta = written(both.mapInArrow(_counts_ahead(k), "doc_id long, n long, setid long"), "jaccard-sets")
    rows, shingles = meta.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = meta.where("n > 0").groupBy("setid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))

    least = max(HOT_LEAST, HOT_SHARE * rows)
    hot = text.mapInArrow(_frequent(k), "key long, sets long").groupBy("key").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= least).orderBy("key").toArrow()
    hot = spark.sparkContext.broadcast((hot["key"].to_numpy().view(np.uint64), hot["sets"].to_numpy()))
    buckets = max(12, ceil(shingles / 750_000))
    counted = text.mapInArrow(_blocks(k, buckets, hot), _BLOCK).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count_bucket, _COUNTED)
    listed = written(counted.groupBy("portion").applyInArrow(_prefixes(num, den, hot), "key long, setid long").distinct(), "jaccard-postings")
    hubs = listed.groupBy("key").agg(F.min("setid").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    edges = listed.join(hubs, "key").where("setid <> hub").select(F.col("setid").alias("a"), F.col("hub").alias("b"))
    classes = written(connected(edges, "jaccard-candidates").withColumnsRenamed({"node": "setid"}), "jaccard-classes").join(groups, "setid")
    members = classes.select("setid", "root", "first", "copies")

    some = members.count()
    wanted = None
    if some <= sets_per_broadcast:
        ids = np.sort(members.select("setid").toArrow()["setid"].to_numpy()) if some else np.array([0], np.int64)
        wanted = spark.sparkContext.broadcast(ids)
    sets = text.mapInArrow(_sets_of(k, wanted), "setid long, shingles binary").join(members, "setid")
    sets = written(sets.groupBy("setid").agg(F.first("shingles").alias("shingles"), F.first("root").alias("root"), F.first("first").alias("first"), F.first("copies").alias("copies")), "jaccard-members")
    sized = sets.groupBy("root").agg((F.sum(F.length("shingles")) / 8).cast("long").alias("total"))
    small = sets.join(sized.where(F.col("total") <= class_shingles), "root")
    packs = int(max(12, ceil((sized.agg(F.sum("total")).first()[0] or 0) / 400_000)))
    solved = small.withColumn("pack", F.pmod(F.xxhash64("root"), F.lit(packs))).groupBy("pack").applyInArrow(_solve_classes(num, den), "setid long, component long, links long")
    large = sized.where(F.col("total") > class_shingles)
    if large.limit(1).count():
        solved = solved.unionByName(_large_classes(sets.join(large, "root"), num, den, class_shingles))
    solved = solved.withColumnRenamed("setid", "s")
    told = groups.join(solved, F.col("setid") == F.col("s"), "left").select("setid", F.coalesce("component", "first").alias("component"), F.coalesce("links", F.col("copies") - 1).alias("links"))
    return meta.withColumnRenamed("setid", "own").join(told, F.col("own") == F.col("setid"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def _large_classes(sets: DataFrame, num: int, den: int, class_shingles: int) -> DataFrame:
    """Classes too large for a task are dealt in blocks by size; blocks whose sizes allow a link meet, two at a time."""
    sets = sets.withColumn("size", (F.length("shingles") / 8).cast("long"))
    part = class_shingles // 2
    # sets of one size fill the range of blocks that their shingles take up in the order of sizes
    counts = sets.groupBy("root", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("held"))
    up_to = F.sum("held").over(Window.partitionBy("root").orderBy("size"))
    counts = counts.withColumn("from", F.floor((up_to - F.col("held")) / part)).withColumn("to", F.floor((up_to - 1) / part))
    places = written(counts.select("root", "size", F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to")), "jaccard-places")
    blocks = places.withColumn("b", F.explode(F.sequence("from", "to"))).groupBy("root", "b").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = blocks.select("root", F.col("b").alias("c"), F.col("low").alias("low2"))
    meet = blocks.join(other, "root").where(f"b <= c and low2 * {num} <= high * {den}").select("root", "b", "c")
    meet = meet.select("root", F.col("b").alias("i"), F.col("c").alias("j"))
    sides = meet.select("root", F.col("i").alias("block"), "i", "j").unionByName(meet.where("i < j").select("root", F.col("j").alias("block"), "i", "j"))
    sides = written(sides, "jaccard-meetings")
    placed = sets.join(places, ["root", "size"]).withColumn("block", (F.col("from") + F.pmod(F.xxhash64("setid"), F.col("to") - F.col("from") + 1)).cast("int"))
    dealt = placed.select("root", "block", "setid", "copies", "shingles").join(sides, ["root", "block"])
    met = written(dealt.select("root", "i", "j", "setid", "copies", "block", "shingles").groupBy("root", "i", "j").applyInArrow(_solve_blocks(num, den), "setid long, other long, links long"), "jaccard-blocks")
    roots = connected(met.select(F.col("setid").alias("a"), F.col("other").alias("b")), "jaccard-large")
    own = sets.select("setid", "first", "copies").distinct()
    links = met.groupBy("setid").agg(F.sum("links").alias("found"))
    named = own.join(roots.withColumnRenamed("node", "setid"), "setid", "left").withColumn("root", F.coalesce("root", "setid"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least, "root").join(links, "setid").select("setid", "component", (F.col("found") + F.col("copies") - 1).alias("links"))
