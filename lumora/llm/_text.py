"""Vectorised words and shingles of Arrow string columns.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case. A word's
hash is a polynomial over a random byte table modulo 2**64, taken from prefix sums, so a column is
hashed without a loop over its words. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_RATIO = 0x9E3779B97F4A7C15
_INVERSE = pow(_RATIO, -1, 1 << 64)
_STEPS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(33)
        x *= U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(33)
    return x


def _power_table(ratio: int, n: int) -> np.ndarray:
    have = _powers.get(ratio)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            table = np.full(max(n + n // 4, SLICE_BYTES + 1), ratio, dtype=np.uint64)
            table[0] = 1
            have = _powers[ratio] = np.multiply.accumulate(table)
    return have[:n]


@dataclass
class Words:
    """Words of some texts: text ``d`` has the words ``ptr[d]:ptr[d + 1]``; offsets count bytes in ``data``."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column from ``plain``."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text has one of its own."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, len(column))
        at = to


def words(column: pa.Array) -> Words:
    """The words of a column from ``plain``."""
    raw, offsets = buffers(column)
    data = LOWER[raw]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(column) + 1, np.int64), data)
    inside = ~SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power_table(_RATIO, n), out=sums[1:])
        hashes = (sums[end] - sums[start]) * _power_table(_INVERSE, n)[start]
        hashes = mix(hashes + (end - start).astype(np.uint64) * U64(_STEPS[7]))
    return Words(hashes, start, end, np.searchsorted(start, offsets), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, as if all words were one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, U64(k * 0x5851F42D4C957F2D & (1 << 64) - 1))
        for i in range(k):
            total = mix(total + hashes[i : i + n] * U64(_STEPS[i % 7])) if i % 4 == 3 else total * U64(_STEPS[(i + 3) % 7]) + hashes[i : i + n]
        return mix(total)


def shingle_sets(w: Words, k: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct ``k``-word shingles, sorted, and each set's 64-bit digest.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    runs = grams(w.hashes, k)
    out, digests = [], np.zeros(len(w.ptr) - 1, np.uint64)
    for d in range(len(w.ptr) - 1):
        a, b = int(w.ptr[d]), int(w.ptr[d + 1])
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            s = grams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        out.append(s)
        if len(s):
            with np.errstate(over="ignore"):
                digests[d] = mix(s ^ U64(_STEPS[0])).sum(dtype=np.uint64) ^ (mix(s + U64(_STEPS[1])).sum(dtype=np.uint64) * U64(_STEPS[2]))
    return out, mix(digests)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text of a column from ``plain``, without hashing them."""
    out = []
    for a, b in slices(column):
        raw, offsets = buffers(column.slice(a, b - a))
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        first[edges] = inside[edges]
        total = np.concatenate(([0], np.cumsum(first)))
        out.append(np.diff(total[offsets]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)
