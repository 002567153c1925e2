"""Token ids in length-delimited binary records with a separate offset index.

A record file holds, for each sequence: its length (uint64), the masked checksum of these 8 bytes (uint32),
the payload, and the payload's masked checksum (uint32), all little-endian. A payload is one byte (1: the
document has an id), the id (int64), one byte (bytes per token id: 2 or 4), then the token ids. Checksums are
zlib's CRC-32, rotated right by 15 bits plus a constant, so that a checksum over data holding checksums stays
sound. An index file holds MAGIC and then offset and payload length (uint64 each) of every record, so a
reader can fetch any record, in any order, without the others.

Files are written under names of one attempt each; those of failed or repeated attempts are not in the
manifest and are never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm._shared import columns, table_path, trimmed
from lumora.llm._text import plain, slices

MAGIC = b"LUMIDX01"
MASK = 0xA282EAD8
#: Words that an encoder remembers before it forgets those that it met once; one takes about 60 bytes.
WORDS = 500_000
#: Every so many texts, the tokenizer itself encodes one whole, too, and the ids must agree.
CHECKED = 256


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview | bytes, offset: int) -> tuple[bytes, int]:
    """The payload at an offset, and the offset after it."""
    head = bytes(data[offset : offset + 8])
    n, crc = struct.unpack("<QI", bytes(data[offset : offset + 12]))
    if masked(head) != crc:
        raise ValueError(f"length at {offset} does not match its checksum")
    payload = bytes(data[offset + 12 : offset + 12 + n])
    if len(payload) < n or masked(payload) != struct.unpack("<I", bytes(data[offset + 12 + n : offset + 16 + n]))[0]:
        raise ValueError(f"record at {offset} does not match its checksum")
    return payload, offset + 16 + n


def arrow_uri(path: str) -> str:
    """Hadoop's names of S3 as Arrow has them."""
    return re.sub("^s3[an]://", "s3://", path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """For local paths and the schemes that Arrow knows."""
    path = arrow_uri(path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


_LETTER, _NUMBER, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
#: The byte-level pre-tokenizer's own split, for texts of Latin-1 characters.
_SPLIT = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_KINDS = _OTHER_KIND, _LETTER_KIND, _NUMBER_KIND, _BLANK_KIND, _END_KIND = range(5)
_KIND = np.array([next((k for k, x in ((_LETTER_KIND, _LETTER), (_NUMBER_KIND, _NUMBER), (_BLANK_KIND, _BLANK)) if re.match(f"[{x}]", chr(c))), _OTHER_KIND) for c in range(256)], np.uint8)
#: Words up to so many characters are told apart by two numbers that hold all of them.
SHORT = 15
_PAD = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where ``_SPLIT`` begins a word in Latin-1 texts, each followed by a byte at ``ends`` that counts as a word."""
    kind = _KIND[raw]
    kind[ends] = _END_KIND
    first = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[ends] = True
    blank = kind == _BLANK_KIND
    last = np.flatnonzero(blank[:-1] & ~blank[1:])
    last = last[kind[last + 1] != _END_KIND]
    first[last] = True  # the last of some blanks is apart from the others
    first[last[raw[last] == 32] + 1] = False  # and a space goes with what follows
    at = np.flatnonzero(raw == 39)
    at = at[first[at] & (kind[at] == _OTHER_KIND)]
    at = at[kind[at + 1] == _LETTER_KIND]
    if len(at):
        x, y = raw[at + 1], np.where(kind[at + 2] == _LETTER_KIND, raw[at + 2], 0)
        two = (x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))
        three = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        at, n = at[two | three], np.where(two, 2, 3)[two | three]
        first[at + 1] = False
        after = at + n
        first[after[kind[after] == _LETTER_KIND]] = True
    return np.flatnonzero(first)


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start[i]`` up to ``start[i] + n[i]``, one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, with the ids of words seen before remembered.

    A byte-level tokenizer merges within the words of its pre-tokenizer only, so a text's ids are its words'
    ids in turn. Latin-1 texts are split here, by the same rule, all texts of a call at once, and new words are
    encoded many at a time. Texts with other characters or with a special token's text, and files of another
    pre-tokenizer, go to the tokenizer as they are. Of the split texts one in CHECKED does, too; a difference
    is an error.

    Words have numbers: their ids are a run of ``pool``, and ``table``, open to probing, finds a short word's
    number by all its characters. Number 0 is no word. Long words are found by their bytes in ``long``.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.texts = 0
        with open(file, encoding="utf-8") as f:
            about = json.load(f)
        pre = about.get("pre_tokenizer") or {}
        self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not about.get("normalizer") and about["model"]["type"] == "BPE" and not about["model"].get("dropout")
        self.special = [t["content"] for t in about.get("added_tokens", [])]
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.line = vocab.get("\u010a", -1)
        self._empty()

    def _empty(self) -> None:
        self.words, self.pooled = 1, 0
        self.low, self.high = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.begin, self.count, self.met = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.table = np.zeros(1 << 15, np.int32)
        self.long: dict[bytes, int] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return out

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return (h >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words' numbers, 0 for unknown ones."""
        at = self._slots(low, high)
        out = self.table[at]
        late = np.flatnonzero((out != 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(late):
            at[late] = (at[late] + 1) & (len(self.table) - 1)
            out[late] = now = self.table[at[late]]
            late = late[(now != 0) & ((self.low[now] != low[late]) | (self.high[now] != high[late]))]
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        at = self._slots(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.table[at] == 0
            self.table[at[free]] = numbers[free]
            late = self.table[at] != numbers
            numbers, at = numbers[late], (at[late] + 1) & (len(self.table) - 1)

    def _add(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers new words; ``ids`` has ``n[i]`` for each."""
        a, b = self.words, self.words + len(n)
        if b > len(self.low):
            room = max(b, len(self.low) * 3 // 2)
            for name in ("low", "high", "begin", "count", "met"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(room - len(old), old.dtype))))
        to = self.pooled + len(ids)
        if to > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(to, len(self.pool) * 3 // 2) - len(self.pool), self.dtype)))
        self.low[a:b], self.high[a:b], self.count[a:b], self.met[a:b] = low, high, n, False
        self.begin[a:b] = self.pooled + np.cumsum(n) - n
        self.pool[self.pooled : to] = ids
        self.words, self.pooled = b, to
        numbers = np.arange(a, b, dtype=np.int32)
        if 2 * b > len(self.table):
            self.table = np.zeros(1 << (2 * b).bit_length(), np.int32)
            every = np.arange(1, b, dtype=np.int32)
            self._insert(every[self.high[1:b] != 0])
        else:
            self._insert(numbers[high != 0])
        return numbers

    def _forget(self) -> None:
        """Makes room: only words that were met again since the last time stay, half of WORDS at most."""
        stay = np.flatnonzero(self.met[: self.words])[: WORDS // 2]
        n = self.count[stay]
        low, high, ids = self.low[stay], self.high[stay], self.pool[ragged(self.begin[stay], n)]
        new = np.zeros(self.words, np.int32)
        new[stay] = np.arange(1, len(stay) + 1)
        names = {w: int(new[i]) for w, i in self.long.items() if new[i]}
        self._empty()
        self._add(low, high, n, ids)
        self.long = names

    def _learn(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words at places of ``raw``, and how many each has."""
        lead, next_ = raw[start], _KIND[raw[start + 1]]
        spaced = (lead == 32) & (n > 1) & (next_ != _BLANK_KIND)
        bare = (_KIND[lead] != _BLANK_KIND) & (lead != 39)
        count, parts = np.zeros(len(start), np.int64), []
        for which, between in ((spaced, False), (bare, True), (~spaced & ~bare, None)):
            rows = np.flatnonzero(which)
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                found = self._joined(raw, start[part], n[part], between) if between is not None else None
                if found is None:
                    alone = [np.frombuffer(x, self.dtype) for x in self.whole([raw[a : a + m].tobytes().decode("latin-1") for a, m in zip(start[part].tolist(), n[part].tolist(), strict=True)])]
                    found = np.concatenate(alone), np.array([len(x) for x in alone])
                parts.append((part, found[0]))
                count[part] = found[1]
        begin = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), self.dtype)
        for part, x in parts:
            ids[ragged(begin[part], count[part])] = x
        return ids, count

    def _joined(self, raw: np.ndarray, start: np.ndarray, n: np.ndarray, between: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Of words that stay apart when written one after the other, with a line's end between them or a space of their own."""
        text = raw[ragged(start, n + between)]
        if between:
            text[np.cumsum(n + 1) - 1] = 10
        e = self.tokenizer.encode_batch_fast([text.tobytes().decode("latin-1")], add_special_tokens=False)[0]
        ids = np.array(e.ids, np.int64)
        if between:
            at = np.flatnonzero(ids == self.line)
            if len(at) != len(n):
                return None
            return np.delete(ids, at), np.diff(at, prepend=-1) - 1
        at = np.flatnonzero(self.spaced[ids])
        return (ids, np.diff(at, append=len(ids))) if len(at) == len(n) else None

    def _split_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of Latin-1 texts."""
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size + 1) - 1
        raw = np.frombuffer(b"\0".join([*texts, bytes(_PAD)]), np.uint8)
        total = int(ends[-1]) + 1
        start = word_starts(raw[:total], ends)
        n = np.diff(start, append=total)
        wide = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = wide[start] & _MASKS[np.minimum(n, 8)]
        high = wide[start + 8] & _MASKS[np.clip(n - 8, 0, 7)] | n.astype(np.uint64) << np.uint64(56)
        closing = np.searchsorted(start, ends)
        short = n <= SHORT
        short[closing] = False
        rows = np.flatnonzero(short)
        low, high = low[rows], high[rows]
        numbers = np.zeros(len(start), np.int32)
        numbers[rows] = found = self._find(low, high)
        self.met[found] = True
        new = np.flatnonzero(found == 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            x, y = low[order], high[order]
            at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            one = order[at]
            ids, count = self._learn(raw, start[rows[one]], n[rows[one]])
            learnt = self._add(low[one], high[one], count, ids)
            self.met[learnt] = np.diff(at, append=len(order)) > 1
            numbers[rows[new]] = self._find(low[new], high[new])
        short[closing] = True
        places = np.flatnonzero(~short)
        words = [raw[a : a + m].tobytes() for a, m in zip(start[places].tolist(), n[places].tolist(), strict=True)]
        self.met[[k for w in words if (k := self.long.get(w))]] = True
        late = {w: i for w, i in zip(words, places.tolist(), strict=True) if w not in self.long}
        if late:
            at, none = np.array(list(late.values())), np.zeros(len(late), np.uint64)
            ids, count = self._learn(raw, start[at], n[at])
            self.long.update(zip(late, self._add(none, none, count, ids).tolist(), strict=True))
        numbers[places] = [self.long[w] for w in words]
        self.met[0] = False
        count = self.count[numbers]
        data = self.pool[ragged(self.begin[numbers], count)].tobytes()
        cut = (np.cumsum(count)[closing] * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, bytes] = {}
        for i, t in enumerate(texts):
            if self.split and not any(x in t for x in self.special):
                try:
                    split[i] = t.encode("latin-1")
                except UnicodeEncodeError:
                    continue
        if split:
            for i, b in zip(split, self._split_texts(list(split.values())), strict=True):
                out[i] = b
        late = [i for i, b in enumerate(out) if b is None]
        for i, b in zip(late, self.whole([texts[i] for i in late]), strict=True):
            out[i] = b
        checked = [i for i in split if (self.texts + i) % CHECKED == 0]
        for i in checked:
            alone = np.frombuffer(split[i] + b"\0", np.uint8)
            if word_starts(alone, np.array([len(split[i])]))[:-1].tolist() != [m.start() for m in _SPLIT.finditer(texts[i])]:
                raise ValueError("a text's words begin in other places by the pre-tokenizer's rule")
        if [out[i] for i in checked] != self.whole([texts[i] for i in checked]):
            raise ValueError("the words of a text and the tokenizer disagree")
        self.texts += len(texts)
        if self.words > WORDS or self.pooled > 8 * WORDS:
            self._forget()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Texts that repeat are encoded once."""
        new = list(dict.fromkeys(texts))
        found = dict(zip(new, self._encoded(new), strict=True))
        return [found[t] for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def _write(folder: str, tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        end = np.array([end_id], encode.dtype).tobytes()
        width = encode.dtype.itemsize
        fs, root = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}"
        records = tokens = at = 0
        index: list[int] = []
        out = None
        for batch in batches:
            ids, column = batch.column(0), plain(batch.column(1))
            for a, b in slices(column):
                encoded = encode(column.slice(a, b - a).to_pylist())
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.records", buffer_size=1 << 20)
                for doc_id, body in zip(ids.slice(a, b - a).to_pylist(), encoded, strict=True):
                    payload = b"".join((struct.pack("<BqB", doc_id is not None, doc_id or 0, width), body, end))
                    out.write(frame(payload))
                    index += (at, len(payload))
                    at += len(payload) + 16
                    records += 1
                    tokens += len(body) // width + 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{name}.index") as x:
            x.write(MAGIC + np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name.rpartition("/")[2]], "records": [records], "tokens": [tokens]})
    return trimmed(run)


def read_records(fs: pafs.FileSystem, name: str, window: int = 8 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of each record of a file, by its index, every checksum verified."""
    with fs.open_input_file(f"{name}.index") as x:
        raw = x.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{name}.index: not an index")
    entries = np.frombuffer(raw, "<u8", offset=8).reshape(-1, 2).astype(np.int64)
    with fs.open_input_file(f"{name}.records") as f:
        i = 0
        while i < len(entries):
            first = int(entries[i, 0])
            j = max(i + 1, int(np.searchsorted(entries[:, 0] + entries[:, 1] + 16, first + window, side="right")))
            data = memoryview(f.read_at(int(entries[j - 1].sum()) + 16 - first, first))
            for offset, n in entries[i:j]:
                payload, _ = unframe(data, int(offset) - first)
                if len(payload) != n:
                    raise ValueError(f"{name}: the index does not match the record at {offset}")
                has, doc_id, width = struct.unpack("<BqB", payload[:10])
                yield (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=10)
            i = j


def read_record(fs: pafs.FileSystem, name: str, k: int) -> tuple[int | None, np.ndarray]:
    """The ``k``-th record of a file alone."""
    with fs.open_input_file(f"{name}.index") as x:
        offset, n = struct.unpack("<QQ", x.read_at(16, 8 + 16 * k))
    with fs.open_input_file(f"{name}.records") as f:
        payload, _ = unframe(f.read_at(n + 16, offset), 0)
    has, doc_id, width = struct.unpack("<BqB", payload[:10])
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=10)


def write_records(documents: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Writes ``documents(doc_id, text)`` in ascending doc_id order; returns the manifest, a row per file.

    Null texts count as empty; null doc_ids come first; rows of one doc_id are ordered by text. ``end_id``
    closes every sequence. Other columns are not read. Without rows no file is written.
    Manifest: shard, name, records, tokens, first_token (tokens of all files before), all long but name.
    """
    rows = columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    tie = F.xxhash64("text")  # so that one doc_id with very many rows does not have to fit a range
    # rows that are equal altogether may lie in several files
    ordered = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange("doc_id", tie, "_spread").sortWithinPartitions("doc_id", tie, "text").drop("_spread")
    done = ordered.mapInArrow(_write(folder, tokenizer_file, end_id), "shard long, name string, records long, tokens long").toPandas().sort_values("shard", ignore_index=True)
    done["first_token"] = (done["tokens"].cumsum() - done["tokens"]).astype("int64")
    return documents.sparkSession.createDataFrame(done, "shard long, name string, records long, tokens long, first_token long")


def _digest(folder: str):
    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in read_records(fs, f"{root}/{name}"):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
    return trimmed(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per record of the files: doc_id, start (ids before it), n_tokens, ids_crc32 of its ids as uint32."""
    files = max(1, manifest.count())
    spread = manifest.select("name", "first_token").repartition(min(files, 2000), "name")
    return spread.mapInArrow(_digest(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(documents: DataFrame, tokenizer_file: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the records (by default under the shared folder) and reads each document's digest back from the files."""
    spark = documents.sparkSession
    folder = folder or table_path(spark, "token-records")
    return read_digests(spark, write_records(documents, folder, tokenizer_file, end_id), folder)
