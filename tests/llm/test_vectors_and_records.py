import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import token_records as R
from lumora.llm.hash_forest import nearest
from lumora.llm.registry import byte_bpe
from tests.llm.helpers import corpus, frame

ENCODER = None


def encoder():
    global ENCODER
    ENCODER = ENCODER or R.Encoder(byte_bpe())
    return ENCODER


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\t", "'s", "'", "12", "²", ".", "!?", "<|endoftext|>", "Foo", "œ", "\x85", "\x1c", "_", "\r\n", "漢", "\u00a0", "\u2003", "\xad"]), max_size=12).map("".join)), max_size=4))
def test_encoder_equals_the_tokenizer(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoder()(texts) == encoder().whole(texts)


def test_encoder_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(R, "WORDS", 3)
    e = R.Encoder(byte_bpe())
    for _ in range(3):
        texts = ["one two three four five", "six\nseven eight's"]
        assert e(texts) == e.whole(texts)


def test_encoder_is_checked_against_the_tokenizer(monkeypatch):
    e = R.Encoder(byte_bpe())
    texts = [" ".join(f"w{i * j}" for j in range(300)) for i in range(70)] + ["x" * 50_000, ""]
    monkeypatch.setattr(R, "CHECKED", 8)
    assert e(texts) == e.whole(texts) and e.texts == len(texts)
    broken = R.Encoder(byte_bpe())
    monkeypatch.setattr(R, "_SPLIT", R.re.compile(".{1,3}"))
    with pytest.raises(ValueError):
        broken(["one whole text, split in other places", "x"])


_PIECES = st.one_of(st.characters(max_codepoint=255), st.sampled_from([" ", "  ", "'", "'s", "'re", "'l", "ll", "\n", "\xa0", "a", "1", "!"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(_PIECES, max_size=30).map("".join), min_size=1, max_size=4))
def test_words_begin_where_the_rule_says(texts):
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    raw = np.frombuffer("".join(f"{t}\0" for t in texts).encode("latin-1"), np.uint8)
    want = [e - len(t) + m for t, e in zip(texts, ends.tolist(), strict=True) for m in [*(x.start() for x in R._SPLIT.finditer(t)), len(t)]]
    assert R.word_starts(raw, ends).tolist() == want


def _vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghinorst", k=rng.randint(3, 11))) for _ in range(n)]


def test_known_words_cost_a_small_part_of_the_tokenizers_time():
    words, rng = _vocabulary(20_000, 1), random.Random(2)
    texts = [" ".join(rng.choices(words, k=500)) + "." for _ in range(400)]
    e = R.Encoder(byte_bpe())
    e(texts)
    least = {}
    for _ in range(3):
        for name, f in (("own", e), ("library", e.whole)):
            t = time.process_time()
            f(texts)
            least[name] = min(least.get(name, 1e9), time.process_time() - t)
    assert least["own"] < 0.09 * least["library"]


def test_remembered_words_take_little_memory():
    texts = [" ".join(_vocabulary(1000, i)) for i in range(100)]
    e = R.Encoder(byte_bpe())
    tracemalloc.start()
    for i in range(0, len(texts), 10):
        e(texts[i : i + 10])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 100 * len({w for t in texts for w in t.split()})


def test_long_words_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(R, "WORDS", 50)
    e = R.Encoder(byte_bpe())
    texts = [f"{'long' * n} {'x' * 14}{n % 3} {'x' * 15}{n % 3}\n{'=' * 20} ordinary {n}" for n in range(60)]
    for _ in range(3):
        for i in range(0, 60, 7):
            assert e(texts[i : i + 7]) == e.whole(texts[i : i + 7])
    assert e.words < 150


def test_stores_of_other_names():
    assert R.arrow_uri("s3a://bucket/s3a://x") == "s3://bucket/s3a://x" and R.arrow_uri("file:/a") == "file:/a" and R.filesystem("file:///a/b")[1] == "/a/b"


def test_records_round_trip(spark, tmp_path):
    rows = [*corpus(7), (3, "again"), (None, "no id"), (-5, "first")]
    folder = f"file://{tmp_path}/records"
    docs = frame(spark, rows).repartition(5)
    manifest = R.write_records(docs, folder, byte_bpe(), 2)
    got = R.read_digests(spark, manifest, folder).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    text = {}
    for d, t in rows:
        want = np.array([*encoder().tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        text.setdefault(d, []).append((len(want), zlib.crc32(want.tobytes())))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in text.items()}
    # any record alone, by the index
    fs = pafs.LocalFileSystem()
    first = manifest.orderBy("shard").first()
    name = f"{tmp_path}/records/{first['name']}"
    every = list(R.read_records(fs, name))
    for k in random.Random(1).sample(range(len(every)), min(5, len(every))):
        doc_id, x = R.read_record(fs, name, k)
        assert doc_id == every[k][0] and (x == every[k][1]).all()
    assert [len(x) for _, x in R.read_records(fs, name, window=64)] == [len(x) for _, x in every]
    # a flipped byte is noticed
    with open(f"{name}.records", "r+b") as f:
        f.seek(30)
        byte = f.read(1)
        f.seek(30)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(ValueError):
        list(R.read_records(fs, name))


def test_no_records(spark, tmp_path):
    assert R.token_records(frame(spark, []), byte_bpe(), folder=f"file://{tmp_path}/none").count() == 0


def test_frames():
    data = R.frame(b"abc") + R.frame(b"")
    payload, at = R.unframe(data, 0)
    assert payload == b"abc" and R.unframe(data, at) == (b"", len(data))
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 0x40
        with pytest.raises(ValueError):
            _, at = R.unframe(bytes(broken), 0)
            R.unframe(bytes(broken), at)


def brute(vectors, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in vectors if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1800] = x[1000] + 0.05 * rng.standard_normal((800, 24)).astype(np.float32)
    x[2000:2100] = x[2000]  # many copies of one vector
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    odd = [(9000, None), (9020, []), (9040, [0.0] * 24), (9060, [float("nan")] + [1.0] * 23), (9080, [float("inf")] + [1.0] * 23), (9100, [None] + [1.0] * 23), (None, [1.0] * 24), (9120, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, score string")
    queries = table.where("vec_id % 20 = 0")
    got = {}
    for r in nearest(table, queries, k=20, block_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, rows[::20], 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.9
    exact = {q: {i: float(np.dot(np.float64(x[q]), np.float64(x[i]))) for i, _ in got[q]} for q in got}
    assert all(abs(s - exact[q][i]) < 1e-9 for q in got for i, s in got[q])
    copies = [i for i, _ in got[2000]]
    assert copies == sorted(copies) and copies[0] == 2001  # ties go to the smaller id


def test_nearest_among_equal_vectors(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((500, 32))
    x[:15] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(table, table.where("vec_id < 15"), k=20).orderBy("query_id", "rank").collect()
    for q in range(15):
        mine = [r["vec_id"] for r in got if r["query_id"] == q]
        assert len(set(mine)) == 20 and mine[:14] == [i for i in range(15) if i != q]


def test_each_query_row_is_a_query(spark):
    rng = np.random.default_rng(16)
    rows = [(i % 90, v.tolist()) for i, v in enumerate(rng.standard_normal((100, 16)))] + [(20, [1.0] * 16), (20, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(table, "vec_id % 20 = 0", k=12, block_rows=30).collect()
    asked = [i for i, (d, _) in enumerate(rows) if d % 20 == 0]
    want = []
    for i in asked:
        scored = sorted((-float(np.dot(rows[i][1], y)), d) for j, (d, y) in enumerate(rows) if j != i)
        want += [(rows[i][0], r + 1, d, round(-s, 9)) for r, (s, d) in enumerate(scored[:12])]
    # blocks of 30 are searched whole, so the result is exact
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_a_query_of_another_length(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(table, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 2.0)]
    assert nearest(table.limit(0), "vec_id % 20 = 0").count() == 0


def test_nearest_with_few_vectors(spark):
    table = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = nearest(table, table.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert nearest(table.limit(0), table).count() == 0 and nearest(table, table.limit(0)).count() == 0
