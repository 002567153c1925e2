import glob
import os
import random

import duckdb
import numpy as np
import psutil
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lumora.llm import _shared
from lumora.llm import _text as T
from lumora.llm.decontaminate import WINDOW
from lumora.llm.registry import oracle_sql, queries
from tests.llm.helpers import changed, prose, shingles


def tables(folder, seed=1, n=300):
    rng = random.Random(seed)
    bench = [(i, prose(rng, 30)) for i in range(5)]
    docs, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(20, 90))
        toxic = i % 6 == 0
        if toxic:
            text = f"blargh {text} zorkling blargh"
        if i % 25 == 7:
            text += " " + bench[i % 5][1]
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, changed(rng, docs[1][1], i % 2), "en", "s1", 1) for i in range(6)] + [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (None, "no id at all here", "en", "s0", 3)]
    write = lambda name, cols, rows: pq.write_table(pa.table({c: [r[k] for r in rows] for k, c in enumerate(cols)}), f"{folder}/{name}.parquet")
    write("documents", ("doc_id", "text", "lang", "source", "n_chars"), docs)
    write("labels", ("doc_id", "quality", "toxic"), labels)
    write("benchmark", ("item_id", "text"), bench)
    return docs, bench


def test_every_stage(spark, tmp_path):
    docs, bench = tables(tmp_path)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_records"]
    kept, last = given, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == given.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
        ids = sorted(d for d, _ in rows if d is not None)
        new = [r["doc_id"] for r in out.collect()]
        if name == "toxicity":
            assert sorted(x for x in new if x is not None) == [d for d in ids if not (d % 6 == 0 and d < 1000)]
        elif name == "ngram_jaccard_join":
            sets = {d: shingles(t) for d, t in rows if d is not None}
            link = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a]
            gone = set(ids) - set(new)
            assert gone == {b for b in ids if any(a < b and link(a, b) for a in ids)} and None in new
        elif name == "benchmark_decontamination":
            assert set(ids) - set(new) == {d for d, t in rows if d is not None and any(b in (t or "") for _, b in bench)} and WINDOW < 30
        elif name == "source_mixing":
            assert set(new) <= {d for d, _ in rows} and max(new.count(x) for x in set(new)) <= 2
        else:
            assert sorted(map(str, new)) == sorted(map(str, last))
        kept, last = out, new


def test_jaccard_stage_decides_by_row(spark, tmp_path):
    rng = random.Random(9)
    clean, near, unnamed = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, near), (2, clean), (2, changed(rng, near, 1)), (3, ""), (4, None), (None, unnamed), (None, changed(rng, unnamed, 1)), (5, prose(rng, 40))]
    got = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame([*rows, *rows], "doc_id long, text string"), str(tmp_path)).collect()
    named = sorted((r["doc_id"], r["text"] or "") for r in got if r["doc_id"] is not None)
    assert named == [(1, near), (2, clean), (3, ""), (4, ""), (5, rows[-1][1])]
    assert len([r for r in got if r["doc_id"] is None]) == 1


def test_run_equals_its_stages(spark, tmp_path):
    tables(tmp_path, seed=2, n=120)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.execute(oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = queries()[name](spark, "/root/testdata/sf0.001").select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_stages_take_odd_tables(spark, tmp_path):
    tables(tmp_path, n=60)
    wide = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, h long, score double, setid long, did long, _row string, jaccard string"
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (1, "same text here", None, "s", 1), (1, "same text here", None, "s", 1), (2, "x " * 30_000, "en", "s", 1)]
    odd = spark.createDataFrame([(*r, "k", 1, 2, 0.5, 3, 4, "r", "j") for r in rows], wide)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        assert name == "token_records" or out.columns == odd.columns
        got = sorted(str((r["doc_id"], r["text"] and r["text"][:20])) if name != "token_records" else str(r["doc_id"]) for r in out.collect())
        if name in ("toxicity", "benchmark_decontamination"):
            assert len(got) == 5
        elif name == "ngram_jaccard_join":
            assert len(got) == 4 and got.count("(1, 'same text here')") == 1
        elif name == "source_mixing":
            assert set(got) <= {"(1, 'same text here')", "(2, 'x x x x x x x x x x ')"} and got
        else:
            assert got == sorted(["None", "None", "1", "1", "2"])
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
    assert T.SLICE_BYTES > 0


def test_a_finished_task_gives_its_memory_back(monkeypatch):
    def task(batches):
        for _ in batches:
            held = [np.ones(8000) for _ in range(3000)]  # 192 MB in pieces of the heap
            pinned.extend(held[::100])
            yield len(held)

    pinned, size = [], lambda: psutil.Process().memory_info().rss
    monkeypatch.setattr(_shared, "_trimmed", [0.0])
    before = size()
    assert list(_shared.trimmed(task)([0])) == [3000]
    assert size() - before < 64e6


def test_tables_for_hashing_fit_a_slice(monkeypatch):
    monkeypatch.setattr(T, "_powers", {})
    column = T.plain(pa.array(["some words of a short text"] * 20))
    T.words(column)
    assert sum(x.nbytes for x in T._powers.values()) < 17 * T.SLICE_BYTES
    long = T.plain(pa.array(["a " * 700_000 + "b"]))
    assert len(T.words(long).hashes) == 700_001 and len(set(T.words(long).hashes.tolist())) == 2
