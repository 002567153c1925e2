import glob
import os

import duckdb
import pytest

from lumora import catalog

DATA = "/root/testdata/sf0.001"


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    got = rows(map(tuple, frame.collect()), frame.columns)
    if name not in catalog.SQL:
        assert got
        return
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.execute(catalog.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows(want.fetchall(), names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_storage_queries_store_all_samples(spark):
    store, _ = catalog._stored(spark, DATA)
    events = f"'{DATA}/events.parquet'"
    n, low, high = duckdb.connect().execute(f"SELECT count(*), min(epoch_ms(ts) // 3600000), max(epoch_ms(ts) // 3600000) FROM {events}").fetchone()
    blocks = store.blocks()
    assert len(blocks) == 3 and sum(b.samples for b in blocks) == n
    store.maintain(0, ranges=[128 * catalog.HOUR, 40_000 * catalog.HOUR])
    (merged,) = store.blocks()
    kept = duckdb.connect().execute(f"SELECT count(DISTINCT (event_type, user_id, epoch_ms(ts) // 3600000)) FROM {events}").fetchone()[0]
    assert (merged.samples, merged.min_ts // catalog.HOUR, merged.max_ts // catalog.HOUR) == (kept, low, high)
