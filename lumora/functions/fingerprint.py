"""64-bit identity of a label set: FNV-1a over its pairs by name, each string after its length in 8 bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

_START, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fingerprint(labels: dict[str, str]) -> int:
    """Unsigned."""
    h = _START
    for name, value in sorted(labels.items()):
        for part in (name.encode(), value.encode()):
            for byte in len(part).to_bytes(8, "big") + part:
                h = (h ^ byte) * _PRIME & _MASK
    return h


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(dimension: DataFrame, name: str = "fingerprint") -> DataFrame:
    """A dimension with ``labels`` and a new column of signed fingerprints; meant for distinct label sets, not facts."""
    def run(batches):
        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("labels")).to_pylist()
            out = [None if s is None else signed(fingerprint(dict(s))) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, name])

    return dimension.mapInArrow(run, StructType([*dimension.schema.fields, StructField(name, LongType())]))
