"""A bit array of fixed size that tells which rows may have a wanted id, to shuffle the texts
of few others. What it lets through is joined exactly; it only saves work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

FILTER_BITS = 23  # 1 MB


def _places(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> bytes:
    """The array of the one column of ``ids``, 64-bit numbers without null."""
    import pyarrow as pa

    def work(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def merge(batches):
        total = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            for x in batch.column(1):
                total |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    total = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in ids.mapInArrow(work, schema).repartition(8).mapInArrow(merge, schema).toLocalIterator():
        total |= np.frombuffer(bytes(r.bits), np.uint8)
    return total.tobytes()


def may_hold(array: bytes, ids: np.ndarray) -> np.ndarray:
    """Booleans: True for every id of the array, and for some others."""
    at = _places(ids)
    return (np.frombuffer(array, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def passing(rows: DataFrame, column: str, array: bytes, inside: bool = True) -> DataFrame:
    """The rows that may have an id of the array in ``column``; or, not ``inside``, all others."""
    import pyarrow as pa

    at, shared = rows.columns.index(column), rows.sparkSession.sparkContext.broadcast(array)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, batch.column(at).to_numpy()) == inside))

    return rows.mapInArrow(work, rows.schema)
