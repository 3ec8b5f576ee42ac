"""Number columns as packed bytes, and sums of large fixed arrays over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SLICES = 16


def pack(a: np.ndarray) -> bytes:
    """The array compressed by byte planes: equal high bytes cost nothing."""
    import zstandard

    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


def sliced(a: np.ndarray) -> list[tuple[int, bytes]]:
    """An array of fixed size as (slice, bytes) rows, to be summed by summed()."""
    return [(i, pack(x)) for i, x in enumerate(np.array_split(a, _SLICES))]


def summed(rows: DataFrame, dtype: type, merge=np.add) -> np.ndarray:
    """The sum of the arrays that tasks gave as rows (slice int, part binary), made in parallel by slice.

    A worker holds one array's slice at a time, whatever the number of tasks. The result has the size
    of one array, which is fixed by a parameter of the caller. No rows give an empty array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = unpack(b, dtype)
                held[i] = merge(held[i], a) if i in held else a
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(a) for a in held.values()], pa.binary())], names=["slice", "part"])

    parts = rows.select("slice", "part").repartition(_SLICES, "slice").mapInArrow(run, "slice int, part binary").collect()
    found = {r["slice"]: unpack(bytes(r["part"]), dtype) for r in parts}
    return np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(0, dtype)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they come in fewer parts, as from one small file; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
