"""Counts of small whole numbers over all rows of a table, as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Numbers whose counts travel as one row.
SLICE = 1 << 16
#: Numbers that are gathered before they are counted, and that a task counts in one table of 32-bit counts.
GATHERED, TABLE_NUMBERS = 1 << 17, 1 << 30

_PART = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def tally(rows: DataFrame, size: int, numbers: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
          told: Callable[[np.ndarray], np.ndarray] = lambda n: n) -> np.ndarray:
    """How often each of 0 to ``size`` - 1 occurs in the arrays that ``numbers`` makes of the batches of ``rows``.

    Every row is counted.  Each task counts its own rows; the tasks' counts are added slice by slice after a shuffle of
    ``size`` compressed numbers a task, and only what ``told`` makes of the sums, ``size`` numbers in all, goes to the
    driver.  A task holds 4 bytes for each of the numbers, and few more beside them."""
    dtype = told(np.zeros(1, dtype=np.int64)).dtype

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, n, counted = np.zeros(size, dtype=np.int32), [], 0, 0
        for batch in batches:
            for found in numbers(batch):
                waiting.append(found)
                n += len(found)
                if n >= GATHERED:
                    _add(table, waiting)
                    counted += n
                    waiting, n = [], 0
                if counted >= TABLE_NUMBERS:  # before a count can be too large for the table
                    yield from _rows(_slices(table))
                    table[:] = 0
                    counted = 0
        _add(table, waiting)
        yield from _rows(_slices(table))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = _unpacked(counts.as_py(), np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        yield from _rows((k, told(counts)) for k, counts in sums.items())

    out = told(np.zeros(size, dtype=np.int64))
    for r in rows.mapInArrow(count, _PART).repartition("slice").mapInArrow(add, _PART).collect():
        counts = _unpacked(bytes(r["counts"]), dtype)
        out[r["slice"] * SLICE:r["slice"] * SLICE + len(counts)] = counts
    return out


def _add(table: np.ndarray, waiting: list[np.ndarray]) -> None:
    if waiting:
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        table[found] += n.astype(table.dtype)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def _slices(table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The slices that have any count, one at a time."""
    for k, a in enumerate(range(0, len(table), SLICE)):
        if table[a:a + SLICE].any():
            yield k, table[a:a + SLICE].astype(np.int64)


def _rows(tables: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=1)
    for k, counts in tables:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([tool.compress(counts.tobytes())], pa.binary())], names=_PART.names)
