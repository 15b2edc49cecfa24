"""CSR files: int64 rows, columns, entries; int64 indptr; int32 indices; float32 values.

Partitions are ranges of rows, and each reads only its part of the file, so a file of
any size is read in parallel, from any file system that Arrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenta.sources import ranges

ROWS = 50_000
HEADER = 24


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.shape = self._numbers(0, "<i8", 3, "the file has no header")

    def _numbers(self, start: int, kind: str, n: int, fault: str = "the file is cut off") -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        got = ranges.read(self.path, start, size)
        if len(got) < size:
            raise ValueError(fault)
        return np.frombuffer(got, kind)

    def partitions(self) -> list[_Rows]:
        n = int(self.shape[0])
        return [_Rows(i, min(n, i + ROWS)) for i in range(0, n, ROWS)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        n, _, entries = map(int, self.shape)
        rows = partition.last - partition.first
        if not rows:
            return
        at = self._numbers(HEADER + 8 * partition.first, "<i8", rows + 1)
        lo, hi = int(at[0]), int(at[-1])
        base = HEADER + 8 * (n + 1)
        indices = self._numbers(base + 4 * lo, "<i4", hi - lo)
        values = self._numbers(base + 4 * (entries + lo), "<f4", hi - lo)
        offsets = pa.array(at - lo, pa.int32())
        columns = [pa.array(np.arange(partition.first, partition.last)), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (indices, values))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "indices", "values"])


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "doc_id long, indices array<int>, values array<float>"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"])


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").load(path)


def write_csr(path: str, dim: int, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray) -> None:
    """One file of a batch that the caller holds."""
    with open(path, "wb") as f:
        np.array([len(indptr) - 1, dim, len(indices)], "<i8").tofile(f)
        np.asarray(indptr, "<i8").tofile(f)
        np.asarray(indices, "<i4").tofile(f)
        np.asarray(values, "<f4").tofile(f)
