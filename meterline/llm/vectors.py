"""Vectors of whole numbers: scaling, and blocks of rows packed where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component, as longs; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return F.when((F.size(vector) > 0) & ~bad, whole)


def encoded(matrix: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes and little-endian bytes of whole numbers."""
    most = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, matrix.astype(f"<i{width}").tobytes()


def decoded(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(data, f"<i{width}").reshape(len(names), -1).astype(np.int64)


def number(most: float) -> type:
    """The type in which whole numbers up to `most` and their sums are exact."""
    return np.float64 if most < 1 << 52 else object


def blocks_of(rows: DataFrame, block_rows: int) -> DataFrame:
    """(n, ids, labels, width, data): the rows (vec_id, label, v) of a task in blocks of equal vector length."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(n: int) -> pa.RecordBatch:
            picked = sorted(held.pop(n), key=lambda p: p[:2])
            width, data = encoded(np.stack([p[2] for p in picked]))
            pack = lambda k: np.array([p[k] for p in picked], "<i8").tobytes()
            return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "ids": [pack(0)], "labels": [pack(1)],
                                               "width": pa.array([width], pa.int32()), "data": [data]})

        for batch in batches:
            for name, label, vector in zip(*batch.columns, strict=True):
                values = vector.values.to_numpy(zero_copy_only=False)
                held.setdefault(len(values), []).append((name.as_py(), label.as_py(), values))
                if len(held[len(values)]) >= block_rows:
                    yield row(len(values))
        for n in list(held):
            yield row(n)

    return rows.select("vec_id", "label", "v").mapInArrow(gathered, "n int, ids binary, labels binary, width int, data binary")
