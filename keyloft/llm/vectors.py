"""Vectors as the bytes of their components, for operators that work on blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as float64; None where it is null, empty or holds a null or non-finite number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    flat = column.values
    ok = ~flat.is_null().to_numpy(zero_copy_only=False)
    values = np.where(ok, flat.fill_null(0).to_numpy(zero_copy_only=False), np.nan).astype(np.float64)
    out: list[np.ndarray | None] = []
    for lo, hi, null in zip(offsets[:-1], offsets[1:], column.is_null().to_numpy(zero_copy_only=False), strict=True):
        v = values[lo:hi]
        out.append(None if null or hi == lo or not np.isfinite(v).all() else v)
    return out


def as_bytes(df: DataFrame, vector_col: str, keep: list[str], convert, out: str = "raw") -> DataFrame:
    """``keep`` and, per row, ``convert`` of the vector as bytes (None where it takes no part)."""
    narrow = df.select(*keep, df[vector_col].alias("_v"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else convert(v) for v in rows_of(batch.column(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.binary())], [*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:n])
    return narrow.mapInArrow(run, f"{fields}, {out} binary")


def matrix(data: list[bytes], dtype) -> np.ndarray:
    """Rows of equally many bytes as a matrix."""
    return np.frombuffer(b"".join(data), dtype).reshape(len(data), -1) if data else np.zeros((0, 0), dtype)
