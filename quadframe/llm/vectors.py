"""Vectors as whole numbers in compact bytes, and exact distances between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Components beyond this become this: with up to 64 of them a squared distance just fits into 63 bits.
MOST = (1 << 27) - 1
_WIDTHS = ("<i1", "<i2", "<i4")


def common_length(df: DataFrame, vector: str, multiple: int = 1) -> int:
    """The most frequent number of components that ``multiple`` divides, the larger of two; 0 without any."""
    sizes = df.groupBy(F.size(vector).alias("n")).count().where((F.col("n") > 0) & (F.col("n") % multiple == 0))
    found = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def finite_rows(batch: pa.RecordBatch, vector: str, length: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has ``length`` components, none null or non-finite, and these vectors as doubles."""
    column = batch.column(vector)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    ok = np.isfinite(values).all(axis=1)
    return batch.filter(pa.array(ok)), values[ok]


def of_length(df: DataFrame, vector: str, length: int, *columns: str) -> DataFrame:
    """``columns`` and the vectors of ``length`` components; others never reach Python."""
    return df.where(F.size(vector) == length).select(*columns, vector)


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, one, two or four a number: the least that a row needs, so that equal rows are equal bytes."""
    kinds = np.searchsorted([127, 32767], np.abs(rows).max(axis=1, initial=0))
    offsets = np.r_[0, np.cumsum(rows.shape[1] * (1 << kinds))].astype(np.int32)
    data = np.empty(offsets[-1], np.uint8)
    for kind, width in enumerate(_WIDTHS):
        if (own := kinds == kind).any():
            raw = np.ascontiguousarray(rows[own].astype(width)).view(np.uint8).reshape(int(own.sum()), -1)
            data[offsets[:-1][own][:, None] + np.arange(raw.shape[1])] = raw
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(column: pa.Array, length: int) -> np.ndarray:
    """The rows of ``pack`` as 64-bit numbers."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    out = np.empty((len(column), length), np.int64)
    for kind, width in enumerate(_WIDTHS):
        if (own := np.diff(offsets) == length << kind).any():
            raw = data[offsets[:-1][own][:, None] + np.arange(length << kind)]
            out[own] = raw.view(width)
    return out


def fixed(column: pa.Array, dtype: str, length: int) -> np.ndarray:
    """Binary values of one size as a matrix."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, length), dtype)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype, len(column) * length, first).reshape(-1, length)


def as_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def quantised(df: DataFrame, vector: str, scale: int, length: int, *columns: str) -> DataFrame:
    """``columns`` and, in ``q``, floor(scale * x) of each component; vectors of another length, with a null or a non-finite component are left out."""
    source = of_length(df, vector, length, *columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = finite_rows(batch, vector, length)
            rows = np.clip(np.floor(values * scale), -MOST, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], pack(rows)], names=[*columns, "q"])

    return source.mapInArrow(whole, StructType([*[source.schema[c] for c in columns], StructField("q", BinaryType())]))


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to whole-number entries.

    A sum of products is at most the square of both lengths, so where that fits into a float's digits every step is exact, in any order.
    """
    xx, ee = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
    reach = (float(xx.max(initial=0)) ** 0.5 + float(ee.max(initial=0)) ** 0.5 + 1) ** 2
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    out = x.astype(kind) @ entries.astype(kind).T
    out *= -2
    out += xx.astype(kind)[:, None]
    out += ee.astype(kind)
    return out


def roots(squares: np.ndarray) -> np.ndarray:
    """The largest whole numbers whose squares are at most these."""
    out = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    out -= out * out > squares
    return out + ((out + 1) * (out + 1) <= squares)
