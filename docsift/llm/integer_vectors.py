"""Vector columns as whole numbers, for the exact vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import field_type, only, tidy

# Squares of a vector sum to less than this, so that inner products and squared
# distances of any two vectors fit a long and components fit 32 bits.
MOST_SQUARES = 2.0**60


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """(``vec_id``, ``vec``, ``low``, ``high``) of the rows that take part:
    components as ``floor(scale * x)``, 32-bit little-endian, with the smallest
    and the largest of them (null if there is none).

    Left out: null vectors, vectors with null or non-finite components, of
    another dimension than ``dims`` (if given), or with squares of 2^60 and
    more in sum, whose products a long cannot hold."""
    schema = T.StructType([T.StructField("vec_id", field_type(df, id_col)), T.StructField("vec", T.BinaryType()),
                           T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy()
            start, lengths = offsets[0], np.diff(offsets)
            values = column.values.slice(start, offsets[-1] - start)
            null = values.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
            bad = null | ~np.isfinite(whole) | (np.abs(whole) >= 2.0**30)
            whole = np.where(bad, 0, whole)
            place = np.repeat(np.arange(len(lengths)), lengths)
            squares = np.bincount(place, weights=whole * whole, minlength=len(lengths))
            ok = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(place, weights=bad, minlength=len(lengths)) == 0)
            ok &= squares < MOST_SQUARES
            if dims is not None:
                ok &= lengths == dims
            kept, lengths = whole[ok[place]].astype("<i4"), lengths[ok]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            low, high = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            some = lengths > 0
            if some.any():
                low[some], high[some] = (f.reduceat(kept, ends[:-1][some]) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(pa.array(ok)),
                pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(kept)]),
                pa.array(low, mask=~some), pa.array(high, mask=~some)], names=["vec_id", "vec", "low", "high"])

    return only(df, id_col, vector_col).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vec")) \
        .mapInArrow(tidy(run), schema)


def exact_type(largest: float) -> type:
    """numpy type whose sums of products are exact below ``largest``; the
    floating types go through fast matrix products."""
    return np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else np.int64


def integer_matrix(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<i4").reshape(len(rows), dims).astype(np.int64)
