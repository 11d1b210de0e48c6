"""Vector columns as bytes, for the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import field_type, materialise, only, tidy


def component_type(df: DataFrame, col: str) -> str:
    """numpy type of the components of an array column, little-endian."""
    kind = field_type(df, col).elementType
    return "<f4" if isinstance(kind, T.FloatType) else "<f8"


def packed_vectors(df: DataFrame, id_col: str, vector_col: str, direction: bool = False) -> DataFrame:
    """(``vec_id``, ``vec``): components as bytes of ``component_type``; ``vec``
    is null where the vector is null, empty, zero or holds null or non-finite
    components.  Negative zeros are written as zeros.  ``direction``: doubles,
    divided by the largest of them, which is the same for parallel vectors."""
    kind = component_type(df, vector_col)
    schema = T.StructType([T.StructField("vec_id", field_type(df, id_col)), T.StructField("vec", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            offsets = column.offsets.to_numpy()
            values = column.values.cast(pa.float32() if kind == "<f4" else pa.float64()).to_numpy(zero_copy_only=False)
            finite, null = np.isfinite(values), column.values.is_null().to_numpy(zero_copy_only=False)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            for ok, s, e in zip(valid, offsets[:-1], offsets[1:]):
                x = values[s:e]
                ok = ok and e > s and finite[s:e].all() and not null[s:e].any() and x.any()
                if ok and direction:
                    x = x.astype(np.float64)
                    x = x / np.abs(x).max()
                out.append((x + 0.0).astype("<f8" if direction else kind).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return only(df, id_col, vector_col).toDF("vec_id", "vec").mapInArrow(tidy(run), schema)


def vector_classes(packed: DataFrame) -> DataFrame:
    """Equal vectors as one class: (``vec``, ``class_no``, ``first_id``
    smallest id, ``copies``), written once."""
    groups = packed.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("vec_id").alias("first_id"),
                                                                       F.count(F.lit(1)).alias("copies"))
    return materialise(groups.withColumn("class_no", F.monotonically_increasing_id()))


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).astype(np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, in doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
