"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.session import ensure_checkpoint_dir

# ASCII white space; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WORD_BYTES = bytes([0x20, *range(0x09, 0x0E)])
# str.translate / bytes.translate tables: A-Z to lower case, white space to blanks.
LOWER_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
LOWER_SPACE_BYTES = bytes(0x20 if i in _WORD_BYTES else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text.
    White space other than those six bytes (such as U+0085, 0x1C) belongs to words."""
    return [w for w in text.translate(LOWER_SPACE_BYTES).split(b" ") if w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def field_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def only(df: DataFrame, *cols: str) -> DataFrame:
    """Exactly these columns, so that no other column of the input can clash
    with a column that an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def byte_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying per row; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunked(batches, max_bytes: int, column: str = "text"):
    """Record batches cut so that each holds about ``max_bytes`` of ``column``
    (one longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_block(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


@functools.lru_cache(maxsize=4)
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """Return freed memory to the system: a worker process serves many tasks,
    and what one has used would otherwise add to what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(task):
    """A ``mapInArrow`` function that gives its memory back when it ends."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def crc32_remainder(col, n: int):
    """crc32 of the id as text, modulo ``n`` (null id: null)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)
