"""Centroid clustering over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve through their space and cut
into blocks of near vectors; a block is written once with the box around it
(smallest and largest value of each dimension), its count and its sum.  A round
reads the blocks and rules out centroids for a whole block by its box:

* one whose least distance to the box is over another's largest distance;
* one that is farther than the centroid nearest the middle of the box all over
  the box: |x - c|^2 - |x - c'|^2 is linear in x, so its largest value over the
  box is found dimension by dimension.

A block with a single candidate adds its sum without looking at a vector; else
all vectors of the block are compared with the candidates left, in whole
numbers.  Rounds exchange one row a task, centroid and dimension; only the
centroids (a parameter's number) reach the driver, and no round depends on the
plan of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import field_type, shared_path, tidy
from docsift.llm.integer_vectors import integer_matrix, integer_vectors

CURVE_BITS = 4
PART_ROWS = 1 << 18


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve, as rows of bytes that sort like the places,
    of points with ``bits``-bit coordinates (Skilling's transform, all rows at
    once)."""
    x = [c.astype(np.int64) for c in cells.T]
    if not x:
        return np.zeros((len(cells), 0), np.uint8)
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, bit = np.zeros(len(cells), np.int64), 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    planes = [((c ^ flip) >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1) for c in x]
    return np.packbits(np.array(planes).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers (ascending) of the centroids that can be nearest to some point
    of the box; of equally near ones the smaller number counts as nearer."""
    gap = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    left = np.flatnonzero((gap * gap).sum(axis=1) <= (far * far).sum(axis=1).min())
    middle = 2 * centroids[left] - (low + high)
    best = left[np.argmin((middle * middle).sum(axis=1))]
    squares = (centroids[left] ** 2).sum(axis=1)
    lead = 2 * (centroids[left] - centroids[best])
    most = np.maximum(lead * low, lead * high).sum(axis=1) + (centroids[best] ** 2).sum() - squares
    return left[(most > 0) | ((most == 0) & (left <= best))]


def assign(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``numbers`` and squared distance of each row,
    exactly: the callers' type holds every term."""
    c = centroids[numbers]
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    at = np.argmin(d, axis=1)
    return numbers[at], d[np.arange(len(x)), at].astype(np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3,
                    id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 256) -> DataFrame:
    """k-means in whole numbers, components as ``floor(scale * x)``.  The ``k``
    vectors with the smallest sha256 of ``<seed>:<id>`` start as centroids
    0, 1, ...; each round assigns all vectors (ties: smaller number) and moves
    every non-empty centroid to the floor of its mean; a last assignment
    follows.  Per vector: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia``, ``centroid_sha256`` (of the final
    centroid's components, joined by commas).

    Rows that do not take part: null vectors, other dimensions than ``dims``,
    null or non-finite components, squares of 2^60 and more in sum.  Each
    repeated row counts and is returned; a null id counts as empty text in the
    hash; equal hashes start in the order of their vectors.  Fewer than ``k``
    vectors: fewer centroids; none: no rows.  Sums beyond a long are null.
    Other columns are not read."""
    spark, kind = vectors.sparkSession, field_type(vectors, id_col)
    result = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    path = shared_path(spark, "vectors")
    integer_vectors(vectors, id_col, vector_col, scale, dims).write.parquet(path)
    kept = spark.read.parquet(path)
    low, high, n = kept.agg(F.min("low"), F.max("high"), F.count(F.lit(1))).first()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(order, "vec").limit(k).select("vec").collect()
    # products and sums of three terms of at most `largest` are exact in doubles below 2^53
    largest = 4.0 * dims * max(abs(low or 0), abs(high or 0)) ** 2
    number = np.float64 if largest < 2.0**52 else np.int64
    centroids = integer_matrix([r.vec for r in start], dims).astype(number)

    blocks_path = shared_path(spark, "blocks")
    _blocks(kept, kind, dims, low or 0, high or 0, n, block_rows).write.parquet(blocks_path)
    blocks = spark.read.parquet(blocks_path)
    for _ in range(rounds if n else 0):
        moved = _moved(blocks, centroids, dims)
        if (moved == centroids).all():  # every later round would repeat this one
            break
        centroids = moved

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, numbers in _parts(batches, centroids, dims):
            cluster, distance = assign(x, centroids, numbers)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=result.names)

    final_path = shared_path(spark, "clusters")
    blocks.select("ids", "vecs", "low", "high").mapInArrow(tidy(final), result).write.parquet(final_path)
    rows = spark.read.parquet(final_path)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    names = spark.createDataFrame([(i, _sha256(c)) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    total = sums.agg(F.sum("sum").alias("total"))
    # k rows, a bound that the caller sets
    info = sums.join(names, "cluster").join(total).selectExpr(
        "cluster", "try_cast(sum AS BIGINT) AS cluster_inertia", "try_cast(total AS BIGINT) AS inertia", "centroid_sha256")
    return rows.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sha256(components: list[float]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in components).encode()).hexdigest()


def _blocks(kept: DataFrame, kind: T.DataType, dims: int, low: int, high: int, n: int, block_rows: int) -> DataFrame:
    """Vectors along the curve, ``block_rows`` of a task to a row."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integer_matrix(batch.column(1).to_pylist(), dims)
            place = hilbert_keys(((x - low) << CURVE_BITS) // (high - low + 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in place], pa.binary())],
                                             names=["vec_id", "vec", "place"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in (*batches, None):
            if batch is not None:
                waiting.append(batch)
                size += batch.num_rows
                if size < block_rows:
                    continue
            if not size:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            whole = size if batch is None else size - size % block_rows
            out = []
            for s in range(0, whole, block_rows):
                part = rows.slice(s, min(block_rows, whole - s))
                x = integer_matrix(part.column(1).to_pylist(), dims)
                out.append((part.num_rows, x))
            ends = np.cumsum([0] + [c for c, _ in out]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([rows.column(0).slice(0, whole)])),
                *(pa.array([f(x).astype("<i4" if i < 3 else "<i8").tobytes() for _, x in out], pa.binary())
                  for i, f in enumerate((lambda x: x, lambda x: x.min(axis=0), lambda x: x.max(axis=0), lambda x: x.sum(axis=0))))],
                names=["ids", "vecs", "low", "high", "total"])
            waiting, size = [rows.slice(whole)], size - whole

    row = T.StructType([T.StructField("vec_id", kind), T.StructField("vec", T.BinaryType()), T.StructField("place", T.BinaryType())])
    placed = kept.select("vec_id", "vec").mapInArrow(tidy(keys), row)
    parts = max(-(-n // PART_ROWS), min(-(-n // 2048), kept.sparkSession.sparkContext.defaultParallelism), 1)
    # the id spreads copies of a vector
    ordered = placed.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("vecs", "low", "high", "total"))])
    return ordered.select("vec_id", "vec").mapInArrow(tidy(block), schema)


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dims: int):
    """(ids, vectors, candidates) of each block."""
    for batch in batches:
        ids = batch.column(0)
        for i, (vecs, low, high) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:4]))):
            box = [np.frombuffer(b, "<i4").astype(centroids.dtype) for b in (low, high)]
            x = np.frombuffer(vecs, "<i4").reshape(-1, dims).astype(centroids.dtype)
            yield ids.slice(i, 1).flatten(), x, candidates(*box, centroids)


def _moved(blocks: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after one round."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for vecs, low, high, whole in zip(*(c.to_pylist() for c in batch.columns)):
                box = [np.frombuffer(b, "<i4").astype(centroids.dtype) for b in (low, high)]
                numbers = candidates(*box, centroids)
                if len(numbers) == 1:
                    total[numbers[0]] += np.frombuffer(whole, "<i8")
                    count[numbers[0]] += len(vecs) // (4 * dims)
                    continue
                x = np.frombuffer(vecs, "<i4").reshape(-1, dims)
                cluster, _ = assign(x.astype(centroids.dtype), centroids, numbers)
                for c in numbers.tolist():
                    mine = cluster == c
                    total[c] += x[mine].sum(axis=0, dtype=np.int64)
                    count[c] += mine.sum()
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(some, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(some))),
            pa.array(total[some].ravel()), pa.array(np.repeat(count[some], dims))], names=["cluster", "dim", "total", "n"])

    rows = (blocks.select("vecs", "low", "high", "total").mapInArrow(tidy(sums), "cluster int, dim int, total long, n long")
            .groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect())
    moved = centroids.copy()
    for r in rows:
        moved[r.cluster, r.dim] = int(r.total) // r.n
    return moved
