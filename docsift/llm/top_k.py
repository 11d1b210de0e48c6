"""Exact top-k search by inner product: columnar branch and bound.

Candidates are dealt to shards and queries to groups; a task has one shard and
one group.  It lays its shard out vertically (one contiguous row a dimension,
dimensions with most mass first) and adds up scores one block of dimensions
after the other.  After each block the dimensions to come can change a score by
at most |rest of the query| * |rest of the candidate| (Cauchy-Schwarz).  A
candidate whose score plus that mass stays below the k-th largest score minus
mass is out for good.  While many are left, a block is one matrix product for
all queries of a tile; then the survivors are compacted to (query, candidate)
pairs and only these go on.  Every bound is safe, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import field_type, materialise, tidy
from docsift.llm.integer_vectors import exact_type, integer_matrix, integer_vectors

BLOCK_DIMS = 8
TILE = 64          # queries that share the dense part
COMPACT = 0.25     # share of survivors below which pairs are compacted
OUT = -2**62       # score of a query's own row: below any sum of products


class VerticalShard:
    """Candidates ``x`` (rows of whole numbers, sorted by ``ids``) by dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block_dims: int = BLOCK_DIMS):
        self.ids, self.block_dims = ids, block_dims
        squares = x.astype(np.float64) ** 2
        self.order = np.argsort(-squares.sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(x.T[self.order])
        self.blocks = [slice(s, s + block_dims) for s in range(0, x.shape[1], block_dims)]
        self.rest = self._rest(squares)
        self.largest = float(squares.sum(axis=1).max(initial=0))
        self.typed: dict[type, np.ndarray] = {}

    def _rest(self, squares: np.ndarray) -> np.ndarray:
        """Length of what follows each block (blocks x rows), rounded up."""
        ordered = squares[:, self.order]
        sums = [ordered[:, b.stop:].sum(axis=1) for b in self.blocks]
        return np.sqrt(np.array(sums).reshape(len(self.blocks), len(squares))) * (1 + 1e-12)

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries ``q`` with ids ``own``: (query, row, score) of the k
        best rows of other ids, ties to the smaller id; and in ``self.done``
        the number of (pair, dimension) products that were not skipped."""
        self.done, found = 0, []
        largest = float((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        # |sum over any dimensions| <= product of the lengths
        kind = exact_type(max(largest, self.largest) + 1)
        if kind not in self.typed:
            self.typed = {kind: self.columns.astype(kind)}
        for start in range(0, len(q), TILE):
            at, row, score = self._tile(q[start:start + TILE], own[start:start + TILE], k, self.typed[kind])
            found.append((at + start, row, score))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _tile(self, q: np.ndarray, own: np.ndarray, k: int, columns: np.ndarray):
        n = len(self.ids)
        mass = self._rest(q.astype(np.float64) ** 2)
        ordered = q[:, self.order].astype(columns.dtype)
        score = np.zeros((len(q), n), columns.dtype)
        for i, (s, e) in enumerate(zip(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right"))):
            score[i, s:e] = OUT
        least = np.full(len(q), -np.inf)  # what the k-th best has at least
        at = row = None
        for b, block in enumerate(self.blocks):
            if at is None:
                score += ordered[:, block] @ columns[block]
                self.done += score.size * len(columns[block])
                slack = mass[b][:, None] * self.rest[b][None, :]
                if n >= k:
                    least = np.maximum(least, np.partition(score - slack, n - k, axis=1)[:, n - k])
                alive = score + slack >= least[:, None]
                if alive.mean() < COMPACT:
                    at, row = np.nonzero(alive)
                    score = score[at, row]
            else:
                for d in range(block.start, min(block.stop, len(columns))):
                    score = score + ordered[at, d] * columns[d][row]
                self.done += len(score) * len(columns[block])
                slack = mass[b][at] * self.rest[b][row]
                ends = np.searchsorted(at, np.arange(len(q) + 1))
                low = score - slack
                for i in np.flatnonzero(np.diff(ends) >= k):
                    part = low[ends[i]:ends[i + 1]]
                    least[i] = max(least[i], np.partition(part, len(part) - k)[len(part) - k])
                alive = score + slack >= least[at]
                at, row, score = at[alive], row[alive], score[alive]
        if at is None:
            at, row = (x.ravel() for x in np.indices(score.shape))
            score = score.ravel()
        real = score > OUT / 2
        at, row, score = at[real], row[real], score[real].astype(np.int64)
        best = np.lexsort((row, -score, at))
        at, row, score = at[best], row[best], score[best]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[first], row[first], score[first]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                vector_col: str = "embedding", shard_rows: int = 8192, group_rows: int = 65536, block_rows: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest integer inner product with
    each row of ``queries`` (same columns), components as ``floor(scale * x)``:
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties to the smaller id.

    Rows with the query's id are not its candidates.  Fewer than ``k`` others:
    all of them.  Vectors that are null or hold null or non-finite components,
    or whose squares sum to 2^60 and more, take no part, nor do rows with a
    null id; vectors compare with those of their own dimension (zero and empty
    vectors too, with score 0).  Repeated rows count once; other rows of a
    repeated id count each, and each asks for itself.  Empty tables give no
    rows; other columns are not read."""
    rows = integer_vectors(vectors, id_col, vector_col, scale).where(F.col("vec_id").isNotNull()).select("vec_id", "vec").distinct()
    asked = integer_vectors(queries, id_col, vector_col, scale).where(F.col("vec_id").isNotNull()).select("vec_id", "vec").distinct()
    asked = materialise(asked.withColumn("query_no", F.monotonically_increasing_id()))

    # a grid of cells: candidates by shard, queries by group; both numbers follow from the tables
    shards = max(1, -(-vectors.count() // shard_rows))
    groups = max(1, -(-asked.count() // group_rows))
    nothing = F.lit(None).cast("binary")
    dims = (F.octet_length("vec") / 4).cast("int").alias("dims")
    place = rows.select(dims, F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int").alias("shard"),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"),
                        F.col("vec_id").cast("long").alias("vec_id"), "vec", nothing.alias("numbers"), nothing.alias("ids"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of one dimension and group as blocks of at most ``block_rows``."""
        for batch in (b.slice(s, block_rows) for b in batches for s in range(0, b.num_rows, block_rows)):
            ids, numbers, part = (batch.column(i).to_numpy() for i in (0, 2, 3))
            vecs = np.array(batch.column(1).to_pylist() + [None], dtype=object)[:-1]
            of = np.array([len(v) // 4 for v in vecs])
            for d, p in sorted(set(zip(of.tolist(), part.tolist()))):
                mine = (of == d) & (part == p)
                yield pa.RecordBatch.from_arrays([
                    pa.array([d], pa.int32()), pa.array([p], pa.int32()), pa.array([b"".join(vecs[mine])], pa.binary()),
                    pa.array([numbers[mine].tobytes()], pa.binary()), pa.array([ids[mine].tobytes()], pa.binary())],
                    names=["dims", "part", "vec", "numbers", "ids"])

    blocks = asked.select(F.col("vec_id").cast("long").alias("vec_id"), "vec", "query_no",
                          F.pmod(F.xxhash64("query_no"), F.lit(groups)).cast("int").alias("part")) \
        .mapInArrow(tidy(block), "dims int, part int, vec binary, numbers binary, ids binary")
    sent = blocks.select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "part", F.lit(1).alias("kind"),
                         F.lit(None).cast("long").alias("vec_id"), "vec", "numbers", "ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, its candidates by id and before the queries."""
        now, ids, vecs, shard = None, [], [], None
        for batch in batches:
            for dim, shard_no, part, what, vec_id, vec, numbers, query_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (dim, shard_no, part):
                    now, ids, vecs, shard = (dim, shard_no, part), [], [], None
                if what == 0:
                    ids.append(vec_id)
                    vecs.append(vec)
                    continue
                if not ids:
                    continue
                if shard is None:
                    shard, vecs = VerticalShard(np.array(ids), integer_matrix(vecs, dim)), []
                own, no = (np.frombuffer(x, np.int64) for x in (query_ids, numbers))
                q = np.frombuffer(vec, "<i4").reshape(len(no), dim).astype(np.int64)
                at, row, score = shard.search(q, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(no[at]), pa.array(own[at]), pa.array(shard.ids[row]), pa.array(score)],
                                                 names=["query_no", "query_id", "vec_id", "score"])

    cell = ["dims", "shard", "part"]
    found = (place.unionByName(sent).repartition(*cell).sortWithinPartitions(*cell, "kind", "vec_id")
             .mapInArrow(tidy(search), "query_no long, query_id long, vec_id long, score long"))
    ranked = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    kind = field_type(vectors, id_col)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        F.col("query_id").cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").cast(kind).alias("vec_id"), "score")
