"""Nearest neighbours by vantage-point trees, one tree a shard.

Parallel vectors, which are equally near to any query, are one class that keeps
its smallest ids.  Classes are dealt to shards of about ``shard_rows``; each shard is one task that builds its tree: a
vantage point splits the others at the median distance into an inner and an
outer half, down to leaves.  Queries travel in blocks to every shard; a block
first goes down to each query's own leaf, which gives a first radius (the
distance of its k-th nearest so far), and then through the tree with all
queries of the block that still need a branch.

Distances are Euclidean between unit vectors, whose order is that of the
cosine.  A branch whose distances from the vantage point lie in [low, high]
holds nothing nearer than max(low - d, d - high) to a query at distance d.  It
is skipped if that bound is at least ``factor`` times the radius: factor 1 is
the triangle inequality and finds the exact neighbours; smaller factors skip
more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import field_type, materialise, tidy
from docsift.llm.vectors import cosines, matrix, packed_vectors, unit, vector_classes

LEAF = 48
# Classes kept beyond the wanted ones; a query that might need more is compared
# with the whole shard.
SPARE = 8
TILE = 64
# Largest difference between the cosines of the search and the final ones.
TIE = 1e-9
# Distances near zero are square roots of rounded differences.
ROUNDING = 1e-7


class VantageTree:
    """A vantage-point tree over the rows of ``x`` (unit vectors)."""

    def __init__(self, x: np.ndarray, seed: int, leaf: int = LEAF):
        self.x, self.order, self.leaf = x, np.arange(len(x)), leaf
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(x))

    def _build(self, start: int, stop: int) -> int:
        node = len(self.nodes)
        self.nodes.append(())
        if stop - start > self.leaf:
            rows = self.order[start:stop]
            vantage = self.x[rows[self.rng.integers(len(rows))]]
            d = distances(self.x[rows] @ vantage)
            inner = d <= np.median(d)
            if not inner.all():
                middle = start + int(inner.sum())
                self.order[start:stop] = np.concatenate([rows[inner], rows[~inner]])
                bounds = (d[inner].min(), d[inner].max(), d[~inner].min(), d[~inner].max())
                self.nodes[node] = (vantage, bounds, self._build(start, middle), self._build(middle, stop))
                return node
        self.nodes[node] = (None, start, stop)
        return node

    def search(self, queries: np.ndarray, k: int, factor: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and rows (-1: none) of the ``keep`` best found for each
        query; the radius is that of the ``k``-th best."""
        self.best = np.full((len(queries), keep), -np.inf)
        self.rows = np.full((len(queries), keep), -1, dtype=np.int64)
        self.queries, self.k, self.factor = queries, k, factor
        self.home = np.full(len(queries), -1)
        self._descend(self.root, np.arange(len(queries)))
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.rows

    def _take(self, node: int, active: np.ndarray) -> None:
        _, start, stop = self.nodes[node]
        rows = self.order[start:stop]
        scores = np.concatenate([self.best[active], self.queries[active] @ self.x[rows].T], axis=1)
        ids = np.concatenate([self.rows[active], np.broadcast_to(rows, (len(active), len(rows)))], axis=1)
        top = np.argsort(-scores, axis=1, kind="stable")[:, :self.best.shape[1]]
        self.best[active] = np.take_along_axis(scores, top, axis=1)
        self.rows[active] = np.take_along_axis(ids, top, axis=1)

    def _descend(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        if self.nodes[node][0] is None:
            self.home[active] = node
            self._take(node, active)
            return
        vantage, bounds, inner, outer = self.nodes[node]
        inside = distances(self.queries[active] @ vantage) <= bounds[1]
        self._descend(inner, active[inside])
        self._descend(outer, active[~inside])

    def _visit(self, node: int, active: np.ndarray) -> None:
        if self.nodes[node][0] is None:
            active = active[self.home[active] != node]
            if len(active):
                self._take(node, active)
            return
        vantage, (low_in, high_in, low_out, high_out), inner, outer = self.nodes[node]
        d = distances(self.queries[active] @ vantage)
        for child, low, high in ((inner, low_in, high_in), (outer, low_out, high_out)):
            radius = distances(self.best[active, self.k - 1])  # as the first child has left it
            need = np.maximum(low - d, d - high) < self.factor * radius + ROUNDING
            if need.any():
                self._visit(child, active[need])


def best_classes(tree: VantageTree, original: np.ndarray, first_id: np.ndarray, single: np.ndarray,
                 q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` best classes found for each query, ties
    to the class with the smaller ``first_id``; those that hold nothing but the
    query's own id are left out."""
    queries = unit(q)
    best, rows = tree.search(queries, k, factor, k + SPARE)
    real = rows >= 0
    other = real & ~(single[rows] & (first_id[rows] == own[:, None]))
    last = np.where((np.cumsum(other, axis=1) == k) & other, best, np.inf).min(axis=1)  # inf: fewer than k
    more = np.flatnonzero(real[:, -1] & (best[:, -1] >= np.where(np.isinf(last), -np.inf, last) - TIE))
    other[more] = False
    at, column = np.nonzero(other)
    found = [(at, rows[at, column])]
    for s in range(0, len(more), TILE):
        some = more[s:s + TILE]
        score = queries[some] @ tree.x.T
        score[single[None, :] & (first_id[None, :] == own[some, None])] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(some), -np.inf)
        at, row = np.nonzero((score >= least[:, None] - TIE) & np.isfinite(score))
        found.append((some[at], row))
    at, row = (np.concatenate(x) for x in zip(*found))
    cosine = cosines(original[row], q[at])
    order = np.lexsort((first_id[row], -cosine, at))
    at, row, cosine = at[order], row[order], cosine[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], row[first], cosine[first]


def distances(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors with some cosine; infinite if there is none yet."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.2, id_col: str = "vec_id",
                    vector_col: str = "embedding", shard_rows: int = 8192, block_rows: int = 2048, seed: int = 5) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by cosine, found with ``factor``,
    for every row of ``queries`` (same columns): ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score``, nearest first, ties to the smaller id.

    Rows with the query's id are not its neighbours.  Fewer than ``k`` others:
    all of them.  Null, empty, zero and non-finite vectors and rows with a null
    id take no part; vectors of another dimension are no candidates; repeated
    rows count once; empty tables give no rows; other columns are not read."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    kind, size = "<f8", 8
    rows = packed_vectors(vectors, id_col, vector_col, direction=True)
    rows = materialise(rows.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).distinct())
    classes = vector_classes(rows)
    asked = packed_vectors(queries, id_col, vector_col, direction=True)
    asked = asked.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).distinct()

    # dimension and shard; the number of shards follows from the number of classes
    dims = (F.octet_length("vec") / size).cast("int")
    shards = max(1, -(-classes.count() // shard_rows))
    # a class of one id is none of that id's neighbours
    alone = F.when(F.col("copies") == 1, b"1").otherwise(b"")
    place = classes.select(F.lit(0).alias("kind"), "class_no", F.col("first_id").cast("long").alias("first_id"), alone.alias("ids"), "vec", dims.alias("dims"),
                           F.pmod(F.xxhash64("class_no"), F.lit(shards)).cast("int").alias("shard"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of one dimension as blocks of at most ``block_rows``."""
        for batch in (b.slice(s, block_rows) for b in batches for s in range(0, b.num_rows, block_rows)):
            ids, vecs = batch.column(0).cast(pa.int64()).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            of = np.array([len(v) // size for v in vecs])
            for d in np.unique(of).tolist():
                yield pa.RecordBatch.from_arrays([
                    pa.array([d], pa.int32()), pa.array([ids[of == d].tobytes()], pa.binary()),
                    pa.array([b"".join(vecs[of == d])], pa.binary())], names=["dims", "ids", "vec"])

    blocks = asked.mapInArrow(tidy(block), "dims int, ids binary, vec binary")
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        F.lit(1).alias("kind"), F.lit(None).cast("long").alias("class_no"), F.lit(None).cast("long").alias("first_id"), "vec", "dims", "shard", "ids")
    both = place.unionByName(sent)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and dimension, its vectors before the blocks."""
        now, ids, vecs, tree = None, [], [], None
        for batch in batches:
            for dim, shard, what, class_no, first_id, vec, query_ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (dim, shard):
                    now, ids, vecs, tree = (dim, shard), [], [], None
                if what == 0:
                    ids.append((class_no, first_id, bool(query_ids)))
                    vecs.append(vec)
                    continue
                if not ids:
                    continue
                if tree is None:
                    original = matrix(pa.array(vecs, pa.binary()), kind)
                    vecs, (class_of, first_of, single) = [], (np.array(x) for x in zip(*ids))
                    tree = VantageTree(unit(original), seed + shard)
                q, own = np.frombuffer(vec, dtype=kind).reshape(-1, dim), np.frombuffer(query_ids, np.int64)
                at, row, scores = best_classes(tree, original, first_of, single, q, own, k + 1, factor)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(class_of[row]), pa.array(first_of[row]), pa.array(scores)],
                                                 names=["query_id", "class_no", "first_id", "score"])

    order = ["dims", "shard", "kind"]
    found = (both.select(*order, "class_no", "first_id", "vec", "ids").repartition("dims", "shard").sortWithinPartitions(*order, "class_no")
             .mapInArrow(tidy(search), "query_id long, class_no long, first_id long, score double"))

    # classes to rows: of a class at most k + 1 ids can be among the k nearest others
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    smallest = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    members = smallest.join(classes.select("vec", "class_no"), "vec").select("class_no", F.col("vec_id").cast("long").alias("vec_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_id")
    near = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("query_id", "class_no", "score")
    pairs = near.join(members, "class_no").where(F.col("vec_id") != F.col("query_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranked))
    return top.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"),
                                                F.col("vec_id").cast(field_type(vectors, id_col)), "score")
