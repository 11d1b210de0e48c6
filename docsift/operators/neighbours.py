"""V3: approximate nearest neighbours on a stored index of hash tables.

The index has ``tables`` hash tables.  Table t cuts the space by ``bits`` seeded
hyperplanes; the sides on which a vector lies are its bucket.  A search goes
through the buckets of every table by their cost, the sum of the squared
distances to the planes that part them from the query, and compares the vectors
of the first ``probes`` buckets of each table exactly.  ``bits`` follow from the
number of vectors.  ``probes`` are fitted when the index is built: a bounded
sample of vectors is searched exactly, and the buckets are taken that hold the
wanted share of the true neighbours.  So recall holds on any table; where vectors
have no structure the price is that a larger share of them is read, which
``probed_share`` tells before a search.

Vectors are stored once a table, range-partitioned and sorted by (cell, id),
where a cell is a bucket of a table: a search reads only the row groups of its
cells, and a cell that holds a third of all vectors is spread over many files.
A batch of queries goes to the cells it probes; a cell with many vectors is dealt
out in parts by the stored counts, so no task holds it whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.vectors import TIE, _rows, _unit_matrix, cosine_sim, knn_join, model_vectors, top_k_per_group

KNN_CANDIDATES = 600  # fixed value: approximate kNN candidates
TABLES = 8
CELL_VECTORS = 16     # vectors a bucket should hold
MOST_BITS = 20
SAMPLE = 64           # vectors searched exactly when an index is fitted
RECALL = 0.95         # share of their neighbours that the probed buckets must hold
PART_VECTORS = 4096   # vectors of a cell that one task holds
KEPT = 1 << 20        # pairs a task holds before it cuts them down
PAIRS = 1 << 16       # pairs compared row by row at a time
ASKED_ROWS = 1 << 12  # copies of a query handed on at once


def hash_planes(dims: int, tables: int, bits: int, seed: int = 0) -> np.ndarray:
    """Normals of the hyperplanes, as small whole numbers (tables x bits x dims)."""
    return np.rint(np.random.default_rng(seed).normal(size=(tables, bits, dims)) * 8)


def buckets_of(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bucket of each row in every table (rows x tables): bit j is set on the
    upper side of plane j."""
    return np.stack([((x @ p.T >= 0) << np.arange(len(p))).sum(axis=1) for p in planes], axis=1)


def bucket_costs(q: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Cost of every bucket of one table for one query: the squared distances
    to the planes that part them."""
    margin = planes @ q
    cost = np.zeros(1)
    for m in margin:  # doubles: without and with the next bit
        cost = np.concatenate([cost + (m >= 0) * m * m, cost + (m < 0) * m * m])
    return cost


def probed_buckets(q: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` buckets of least cost, ties by number."""
    cost = bucket_costs(q, planes)
    least = np.partition(cost, probes - 1)[probes - 1] if probes < len(cost) else np.inf
    near = np.flatnonzero(cost <= least)
    return near[np.lexsort((near, cost[near]))[:probes]]


@dataclass(frozen=True)
class NeighbourIndex:
    """A stored index: ``cells`` (cell, id, model_id, embedding), ``counts``
    (cell, n) and the parameters it was built with."""
    cells: DataFrame
    counts: DataFrame
    n: int
    dims: int
    tables: int
    bits: int
    probes: int
    seed: int

    def planes(self) -> np.ndarray:
        return hash_planes(self.dims, self.tables, self.bits, self.seed)

    def probed_cells(self, q, probes: int | None = None) -> np.ndarray:
        x = np.zeros(self.dims)
        x[:len(q)] = q[:self.dims]
        return np.concatenate([(t << self.bits) + probed_buckets(x, p, probes or self.probes) for t, p in enumerate(self.planes())])


def write_neighbour_index(emb: DataFrame, path: str, model_id: int = 1, tables: int = TABLES, bits: int | None = None,
                          probes: int | None = None, seed: int = 0, recall: float = RECALL, sample: int = SAMPLE, k: int = 10) -> NeighbourIndex:
    """Build the index of one model's vectors (start 0) under ``path``.

    ``bits`` default to about ``CELL_VECTORS`` vectors a bucket; ``probes``
    default to what finds the share ``recall`` of the ``k`` nearest neighbours
    of ``sample`` vectors, those with the smallest hashed ids.  Zero and
    non-finite vectors are indexed and score -1; a null vector has no bucket."""
    spark = emb.sparkSession
    vec = model_vectors(emb, model_id).where(F.col("embedding").isNotNull()).select("id", "embedding")
    n, dims = vec.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if bits is None:
        bits = max(1, min(MOST_BITS, int(math.log2(max(n, 2) / CELL_VECTORS))))
    planes = hash_planes(dims, tables, bits, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, dims))
            for i, v in enumerate(_rows(batch.column(1))):
                x[i, :len(v)] = v
            x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
            cells = (buckets_of(x, planes) + (np.arange(tables) << bits)).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, tables, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["id", "embedding", "cells"])

    kind = next(f.dataType for f in vec.schema.fields if f.name == "embedding").simpleString()
    placed = vec.mapInArrow(place, f"id long, embedding {kind}, cells array<int>")
    rows = placed.select(F.explode("cells").alias("cell"), "id", F.lit(model_id).alias("model_id"), "embedding")
    (rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
     .write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/cells"))
    stored = spark.read.parquet(f"{path}/cells")
    stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    if probes is None:
        probes = _fitted_probes(vec, stored, planes, recall, sample, k)
    meta = spark.createDataFrame([(n, dims, tables, bits, min(probes, 1 << bits), seed)],
                                 "n long, dims int, tables int, bits int, probes int, seed int")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    return open_neighbour_index(spark, path)


def open_neighbour_index(spark: SparkSession, path: str) -> NeighbourIndex:
    meta = spark.read.parquet(f"{path}/meta").first()
    return NeighbourIndex(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/counts"), **meta.asDict())


def _fitted_probes(vec: DataFrame, stored: DataFrame, planes: np.ndarray, recall: float, sample: int, k: int) -> int:
    """Buckets a table to probe, from the exact neighbours of a few vectors."""
    tables, bits = planes.shape[:2]
    asked = vec.orderBy(F.xxhash64("id"), "id").limit(sample)
    queries = {r.id: r.embedding for r in asked.collect()}  # `sample` vectors
    if not queries:
        return 1
    pairs = knn_join(asked.select("id"), vec.withColumn("model_id", F.lit(1)).withColumn("start", F.lit(0)), k).select("qid", "id")
    # `sample` x k x tables rows
    near = stored.select("cell", "id").join(F.broadcast(pairs), "id").select("qid", "id", "cell").collect()
    place, best = {}, {}
    for qid, v in queries.items():
        x = np.zeros(planes.shape[2])
        x[:len(v)] = np.nan_to_num(np.array(v, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        for t in range(tables):
            cost = bucket_costs(x, planes[t])
            rank = np.empty(len(cost), dtype=np.int64)
            rank[np.lexsort((np.arange(len(cost)), cost))] = np.arange(len(cost))
            place[qid, t] = {r.id: int(rank[r.cell & (1 << bits) - 1]) for r in near if r.qid == qid and r.cell >> bits == t}
            for i, r in place[qid, t].items():
                best[qid, i] = min(best.get((qid, i), r), r)
    ranks = sorted(best.values())
    return ranks[min(len(ranks) - 1, max(0, math.ceil(recall * len(ranks)) - 1))] + 1 if ranks else 1


def _in_cells(cells) -> Column:
    """Membership as ORs of at most ten values each, which Parquet can use to
    skip row groups and pages; a longer IN would become one wide range."""
    values = sorted(int(c) for c in cells)
    parts = [F.col("cell").isin(values[i:i + 10]) for i in range(0, len(values), 10)]
    while len(parts) > 1:
        parts = [functools.reduce(lambda a, b: a | b, parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def knn_approx(index: NeighbourIndex, q: list[float], k: int, candidates: int | None = KNN_CANDIDATES,
               docs: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """V3: the nearest vectors to ``q`` among those of the probed buckets (id,
    similarity), best first, ties by id.  At least the fitted ``probes`` buckets
    a table are read, and so many that they hold ``candidates`` vectors (by the
    stored counts).  With ``docs`` only vectors of those documents count, before
    the k nearest are taken."""
    probes = probes or index.probes
    while candidates and probes < 1 << index.bits:
        # a vector lies in one bucket a table, so in `tables` of the cells at most
        held = index.counts.where(_in_cells(index.probed_cells(q, probes))).agg(F.sum("n")).first()[0] or 0
        if held >= max(candidates, k) * index.tables:
            break
        probes *= 2
    near = index.cells.where(_in_cells(index.probed_cells(q, probes)))
    if docs is not None:
        near = near.join(docs.select("id"), "id", "left_semi")
    scored = near.select("id", cosine_sim(q, F.col("embedding")).alias("similarity"))
    order = [F.col("similarity").desc(), F.col("id")]
    # a vector comes at most once a table
    return scored.orderBy(*order).limit(k * index.tables).distinct().orderBy(*order).limit(k)


def probed_share(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """(qid, share) of the stored rows that a search for each query (id,
    embedding) reads."""
    cells = _asked_cells(index, queries).select("qid", "cell")
    # probes x tables counts a query
    return (cells.join(index.counts, "cell", "left").groupBy("qid")
            .agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(max(1, index.n * index.tables)))).alias("share")))


def _asked_cells(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """(qid, cell, embedding): a row for every cell that a query probes."""
    planes, dims, bits, probes = index.planes(), index.dims, index.bits, index.probes  # the task takes no DataFrame along

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cells_asked(batch, planes, dims, bits, probes)

    kind = next(f.dataType for f in queries.schema.fields if f.name == "embedding").simpleString()
    return queries.select("id", "embedding").where(F.col("embedding").isNotNull()).mapInArrow(ask, f"qid long, cell int, embedding {kind}")


def _cells_asked(batch: pa.RecordBatch, planes: np.ndarray, dims: int, bits: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(qid, cell, embedding) of the queries of a batch, table by table and some
    rows at a time, as the cells that a query probes grow with the index."""
    for i, v in enumerate(_rows(batch.column(1))):
        x = np.zeros(dims)
        x[:min(len(v), dims)] = np.nan_to_num(v[:dims], nan=0.0, posinf=0.0, neginf=0.0)
        for t, p in enumerate(planes):
            cells = ((t << bits) + probed_buckets(x, p, probes)).astype(np.int32)
            for s in range(0, len(cells), ASKED_ROWS):
                same = pa.array(np.full(len(cells[s:s + ASKED_ROWS]), i, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), pa.array(cells[s:s + ASKED_ROWS]), batch.column(1).take(same)],
                                                 names=["qid", "cell", "embedding"])


def knn_approx_join(index: NeighbourIndex, queries: DataFrame, k: int) -> DataFrame:
    """V3 for many queries (id, embedding): the ``k`` nearest other vectors
    found for each (qid, id, similarity, rank).  Queries go to the cells that
    they probe and are compared there; a task hands on the best of what it saw
    of each query."""
    parts = F.ceil(F.col("n") / PART_VECTORS).cast("int")
    dealt = index.counts.select("cell", parts.alias("parts"))
    large = F.broadcast(dealt.where(F.col("parts") > 1))  # n x tables / PART_VECTORS rows at most
    held = index.cells.join(large, "cell", "left").select(
        "cell", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "embedding")
    asked = _asked_cells(index, queries).join(large, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(1).alias("kind"),
        F.col("qid").alias("id"), "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, found, size = None, [], [], [], 0
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            cell, part, kind, number = (batch.column(i).to_numpy() for i in range(4))
            rows = _rows(batch.column(4))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(cell)]):
                if (cell[s], part[s]) != now:
                    now, ids, vectors = (cell[s], part[s]), [], []
                if kind[s] == 0:
                    ids.extend(number[s:e].tolist())
                    vectors.extend(rows[s:e])
                elif ids:
                    dims = max(map(len, vectors + rows[s:e]))
                    x, q = _unit_matrix(vectors, dims), _unit_matrix(rows[s:e], dims)
                    found.append(_nearest(number[s:e], q, np.array(ids), x, k))
                    size += len(found[-1][0])
                    if size > KEPT:
                        found = [_cut(found, k)]
                        size = len(found[0][0])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _cut(found, k)], names=["qid", "id", "similarity"])

    order = ["cell", "part", "kind"]
    near = held.unionByName(asked).repartition("cell", "part").sortWithinPartitions(*order).mapInArrow(search, "qid long, id long, similarity double")
    return top_k_per_group(near.distinct(), ["qid"], [F.col("similarity").desc(), F.col("id").asc()], k, "id")


def _nearest(qid, q, ids, x, k):
    """Rows of a cell that can be among the k nearest of each query, with
    cosines computed row by row, so that equal vectors have equal ones."""
    sim = np.nan_to_num(q @ x.T, nan=-1.0)
    sim[ids[None, :] == qid[:, None]] = -np.inf
    least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(qid), -np.inf)
    at, row = np.nonzero((sim >= least[:, None] - TIE) & np.isfinite(sim))
    exact = [(q[at[s:s + PAIRS]] * x[row[s:s + PAIRS]]).sum(axis=1) for s in range(0, len(at), PAIRS)]
    return qid[at], ids[row], np.nan_to_num(np.concatenate([*exact, np.zeros(0)]), nan=-1.0)


def _cut(found, k):
    """The k best different rows of each query."""
    qid, ids, sim = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((ids, -sim, qid))
    qid, ids, sim = qid[order], ids[order], sim[order]
    new = np.ones(len(qid), dtype=bool)
    new[1:] = (qid[1:] != qid[:-1]) | (ids[1:] != ids[:-1]) | (sim[1:] != sim[:-1])
    qid, ids, sim = qid[new], ids[new], sim[new]
    first = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[first], ids[first], sim[first]
