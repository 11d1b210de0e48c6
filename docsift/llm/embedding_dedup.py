"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one class.  In every pass a class gets a key, the signs of
its projections on random directions, concatenated; the classes are ordered by
key and each is compared with the next ``window`` of its order.  All passes are
sorted in one shuffle.  The number of passes follows from the keys of the first
few: how many bits cut the surroundings of a class down to a window is measured,
since alike vectors need more of them, and as many passes are made as find a
pair at the design similarity with the wanted probability.
Pairs verified at the threshold are united across passes.

Inside a component links are then counted exactly, block against block of
classes, so a group that is larger than the window loses none; only counts
leave the tasks, and a copy counts as often as it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import field_type, materialise, tidy
from docsift.llm.components import FOREST_LINKS, connected_components, forest
from docsift.llm.vectors import component_type, matrix, packed_vectors, unit, vector_classes

KEY_BITS = 63
CHUNK = 1024
MEASURED = 4             # passes whose keys are measured
LINK = "a long, b long"


def passes_needed(bits: dict[int, int], similarity: float, recall: float) -> int:
    """Passes after which a pair at ``similarity`` has met in a window with
    probability ``recall``, over all classes; ``bits``: how many classes have
    so many bits that must agree for it (``window_bits``)."""
    need, rows = np.array(list(bits), dtype=float), np.array(list(bits.values()), dtype=float)
    if not len(need):
        return 1
    met = (1 - math.acos(min(similarity, 1.0)) / math.pi) ** need

    def found(passes: int) -> float:
        return float(rows @ (1 - (1 - met) ** passes) / rows.sum())

    high = 1
    while found(high) < recall:
        high *= 2
    low = high // 2  # too few, or 0
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if found(middle) >= recall else (middle, high)
    return high


def window_bits(classes: DataFrame, kind: str, threshold: float, window: int, seed: int) -> dict[int, int]:
    """Rows of the first passes by the number of leading bits of the key that
    fewer than ``window`` neighbours on a side share.  A row that is linked
    with the one ``window`` places on is in a group that windows chain, and
    does not count; nor do the last ``window`` rows of a partition."""
    order = ["lane", "key", "class_no"]
    rows = _keyed(classes, kind, MEASURED, seed).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(KEY_BITS + 1, dtype=np.int64), None
        for batch in (b.slice(s, 4096) for b in batches for s in range(0, b.num_rows, 4096)):
            batch = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(max(batch.num_rows - window, 0))
            lanes, keys = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = np.arange(max(batch.num_rows - window, 0))
            same = lanes[at] == lanes[at + window]
            counts[0] += (~same).sum()  # the end of a lane
            at = at[same]
            for lane in np.unique(lanes[at]).tolist():
                mine = at[lanes[at] == lane]
                x, y = (unit(matrix(batch.column(1).take(pa.array(m)), kind)) for m in (mine, mine + window))
                mine = mine[np.einsum("ij,ij->i", x, y) < threshold]
                differ = keys[mine] ^ keys[mine + window]
                shared = KEY_BITS - np.array([d.bit_length() for d in differ.tolist()], dtype=np.int64)
                counts += np.bincount(np.minimum(shared + 1, KEY_BITS), minlength=KEY_BITS + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bits", "n"])

    found = rows.mapInArrow(tidy(run), "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n"))
    return {r.bits: r.n for r in found.collect()}  # KEY_BITS + 1 at most


def directions(dims: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dims]).normal(size=(dims, KEY_BITS))


def _keyed(classes: DataFrame, kind: str, passes: int, seed: int) -> DataFrame:
    """(class_no, vec, lane, key): one row a pass.  A lane is a pass over the
    vectors of one dimension."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for batch in (b.slice(s, 2048) for b in batches for s in range(0, b.num_rows, 2048)):
            dims = np.array([len(v) // size for v in batch.column(1).to_pylist()])
            for d in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = matrix(rows.column(1), kind)
                for p in range(passes):
                    if (d, p) not in planes:
                        planes[d, p] = directions(d, p, seed)
                    bits = (x @ planes[d, p] >= 0).astype(np.int64)
                    key = bits @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                    lane = pa.array(np.full(len(x), d * passes + p, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lane, pa.array(key)],
                                                     names=["class_no", "vec", "lane", "key"])

    return classes.select("class_no", "vec").mapInArrow(tidy(run), "class_no long, vec binary, lane long, key long")


def projection_links(classes: DataFrame, kind: str, threshold: float, window: int, passes: int, seed: int) -> DataFrame:
    """(``a``, ``b``): links with the components of all pairs of classes that
    are within ``window`` places of each other in some pass and have a cosine of
    at least ``threshold``."""
    order = ["lane", "key", "class_no"]
    rows = _keyed(classes, kind, passes, seed).repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(ids: np.ndarray, lanes: np.ndarray, x: np.ndarray, from_row: int) -> Iterator[pa.RecordBatch]:
        """Pairs that end at ``from_row`` or later."""
        for step in range(1, min(window, len(ids) - 1) + 1):
            at = np.arange(max(from_row - step, 0), len(ids) - step)
            at = at[lanes[at] == lanes[at + step]]
            hit = at[np.einsum("ij,ij->i", x[at], x[at + step]) >= threshold] if len(at) else at
            if len(hit):
                yield _pairs(ids[hit], ids[hit + step])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one partition, cut down to forests of their components, and
        its first and last rows for the next scan."""
        part = TaskContext.get().partitionId()
        head: list = []
        near: list = []
        n_near = 0
        held = None  # the last rows so far, of one lane
        for batch in (b.slice(s, 4096) for b in batches for s in range(0, b.num_rows, 4096)):
            ids, vecs, lanes = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            if len(head) < window:
                head += [(i, v, lane, n) for n, (i, v, lane) in enumerate(
                    zip(ids[:window].tolist(), vecs[:window].to_pylist(), lanes[:window].tolist()), len(head))][:window - len(head)]
            cuts = np.flatnonzero(lanes[1:] != lanes[:-1]) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ids)]):
                x, i, v = unit(matrix(vecs.slice(s, e - s), kind)), ids[s:e], vecs.slice(s, e - s).to_pylist()
                old = 0
                if held is not None and held[1] == lanes[s]:
                    old = len(held[0])
                    x, i, v = np.concatenate([held[2], x]), np.concatenate([held[0], i]), held[3] + v
                for pairs in compare(i, np.full(len(i), lanes[s]), x, old):
                    near.append(pairs)
                    n_near += pairs.num_rows
                if n_near >= FOREST_LINKS:
                    yield _tagged(near)
                    near, n_near = [], 0
                held = (i[-window:], lanes[s], x[-window:], v[-window:])
        if near:
            yield _tagged(near)
        if held is not None:
            for row in head:
                yield _edge(part - 1, 1, *row)
            last = len(held[0])
            for n, (i, v) in enumerate(zip(held[0].tolist(), held[3])):
                yield _edge(part, 0, i, v, int(held[1]), last - 1 - n)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs across a border of two partitions: row n before it and row m
        behind it are n + m + 1 places apart."""
        now, tail = None, []
        for batch in batches:
            for where, side, i, v, lane, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != where:
                    now, tail = where, []
                if side == 0:
                    tail.append((i, v, lane, n))
                    continue
                near = [t for t in tail if t[2] == lane and t[3] + n + 1 <= window]
                if near:
                    x = unit(matrix(pa.array([t[1] for t in near] + [v], pa.binary()), kind))
                    hit = np.flatnonzero(x[:-1] @ x[-1] >= threshold)
                    if len(hit):
                        yield _pairs(np.array([near[h][0] for h in hit]), np.full(len(hit), i))

    schema = "a long, b long, side int, vec binary, lane long, place int"
    found = materialise(rows.mapInArrow(tidy(scan), schema))
    edges = found.where(F.col("side") >= 0).select(F.col("b").alias("border"), "side", F.col("a").alias("class_no"), "vec", "lane", "place")
    crossing = edges.repartition("border").sortWithinPartitions("border", "side", "place").mapInArrow(tidy(border), LINK)
    return found.where(F.col("side") < 0).select("a", "b").unionByName(crossing)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _tagged(pairs: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A forest with the components of the pairs, as rows of no border."""
    a, b = forest(*(np.concatenate([p.column(i).to_numpy() for p in pairs]) for i in (0, 1)))
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
        names=["a", "b", "side", "vec", "lane", "place"])


def _edge(border: int, side: int, class_no: int, vec: bytes, lane: int, place: int) -> pa.RecordBatch:
    values = [(class_no, pa.int64()), (border, pa.int64()), (side, pa.int32()), (vec, pa.binary()), (lane, pa.int64()), (place, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["a", "b", "side", "vec", "lane", "place"])


def count_links(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(``class_no``, ``links``): for the classes (``component``,
    ``class_no``, ``vec``, ``copies``) of each component, the vectors of other
    classes at ``threshold`` or above.  A component is dealt to chunks of
    about ``CHUNK`` classes and every pair of chunks is one group of rows."""
    chunks = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = members.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("class_no"), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.select("component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk",
                       "class_no", "copies", "vec")
    group = ["component", "low", "high"]

    def emit(key, parts) -> pa.RecordBatch:
        columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        chunk, ids, copies = columns
        x = unit(matrix(pa.array([v for p in parts for v in p[3]], pa.binary()), kind))
        left = chunk == key[1]
        right = left if key[1] == key[2] else ~left
        near = x[left] @ x[right].T >= threshold
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
            return _counts(ids, near @ copies)
        return _counts(np.concatenate([ids[left], ids[right]]), np.concatenate([near @ copies[right], copies[left] @ near]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
                if s == e:
                    continue
                key = tuple(int(k[s]) for k in keys)
                if held and key != now:
                    yield emit(now, held)
                    held = []
                now = key
                part = batch.slice(s, e - s)
                held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).to_pylist()))
        if held:
            yield emit(now, held)

    counted = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(run), "class_no long, links long")
    return counted.groupBy("class_no").agg(F.sum("links").alias("links"))


def _counts(ids: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], names=["class_no", "links"])


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                         window: int = 32, similarity: float | None = None, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (``vec_id`` is ``component_id``).

    Links are cosines of at least ``threshold``.  ``similarity`` (of the pairs
    to be found; the threshold if None) and ``recall`` set the number of passes
    (``passes_needed``).  Null, empty, zero and
    non-finite vectors link with nothing; vectors of different dimensions do
    not link.  Rows with equal vectors link, repeated rows included.  A null id
    is never the smallest and is never kept; an empty table gives no rows;
    other columns are not read."""
    kind = component_type(vectors, vector_col)
    packed = materialise(packed_vectors(vectors, id_col, vector_col))
    classes = vector_classes(packed)
    bits = window_bits(classes, kind, threshold, window, seed)
    passes = passes_needed(bits, threshold if similarity is None else similarity, recall)
    links = projection_links(classes, kind, threshold, window, passes, seed)
    labels = materialise(connected_components(links).toDF("class_no", "component"))
    members = classes.join(labels, "class_no")
    counts = count_links(members, kind, threshold)
    smallest = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = labels.join(smallest, "component").join(counts, "class_no").select(
        "class_no", "component_id", "links", F.lit(True).alias("linked"))
    resolved = classes.join(linked, "class_no", "left").select(
        "vec", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    valid = packed.where(F.col("vec").isNotNull()).join(resolved, "vec").select("vec_id", "n_links", "component_id")
    alone = packed.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = valid.unionByName(alone).withColumn("vec_id", F.col("vec_id").cast(field_type(vectors, id_col)))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
