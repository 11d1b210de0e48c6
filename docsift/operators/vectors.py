"""Vector search.

Similarity is a codegen'd ``zip_with`` + ``aggregate`` in double precision.
The query vector is either a literal array or a scalar subquery (one row,
planned once and broadcast as a value), so scoring is a narrow projection of
the vector table; the top-k is taken there (per-partition top-k, then
``k x partitions`` rows merged) and only its k rows meet the documents.
Batches of query vectors (V5) travel in blocks to shards of the vector table,
and only each shard's k best per query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOIN_SHARD = 16_384  # vectors one task of the kNN join holds
PRODUCT_ROWS = 128   # queries compared with them at once
TIE = 1e-9  # cosines that may differ by less than this are compared exactly


def _arr(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def dot(a, b) -> Column:
    a, b = _arr(a), _arr(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    a = _arr(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_sim(q, v) -> Column:
    """V1: dot / (|q| |v|); NULL, NaN or a zero norm give -1."""
    sim = F.try_divide(dot(q, v), norm(q) * norm(v))
    return F.coalesce(F.nanvl(sim, F.lit(-1.0)), F.lit(-1.0))


def model_vectors(emb: DataFrame, model_id: int, start: int | None = 0) -> DataFrame:
    """Vectors of one model (Q7: filter by model, one row per document)."""
    e = emb.where(F.col("model_id") == model_id)
    if start is not None:
        e = e.where(F.col("start") == start)
    return e


def nearest_documents(docs: DataFrame, scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` documents with the best ``similarity`` of ``scored`` (id,
    similarity), ties by id; documents that are not in ``scored`` count as -1.

    The k best are taken from the narrow (id, similarity) rows; those k rows
    (bounded by the request) then fetch their documents.  Documents without a
    vector are looked up only if they can be among the k."""
    ids = docs.select(F.col(id_col).alias("id"))
    best = (scored.join(ids, "id", "left_semi").orderBy(F.col("similarity").desc(), "id").limit(k)).collect()
    spark = docs.sparkSession
    top = spark.createDataFrame([tuple(r) for r in best], "_vid long, similarity double")
    if len(best) < k or best[-1].similarity <= -1.0:
        without = (ids.join(scored.select("id"), "id", "left_anti").orderBy("id").limit(k)
                   .select(F.col("id").alias("_vid"), F.lit(-1.0).alias("similarity")))
        top = top.unionByName(without)
    found = docs.join(F.broadcast(top), docs[id_col] == top["_vid"]).drop("_vid")
    return found.orderBy(F.col("similarity").desc(), F.col(id_col).asc()).limit(k)


def knn_exact(docs: DataFrame, emb: DataFrame, q, k: int, model_id: int = 1,
              id_col: str = "id") -> DataFrame:
    """Documents by cosine similarity to ``q``, best first; documents
    without a vector of the model score -1 and sort last; ties by id."""
    # the query vector becomes a column first: a subquery may not sit inside a lambda
    vec = model_vectors(emb, model_id).select("id", "embedding").withColumn("_q", _arr(q))
    scored = vec.select("id", cosine_sim(F.col("_q"), F.col("embedding")).alias("similarity"))
    return nearest_documents(docs, scored, k, id_col)


def vector_of(emb: DataFrame, doc_id: int, model_id: int = 1) -> Column:
    """Scalar subquery: the start-0 vector of one document."""
    return (model_vectors(emb, model_id).where(F.col("id") == doc_id)
            .select(F.col("embedding").cast("array<double>")).scalar())


def more_like(docs: DataFrame, emb: DataFrame, doc_id: int, k: int, model_id: int = 1) -> DataFrame:
    """V4: search with the vector of an existing document."""
    return knn_exact(docs, emb, vector_of(emb, doc_id, model_id), k, model_id)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, salt_col: str,
                    salts: int | None = None) -> DataFrame:
    """Top-k rows per group, adding a ``rank`` column, without ever holding a
    whole group in one task.

    The limit is done in two rounds, whatever ``k`` is: per (group, salt) - a
    group holding a third of all rows is split over ``salts`` tasks (default:
    the shuffle partition count, at least 64) - then per group over at most
    ``salts x k`` survivors."""
    spark = df.sparkSession
    if salts is None:
        salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1))
             .where(F.col("_r") <= k).drop("_r", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return first.withColumn("rank", F.row_number().over(w2).cast("long")).where(F.col("rank") <= k)


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column as double arrays; a NULL vector is empty."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[s:e] if ok else values[:0] for ok, s, e in zip(valid, offsets[:-1], offsets[1:])]


def _unit_matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Unit vectors as rows, shorter ones filled up with zeros; zero and
    non-finite vectors become NaN rows."""
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, :len(v)] = v
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.full_like(x, np.nan), where=(length > 0) & np.isfinite(length))


def knn_join(queries: DataFrame, emb: DataFrame, k: int, model_id: int = 1, shard_rows: int = JOIN_SHARD,
             block_rows: int = 1024) -> DataFrame:
    """V5: for each query document, its ``k`` nearest other documents (qid,
    id, similarity, rank).

    The vector table is dealt to shards; the query vectors go to every shard
    and are compared there block by block, as a matrix product.  A task holds
    one shard and one block and hands on the k best of each query, so no list
    of all pairs exists anywhere and any number of queries is served."""
    vec = model_vectors(emb, model_id).select("id", "embedding")
    shards = max(1, -(-vec.count() // shard_rows))
    held = vec.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "embedding")
    asked = vec.join(queries.select("id").distinct(), "id", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, x = None, [], [], None
        for batch in (b.slice(s, block_rows) for b in batches for s in range(0, b.num_rows, block_rows)):
            shard, kind, number = (batch.column(i).to_numpy() for i in range(3))
            rows = _rows(batch.column(3))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(shard)]):
                if shard[s] != now:
                    now, ids, vectors, x = shard[s], [], [], None
                if kind[s] == 0:
                    ids.extend(number[s:e].tolist())
                    vectors.extend(rows[s:e])
                elif ids:
                    dims = max(map(len, rows[s:e]))
                    if x is None or x.shape[1] < dims:  # once a shard, unless a longer query comes
                        x = _unit_matrix(vectors, max(dims, *map(len, vectors), 0))
                    for r in range(s, e, PRODUCT_ROWS):
                        end = min(r + PRODUCT_ROWS, e)
                        yield _best(number[r:end], _unit_matrix(rows[r:end], x.shape[1]), np.array(ids), x, k)

    order = ["shard", "kind"]
    found = (held.unionByName(asked).repartition("shard").sortWithinPartitions(*order)
             .mapInArrow(search, "qid long, id long, similarity double"))
    return top_k_per_group(found, ["qid"], [F.col("similarity").desc(), F.col("id").asc()], k, "id")


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query, itself left out; ties by id."""
    sim = q @ x.T
    sim[np.isnan(sim)] = -1.0
    sim = np.where(ids[None, :] == qid[:, None], -np.inf, sim)
    least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(qid), -np.inf)
    at, place, best = [], [], []
    for i in range(len(qid)):
        # a matrix product may differ in the last digits for equal vectors, so what
        # is near the k-th best is computed again, row by row
        near = np.flatnonzero((sim[i] >= least[i] - TIE) & np.isfinite(sim[i]))
        exact = (x[near] * q[i]).sum(axis=1)
        exact[np.isnan(exact)] = -1.0
        order = np.lexsort((ids[near], -exact))[:k]
        at.append(np.full(len(order), qid[i]))
        place.append(ids[near[order]])
        best.append(exact[order])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (at, place, best)], names=["qid", "id", "similarity"])


def best_chunk(emb: DataFrame, q, model_id: int = 2) -> DataFrame:
    """V6: per document, the chunk (start) most similar to ``q``; ties keep
    the earliest start.  An aggregate (max of a struct), not a window."""
    e = model_vectors(emb, model_id, start=None).withColumn("_q", _arr(q))
    s = e.select("id", "start", cosine_sim(F.col("_q"), F.col("embedding")).alias("sim"))
    best = s.groupBy("id").agg(F.max(F.struct(F.col("sim"), (-F.col("start")).alias("ns"))).alias("b"))
    return best.select("id", (-F.col("b.ns")).alias("start"), F.col("b.sim").alias("similarity"))


def check_dims(emb: DataFrame, models: DataFrame) -> DataFrame:
    """V7: vectors whose length differs from their model's size (model table is
    a bounded dimension: broadcast)."""
    m = F.broadcast(models.select(F.col("id").alias("model_id"), F.col("size").alias("dims")))
    return (emb.join(m, "model_id", "left")
            .where(F.col("dims").isNull() | (F.size("embedding") != F.col("dims")))
            .select("id", "model_id", "start", F.size("embedding").alias("length"), "dims"))


def vector_to_json(v, decimals: int | None = None) -> Column:
    """V8: vector as JSON text; with ``decimals`` the elements are written in
    fixed-point form so that every engine prints the same text."""
    a = _arr(v)
    if decimals is None:
        return F.to_json(a)
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string(f"%.{decimals}f",
                                                                                         x.cast("double"))), ","),
                    F.lit("]"))


def has_embedding(docs: DataFrame, emb: DataFrame, model_id: int, id_col: str = "id") -> DataFrame:
    """documents with a vector of the model."""
    ids = emb.where(F.col("model_id") == model_id).select(F.col("id").alias("_vid"))
    return docs.join(ids, docs[id_col] == ids["_vid"], "left_semi")


def vectors_as_map(emb: DataFrame, models: DataFrame) -> DataFrame:
    """{model path: start-0 vector} per document."""
    m = F.broadcast(models.select(F.col("id").alias("model_id"), F.col("path").alias("model_path")))
    e = emb.where(F.col("start") == 0).join(m, "model_id")
    return e.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("model_path", "embedding")))).alias("vectors"))


def export_documents(docs: DataFrame, tags: DataFrame, emb: DataFrame, models: DataFrame,
                     fields: list[str]) -> DataFrame:
    """Document + media type + tag array + vector map as one JSON record;
    the ``tag`` key is absent when a document has no tags.  Tags and vectors
    are pre-aggregated per document before the two left joins."""
    t = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tag"))
    v = vectors_as_map(emb, models).withColumnRenamed("vectors", "emb")
    j = docs.select("id", *fields).join(t, "id", "left").join(v, "id", "left")
    return j.select("id", F.to_json(F.struct(*fields, "tag", "emb")).alias("json"))


def unit_vectors(emb: DataFrame) -> DataFrame:
    """Vectors with a pre-normalised copy (``unit``, NULL for a zero vector),
    written once at index time so that scoring is a single dot product.  The
    norm is an argument of the lambda's list, not of each element."""
    n = norm("embedding")
    lengths = F.array_repeat(n, F.size("embedding"))
    return emb.withColumn("unit", F.when(n > 0, F.zip_with("embedding", lengths, lambda x, y: x.cast("double") / y)))


def knn_unit(docs: DataFrame, vectors: DataFrame, q_unit, k: int, model_id: int = 1,
             id_col: str = "id") -> DataFrame:
    """V2 over pre-normalised vectors: similarity = q_unit . unit (documents
    without a vector of the model score -1), best first, ties by id."""
    vec = model_vectors(vectors, model_id).select("id", F.col("unit").alias("_u")).withColumn("_q", _arr(q_unit))
    sim = F.when(F.col("_u").isNull() | F.col("_q").isNull(), F.lit(-1.0)).otherwise(dot(F.col("_q"), F.col("_u")))
    return nearest_documents(docs, vec.select("id", sim.alias("similarity")), k, id_col)
