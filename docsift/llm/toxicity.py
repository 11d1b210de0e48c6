"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

A text is lower-cased (A-Z) and its white space made blank; its features are
the distinct byte n-grams, hashed into ``2**BITS`` buckets.  Training takes a
bounded sample of labelled rows.  A first pass counts, per bucket, the toxic
and the other sample documents that hold it; their smoothed ratio gives the
naive Bayes log-count ratio r.  Buckets whose counts differ significantly
between the classes (at most ``max_features``, largest chi-square first) become
the inputs of a logistic regression on x * r with an L2 penalty.  Scoring is one pass over the documents without a shuffle: the
model is a table of at most ``max_features`` weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.common import LOWER_SPACE_BYTES, byte_block, chunked, crc32_remainder, field_type, give_back, materialise, only, tidy

ORDERS = (4, 5, 6, 7)
BITS = 22
BLOCKS = 64
BLOCK_BYTES = 1 << 20
SAMPLE_TASKS = 16
CHUNK_FEATURES = 1 << 19
_LOWER = np.frombuffer(LOWER_SPACE_BYTES, dtype=np.uint8)
_MULTIPLIERS = {4: 0x9E3779B97F4A7C15, 5: 0xC2B2AE3D27D4EB4F, 6: 0x165667B19E3779F9, 7: 0xA0761D6478BD642F}


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray   # sorted
    weights: np.ndarray
    bias: float


def hashed_ngrams(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at every byte of lower-cased ``data`` that has one
    (``len(data) - order + 1`` entries)."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    code = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,)) & np.uint64((1 << (8 * order)) - 1)
    code *= np.uint64(_MULTIPLIERS[order])
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(64 - BITS)).astype(np.int32)


def document_buckets(text: np.ndarray) -> np.ndarray:
    """Distinct buckets of one lower-cased text."""
    return np.unique(np.concatenate([hashed_ngrams(text, n) for n in ORDERS]))


def score_block(data: np.ndarray, offsets: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
    """Sum of the weights of the distinct buckets of each document.  Buckets
    without weight are dropped before anything is sorted."""
    data, n_docs = _LOWER[data], len(offsets) - 1
    keys = []
    for order in ORDERS:
        buckets = hashed_ngrams(data, order)
        at = np.flatnonzero(weight_of[buckets])
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + order <= offsets[doc + 1]
        keys.append(doc[inside].astype(np.int64) << BITS | buckets[at[inside]])
    keys = np.unique(np.concatenate(keys))
    return np.bincount(keys >> BITS, weights=weight_of[keys & ((1 << BITS) - 1)], minlength=n_docs)[:n_docs]


def training_sample(labels: DataFrame, max_rows: int, folds: int = 5, id_col: str = "doc_id",
                    label_col: str = "toxic") -> DataFrame:
    """(doc_id, label) of at most about ``max_rows`` labelled documents outside
    the held-out fold, chosen by a hash of the id.  Null ids and labels are
    dropped; of several labels of a document the largest counts."""
    rows = only(labels, id_col, label_col).toDF("doc_id", "label")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc32_remainder(F.col("doc_id"), folds) != 0))
    rows = rows.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    share = max_rows / max(rows.count(), max_rows)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, times: np.ndarray, ratio: np.ndarray, penalty: float,
                 steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights (of x) and bias of a logistic regression on x * ratio, by
    gradient steps on the mean loss with an L2 penalty; every weight has its
    own step size, so that rare and frequent features learn alike.  Row i holds
    the features of ``times[i]`` documents.  Works through the rows in chunks of
    ``CHUNK_FEATURES`` features."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    chunks, start = [], 0
    ends = np.cumsum(lengths)
    while start < len(rows):
        base = ends[start] - lengths[start]
        stop = max(int(np.searchsorted(ends, base + CHUNK_FEATURES, side="right")), start + 1)
        chunks.append((start, stop, np.concatenate(rows[start:stop])))
        start = stop
    n, w = max(times.sum(), 1.0), np.zeros(len(ratio))
    bias = float(np.log(((labels * times).sum() + 0.5) / (((1 - labels) * times).sum() + 0.5)))
    sum_w, sum_b = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(steps if chunks else 0):
        scaled, grad_w, grad_b = w * ratio, np.zeros(len(ratio)), 0.0
        for start, stop, flat in chunks:
            row_of = np.repeat(np.arange(stop - start), lengths[start:stop])
            z = bias + np.bincount(row_of, weights=scaled[flat], minlength=stop - start)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[start:stop]) * times[start:stop]
            grad_w += np.bincount(flat, weights=error[row_of], minlength=len(ratio))
            grad_b += error.sum()
        grad_w, grad_b = grad_w * ratio / n + penalty * w, grad_b / n
        sum_w += grad_w * grad_w
        sum_b += grad_b * grad_b
        w -= 0.1 * grad_w / np.sqrt(sum_w)
        bias -= 0.1 * grad_b / np.sqrt(sum_b)
    return w * ratio, float(bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 1 << 14, min_docs: int = 3,
                   folds: int = 5, penalty: float = 1e-3, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> ToxicityModel:
    """Fit the classifier on at most about ``max_rows`` labelled documents
    whose crc32(id) mod ``folds`` is not 0.

    The sample is bounded, so it may be broadcast to the documents and its
    model fitted in one place.  No labelled document: a model without weights
    that scores 0.5 (one class alone: its rate, near 0 or 1)."""
    sample = training_sample(labels, max_rows, folds, id_col, label_col)
    texts = only(docs, id_col, text_col).toDF("doc_id", "text").where(F.col("doc_id").isNotNull())
    rows = materialise(texts.join(F.broadcast(sample), "doc_id").select("label", "text").repartition(SAMPLE_TASKS))

    span = (1 << BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros((2, 1 << BITS), dtype=np.int32), [0, 0]
        for batch in chunked(batches, BLOCK_BYTES):
            data, offsets = byte_block(batch.column(1))
            data = _LOWER[data]
            for i, label in enumerate(batch.column(0).to_pylist()):
                counts[label][document_buckets(data[offsets[i]:offsets[i + 1]])] += 1
                sizes[label] += 1
        for block in range(BLOCKS):
            part = counts[:, block * span:(block + 1) * span]
            used = np.flatnonzero(part.any(axis=0)).astype(np.int32)
            if len(used) or (block == 0 and sum(sizes)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int32()), pa.array([used.tobytes()], pa.binary()),
                    pa.array([part[:, used].tobytes()], pa.binary()), pa.array([sizes[0] if block == 0 else 0], pa.int64()),
                    pa.array([sizes[1] if block == 0 else 0], pa.int64())], names=["block", "used", "counts", "other", "toxic"])

    counted = materialise(rows.mapInArrow(tidy(count), "block int, used binary, counts binary, other long, toxic long"))
    other, toxic = counted.agg(F.coalesce(F.sum("other"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def merge(table: pa.Table) -> pa.Table:
        total, block = np.zeros((2, span), dtype=np.int64), table.column("block")[0].as_py()
        for used, counts in zip(table.column("used").to_pylist(), table.column("counts").to_pylist()):
            used = np.frombuffer(used, np.int32)
            total[:, used] += np.frombuffer(counts, np.int32).reshape(2, -1)
        keep = np.flatnonzero(total.sum(axis=0) >= min_docs)
        q, p = total[:, keep].astype(np.float64)
        n = other + toxic
        expected = (p + q) * toxic / n
        chi = (p - expected) ** 2 / np.maximum(expected * (1 - (p + q) / n) * (1 - toxic / n), 1e-9)
        strong = chi >= 10.8  # one bucket in a thousand by chance
        return pa.table({"bucket": pa.array((keep + block * span)[strong], pa.int32()), "p": pa.array(p[strong], pa.float64()),
                         "q": pa.array(q[strong], pa.float64()), "chi": pa.array(chi[strong], pa.float64())})

    best = (counted.groupBy("block").applyInArrow(merge, "bucket int, p double, q double, chi double")
            .orderBy(F.desc("chi"), "bucket").limit(max_features).collect())
    if max_features > 1 << 16:
        raise ValueError("features are numbered with two bytes")
    best.sort(key=lambda r: r.bucket)
    buckets = np.array([r.bucket for r in best], dtype=np.int32)
    p, q = np.array([r.p for r in best]), np.array([r.q for r in best])
    ratio = np.log((p + 1) / (toxic + 2)) - np.log((q + 1) / (other + 2))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, BLOCK_BYTES):
            data, offsets = byte_block(batch.column(1))
            data, out = _LOWER[data], []
            for i in range(batch.num_rows):
                found = np.intersect1d(document_buckets(data[offsets[i]:offsets[i + 1]]), buckets, assume_unique=True)
                out.append(np.searchsorted(buckets, found).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["label", "features"])

    # at most max_rows lists of selected features, two bytes each; copies of a text are one
    picked = rows.mapInArrow(tidy(select), "label int, features binary").groupBy("label", "features").count().collect()
    picked.sort(key=lambda r: (r["label"], bytes(r["features"])))  # the same sums in every run
    lists = [np.frombuffer(r["features"], "<u2") for r in picked]
    labels, times = (np.array([r[c] for r in picked], dtype=np.float64) for c in ("label", "count"))
    weights, bias = fit_logistic(lists, labels, times, ratio, penalty)
    del picked, lists
    give_back()
    return ToxicityModel(buckets, weights.astype(np.float32), bias)


def dense_weights(model: ToxicityModel) -> np.ndarray:
    dense = np.zeros(1 << BITS, dtype=np.float32)
    dense[model.buckets] = model.weights
    return dense


def block_scores(model: ToxicityModel, dense: np.ndarray, column: pa.Array) -> np.ndarray:
    """Scores of a column of texts."""
    data, offsets = byte_block(column)
    z = model.bias + score_block(data, offsets, dense)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out`` (crc32(id) mod
    ``folds`` is 0; false for a null id), ``score`` in 0..1 and ``predicted``
    (score >= 0.5).  A null or empty text scores the model's base rate;
    repeated rows score alike; an empty table gives no rows; other columns are
    not read."""
    schema = T.StructType([T.StructField("doc_id", field_type(docs, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(model)
        for batch in chunked(batches, BLOCK_BYTES):
            scores = block_scores(model, dense, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = only(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(tidy(run), schema)
    return scored.select("doc_id", F.coalesce(crc32_remainder(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = dense_weights(model)
        for batch in chunked(batches, BLOCK_BYTES, text_col):
            yield batch.filter(pa.array(block_scores(model, dense, batch.column(where)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
