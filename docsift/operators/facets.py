"""Facets and statistics.

Every facet is a ``groupBy`` whose partial aggregation runs map-side, so a
key holding a third of all rows costs one partial row per task before the
shuffle.  Directory counts explode each document's ancestor directories
once (bounded by path depth) instead of looping level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.paths import path_ancestors, path_depth, strict_ancestors, under
from docsift.operators.documents import major_mime, typed_documents

SIZE_BUCKET = 5_000_000  # fixed value: bytes per size bin
DATE_BUCKET = 2_629_800  # fixed value: seconds per date bin (about a month)


def size_histogram(docs: DataFrame, bucket: int = SIZE_BUCKET, col: str = "size") -> DataFrame:
    """A1: floor(size / b) * b, count."""
    b = F.lit(bucket).cast("long")
    return (docs.groupBy((F.floor(F.col(col) / b).cast("long") * b).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("count")))


def date_histogram(docs: DataFrame, bucket: int = DATE_BUCKET, col: str = "mtime") -> DataFrame:
    """A2: as A1 on the modification time."""
    return size_histogram(docs, bucket, col)


def mime_totals(docs: DataFrame, mime_dim: DataFrame) -> DataFrame:
    """A3: sum(size) and count per known media type (J2 inner join)."""
    return (typed_documents(docs, mime_dim).groupBy("mime")
            .agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("count")))


def mime_index(index_docs: DataFrame) -> DataFrame:
    """A4: count per (index_id, mime), mime not null."""
    return (index_docs.where(F.col("mime").isNotNull()).groupBy("index_id", "mime")
            .agg(F.count(F.lit(1)).alias("count")))


def mime_facet(mime_idx: DataFrame) -> DataFrame:
    """A5: A4 summed over indices."""
    return mime_idx.groupBy("mime").agg(F.sum("count").cast("long").alias("count"))


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered frame; all of them without ``n``."""
    return df if n is None else df.limit(n)


def mime_facet_for_query(hits: DataFrame, top: int | None = None) -> DataFrame:
    """Media-type counts over the hits of a query, biggest first; all
    types, or the ``top`` ones of a top-k request."""
    counts = hits.where(F.col("mime").isNotNull()).groupBy("mime").agg(F.count(F.lit(1)).alias("count"))
    return first_rows(counts.orderBy(F.col("count").desc(), F.col("mime")), top)


def mime_tree(index_docs: DataFrame) -> DataFrame:
    """Category -> subtype counts, with category totals (ROLLUP)."""
    d = index_docs.where(F.col("mime").isNotNull()).select(major_mime("mime").alias("category"), "mime")
    return d.rollup("category", "mime").agg(F.count(F.lit(1)).alias("count"))


def date_range(docs: DataFrame, col: str = "mtime") -> DataFrame:
    """min/max mtime; equal bounds -> max + 1; no rows -> (0, 1)."""
    a = docs.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo = F.coalesce(F.col("lo"), F.lit(0)).cast("long")
    hi = F.coalesce(F.col("hi"), F.lit(1)).cast("long")
    return a.select(lo.alias("date_min"), F.when(lo == hi, hi + 1).otherwise(hi).alias("date_max"))


def path_index(index_docs: DataFrame) -> DataFrame:
    """A10: per (index_id, directory): documents in it or below it, with its
    depth.  Top-level documents (empty directory) are not counted."""
    return (index_docs.where(F.length("path") > 0)
            .select("index_id", F.explode(path_ancestors("path")).alias("path"))
            .groupBy("index_id", "path").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("depth", path_depth(F.col("path"))))


def path_children(paths: DataFrame, index_id: int | None, depth_min: int, depth_max: int,
                  prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Directories between two depths, optionally at/below a prefix; all
    of them, or the first ``limit`` by path."""
    cond = F.col("depth").between(depth_min, depth_max)
    if index_id is not None:
        cond = cond & (F.col("index_id") == index_id)
    if prefix:
        cond = cond & under(F.col("path"), prefix)
    return first_rows(paths.where(cond).orderBy("path", "index_id"), limit).select("index_id", "path", "count")


def path_tree_level(paths: DataFrame, index_id: int, node: str | None, node_depth: int) -> DataFrame:
    """Entries one to three levels below ``node``; an entry below an
    already listed entry ('/' boundary) is dropped, which leaves exactly the
    entries none of whose ancestors are also candidates."""
    cand = path_children(paths, index_id, node_depth + 1, node_depth + 3, node).select("path", "count")
    if node:
        cand = cand.where(F.length("path") > len(node))
    below = (cand.select("path", F.explode(strict_ancestors("path")).alias("anc"))
             .join(cand.select(F.col("path").alias("anc")), "anc", "left_semi").select("path"))
    return cand.join(below, "path", "left_anti")


def date_histogram_peaks(hist: DataFrame, q: float = 0.9) -> DataFrame:
    """Bins whose count is above the ``q`` quantile (linear interpolation)."""
    thr = hist.select(F.percentile(F.col("count"), F.lit(q))).scalar()
    return hist.where(F.col("count") > thr)
