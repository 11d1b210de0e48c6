"""Connected components of a table of links, by alternating star contraction.

Large star: every node hands its larger neighbours to the smallest node it
knows; small star: it hands its smaller neighbours there.  The number of links
never grows, and after a logarithmic number of rounds every node hangs on the
smallest node of its component.  Links that meet in one task are first cut down
to a forest there.  Every round is written as a table to the shared folder and
read again, which cuts the lineage and gives the next round true sizes (sizes
estimated from round to round would multiply); the driver sees two numbers a
round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import shared_path

FOREST_LINKS = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star forest with the components of the links (a, b): every node but the
    smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:  # hook the larger root on the smaller, then shorten the paths
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(parts):
        a, b = forest(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
        if n >= FOREST_LINKS:
            yield emit(held)
            held, n = [], 0
    if held:
        yield emit(held)


def _written(links: DataFrame) -> DataFrame:
    path = shared_path(links.sparkSession, "links")
    links.write.parquet(path)
    return links.sparkSession.read.schema("a long, b long").parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``): the smallest node of its component for every
    node of the links, whose ends are longs; links with a null end or to
    themselves say nothing.  Nodes without links are not listed."""
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pairs = pairs.where(F.col("a") != F.col("b"))
    edges = _written(pairs.mapInArrow(_local_forests, "a long, b long"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that the join below may split a hub's links
        low = _written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))).toDF("a", "low")
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        edges = _written(small.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
                            .unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
