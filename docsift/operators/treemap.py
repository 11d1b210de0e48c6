"""Disk-usage treemap.

A13 merges entries smaller than ``threshold x total`` into their directory,
bottom-up one depth at a time until the top level: an entry at depth d that
stays small is added to its parent at depth d-1 (created if absent), and the
parent is judged with the merged size at the next step.  Bytes are conserved.

Each step touches only the rows of one depth plus the sums carried up from
the level below: a ``groupBy(path).sum`` and a ``groupBy(parent).sum``, both
with map-side partial sums.  The loop runs ``max depth`` times (one row of
scalars reaches the driver, once) and the carried rows are cut from their
lineage at every level with ``checkpoint()`` into the shared checkpoint
folder, so a lost executor never replays earlier levels.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.paths import path_ancestors, path_depth, path_parent
from docsift.session import ensure_checkpoint_dir, scratch_dir

TREEMAP_THRESHOLD = 0.0005  # fixed value: fraction of the total size


def treemap(docs: DataFrame, threshold: float = TREEMAP_THRESHOLD, path_col: str = "path",
            size_col: str = "size") -> DataFrame:
    """(path, size) entries after merging small entries upward.

    Work per level is proportional to that level: the entries at depth d plus
    what the level below carried up are summed per path; entries at or above
    the threshold are final, the others are summed per parent and carried to
    depth d - 1.  Only the carried rows (checkpointed each level) cross from
    one level to the next, so the table is not re-shuffled once per level."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    # entries written once, by depth: the input (often a join) is read a single
    # time, and each level below reads the folder of its own depth only
    stored = scratch_dir(spark, "treemap")
    (docs.groupBy(F.col(path_col).alias("path")).agg(F.sum(size_col).cast("long").alias("size"))
     .withColumn("depth", path_depth(F.col("path"))).write.partitionBy("depth").parquet(stored))
    flat = spark.read.schema("path string, size long, depth long").parquet(stored)
    top = flat.agg(F.max("depth").alias("d"), F.sum("size").cast("double").alias("t")).first()
    max_depth = top["d"] or 0
    # threshold in bytes: floor(total x threshold)
    cut = F.lit(int(math.floor((top["t"] or 0.0) * threshold))).cast("long")
    finals = [flat.where(F.col("depth") == 0).select("path", "size")]  # top-level files stay as they are
    carried = None
    for d in range(max_depth, 0, -1):
        level = flat.where(F.col("depth") == d).select("path", "size")
        if carried is not None:
            level = (level.unionByName(carried).groupBy("path")
                     .agg(F.sum("size").cast("long").alias("size")))
        if d == 1:  # top-level entries have no parent to merge into
            finals.append(level)
            break
        finals.append(level.where(F.col("size") >= cut))
        carried = (level.where(F.col("size") < cut)
                   .groupBy(path_parent(F.col("path")).alias("path"))
                   .agg(F.sum("size").cast("long").alias("size"))).checkpoint(eager=True)
    out = finals[0]
    for f in finals[1:]:
        out = out.unionByName(f)
    return out


def treemap_tree(entries: DataFrame) -> DataFrame:
    """Nested totals of the treemap entries: every directory node gets
    the sum of the entries at or below it; an entry that is also an inner
    node contributes an own-size child named '.'."""
    nodes = entries.select(F.explode(path_ancestors("path")).alias("node"), "size")
    totals = nodes.groupBy("node").agg(F.sum("size").cast("long").alias("size"))
    has_children = (entries.select(F.explode(path_ancestors("path")).alias("anc"), "path")
                    .where(F.col("anc") != F.col("path")).select(F.col("anc").alias("path")).distinct())
    own = entries.join(has_children, "path", "left_semi").select(
        F.concat(F.col("path"), F.lit("/.")).alias("node"), "size")
    out = totals.unionByName(own)
    return out.withColumn("depth", path_depth(F.col("node")))
