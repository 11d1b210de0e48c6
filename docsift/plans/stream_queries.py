"""Registered streaming queries (ST1, ST2): the stream's input files are
written from the driver tables into a fresh folder under the shared
checkpoint location and consumed with ``trigger(availableNow=True)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.plans.registry import query
from docsift.plans.tag_queries import EDITS_CTE
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures, with_fixtures
from docsift.streaming import keyed as K
from docsift.streaming import upserts as U

KEY = "CASE WHEN length(path) = 0 THEN name ELSE path || '/' || name END"


@query("stream_documents", "ST1", with_fixtures(["corpus", "old", "new"], f"""
SELECT coalesce(n.key, o.key) AS key,
       coalesce(o.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY coalesce(n.size % 3, 0), n.key)) AS id,
       coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.size, o.size) AS size
FROM (SELECT {KEY} AS key, id, mtime, size FROM old) o
FULL OUTER JOIN (SELECT {KEY} AS key, mtime, size FROM new) n ON o.key = n.key"""))
def stream_documents(spark, sf_dir):
    """The new listing arrives in three parts, each in as many files as it has
    partitions and each taken up by a run of its own; fresh ids follow the order
    of arrival."""
    fx = Fixtures(spark, sf_dir)
    src, work = scratch_dir(spark, "doc-stream"), scratch_dir(spark, "doc-upsert")
    U.start_documents(spark, fx.old, work)
    for part in range(3):
        fx.new.where(F.coalesce(F.col("size") % 3, F.lit(0)) == part).write.mode("append").parquet(src)
        out = U.continue_documents(spark, src, fx.new.schema, fx.old, work)
    return out.select("key", "id", "mtime", "size")


@query("stream_tag_edits", "ST2", with_fixtures(["tags", "tag_edits"], "SELECT id, tag FROM edited", EDITS_CTE))
def stream_tag_edits(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    src = scratch_dir(spark, "tag-stream")
    fx.tag_edits.repartition(4).write.mode("overwrite").parquet(src)
    work = scratch_dir(spark, "tag-state")
    return U.stream_tag_edits(spark, src, fx.tag_edits.schema, fx.tags, work)


@query("stream_tag_edits_keyed", "ST2", with_fixtures(["tags", "tag_edits"], "SELECT id, tag FROM edited", EDITS_CTE))
def stream_tag_edits_keyed(spark, sf_dir):
    """With keyed state, in two runs: the second goes on from the checkpoint."""
    fx = Fixtures(spark, sf_dir)
    src, work = scratch_dir(spark, "tag-stream"), scratch_dir(spark, "tag-keyed")
    edits = fx.tag_edits.select("id", "tag", "op", "seq")
    K.start_tag_edits(spark, work)
    for half in (1, 0):
        edits.where(F.col("seq") % 2 == half).write.mode("append").parquet(src)
        K.continue_tag_edits(spark, src, work)
    return K.current_tags(spark, fx.tags, work)
