"""Tag operators.

Tags are (id, tag) rows.  Per-tag facets explode the '.'-prefixes of each
tag (bounded by tag depth) and aggregate with map-side partial counts, so a
tag carried by a third of all documents is no hot spot.  Edits resolve the
latest operation per (id, tag) with ``max_by`` (an aggregate, not a window),
then apply as anti joins and unions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.tags import is_coloured, tag_colour, tag_id, tag_prefixes
from docsift.operators.facets import first_rows



def tags_all(docs: DataFrame, tags: DataFrame, query_tags: list[str], require_all: bool = True,
             id_col: str = "id") -> DataFrame:
    """F8: hierarchy tokens of each tag (lower-cased, self included) must
    contain every query tag (AND) or one of them (OR)."""
    q = sorted({t.lower() for t in query_tags})
    tok = (tags.select(F.col(id_col).alias("_tid"), F.explode(tag_prefixes(F.lower("tag"))).alias("tok"))
           .where(F.col("tok").isin(q)))
    if require_all:
        ok = tok.groupBy("_tid").agg(F.count_distinct("tok").alias("_n")).where(F.col("_n") == len(q))
    else:
        ok = tok.select("_tid").distinct()
    return docs.join(ok, docs[id_col] == ok["_tid"], "left_semi")


def tag_counts(tags: DataFrame) -> DataFrame:
    """Documents per tag."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def tag_facet_hierarchy(tags: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct documents per tag prefix, biggest first; all prefixes, or
    the ``top`` ones of a top-k request."""
    counts = (tags.select("id", F.explode(tag_prefixes("tag")).alias("tag")).groupBy("tag")
              .agg(F.count_distinct("id").alias("count")))
    return first_rows(counts.orderBy(F.col("count").desc(), F.col("tag")), top)


def first_per_tag_id(tags: DataFrame) -> DataFrame:
    """Distinct tags, one per id-without-colour: the alphabetically first."""
    return (tags.select("tag").distinct().groupBy(tag_id("tag").alias("tag_id"))
            .agg(F.min("tag").alias("tag")))


def tag_tree(tags: DataFrame) -> DataFrame:
    """Nodes of the tag tree: every '.'-prefix of each kept tag id, with
    its parent and depth; leaves carry the colour of the kept tag."""
    kept = first_per_tag_id(tags).withColumn("_pre", tag_prefixes("tag_id"))
    nodes = kept.select("tag_id", "tag", "_pre", F.posexplode("_pre").alias("pos", "node"))
    leaf = F.col("node") == F.col("tag_id")
    out = nodes.select(
        "node",
        F.when(F.col("pos") == 0, F.lit(None).cast("string"))
        .otherwise(F.try_element_at(F.col("_pre"), F.col("pos").cast("int"))).alias("parent"),
        (F.col("pos") + 1).cast("int").alias("depth"),
        F.when(leaf, tag_colour("tag")).alias("colour"),
    )
    return out.groupBy("node", "parent", "depth").agg(F.max("colour").alias("colour"))


def tags_as_array(tags: DataFrame) -> DataFrame:
    """Sorted distinct tag list per document."""
    return tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def distinct_tags(tags: DataFrame) -> DataFrame:
    """U2."""
    return tags.select("tag").distinct()


def tag_sync_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(id, tag, op) rows that turn ``target`` into ``source``."""
    s = source.select("id", "tag").distinct()
    t = target.select("id", "tag").distinct()
    ins = s.join(t, ["id", "tag"], "left_anti").withColumn("op", F.lit("insert"))
    dele = t.join(s, ["id", "tag"], "left_anti").withColumn("op", F.lit("delete"))
    return ins.unionByName(dele)


def apply_diff(target: DataFrame, diff: DataFrame) -> DataFrame:
    """Target minus deletes plus inserts."""
    dels = diff.where(F.col("op") == "delete").select("id", "tag")
    ins = diff.where(F.col("op") == "insert").select("id", "tag")
    return target.select("id", "tag").join(dels, ["id", "tag"], "left_anti").unionByName(ins).distinct()


def latest_edits(edits: DataFrame) -> DataFrame:
    """Last operation per (id, tag) by ``seq``."""
    return edits.groupBy("id", "tag").agg(F.max_by("op", "seq").alias("op"))


def apply_tag_edits(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Idempotent adds and deletes; the later edit wins per (id, tag)."""
    last = latest_edits(edits)
    base = tags.select("id", "tag").distinct()
    kept = base.join(last.select("id", "tag"), ["id", "tag"], "left_anti")
    added = last.where(F.col("op") == "add").select("id", "tag")
    return kept.unionByName(added)


def refresh_tag_arrays(arrays: DataFrame, new_tags: DataFrame, touched: DataFrame) -> DataFrame:
    """I8: recompute the tag array of touched documents only; others keep theirs."""
    t = touched.select("id").distinct()
    fresh = tags_as_array(new_tags.join(t, "id", "left_semi"))
    untouched = arrays.join(t, "id", "left_anti")
    # touched ids that lost every tag get an empty array
    emptied = t.join(fresh.select("id"), "id", "left_anti").select("id", F.array().cast("array<string>").alias("tags"))
    return untouched.unionByName(fresh).unionByName(emptied)


def suggest_tags(tags: DataFrame, prefix: str, n: int | None = None) -> DataFrame:
    """Distinct tags starting with ``prefix``, ordered; all, or the first ``n``."""
    return first_rows(tags.where(F.col("tag").startswith(prefix)).select("tag").distinct().orderBy("tag"), n)


def suggest_tags_no_colour(tags: DataFrame, prefix: str, n: int | None = None) -> DataFrame:
    """As O8, one per tag id (colour ignored), first tag kept."""
    cand = tags.where(F.col("tag").startswith(prefix))
    return first_rows(first_per_tag_id(cand).orderBy("tag_id"), n).select("tag_id", "tag")


def parse_tags(tags: DataFrame) -> DataFrame:
    """P14/P15 over distinct tags: id, colour, leaf flag, luminance, foreground."""
    from docsift.functions.tags import luminance

    d = tags.select("tag").distinct()
    return d.select("tag", tag_id("tag").alias("tag_id"), tag_colour("tag").alias("colour"),
                    is_coloured("tag").alias("is_leaf"),
                    F.round(luminance(tag_colour("tag")), 4).alias("luminance"),
                    F.when(is_coloured("tag"), F.when(luminance(tag_colour("tag")) > 50, F.lit("#000"))
                           .otherwise(F.lit("#fff"))).alias("fg"))
