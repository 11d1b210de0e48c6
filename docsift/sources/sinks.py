"""Sinks and index registries.

Exports are DataFrame writes (text / CSV); batch numbering for bulk payloads
uses the distributed dense numbering of ``incremental.dense_ids`` instead of
a single-partition ``row_number``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.ids import format_sid, pack_sid
from docsift.operators.incremental import dense_ids

BULK_BATCH = 70  # fixed value: documents per bulk request


def ndjson_lines(docs: DataFrame, source_fields: list[str], index_name) -> DataFrame:
    """One JSON line per document: {_id, _index, _source}."""
    idx = F.lit(index_name) if isinstance(index_name, str) else index_name
    line = F.to_json(F.struct(format_sid(pack_sid("index_id", "id")).alias("_id"), idx.alias("_index"),
                              F.struct(*source_fields).alias("_source")))
    return docs.select(line.alias("value"))


def export_ndjson(docs: DataFrame, path: str, source_fields: list[str], index_name="docs") -> None:
    ndjson_lines(docs, source_fields, index_name).write.mode("overwrite").text(path)


def bulk_payload(index_rows: DataFrame, delete_ids: DataFrame, source_fields: list[str],
                 batch: int = BULK_BATCH, index_name: str = "docs") -> DataFrame:
    """Action line (+ source line for 'index', none for 'delete') per
    document, numbered in (operation, sid) order and grouped in batches.
    Returns (batch, row, part, line); part 0 is the action, 1 the source."""
    idx = index_rows.select(F.lit(0).alias("op"), pack_sid("index_id", "id").alias("sid"),
                            F.to_json(F.struct(*source_fields)).alias("source"))
    dele = delete_ids.select(F.lit(1).alias("op"), pack_sid("index_id", "id").alias("sid"),
                             F.lit(None).cast("string").alias("source"))
    ops = idx.unionByName(dele).withColumn("_k", F.struct("op", "sid"))
    numbered = dense_ids(ops, "_k", F.lit(0).cast("long"))
    verb = F.when(F.col("op") == 0, F.lit("index")).otherwise(F.lit("delete"))
    action = F.concat(F.lit('{"'), verb, F.lit('":{"_id":"'), format_sid("sid"), F.lit('","_index":"'),
                      F.lit(index_name), F.lit('"}}'))
    lines = F.when(F.col("op") == 0, F.array(action, F.col("source"))).otherwise(F.array(action))
    return numbered.select(F.floor((F.col("new_id") - 1) / batch).cast("long").alias("batch"),
                           F.col("new_id").alias("row"), F.posexplode(lines).alias("part", "line")) \
        .select("batch", "row", F.col("part").cast("int").alias("part"), "line")


def union_indices(frames: dict[int, DataFrame]) -> DataFrame:
    """Several indices queried together, rows tagged with ``index_id``."""
    out = None
    for index_id, df in frames.items():
        tagged = df.withColumn("index_id", F.lit(index_id).cast("int"))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def index_registry(docs: DataFrame, emb: DataFrame, models: DataFrame) -> DataFrame:
    """One row per index: name, version (the latest run that wrote one of
    its documents, from a ``version`` column when the documents carry one,
    else 1), timestamp (newest modification time), document count, and the
    models that have vectors in it (pre-aggregated before the join)."""
    ver = F.max("version").cast("long") if "version" in docs.columns else F.lit(1).cast("long")
    per = docs.groupBy("index_id").agg(F.count(F.lit(1)).alias("n_docs"), ver.alias("version"),
                                       F.max("mtime").alias("timestamp"))
    ids = docs.select("id", "index_id")
    used = (emb.select("id", "model_id").join(ids, "id").select("index_id", "model_id").distinct()
            .join(F.broadcast(models.select(F.col("id").alias("model_id"), "name")), "model_id"))
    m = used.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("model_id", "name"))).alias("models"))
    return (per.join(m, "index_id", "left")
            .select("index_id", F.concat(F.lit("index"), F.col("index_id").cast("string")).alias("name"),
                    "n_docs", "version", "timestamp", "models"))


def distinct_models(registry: DataFrame) -> DataFrame:
    """Models over all indices, the first index's entry kept per model
    id (an aggregate, not a window)."""
    e = registry.select("index_id", F.explode("models").alias("m"))
    return (e.groupBy(F.col("m.model_id").alias("model_id"))
            .agg(F.min(F.struct("index_id", F.col("m.name").alias("name"))).alias("f"))
            .select("model_id", F.col("f.name").alias("name"), F.col("f.index_id").alias("index_id")))


def facet_tsv(facets: DataFrame, path: str, key: str, count: str = "count") -> None:
    """Facet rows as tab-separated text, biggest count first."""
    (facets.orderBy(F.col(count).desc(), F.col(key)).select(key, count)
     .write.mode("overwrite").option("sep", "\t").csv(path))
