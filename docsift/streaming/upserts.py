"""Structured Streaming upserts (ST1, ST2).

ST1 - documents arriving as parquet files are upserted by file key with the
rules of the batch snapshot (modified files keep their id, new files get ids
after the current maximum; absence is not an event, so nothing is deleted).
Each micro-batch only *appends* its resolved rows to a log partitioned by
batch id; the current table is the base plus the newest log row per key
(a ``max_by`` aggregate).  Appends make the sink idempotent: a retried batch
overwrites its own ``batch=N`` partition and nothing else.

Ids are looked up in a key table (key, id), partitioned by a hash of the key:
it is written once from the base when the stream starts, a batch reads only the
partitions of its own keys and adds its new keys under its batch number.

ST2 - tag edits: each micro-batch folds its edits into a state table holding
the latest (op, seq) per (id, tag), partitioned by a hash of the id; only the
partitions that a batch touches are read and rewritten.  Folding is a
``max_by`` on ``seq``, which is order-independent and idempotent, so the final
tags equal the batch result however the files are split into micro-batches and
however often one is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.incremental import dense_ids, file_key
from docsift.operators.tags import apply_tag_edits
from docsift.session import ensure_checkpoint_dir

DOC_COLS = ["id", "path", "name", "mtime", "size"]


KEY_PARTITIONS = 256


def _part(col: str):
    return F.pmod(F.xxhash64(col), F.lit(KEY_PARTITIONS)).cast("int").alias("part")


def _touched(df: DataFrame) -> list[int]:
    """Partitions that a batch touches: at most ``KEY_PARTITIONS`` numbers."""
    return [r[0] for r in df.select("part").distinct().collect()]


LOG_SCHEMA = "id long, path string, name string, mtime long, size long, key string, batch long"


def current_documents(spark: SparkSession, base: DataFrame, log_dir: str, before: int | None = None) -> DataFrame:
    """The table as of now (a read-time view): base plus the newest logged
    row per file key (only batches before ``before``, if given)."""
    b = file_key(base.select(*DOC_COLS)).withColumn("batch", F.lit(-1).cast("long"))
    log = spark.read.schema(LOG_SCHEMA).parquet(log_dir)
    if before is not None:
        log = log.where(F.col("batch") < before)
    allrows = b.unionByName(log.select(*b.columns))
    latest = allrows.groupBy("key").agg(F.max_by(F.struct(*DOC_COLS, "batch"), "batch").alias("r"))
    return latest.select("key", *[F.col(f"r.{c}").alias(c) for c in DOC_COLS])


KEY_SCHEMA = "key string, id long, batch long, part int"


def write_key_table(base: DataFrame, keys_dir: str) -> None:
    """The key table of the base, as batch -1."""
    keys = file_key(base.select("id", "path", "name")).select("key", "id", F.lit(-1).cast("long").alias("batch"), _part("key"))
    keys.repartition("part").write.mode("overwrite").partitionBy("batch", "part").parquet(keys_dir)


def upsert_documents_batch(spark: SparkSession, batch: DataFrame, batch_id: int, keys_dir: str,
                           log_dir: str, base_max: int) -> None:
    """One micro-batch of ST1: resolve ids against the key table and append
    the rows under ``batch=<id>``.

    Only the key partitions of the batch's own keys are read; the next free id
    follows the base maximum - computed once when the stream starts - or the
    largest id that an earlier batch logged."""
    rows = file_key(batch.select("path", "name", "mtime", "size"))
    rows = rows.groupBy("key").agg(F.max_by(F.struct("path", "name", "mtime", "size"), "mtime").alias("r")) \
        .select("key", "r.*").withColumn("part", _part("key")).checkpoint(eager=True)
    parts = _touched(rows)
    keys = spark.read.schema(KEY_SCHEMA).parquet(keys_dir).where((F.col("batch") < batch_id) & F.col("part").isin(parts))
    found = rows.join(keys.select("key", "id"), "key", "left")
    log = spark.read.schema(LOG_SCHEMA).parquet(log_dir).where(F.col("batch") < batch_id)
    top = F.greatest(F.lit(base_max).cast("long"),
                     log.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar())
    fresh = dense_ids(found.where(F.col("id").isNull()).drop("id"), "key", top).withColumnRenamed("new_id", "id")
    added = fresh.select("key", "id", F.lit(batch_id).cast("long").alias("batch"), "part")
    # a file for each key partition, however many tasks the new rows come from
    (added.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "part").parquet(keys_dir))
    out = found.where(F.col("id").isNotNull()).select(*LOG_SCHEMA_COLS).unionByName(fresh.select(*LOG_SCHEMA_COLS))
    out.write.mode("overwrite").parquet(f"{log_dir}/batch={batch_id}")


LOG_SCHEMA_COLS = ["id", "path", "name", "mtime", "size", "key"]


def start_documents(spark: SparkSession, base: DataFrame, work_dir: str) -> None:
    """ST1: lay down the log and the key table before the first run."""
    ensure_checkpoint_dir(spark)
    # an empty partition makes the log exist before the first batch reads it
    spark.createDataFrame([], "id long, path string, name string, mtime long, size long, key string") \
        .write.mode("overwrite").parquet(f"{work_dir}/log/batch=-1")
    write_key_table(base, f"{work_dir}/keys")


def stream_documents(spark: SparkSession, source_dir: str, schema, base: DataFrame, work_dir: str,
                     files_per_trigger: int | None = 1) -> DataFrame:
    """ST1: run the stream to completion (availableNow) and return the table."""
    start_documents(spark, base, work_dir)
    return continue_documents(spark, source_dir, schema, base, work_dir, files_per_trigger)


def continue_documents(spark: SparkSession, source_dir: str, schema, base: DataFrame, work_dir: str,
                       files_per_trigger: int | None = None) -> DataFrame:
    """ST1: take up what has arrived since the last run (from the stream's own
    checkpoint), ``files_per_trigger`` files a batch or all at once."""
    log_dir, keys_dir = f"{work_dir}/log", f"{work_dir}/keys"
    base_max = base.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one scalar, once
    reader = spark.readStream.schema(schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: upsert_documents_batch(spark, df, bid, keys_dir, log_dir, base_max))
         .option("checkpointLocation", f"{work_dir}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return current_documents(spark, base, log_dir)


EDIT_STATE_SCHEMA = "id long, tag string, op string, seq long, part int"


def fold_tag_edits_batch(spark: SparkSession, batch: DataFrame, state_dir: str) -> None:
    """One micro-batch of ST2: latest edit per (id, tag) over state and batch;
    the partitions that the batch touches are replaced, the others stay.  The
    merged rows are checkpointed first, because a job may not overwrite what it
    reads."""
    edits = batch.select("id", "tag", "op", "seq").withColumn("part", _part("id"))
    parts = _touched(edits)
    state = spark.read.schema(EDIT_STATE_SCHEMA).parquet(state_dir).where(F.col("part").isin(parts))
    both = state.unionByName(edits)
    latest = both.groupBy("part", "id", "tag").agg(F.max_by(F.struct("op", "seq"), "seq").alias("r")) \
        .select("id", "tag", "r.op", "r.seq", "part").checkpoint(eager=True)
    (latest.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("part").parquet(state_dir))


def stream_tag_edits(spark: SparkSession, source_dir: str, schema, tags: DataFrame, work_dir: str,
                     files_per_trigger: int = 1) -> DataFrame:
    """ST2: run the edit stream to completion and return the resulting tags."""
    ensure_checkpoint_dir(spark)
    state_dir = f"{work_dir}/state"
    # an empty partition makes the state exist before the first batch reads it
    spark.createDataFrame([], "id long, tag string, op string, seq long").write.mode("overwrite").parquet(f"{state_dir}/part=-1")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream
         .foreachBatch(lambda df, _: fold_tag_edits_batch(spark, df, state_dir))
         .option("checkpointLocation", f"{work_dir}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return apply_tag_edits(tags, spark.read.schema(EDIT_STATE_SCHEMA).parquet(state_dir).drop("part"))
