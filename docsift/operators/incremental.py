"""Incremental snapshots, index upserts and document links (I1-I6, I10-I13,
J7-J11).

A snapshot diff is one full outer join on the file key; everything after it
is unions and anti joins on keys, so each step shuffles only on the key.
Fresh ids for new files are a distributed dense numbering: the new rows are
range-partitioned on the key and written once, numbered inside each partition;
the per-partition counts of those same rows (one row per partition) give the
offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.ids import pack_sid
from docsift.functions.paths import path_ancestors, path_depth
from docsift.session import ensure_checkpoint_dir, scratch_dir

UNCHANGED, MODIFIED, NEW, DELETED = "unchanged", "modified", "new", "deleted"


def file_key(df: DataFrame) -> DataFrame:
    """Relative file path (directory/name) as the snapshot key."""
    key = F.when(F.length("path") == 0, F.col("name")).otherwise(F.concat(F.col("path"), F.lit("/"), F.col("name")))
    return df.withColumn("key", key)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every key of either snapshot with its class (unchanged / modified /
    new / deleted), the old id and both modification times."""
    o = file_key(old).select("key", F.col("id").alias("old_id"), F.col("mtime").alias("old_mtime"))
    n = file_key(new).select("key", F.col("mtime").alias("new_mtime"))
    j = o.join(n, "key", "full_outer")
    status = (F.when(F.col("old_id").isNull(), F.lit(NEW))
              .when(F.col("new_mtime").isNull(), F.lit(DELETED))
              .when(F.col("old_mtime") == F.col("new_mtime"), F.lit(UNCHANGED))
              .otherwise(F.lit(MODIFIED)))
    return j.select("key", "old_id", "old_mtime", "new_mtime", status.alias("status"))


def dense_ids(df: DataFrame, key: str, base, partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``key`` order without a single-partition window:
    range-partition on the key, number rows inside each partition, and add
    the running count of the earlier partitions (a table of one row per
    partition).  ``base`` (a column, e.g. a scalar subquery) is added.

    The partitioned rows are checkpointed with their partition and place: range
    bounds come from a sample, and a second evaluation of the same plan (with
    other columns, say) would draw other bounds, so counts and rows must come
    from one and the same evaluation."""
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn("new_id", (base + F.col("_off") + local + 1).cast("long"))
            .drop("_pid", "_mid", "_off"))


def apply_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Next document table: unchanged rows kept with all their columns,
    modified rows replaced by the new listing with their id kept (Q1), new rows
    get ids after the old maximum in key order, deleted rows dropped.  Columns
    that only the old table has (parsed data, version) are NULL on replaced and
    new rows until they are parsed again.  Adds ``status``.

    One full outer join on the key carries both sides' columns, so the
    classification and the new rows come out of a single shuffle."""
    old_cols = [c for c in old.columns if c != "id"]
    new_cols = [c for c in new.columns if c != "id"]
    types = {f.name: f.dataType for f in [*new.schema.fields, *old.schema.fields]}
    cols = new_cols + [c for c in old_cols if c not in new_cols]
    o = file_key(old).select("key", F.col("id").alias("_old_id"), *[F.col(c).alias(f"_o_{c}") for c in old_cols])
    n = file_key(new).select("key", *[F.col(c).alias(f"_n_{c}") for c in new_cols], F.lit(True).alias("_in_new"))
    j = o.join(n, "key", "full_outer").where(F.col("_in_new").isNotNull())
    status = (F.when(F.col("_old_id").isNull(), F.lit(NEW))
              .when(F.col("_o_mtime") == F.col("_n_mtime"), F.lit(UNCHANGED))
              .otherwise(F.lit(MODIFIED)))
    j = j.withColumn("status", status)

    def value(c: str):
        fresh = F.col(f"_n_{c}") if c in new_cols else F.lit(None).cast(types[c])
        return F.when(F.col("status") == UNCHANGED, F.col(f"_o_{c}") if c in old_cols else fresh).otherwise(fresh).alias(c)

    j = j.select("key", "_old_id", *[value(c) for c in cols], "status")
    kept = j.where(F.col("status") != NEW).select(F.col("_old_id").alias("id"), *cols, "status")
    base = old.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    numbered = dense_ids(j.where(F.col("status") == NEW), "key", base).select(
        F.col("new_id").alias("id"), *cols, "status")
    return kept.unionByName(numbered)


def delete_list(old: DataFrame, applied: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Ids to remove from the search index: documents of the old table
    that the applied one (I2, which gives the ids) no longer has, plus the
    earlier list, minus ids that are present again."""
    lst = old.select("id") if previous is None else old.select("id").unionByName(previous.select("id"))
    return lst.distinct().join(applied.select("id"), "id", "left_anti")


def index_upsert(index: DataFrame, incoming: DataFrame, index_id: int) -> DataFrame:
    """I4: packed-id upsert of one scan index: incoming rows replace whole
    rows (Q3) and add new ones; other rows stay."""
    inc = incoming.withColumn("index_id", F.lit(index_id).cast("int")).withColumn("sid", pack_sid(F.lit(index_id), "id"))
    keep = index.join(inc.select("sid"), "sid", "left_anti")
    return keep.unionByName(inc.select(*index.columns))


def write_index(index: DataFrame, path: str) -> None:
    """The search index stored as parquet partitioned by ``index_id``."""
    index.write.mode("overwrite").partitionBy("index_id").parquet(path)


def upsert_stored_index(spark, path: str, incoming: DataFrame, index_id: int) -> None:
    """I4 on a stored index: only the ``index_id`` partition is read (partition
    pruning) and rewritten (dynamic partition overwrite); other indices'
    files are untouched.  The merged partition is checkpointed to the shared
    folder before the overwrite, because a job may not overwrite what it reads."""
    ensure_checkpoint_dir(spark)
    part = spark.read.parquet(path).where(F.col("index_id") == index_id)
    merged = index_upsert(part, incoming, index_id).checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("index_id").parquet(path))


def index_delete(index: DataFrame, deletes: DataFrame, index_id: int) -> DataFrame:
    """Drop the delete-list documents of one index (packed ids, Q2)."""
    gone = deletes.select(pack_sid(F.lit(index_id), "id").alias("sid"))
    return index.join(gone, "sid", "left_anti")


def copy_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add vectors whose (sid, model_id, start) is not present; keep the
    existing ones."""
    key = ["sid", "model_id", "start"]
    add = incoming.join(existing.select(*key), key, "left_anti")
    return existing.unionByName(add.select(*existing.columns))


def record_version(applied: DataFrame, version: int, status_col: str = "status") -> DataFrame:
    """Rows written by this run carry its ``version``; unchanged rows keep
    the version of the run that wrote them, which ``apply_snapshot`` carries
    along (``version - 1`` if the table had none yet)."""
    earlier = F.col("version") if "version" in applied.columns else F.lit(None).cast("long")
    v = F.when(F.col(status_col) == UNCHANGED, F.coalesce(earlier, F.lit(version - 1))).otherwise(F.lit(version))
    return applied.withColumn("version", v.cast("long"))


def run_entry(applied: DataFrame, deleted: DataFrame, version: int, timestamp: int) -> DataFrame:
    """The run's line of the run log: version, time and how many
    documents it found new, modified, unchanged and deleted."""
    of = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    n = applied.agg(*[F.coalesce(of(s), F.lit(0)).cast("long").alias(s) for s in (NEW, MODIFIED, UNCHANGED)])
    gone = deleted.agg(F.count(F.lit(1)).cast("long").alias(DELETED))
    return n.withColumn(DELETED, gone.select(DELETED).scalar()).select(
        F.lit(version).cast("long").alias("version"), F.lit(timestamp).cast("long").alias("timestamp"), NEW, MODIFIED, UNCHANGED, DELETED)


def append_run(entry: DataFrame, path: str) -> None:
    """Add a run's line to the stored run log; a repeated write of one version
    replaces its own line only."""
    (entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path))


def ingest_fields(docs: DataFrame) -> DataFrame:
    """``_tie`` (id as text) and ``_depth`` (directory depth)."""
    return docs.withColumn("_tie", F.col("id").cast("string")).withColumn("_depth", path_depth(F.col("path")))


def check_constraints(models: DataFrame, records: DataFrame, json_col: str = "json_data") -> DataFrame:
    """Constraint violations as (what, key) rows: model id outside
    1..999, name of 16 characters or more, unknown type, duplicate path, and
    records whose JSON does not parse."""
    m = models
    bad_id = m.where(~F.col("id").between(1, 999)).select(F.lit("model_id").alias("what"),
                                                          F.col("id").cast("string").alias("key"))
    bad_name = m.where(F.length("name") >= 16).select(F.lit("model_name").alias("what"), F.col("name").alias("key"))
    bad_type = m.where(~F.col("type").isin("flat", "nested")).select(F.lit("model_type").alias("what"),
                                                                    F.col("type").alias("key"))
    dup = (m.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
           .select(F.lit("model_path").alias("what"), F.col("path").alias("key")))
    bad_json = records.where(F.try_parse_json(F.col(json_col)).isNull()).select(
        F.lit("json").alias("what"), F.col("id").cast("string").alias("key"))
    return bad_id.unionByName(bad_name).unionByName(bad_type).unionByName(dup).unionByName(bad_json)


def pending_deletes(deletes: DataFrame, docs: DataFrame) -> DataFrame:
    """Delete-list rows whose document is still present."""
    return deletes.join(docs.select("id"), "id", "left_semi")


def missing_pairs(a: DataFrame, b: DataFrame, cols=("id", "tag")) -> DataFrame:
    """Tuples of each side absent on the other (anti joins, NULL-safe
    unlike NOT IN)."""
    cols = list(cols)
    only_a = a.select(*cols).join(b.select(*cols), cols, "left_anti").withColumn("side", F.lit("left"))
    only_b = b.select(*cols).join(a.select(*cols), cols, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def resolve_parent_id(links: DataFrame, docs: DataFrame, parent_key_col: str = "parent_key") -> DataFrame:
    """Parent file key -> parent id, an equi join on the file key of the
    document table."""
    keys = file_key(docs.select("id", "path", "name")).select(F.col("key").alias(parent_key_col),
                                                              F.col("id").alias("parent_id"))
    return links.join(keys, parent_key_col, "left")


def root_document(docs: DataFrame, max_rounds: int = 32) -> DataFrame:
    """Climb ``parent`` links to the top document by pointer jumping:
    each round replaces a row's ancestor by that ancestor's ancestor, so a
    chain of length L needs log2(L) rounds.  The loop stops when no row moved
    (one count per round reaches the driver).

    Only the distinct ancestors climb: the members of one archive share one
    parent, so a round joins one row per ancestor, and the members are mapped
    once at the end.  Every round is written as a table and read again, so
    that the next one plans with true sizes.  Links that run in a circle never
    settle; they raise ``ValueError`` (``max_rounds`` rounds settle any chain of
    2**32 links)."""
    spark = docs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "climb")
        df.write.parquet(path)
        return spark.read.parquet(path)

    start = written(docs.select("id", F.coalesce("parent", "id").alias("anc")))
    heads = start.select(F.col("anc").alias("id")).distinct()
    cur = heads.join(start, "id", "left").select("id", F.coalesce("anc", "id").alias("anc"))
    cur = written(cur)
    for _ in range(max_rounds):
        step = cur.alias("c").join(cur.alias("p"), F.col("c.anc") == F.col("p.id"), "left").select(
            F.col("c.id").alias("id"), F.coalesce(F.col("p.anc"), F.col("c.anc")).alias("anc"),
            (F.col("p.anc").isNotNull() & (F.col("p.anc") != F.col("c.anc"))).alias("moved"))
        step = written(step)
        moved = step.where("moved").limit(1).count()
        cur = step.select("id", "anc")
        if moved == 0:
            break
    else:
        raise ValueError("parent links run in a circle")
    # a link that runs in a circle of a power of two may come to rest on itself
    circle = cur.join(start.withColumnRenamed("anc", "_up"), cur["anc"] == start["id"], "inner").where(F.col("_up") != start["id"])
    if circle.limit(1).count():
        raise ValueError("parent links run in a circle")
    tops = cur.select(F.col("id").alias("anc"), F.col("anc").alias("root"))
    return start.join(tops, "anc").select("id", "root")


def descendants(docs: DataFrame, dirs: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Documents whose directory is ``dir`` or below it: each document's
    ancestor directories (bounded by depth) are equi-joined with the listed
    directories - no range or prefix join."""
    anc = docs.select("id", F.explode(path_ancestors("path")).alias(dir_col))
    return anc.join(dirs.select(dir_col).distinct(), dir_col).select(dir_col, "id")
