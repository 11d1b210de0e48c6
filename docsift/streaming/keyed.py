"""ST2 with keyed state: tag edits folded by a stateful stream.

A streaming aggregate keeps, per (id, tag), the newest edit that has been seen,
in a state store that is checkpointed with the stream; a batch costs what its
edits cost, whatever has been folded before, and no key is handed to Python.
Edits that win are handed to a change log.  The log is a ``TieredLog``: every
batch adds one folder, folders of like size are merged by eights (newest edit
per key), so the number of folders grows with the logarithm of the batches and
old rows are rewritten seldom.  A batch that is retried after a failure writes
its own folder again; a restarted stream goes on from its checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.tags import apply_tag_edits
from docsift.session import ensure_checkpoint_dir

FAN = 8  # folders of like size that are merged into one
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EDITS = "id long, tag string, op string, seq long"


class TieredLog:
    """Folders of rows under ``path`` and manifests that say which are live.
    ``newest``: columns of a row's key, and the one whose largest value counts."""

    MANIFEST = "folder string, n_rows long, batch long"

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: str, fan: int = FAN):
        self.spark, self.path, self.schema, self.key, self.order, self.fan = spark, path, schema, key, order, fan

    def create(self) -> None:
        """An empty log."""
        self._write(0, [])

    def _write(self, version: int, folders: list[tuple]) -> None:
        (self.spark.createDataFrame(folders, self.MANIFEST).coalesce(1).write.mode("overwrite")
         .parquet(f"{self.path}/manifest/version={version}"))

    def _last(self) -> tuple[int, list[tuple]]:
        """Last version and its folders."""
        lines = self.spark.read.schema(f"{self.MANIFEST}, version int").parquet(f"{self.path}/manifest")
        # an empty manifest has no line, so the folders' names tell the last version
        names = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/manifest")
        version = names.select(F.max(F.regexp_extract("path", r"version=(\d+)", 1).cast("int"))).first()[0]
        return version, [(r.folder, r.n_rows, r.batch) for r in lines.where(F.col("version") == version).collect()]

    def rows(self) -> DataFrame:
        """All live rows; several of a key may be among them."""
        folders = [f for f, _, _ in self._last()[1]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def latest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key."""
        columns = [c for c in rows.columns if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns), self.order).alias("r"))
        return newest.select(*self.key, *[F.col(f"r.{c}").alias(c) for c in columns]).select(*rows.columns)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of a batch; a batch that is there already is replaced,
        one that a merge has taken in stays."""
        version, folders = self._last()
        if any(b >= batch and f.startswith("m") for f, _, b in folders):
            return
        name = f"b{batch}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()
        folders = [f for f in folders if f[0] != name] + ([(name, n, batch)] if n else [])
        version += 1
        self._write(version, folders)
        while due := self._due(folders):
            version += 1
            merged, newest = f"m{version}", max(b for _, _, b in due)
            held = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f, _, _ in due])
            self.latest(held).write.mode("overwrite").parquet(f"{self.path}/{merged}")
            n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{merged}").count()
            folders = [f for f in folders if f not in due] + [(merged, n, newest)]
            self._write(version, folders)

    def _due(self, folders: list[tuple]) -> list[tuple]:
        tiers: dict[int, list[tuple]] = {}
        for f in folders:
            tiers.setdefault(int(math.log(max(f[1], 1), self.fan)), []).append(f)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def folders(self) -> int:
        return len(self._last()[1])


def newest_edits(edits: DataFrame) -> DataFrame:
    """Per (id, tag) of a stream: hands on an edit that is newer than all before
    it (of the same number, the one of the earlier batch stays).

    The state holds the newest edit and, as ``age``, the negated time of the
    batch that brought it; a batch that is retried has the same time again."""
    age = -F.unix_micros(F.current_timestamp())
    newest = edits.withColumn("age", age).groupBy("id", "tag").agg(F.max(F.struct("seq", "age", "op")).alias("r"))
    return newest.where(F.col("r.age") == age).select("id", "tag", "r.op", "r.seq")


def edit_log(spark: SparkSession, work_dir: str) -> TieredLog:
    return TieredLog(spark, f"{work_dir}/log", EDITS, ["id", "tag"], "seq")


def start_tag_edits(spark: SparkSession, work_dir: str) -> None:
    """Lay down an empty change log before the first run."""
    ensure_checkpoint_dir(spark)
    edit_log(spark, work_dir).create()


def continue_tag_edits(spark: SparkSession, source_dir: str, work_dir: str, files_per_trigger: int | None = None) -> None:
    """Fold what has arrived since the last run.  Edits without an id, a tag or
    a number say nothing."""
    log = edit_log(spark, work_dir)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        reader = spark.readStream.schema(EDITS)
        reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
        edits = reader.parquet(source_dir).where(F.col("id").isNotNull() & F.col("tag").isNotNull() & F.col("seq").isNotNull())
        query = (newest_edits(edits).writeStream.outputMode("update").foreachBatch(lambda df, batch: log.append(df, batch))
                 .option("checkpointLocation", f"{work_dir}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current_tags(spark: SparkSession, tags: DataFrame, work_dir: str) -> DataFrame:
    """The tags as of now: those of before with the newest edit of each key."""
    log = edit_log(spark, work_dir)
    return apply_tag_edits(tags, log.latest(log.rows()))
