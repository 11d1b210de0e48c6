"""A directory walk on the executors.

Level by level, the directories of a level are dealt to tasks, which list them
through a file system that the workers reach by URI (pyarrow's: local, HDFS, S3,
GCS); what they find is written to the shared folder, and the directories among
it are the next level.  Nothing is listed on the driver, and the depth bound and
the exclusion rule prune a directory before it is listed.  Entries arrive in
batches, so the length of a directory is no bound.  The contents of what was
found are read in tasks too, from a shuffle of the paths.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import ensure_checkpoint_dir
from docsift.sources.files import exclude_paths, scan_list

ENTRY = "rel_path string, is_dir boolean, size long, mtime long"
BATCH = 10_000  # entries a task hands on at a time
CONTENT = 8 << 20  # bytes of files a task hands on at a time, but for the last of them


def _opened(root: str):
    """File system and base path of a root, a URI or a plain local path."""
    from pyarrow import fs

    if root.startswith("file:") and not root.startswith("file://"):
        root = "file://" + root[5:]
    system, base = fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)
    return system, base.rstrip("/")


def walkable(spark: SparkSession, root: str) -> bool:
    """Whether ``root`` is a directory of a store that the workers reach."""
    try:
        _opened(root)
    except (pa.ArrowException, OSError, ImportError):
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.exists(path) and system.getFileStatus(path).isDirectory()


def file_name(rel: Column) -> Column:
    return F.substring_index(rel, "/", -1)


def list_directories(dirs: DataFrame, root: str) -> DataFrame:
    """Entries (``ENTRY``) of the directories ``rel_path`` below ``root``; a
    directory that has gone meanwhile has none."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _opened(root)
        for batch in batches:
            for rel in batch["rel_path"]:
                here = f"{base}/{rel}" if rel else base
                found = system.get_file_info(fs.FileSelector(here, allow_not_found=True))
                for s in range(0, len(found), BATCH):
                    rows = [(f"{rel}/{e.base_name}" if rel else e.base_name, e.type == fs.FileType.Directory,
                             e.size if e.type == fs.FileType.File else None, None if e.mtime_ns is None else e.mtime_ns // 1_000_000_000)
                            for e in found[s:s + BATCH] if e.type in (fs.FileType.File, fs.FileType.Directory)]
                    yield pd.DataFrame(rows, columns=["rel_path", "is_dir", "size", "mtime"]).astype({"size": "Int64", "mtime": "Int64"})

    return dirs.select("rel_path").mapInPandas(run, ENTRY)


def walk_files(spark: SparkSession, root: str, depth: int | None = None, exclude: str | None = None, start: DataFrame | None = None) -> DataFrame:
    """(``rel_path``, ``size``, ``mtime``) of the regular files below ``root``,
    at most ``depth`` directories down (None: any, 0: only the root's own) and
    outside of excluded directories.  ``start``: directories (``rel_path``, at
    most so deep as files may be) to begin with instead of the root."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/walk-{uuid.uuid4().hex[:12]}"
    dirs = spark.createDataFrame([("",)], "rel_path string") if start is None else exclude_paths(start.select("rel_path").distinct(), exclude)
    level, levels = 0, []
    while True:
        entries = exclude_paths(list_directories(dirs, root), exclude)
        path = f"{out}/level={level}"
        entries.write.parquet(path)
        stored = spark.read.schema(ENTRY).parquet(path)
        levels.append(stored)
        below = stored.where("is_dir").select("rel_path")
        if depth is not None:
            below = below.where(F.length("rel_path") - F.length(F.replace("rel_path", F.lit("/"), F.lit(""))) < depth)
        if below.isEmpty():
            break
        # a level's directories in other tasks than those that found them
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dirs, level = below.repartition(n, "rel_path"), level + 1
    found = functools.reduce(lambda a, b: a.unionByName(b), levels)
    return found.where(~F.col("is_dir")).select("rel_path", "size", "mtime")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """The files ``rel_path`` below ``root`` with their ``content``, read where
    their rows are; a file that has gone meanwhile is an error."""
    spark = files.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at, schema = files.columns.index("rel_path"), ", ".join([f"`{c}` {kind}" for c, kind in files.dtypes] + ["content binary"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)

        def cut(batch: pa.RecordBatch, start: int, found: list[bytes]) -> pa.RecordBatch:
            part = batch.slice(start, len(found))
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "content"])

        for batch in batches:
            start, found, n_bytes = 0, [], 0
            for rel in batch.column(at).to_pylist():
                with system.open_input_file(f"{base}/{rel}") as f:
                    found.append(f.read())
                n_bytes += len(found[-1])
                if n_bytes >= CONTENT:
                    yield cut(batch, start, found)
                    start, found, n_bytes = start + len(found), [], 0
            if found:
                yield cut(batch, start, found)

    return files.repartition(n, "rel_path").mapInArrow(read, schema)


def walk_list(spark: SparkSession, listing: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """S4 without a walk of everything: only the directories that the listing
    (``value``: paths, absolute or relative to ``root``) names are listed."""
    plain = _opened(root)[1]
    v = F.trim(F.col("value"))
    rel = F.when(v.startswith(plain + "/"), F.substring(v, len(plain) + 2, 1 << 30)).when(~v.startswith("/"), v)
    wanted = listing.select(rel.alias("file")).where(F.col("file").isNotNull())
    above = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    dirs = exclude_paths(wanted.select(above.alias("rel_path")).distinct(), exclude)
    files = list_directories(dirs, root).where(~F.col("is_dir")).select("rel_path", "size", "mtime")
    return scan_list(listing, files, plain, exclude)
