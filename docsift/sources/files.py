"""File-system sources (S1-S7, S10): listing, depth limit, exclusion, explicit
file lists, path splitting, checksums, content bounds and archive members.

Directories are listed and files read inside tasks (``walk``), so the driver
never holds a list of the files.  Two more functions here run Python inside
tasks, both through ``mapInPandas``: archive expansion (``zipfile``/``tarfile``,
per archive, members streamed out in bounded batches) and ``write_tree``, which materialises documents as files
for the listing queries.
"""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.paths import split_file_path, strict_ancestors

DEFAULT_CONTENT_SIZE = 32768  # fixed value: characters of extracted text kept


def _root_uri(root: str) -> str:
    r = root.rstrip("/")
    return r if ":" in r.split("/")[0] else "file:" + r


def _files(spark: SparkSession, root: str, depth: int | None = None, exclude: str | None = None, glob: str | None = None,
           content: bool = False) -> DataFrame:
    """``rel_path``, ``size``, ``mtime`` and, if wanted, ``content`` of the files
    that S1 to S3 leave.  Directories are listed and files read in tasks; only
    stores that the workers don't reach, and a root that is no directory, are
    listed on the driver by Spark's ``binaryFile`` source (which passes over
    empty files and names that begin with a dot or an underscore)."""
    from docsift.sources import walk as W

    if W.walkable(spark, root):
        files = W.walk_files(spark, root, depth, exclude)
        if glob:
            name = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
            files = files.where(W.file_name(F.col("rel_path")).rlike(f"^(?s:{name})$"))
        return W.with_content(files, root) if content else files
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    prefix = _root_uri(root) + "/"
    rel = F.when(F.col("path").startswith(prefix), F.substring(F.col("path"), len(prefix) + 1, 1 << 30)) \
        .otherwise(F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/") + "/", ""))
    files = df.select(rel.alias("rel_path"), F.col("length").alias("size"),
                      F.unix_timestamp(F.col("modificationTime")).alias("mtime"), *(["content"] if content else []))
    return exclude_paths(limit_depth(files, depth), exclude)


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Regular files below ``root``: relative path, size, mtime (epoch s)."""
    return _files(spark, root, glob=glob)


def dir_depth(rel: Column) -> Column:
    """Number of directories above a file in its relative path."""
    return F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit("")))


def limit_depth(files: DataFrame, depth: int | None, col: str = "rel_path") -> DataFrame:
    """Keep files at most ``depth`` directories below the root
    (None = unlimited, 0 = only the root's own files; Q11)."""
    if depth is None:
        return files
    return files.where(dir_depth(F.col(col)) <= depth)


def exclude_paths(files: DataFrame, pattern: str | None, col: str = "rel_path") -> DataFrame:
    """S3: drop files whose relative path, or any ancestor directory, matches
    the unanchored regex (a matching directory prunes its subtree)."""
    if not pattern:
        return files
    rel = F.col(col)
    dirs = strict_ancestors(rel, "/")
    hit = rel.rlike(pattern) | F.exists(dirs, lambda a: a.rlike(pattern))
    return files.where(~hit)


def scan_list(listing: DataFrame, files: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """An explicit list of paths (one per line, absolute or relative to
    ``root``): keep those that are existing regular files under the root,
    then apply the exclusion rule.  A semi join against the real listing."""
    r = root.rstrip("/") + "/"
    v = F.trim(F.col("value"))
    rel = F.when(v.startswith(r), F.substring(v, len(r) + 1, 1 << 30)).when(~v.startswith("/"), v)
    wanted = listing.select(rel.alias("rel_path")).where(F.col("rel_path").isNotNull()).distinct()
    kept = files.join(wanted, "rel_path", "left_semi")
    return exclude_paths(kept, exclude)


def split_paths(files: DataFrame, col: str = "rel_path") -> DataFrame:
    """Relative path -> directory, name, extension columns."""
    parts = split_file_path(F.col(col))
    return files.select("*", parts["path"].alias("path"), parts["name"].alias("name"),
                        parts["extension"].alias("extension"))


def content_checksum(df: DataFrame, col: str = "content") -> DataFrame:
    """SHA-1 hex of the content."""
    return df.withColumn("checksum", F.sha1(F.col(col)))


def truncate_content(df: DataFrame, n: int = DEFAULT_CONTENT_SIZE, col: str = "content") -> DataFrame:
    """Keep the first ``n`` characters; ``n = 0`` disables extraction."""
    if n == 0:
        return df.withColumn(col, F.lit(None).cast("string"))
    return df.withColumn(col, F.substring(F.col(col), 1, n))


# ------------------------------------------------------------------ archives

ARCHIVE_MODES = ("skip", "list", "shallow", "recurse")
MEMBERS_PER_BATCH = 256
MEMBER_SCHEMA = "archive string, member string, size long, depth int, content binary, status string"


def _members(data: bytes, prefix: str, depth: int, mode: str):
    import tarfile
    import zipfile

    buf = io.BytesIO(data)
    entries = []
    if zipfile.is_zipfile(buf):
        with zipfile.ZipFile(buf) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                entries.append((info.filename, info.file_size, lambda i=info, zz=z: zz.read(i)))
            for name, size, read in entries:
                body = read() if mode != "list" else None
                yield prefix + name, size, depth, body
                if mode == "recurse" and body is not None and name.lower().endswith((".zip", ".tar", ".tgz")):
                    yield from _members(body, prefix + name + "/", depth + 1, mode)
        return
    buf.seek(0)
    with tarfile.open(fileobj=buf) as t:
        for m in t.getmembers():
            if not m.isfile():
                continue
            body = t.extractfile(m).read() if mode != "list" else None
            yield prefix + m.name, m.size, depth, body
            if mode == "recurse" and body is not None and m.name.lower().endswith((".zip", ".tar", ".tgz")):
                yield from _members(body, prefix + m.name + "/", depth + 1, mode)


def expand_archives(archives: DataFrame, mode: str = "shallow") -> DataFrame:
    """One row per archive member (``archive``, ``member`` path inside
    it, ``size``, nesting ``depth``, ``content`` unless mode is 'list').
    Modes: skip (no rows), list, shallow (members of the archive itself),
    recurse (members of nested archives too).  Input: (rel_path, content).

    ``status`` is 'ok' for a member.  An archive that cannot be read to its end
    (damaged, or no archive at all) adds one row without a member whose status
    says why; the members before the damage are listed."""
    if mode not in ARCHIVE_MODES:
        raise ValueError(mode)
    if mode == "skip":
        return archives.sparkSession.createDataFrame([], MEMBER_SCHEMA)

    cols = ["archive", "member", "size", "depth", "content", "status"]

    def run(batches):
        import tarfile
        import zipfile
        import zlib

        import pandas as pd

        damaged = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError)
        for pdf in batches:
            rows = []
            for rel, data in zip(pdf["rel_path"], pdf["content"]):
                try:
                    for member, size, depth, body in _members(bytes(data), "", 1, mode):
                        rows.append((rel, member, int(size), depth, body, "ok"))
                        if len(rows) >= MEMBERS_PER_BATCH:  # stream members out, never a whole archive set
                            yield pd.DataFrame(rows, columns=cols)
                            rows = []
                except damaged as e:
                    rows.append((rel, None, None, 1, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=cols).astype({"size": "Int64"})

    return archives.select("rel_path", "content").mapInPandas(run, MEMBER_SCHEMA)


def read_archives(spark: SparkSession, root: str, mode: str = "shallow") -> DataFrame:
    return expand_archives(_files(spark, root, glob="*.{zip,tar,tgz}", content=True).select("rel_path", "content"), mode)


# ----------------------------------------------------- materialising a tree

def write_tree(docs: DataFrame, root: str, archive: bool = False) -> None:
    """Write each document's content as a file ``root/<path>/<name>.<ext>``
    (or as a one-member zip ``root/<path>/<name>.zip``), with the document's
    mtime.  Runs inside the tasks, one file per row; ``root`` must be a
    POSIX path every executor mounts (the listing sources then read it like
    any file tree).  A retried task rewrites the same files."""
    base = root.rstrip("/")
    if base.startswith("file:"):
        base = base[5:]
    if "://" in base or base.split("/")[0].endswith(":"):
        raise ValueError(f"write_tree needs a mounted POSIX folder, not {root!r}")

    def run(batches):
        import os
        import zipfile

        import pandas as pd

        for pdf in batches:
            for path, name, ext, content, mtime in zip(pdf["path"], pdf["name"], pdf["extension"],
                                                       pdf["content"], pdf["mtime"]):
                d = os.path.join(base, path) if path else base
                os.makedirs(d, exist_ok=True)
                fname = name + ("." + ext if ext else "")
                data = (content or "").encode("utf-8")
                if archive:
                    target = os.path.join(d, name + ".zip")
                    with zipfile.ZipFile(target, "w", compression=zipfile.ZIP_DEFLATED) as z:
                        z.writestr(fname, data)
                else:
                    target = os.path.join(d, fname)
                    with open(target, "wb") as f:
                        f.write(data)
                os.utime(target, (int(mtime), int(mtime)))
            yield pd.DataFrame({"n": [len(pdf)]})

    docs.select("path", "name", "extension", "content", "mtime").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def scan_documents(spark: SparkSession, root: str, mime_dim: DataFrame, depth: int | None = None,
                   exclude: str | None = None, content_size: int = DEFAULT_CONTENT_SIZE,
                   checksums: bool = True) -> DataFrame:
    """The scan step: list the regular files below ``root`` (S1), those within
    ``depth`` (S2) and not excluded (S3), split each path (S5), look up the
    media type (P5), read the text content bounded to ``content_size``
    characters (S7) and hash the bytes (S6).  Only the files that the path
    predicates leave are read, once each."""
    from docsift.operators.documents import mime_by_extension

    kept = _files(spark, root, depth, exclude, content=True)
    docs = mime_by_extension(split_paths(kept), mime_dim)
    text = F.col("content").cast("string")
    return docs.select("rel_path", "path", "name", "extension", "size", "mtime", "mime",
                       (F.sha1(F.col("content")) if checksums else F.lit(None).cast("string")).alias("checksum"),
                       (F.substring(text, 1, content_size) if content_size else F.lit(None).cast("string"))
                       .alias("content"))
