"""File scans that keep no list of the files on the driver: the rows of Spark's own listing, from tasks."""

import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.operators.documents import mime_dimension
from docsift.sources import files as FS
from docsift.sources import walk as W

NAMES = ["a.txt", "x/b.TXT", "x/y/c (1).txt", "x/y/z/d%20.md", "ü/日本.txt", ".hidden/a.txt", "x/.b.txt", "_temporary/a.txt", "x/_b.txt", "x/_k=1/c.txt",
         "x/_metadata_x.txt", "x/c._COPYING_", "x y/empty.txt", "skip/e.txt", "noext", "x/we{ird}[1].txt"]


@pytest.fixture
def tree(tmp_path):
    for i, rel in enumerate([*NAMES, *(f"many/{i}.txt" for i in range(150))]):
        (tmp_path / "t" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / rel).write_bytes(b"" if "empty" in rel else f"text é {rel} ".encode() * (1 + i % 5))
        os.utime(tmp_path / "t" / rel, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "t")


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain(root):
    """All files; Spark's own listing left out the empty and the hidden ones."""
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def by_spark(monkeypatch, call):
    with monkeypatch.context() as m:
        m.setattr(W, "walkable", lambda *a: False)
        return rows(call())


LEFT_OUT = re.compile(r"(^|/)(\.|_(?!k=))|_COPYING_|empty")


@pytest.mark.parametrize("glob", [None, "*.txt", "*.{md,TXT}", "[a-c]*", "?????", "we*"])
def test_listing_equals_that_of_spark(spark, tree, monkeypatch, glob):
    scan = lambda root=tree: FS.scan_files(spark, root, glob)
    got = rows(scan())
    assert [r for r in got if not LEFT_OUT.search(r[0])] == by_spark(monkeypatch, scan)
    assert {r[0] for r in got if LEFT_OUT.search(r[0])} == {f for f in plain(tree) if LEFT_OUT.search(f)} or glob
    assert rows(scan(f"file:{tree}/")) == got and got
    assert len(scan().inputFiles()) < 60  # 150 files and more before: the driver held them all


@pytest.mark.parametrize("depth", [None, 0, 2])
@pytest.mark.parametrize("exclude", [None, "skip|y/z"])
def test_documents_equal_those_of_spark(spark, tree, monkeypatch, depth, exclude):
    scan = lambda: FS.scan_documents(spark, tree, mime_dimension(spark), depth, exclude).withColumn("mime", F.coalesce("mime", F.lit("-")))
    got = rows(scan())
    assert [r for r in got if not LEFT_OUT.search(r[0])] == by_spark(monkeypatch, scan)
    assert [r[0] for r in got] == [f for f in plain(tree) if (depth is None or f.count("/") <= depth) and not (exclude and re.search(exclude, f))]
    assert len(scan().inputFiles()) < 60


def test_contents_leave_in_bounded_batches(spark, tree, monkeypatch):
    monkeypatch.setattr(W, "CONTENT", 64)
    got = W.with_content(FS.scan_files(spark, tree), tree)
    assert {r.rel_path: bytes(r.content) for r in got.collect()} == {f: open(f"{tree}/{f}", "rb").read() for f in plain(tree)}
    assert got.where(F.octet_length("content") != F.col("size")).isEmpty()


def test_archives_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    for i in range(120):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / f"d{i % 3}" / f"{i}.zip", "w") as z:
            z.writestr("in/a.txt", "x" * i)
    (tmp_path / "d0" / "bad.zip").write_bytes(b"nothing")
    (tmp_path / "d0" / "a.txt").write_bytes(b"no archive")
    read = lambda: FS.read_archives(spark, str(tmp_path)).select("archive", F.coalesce("member", F.lit("-")), F.coalesce("size", F.lit(-1)), "depth", "status", F.md5(F.coalesce("content", F.lit(b""))))
    want = by_spark(monkeypatch, read)
    assert rows(read()) == want and len(want) == 121
    assert len(read().inputFiles()) < 60


def test_roots_that_are_not_walked(spark, tree):
    assert not W.walkable(spark, "viewfs://store/in") and not W.walkable(spark, f"{tree}/a.txt") and not W.walkable(spark, f"{tree}/none")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FS.scan_files(spark, f"{tree}/none").collect()
