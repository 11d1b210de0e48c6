"""The directory walk: same files as Python's own walk, pruned before listing."""

import os
import re

import pytest

from docsift.sources import walk as W


@pytest.fixture
def tree(tmp_path):
    for rel in ["a.txt", "x/b.txt", "x/y/c.txt", "x/y/z/d.txt", "skip/e.txt", "x/skip/f.txt", "x/skip/deep/g.txt", "ü/日本.txt", "many/keep.md", "x y/100%.txt"]:
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("12345" * len(rel))
        os.utime(tmp_path / rel, (1_700_000_000, 1_700_000_000))
    (tmp_path / "empty/inner").mkdir(parents=True)
    return tmp_path


def plain(root, depth=None, exclude=None):
    out = {}
    for base, _, files in os.walk(root):
        for f in files:
            rel = os.path.relpath(os.path.join(base, f), root)
            parts = rel.split("/")
            hit = exclude and any(re.search(exclude, "/".join(parts[:i])) for i in range(1, len(parts) + 1))
            if (depth is None or len(parts) - 1 <= depth) and not hit:
                out[rel] = os.path.getsize(os.path.join(base, f))
    return out


def rows(df):
    got = df.collect()
    assert all(r.mtime == 1_700_000_000 for r in got)
    out = {r.rel_path: r.size for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("depth", [None, 0, 1, 2])
@pytest.mark.parametrize("exclude", [None, "skip$", "\\.txt$"])
def test_same_as_a_plain_walk(spark, tree, depth, exclude):
    assert rows(W.walk_files(spark, str(tree), depth, exclude)) == plain(tree, depth, exclude)


def test_roots_and_starts(spark, tree):
    for root in (f"file:{tree}", f"file://{tree}", f"{tree}/"):
        assert rows(W.walk_files(spark, root)) == plain(tree)
    start = spark.createDataFrame([("x/y",), ("x/y",), ("gone",), ("x/skip",)], "rel_path string")
    got = rows(W.walk_files(spark, str(tree), exclude="skip", start=start))
    assert set(got) == {"x/y/c.txt", "x/y/z/d.txt"}


def test_pruned_before_listing(spark, tree, monkeypatch):
    """Directories that are too deep or excluded are never listed."""
    asked = []
    real = W.list_directories
    monkeypatch.setattr(W, "list_directories", lambda dirs, root: (asked.extend(r.rel_path for r in dirs.collect()), real(dirs, root))[1])
    W.walk_files(spark, str(tree), depth=1, exclude="skip").collect()
    assert sorted(asked) == ["", "empty", "many", "x", "x y", "ü"]


def test_list_looks_at_named_directories_only(spark, tree, monkeypatch):
    asked = []
    real = W.list_directories
    monkeypatch.setattr(W, "list_directories", lambda dirs, root: (asked.extend(r.rel_path for r in dirs.collect()), real(dirs, root))[1])
    listing = spark.createDataFrame([("a.txt",), (f"{tree}/x/y/c.txt",), ("x/y/none.txt",), ("x/skip/f.txt",), ("/elsewhere/a.txt",), ("x/y",), (None,)], "value string")
    got = W.walk_list(spark, listing, str(tree), exclude="skip")
    assert sorted(r.rel_path for r in got.collect()) == ["a.txt", "x/y/c.txt"]
    assert sorted(asked) == ["", "x", "x/y"]
