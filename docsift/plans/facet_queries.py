"""Registered facet, statistics, directory and treemap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import facets as A
from docsift.operators import search as S
from docsift.operators import treemap as TM
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index
from docsift.plans.registry import query
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures, with_fixtures

PI_CTE = (IDX_CTE + ",\n" + f"""pi AS (
  SELECT index_id, anc AS path, count(*) AS count, {Q.depth('anc')} AS depth
  FROM (SELECT index_id, unnest({Q.ancestors('path')}) AS anc FROM idx WHERE length(path) > 0)
  GROUP BY index_id, anc)""")


def _pi(spark, sf_dir):
    return A.path_index(doc_index(Fixtures(spark, sf_dir)))


@query("size_histogram", "A1", with_fixtures(["corpus"], f"""
SELECT CAST(size // {A.SIZE_BUCKET} * {A.SIZE_BUCKET} AS BIGINT) AS bucket, count(*) AS count
FROM corpus GROUP BY 1"""))
def size_histogram(spark, sf_dir):
    return A.size_histogram(Fixtures(spark, sf_dir).corpus)


@query("date_histogram", "A2", with_fixtures(["corpus"], f"""
SELECT CAST(mtime // {A.DATE_BUCKET} * {A.DATE_BUCKET} AS BIGINT) AS bucket, count(*) AS count
FROM corpus GROUP BY 1"""))
def date_histogram(spark, sf_dir):
    return A.date_histogram(Fixtures(spark, sf_dir).corpus)


@query("mime_totals", "A3/J2", with_fixtures(["corpus", "mime"], """
SELECT m.mime, CAST(sum(c.size) AS BIGINT) AS size, count(*) AS count
FROM corpus c JOIN mime m ON lower(c.extension) = lower(m.extension) GROUP BY m.mime"""))
def mime_totals(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return A.mime_totals(fx.corpus, fx.mime)


@query("mime_index", "A4/J1", with_fixtures(["corpus", "mime"], """
SELECT index_id, mime, count(*) AS count FROM idx WHERE mime IS NOT NULL GROUP BY index_id, mime""", IDX_CTE))
def mime_index(spark, sf_dir):
    return A.mime_index(doc_index(Fixtures(spark, sf_dir)))


@query("mime_facet", "A5", with_fixtures(["corpus", "mime"], """
SELECT mime, CAST(sum(count) AS BIGINT) AS count FROM (
  SELECT index_id, mime, count(*) AS count FROM idx WHERE mime IS NOT NULL GROUP BY index_id, mime)
GROUP BY mime""", IDX_CTE))
def mime_facet(spark, sf_dir):
    return A.mime_facet(A.mime_index(doc_index(Fixtures(spark, sf_dir))))


@query("mime_facet_for_query", "A6", with_fixtures(["corpus", "mime"], """
SELECT mime, count(*) AS count FROM idx WHERE size >= 1000000 AND mime IS NOT NULL
GROUP BY mime""", IDX_CTE))
def mime_facet_for_query(spark, sf_dir):
    hits = S.filter_documents(doc_index(Fixtures(spark, sf_dir)), S.SearchRequest(size_min=1_000_000))
    return A.mime_facet_for_query(hits)


@query("mime_tree", "A7", with_fixtures(["corpus", "mime"], """
SELECT split_part(mime, '/', 1) AS category, mime, count(*) AS count
FROM idx WHERE mime IS NOT NULL GROUP BY ROLLUP (split_part(mime, '/', 1), mime)""", IDX_CTE))
def mime_tree(spark, sf_dir):
    return A.mime_tree(doc_index(Fixtures(spark, sf_dir)))


_RANGE = """SELECT '{what}' AS what, CAST(coalesce(min(mtime), 0) AS BIGINT) AS date_min,
       CAST(CASE WHEN coalesce(min(mtime), 0) = coalesce(max(mtime), 1) THEN coalesce(max(mtime), 1) + 1
                 ELSE coalesce(max(mtime), 1) END AS BIGINT) AS date_max
FROM corpus WHERE {where}"""
_RANGES = {"all": "true", "none": "size < 0", "newest": "mtime = (SELECT max(mtime) FROM corpus)"}


@query("date_range", "A8", with_fixtures(["corpus"], " UNION ALL ".join(
    _RANGE.format(what=k, where=v) for k, v in _RANGES.items())))
def date_range(spark, sf_dir):
    """Of all documents, of none, and of one moment."""
    c = Fixtures(spark, sf_dir).corpus
    parts = {"all": c, "none": c.where(F.col("size") < 0),
             "newest": c.where(F.col("mtime") == c.select(F.max("mtime")).scalar())}
    out = None
    for what, docs in parts.items():
        row = A.date_range(docs).select(F.lit(what).alias("what"), "date_min", "date_max")
        out = row if out is None else out.unionByName(row)
    return out


@query("path_index", "A10", with_fixtures(["corpus", "mime"], "SELECT * FROM pi", PI_CTE))
def path_index(spark, sf_dir):
    return _pi(spark, sf_dir).select("index_id", "path", "count", "depth")


@query("path_children", "A11", with_fixtures(["corpus", "mime"], """
SELECT index_id, path, count FROM pi
WHERE depth BETWEEN 2 AND 3 AND index_id = 1 AND (path = 'src0' OR starts_with(path, 'src0/'))
""", PI_CTE))
def path_children(spark, sf_dir):
    return A.path_children(_pi(spark, sf_dir), 1, 2, 3, "src0")


@query("path_tree_level", "A12", with_fixtures(["corpus", "mime"], """
SELECT c.path, c.count FROM (
  SELECT path, count FROM pi
  WHERE depth BETWEEN 2 AND 4 AND index_id = 1 AND (path = 'src0' OR starts_with(path, 'src0/'))
    AND length(path) > 4) c
WHERE NOT EXISTS (SELECT 1 FROM pi p WHERE p.index_id = 1 AND p.depth BETWEEN 2 AND 4
                  AND starts_with(c.path, p.path || '/') AND p.path <> c.path
                  AND (p.path = 'src0' OR starts_with(p.path, 'src0/')) AND length(p.path) > 4)""", PI_CTE))
def path_tree_level(spark, sf_dir):
    return A.path_tree_level(_pi(spark, sf_dir), 1, "src0", 1)


@query("suggest_paths", "O7", with_fixtures(["corpus", "mime"], """
SELECT path FROM (SELECT DISTINCT path FROM pi) WHERE starts_with(path, 'src0/')
""", PI_CTE))
def suggest_paths(spark, sf_dir):
    paths = _pi(spark, sf_dir).select("path").distinct()
    return S.suggest_paths(paths, "src0/")


@query("suggest_paths_contains", "O7", with_fixtures(["corpus", "mime"], """
SELECT path FROM (SELECT DISTINCT path FROM pi) WHERE contains(lower(path), 'de/y')
""", PI_CTE))
def suggest_paths_contains(spark, sf_dir):
    paths = _pi(spark, sf_dir).select("path").distinct()
    return S.suggest_paths(paths, "DE/Y")


def _paths_index(spark, sf_dir):
    from docsift.operators.completion import write_completions

    return write_completions(_pi(spark, sf_dir), scratch_dir(spark, "completions"), "path")


@query("suggest_paths_stored", "O7", with_fixtures(["corpus", "mime"], """
SELECT path AS value FROM (SELECT DISTINCT path FROM pi) WHERE starts_with(path, 'src0/')
""", PI_CTE))
def suggest_paths_stored(spark, sf_dir):
    return _paths_index(spark, sf_dir).suggest_paths("src0/")


@query("suggest_paths_contains_stored", "O7", with_fixtures(["corpus", "mime"], """
SELECT path AS value FROM (SELECT DISTINCT path FROM pi) WHERE contains(lower(path), 'de/y')
""", PI_CTE))
def suggest_paths_contains_stored(spark, sf_dir):
    return _paths_index(spark, sf_dir).suggest_paths("DE/Y")


def _treemap_sql(levels: int = 5, src: str = "tree") -> str:
    """Unrolled bottom-up merge over ``src`` (path, size) whose paths have at
    most ``levels`` segments (the tree fixture has five)."""
    parts = [f"e{levels} AS (SELECT path, CAST(sum(size) AS BIGINT) AS size FROM {src} GROUP BY path)",
             f"thr AS (SELECT CAST(floor(CAST(sum(size) AS DOUBLE) * 0.0005) AS BIGINT) AS cut FROM {src})"]
    for d in range(levels, 1, -1):
        src = f"e{d}"
        parts.append(
            f"e{d - 1} AS (SELECT path, CAST(sum(size) AS BIGINT) AS size FROM ("
            f"SELECT path, size FROM {src}, thr WHERE {Q.depth('path')} <> {d} OR size >= thr.cut "
            f"UNION ALL SELECT {Q.parent('path')} AS path, size FROM {src}, thr "
            f"WHERE {Q.depth('path')} = {d} AND size < thr.cut) GROUP BY path)")
    return ",\n".join(parts)


@query("treemap", "A13", with_fixtures(["tree"], "SELECT path, size FROM e1", _treemap_sql()))
def treemap(spark, sf_dir):
    return TM.treemap(Fixtures(spark, sf_dir).tree)


@query("treemap_tree", "A14", with_fixtures(["tree"], f"""
SELECT node, CAST(sum(size) AS BIGINT) AS size, {Q.depth('node')} AS depth
FROM (SELECT unnest({Q.ancestors('path')}) AS node, size FROM e1) GROUP BY node
UNION ALL
SELECT path || '/.' AS node, size, {Q.depth("path || '/.'")} AS depth FROM e1 e
WHERE EXISTS (SELECT 1 FROM e1 x WHERE starts_with(x.path, e.path || '/'))""", _treemap_sql()))
def treemap_tree(spark, sf_dir):
    return TM.treemap_tree(TM.treemap(Fixtures(spark, sf_dir).tree))


@query("date_histogram_peaks", "A20", with_fixtures(["corpus"], f"""
SELECT bucket, count FROM h WHERE count > (SELECT quantile_cont(count, 0.9) FROM h)""",
    f"h AS (SELECT CAST(mtime // {A.DATE_BUCKET} * {A.DATE_BUCKET} AS BIGINT) AS bucket, count(*) AS count "
    f"FROM corpus GROUP BY 1)"))
def date_histogram_peaks(spark, sf_dir):
    return A.date_histogram_peaks(A.date_histogram(Fixtures(spark, sf_dir).corpus))


@query("top_size_bins", "O10", with_fixtures(["corpus"], f"""
SELECT CAST(size // {A.SIZE_BUCKET} * {A.SIZE_BUCKET} AS BIGINT) AS bucket, count(*) AS count
FROM corpus GROUP BY 1 ORDER BY count DESC, bucket LIMIT 25"""))
def top_size_bins(spark, sf_dir):
    return S.top_by(A.size_histogram(Fixtures(spark, sf_dir).corpus), "count", 25, "bucket")


@query("top_mimes_by_count", "O11", with_fixtures(["corpus", "mime"], """
SELECT m.mime, CAST(sum(c.size) AS BIGINT) AS size, count(*) AS count
FROM corpus c JOIN mime m ON lower(c.extension) = lower(m.extension) GROUP BY m.mime
ORDER BY count DESC, mime LIMIT 15"""))
def top_mimes_by_count(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return S.top_by(A.mime_totals(fx.corpus, fx.mime), "count", 15, "mime")


@query("top_mimes_by_size", "O11", with_fixtures(["corpus", "mime"], """
SELECT m.mime, CAST(sum(c.size) AS BIGINT) AS size, count(*) AS count
FROM corpus c JOIN mime m ON lower(c.extension) = lower(m.extension) GROUP BY m.mime
ORDER BY size DESC, mime LIMIT 15"""))
def top_mimes_by_size(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return S.top_by(A.mime_totals(fx.corpus, fx.mime), "size", 15, "mime")
