"""Registered incremental-scan, index-maintenance and link queries
(I1-I6, I10-I13, J7-J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions.ids import pack_sid
from docsift.functions.paths import path_depth
from docsift.operators import fulltext as T
from docsift.operators import incremental as I
from docsift.plans import sqlfrag as Q
from docsift.plans.common import search_index, text_index
from docsift.plans.registry import query
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures, with_fixtures

KEY = "CASE WHEN length(path) = 0 THEN name ELSE path || '/' || name END"
DIFF_CTE = f"""o AS (SELECT {KEY} AS key, id AS old_id, mtime AS old_mtime FROM old),
n AS (SELECT {KEY} AS key, mtime AS new_mtime FROM new),
d AS (SELECT coalesce(o.key, n.key) AS key, old_id, old_mtime, new_mtime,
             CASE WHEN old_id IS NULL THEN 'new' WHEN new_mtime IS NULL THEN 'deleted'
                  WHEN old_mtime = new_mtime THEN 'unchanged' ELSE 'modified' END AS status
      FROM o FULL OUTER JOIN n ON o.key = n.key)"""
APPLY_CTE = DIFF_CTE + f""",
nk AS (SELECT *, {KEY} AS key FROM new),
applied AS (
  SELECT d.old_id AS id, nk.path, nk.name, nk.mtime, nk.size, d.status
  FROM nk JOIN d ON nk.key = d.key WHERE d.status IN ('unchanged', 'modified')
  UNION ALL
  SELECT CAST((SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY nk.key) AS BIGINT) AS id,
         nk.path, nk.name, nk.mtime, nk.size, d.status
  FROM nk JOIN d ON nk.key = d.key WHERE d.status = 'new')"""
SID = "((CAST({i} AS BIGINT) << 32) | {c})"
INDEX_CTE = APPLY_CTE + f""",
ix AS (SELECT {SID.format(i='index_id', c='id')} AS sid, index_id, id, path, name, mtime, size FROM corpus),
inc AS (SELECT {SID.format(i=1, c='id')} AS sid, CAST(1 AS INT) AS index_id, id, path, name, mtime, size FROM applied),
upserted AS (SELECT * FROM ix WHERE sid NOT IN (SELECT sid FROM inc) UNION ALL SELECT * FROM inc)"""
PREV_DELETES = "prev AS (SELECT id FROM corpus WHERE id NOT IN (SELECT id FROM old))"


def _prev(fx):
    """The previous run's delete list: documents missing from the old snapshot."""
    return fx.corpus.select("id").join(fx.old.select("id"), "id", "left_anti")


@query("snapshot_diff", "I1", with_fixtures(["corpus", "old", "new"], "SELECT * FROM d", DIFF_CTE))
def snapshot_diff(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.snapshot_diff(fx.old, fx.new)


@query("snapshot_counts", "I1", with_fixtures(["corpus", "old", "new"],
                                              "SELECT status, count(*) AS n FROM d GROUP BY status", DIFF_CTE))
def snapshot_counts(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.snapshot_diff(fx.old, fx.new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("apply_snapshot", "I2", with_fixtures(["corpus", "old", "new"], "SELECT * FROM applied", APPLY_CTE))
def apply_snapshot(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.apply_snapshot(fx.old, fx.new).select("id", "path", "name", "mtime", "size", "status")


@query("delete_list", "I3", with_fixtures(["corpus", "old", "new"], """
SELECT DISTINCT id FROM (SELECT old_id AS id FROM d WHERE status = 'deleted' UNION ALL SELECT id FROM prev)
WHERE id NOT IN (SELECT id FROM applied)""", APPLY_CTE + ",\n" + PREV_DELETES))
def delete_list(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.delete_list(fx.old, I.apply_snapshot(fx.old, fx.new), _prev(fx))


def _applied(fx):
    return I.apply_snapshot(fx.old, fx.new).drop("status")


def _index(fx):
    return fx.corpus.select(pack_sid("index_id", "id").alias("sid"), "index_id", "id", "path", "name", "mtime",
                            "size")


@query("index_upsert", "I4", with_fixtures(["corpus", "old", "new"], "SELECT * FROM upserted", INDEX_CTE))
def index_upsert(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.index_upsert(_index(fx), _applied(fx), 1)


@query("index_upsert_stored", "I4", with_fixtures(["corpus", "old", "new"], "SELECT * FROM upserted", INDEX_CTE))
def index_upsert_stored(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    path = scratch_dir(spark, "doc-index")
    I.write_index(_index(fx), path)
    I.upsert_stored_index(spark, path, _applied(fx), 1)
    t = spark.read.parquet(path)
    return t.select("sid", F.col("index_id").cast("int").alias("index_id"), "id", "path", "name", "mtime", "size")


@query("index_delete", "I5", with_fixtures(["corpus", "old", "new"], f"""
SELECT * FROM upserted WHERE sid NOT IN (
  SELECT {SID.format(i=1, c='id')} FROM (
    SELECT DISTINCT id FROM (SELECT old_id AS id FROM d WHERE status = 'deleted' UNION ALL SELECT id FROM prev)
    WHERE id NOT IN (SELECT id FROM applied)))""", INDEX_CTE + ",\n" + PREV_DELETES))
def index_delete(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    applied = _applied(fx)
    return I.index_delete(I.index_upsert(_index(fx), applied, 1), I.delete_list(fx.old, applied, _prev(fx)), 1)


@query("copy_vectors", "I6", with_fixtures(["emb"], f"""
SELECT sid, model_id, start, array_to_string(list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',') AS vector FROM (
  SELECT {SID.format(i=1, c='id')} AS sid, model_id, start, embedding FROM emb WHERE model_id = 1
  UNION ALL
  SELECT {SID.format(i=1, c='id')} AS sid, model_id, start, list_reverse(embedding) AS embedding FROM emb
  WHERE model_id <> 1)"""))
def copy_vectors(spark, sf_dir):
    e = Fixtures(spark, sf_dir).emb.withColumn("sid", pack_sid(F.lit(1), "id"))
    existing = e.where(F.col("model_id") == 1).select("sid", "model_id", "start", "embedding")
    incoming = e.select("sid", "model_id", "start", F.reverse("embedding").alias("embedding"))
    out = I.copy_vectors(existing, incoming)
    return out.select("sid", "model_id", "start", F.array_join(F.transform(
        "embedding", lambda x: F.format_string("%.4f", x.cast("double"))), ",").alias("vector"))


@query("record_version", "I10", with_fixtures(["corpus", "old", "new"], """
SELECT id, CAST(CASE WHEN status = 'unchanged' THEN 1 ELSE 2 END AS BIGINT) AS version FROM applied""", APPLY_CTE))
def record_version(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.record_version(I.apply_snapshot(fx.old, fx.new), 2).select("id", "version")


# A third listing: some files go, some change, and some that were gone come back.
THIRD_WHERE, THIRD_MTIME, BACK_MTIME = "size % 7 <> 3", "CASE WHEN size % 5 = 0 THEN mtime + 10 ELSE mtime END", "mtime + 1"
THREE_CTE = f"""l1 AS (SELECT {KEY} AS key, mtime FROM old),
l2 AS (SELECT {KEY} AS key, mtime FROM new),
l3 AS (SELECT {KEY} AS key, {THIRD_MTIME} AS mtime FROM new WHERE {THIRD_WHERE}
       UNION ALL SELECT key, {BACK_MTIME} AS mtime FROM l1 WHERE key NOT IN (SELECT key FROM l2)),
t1 AS (SELECT key, mtime, row_number() OVER (ORDER BY key) AS id, 1 AS version FROM l1),
t2 AS (SELECT l.key, l.mtime, t.id, CASE WHEN t.mtime = l.mtime THEN t.version ELSE 2 END AS version FROM l2 l JOIN t1 t ON l.key = t.key
       UNION ALL SELECT key, mtime, (SELECT max(id) FROM t1) + row_number() OVER (ORDER BY key), 2
       FROM l2 WHERE key NOT IN (SELECT key FROM t1)),
t3 AS (SELECT l.key, l.mtime, t.id, CASE WHEN t.mtime = l.mtime THEN t.version ELSE 3 END AS version FROM l3 l JOIN t2 t ON l.key = t.key
       UNION ALL SELECT key, mtime, (SELECT max(id) FROM t2) + row_number() OVER (ORDER BY key), 3
       FROM l3 WHERE key NOT IN (SELECT key FROM t2))"""


def _three_runs(spark, sf_dir):
    """Three scans one after another; each table is written before the next
    run reads it, and each run adds its line to the run log."""
    fx = Fixtures(spark, sf_dir)
    cols = ["path", "name", "mtime", "size"]
    gone = I.file_key(fx.old).join(I.file_key(fx.new).select("key"), "key", "left_anti").select(*cols)
    third = fx.new.where(THIRD_WHERE).withColumn("mtime", F.expr(THIRD_MTIME)).select(*cols).unionByName(
        gone.withColumn("mtime", F.expr(BACK_MTIME)))
    table = spark.createDataFrame([], "id long, path string, name string, mtime long, size long, version long")
    out, log = scratch_dir(spark, "runs"), scratch_dir(spark, "run-log")
    for version, listing in enumerate([fx.old.select(*cols), fx.new.select(*cols), third], 1):
        applied = I.record_version(I.apply_snapshot(table, listing), version)
        applied.write.parquet(f"{out}/{version}")
        applied = spark.read.parquet(f"{out}/{version}")
        I.append_run(I.run_entry(applied, I.delete_list(table, applied), version, 1000 * version), log)
        table = applied.drop("status")
    return table, spark.read.parquet(log)


@query("three_runs", "I10/I2", with_fixtures(["corpus", "old", "new"], """
SELECT key, CAST(id AS BIGINT) AS id, mtime, CAST(version AS BIGINT) AS version FROM t3""", THREE_CTE))
def three_runs(spark, sf_dir):
    return I.file_key(_three_runs(spark, sf_dir)[0]).select("key", "id", "mtime", "version")


def _log_sql(old: str, new: str, version: int) -> str:
    return f"""SELECT CAST({version} AS BIGINT) AS version, CAST({1000 * version} AS BIGINT) AS timestamp,
  (SELECT count(*) FROM {new} WHERE key NOT IN (SELECT key FROM {old})) AS "new",
  (SELECT count(*) FROM {new} n JOIN {old} o ON n.key = o.key WHERE n.mtime <> o.mtime) AS modified,
  (SELECT count(*) FROM {new} n JOIN {old} o ON n.key = o.key WHERE n.mtime = o.mtime) AS unchanged,
  (SELECT count(*) FROM {old} WHERE key NOT IN (SELECT key FROM {new})) AS deleted"""


@query("run_log", "I10", with_fixtures(["corpus", "old", "new"], " UNION ALL ".join([
    _log_sql("(SELECT key, mtime FROM t1 WHERE false)", "t1", 1), _log_sql("t1", "t2", 2), _log_sql("t2", "t3", 3)]), THREE_CTE))
def run_log(spark, sf_dir):
    log = _three_runs(spark, sf_dir)[1]
    return log.select(F.col("version").cast("long").alias("version"), "timestamp", "new", "modified", "unchanged", "deleted")


@query("ingest_fields", "I11", with_fixtures(["corpus"], f"""
SELECT id, CAST(id AS VARCHAR) AS _tie, {Q.depth('path')} AS _depth FROM corpus"""))
def ingest_fields(spark, sf_dir):
    return I.ingest_fields(Fixtures(spark, sf_dir).corpus).select("id", "_tie", "_depth")


def _compact_sql() -> str:
    from docsift.plans.text_queries import _postings_cte

    return with_fixtures(["corpus"], "SELECT token, id, field, tf FROM post", _postings_cte())


@query("compact_index", "I12", _compact_sql())
def compact_index(spark, sf_dir):
    """Rewrite the existing text index's postings into a fresh, token-ordered
    layout (what an index merge does after many incremental loads)."""
    out = scratch_dir(spark, "postings")
    T.write_postings(text_index(spark, sf_dir).postings.select("token", "id", "field", "tf"), out)
    return spark.read.parquet(out)


@query("check_constraints", "I13", with_fixtures(["model"], """
SELECT 'model_id' AS what, CAST(id AS VARCHAR) AS key FROM model WHERE id NOT BETWEEN 1 AND 999
UNION ALL SELECT 'model_name', name FROM model WHERE length(name) >= 16
UNION ALL SELECT 'model_type', type FROM model WHERE type NOT IN ('flat', 'nested')
UNION ALL SELECT 'model_path', path FROM model GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'json', CAST(conv_id * 1000 + turn AS VARCHAR) FROM conversations WHERE NOT json_valid(text)"""))
def check_constraints(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    recs = fx.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                   F.col("text").alias("json_data"))
    return I.check_constraints(fx.model, recs)


@query("pending_deletes", "J7", with_fixtures(["corpus", "old", "new"], """
SELECT id FROM prev WHERE id IN (SELECT id FROM new)""", PREV_DELETES))
def pending_deletes(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return I.pending_deletes(_prev(fx), fx.new)


@query("missing_pairs", "J8", with_fixtures(["corpus", "tags", "old"], """
SELECT id, tag, 'left' AS side FROM (SELECT id, tag FROM tags EXCEPT ALL SELECT id, tag FROM target)
UNION ALL SELECT id, tag, 'right' AS side FROM (SELECT id, tag FROM target EXCEPT ALL SELECT id, tag FROM tags)""",
    __import__("docsift.plans.tag_queries", fromlist=["TARGET_CTE"]).TARGET_CTE))
def missing_pairs(spark, sf_dir):
    from docsift.plans.tag_queries import _target

    fx = Fixtures(spark, sf_dir)
    return I.missing_pairs(fx.tags, _target(fx))


LINKS_CTE = f"""links AS (
  SELECT c.id, CASE WHEN length(p.path) = 0 THEN p.name ELSE p.path || '/' || p.name END AS parent_key
  FROM corpus c JOIN corpus p ON c.parent = p.id)"""


@query("resolve_parent_id", "J9", with_fixtures(["corpus"], f"""
SELECT l.id, c.id AS parent_id FROM links l LEFT JOIN corpus c ON l.parent_key = {KEY.replace('path', 'c.path').replace('name', 'c.name')}""",
    LINKS_CTE))
def resolve_parent_id(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    p = I.file_key(c).select(F.col("id").alias("pid"), F.col("key").alias("parent_key"))
    links = c.join(p, c["parent"] == p["pid"]).select("id", "parent_key")
    return I.resolve_parent_id(links, c).select("id", "parent_id")


@query("root_document", "J10", with_fixtures(["corpus"], """
SELECT id, root FROM (
  WITH RECURSIVE up(id, anc, parent) AS (
    SELECT c.id, c.id, c.parent FROM corpus c
    UNION ALL
    SELECT u.id, p.id, p.parent FROM up u JOIN corpus p ON u.parent = p.id)
  SELECT id, anc AS root FROM up WHERE parent IS NULL)"""))
def root_document(spark, sf_dir):
    return I.root_document(Fixtures(spark, sf_dir).corpus.select("id", "parent"))


@query("descendants", "J11", with_fixtures(["corpus"], f"""
SELECT dd.dir, c.id FROM (SELECT DISTINCT path AS dir FROM corpus WHERE {Q.depth('path')} = 2) dd
JOIN corpus c ON c.path = dd.dir OR starts_with(c.path, dd.dir || '/')"""))
def descendants(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    dirs = c.where(path_depth(F.col("path")) == 2).select(F.col("path").alias("dir")).distinct()
    return I.descendants(c, dirs)


def _index_summary_sql() -> str:
    from docsift.plans.facet_queries import PI_CTE, _treemap_sql
    from docsift.plans.scalar_queries import REL_SQL
    from docsift.plans.text_queries import _postings_cte

    ctes = (PI_CTE + ",\n" + _postings_cte() + ",\n"
            + f"tmsrc AS (SELECT {REL_SQL} AS path, size FROM corpus WHERE parent IS NULL),\n"
            + _treemap_sql(4, "tmsrc"))
    body = """
SELECT 'documents' AS "table", count(*) AS n_rows FROM corpus
UNION ALL SELECT 'text', count(*) FROM post
UNION ALL SELECT 'mime_index', count(*) FROM (SELECT DISTINCT index_id, mime FROM idx WHERE mime IS NOT NULL)
UNION ALL SELECT 'path_index', count(*) FROM pi
UNION ALL SELECT 'date_range', 1
UNION ALL SELECT 'size_histogram', count(DISTINCT size // 5000000) FROM corpus
UNION ALL SELECT 'date_histogram', count(DISTINCT mtime // 2629800) FROM corpus
UNION ALL SELECT 'mime_totals', count(DISTINCT m.mime) FROM corpus c JOIN mime m ON lower(c.extension) = lower(m.extension)
UNION ALL SELECT 'treemap', count(*) FROM e1
UNION ALL SELECT 'tags', count(*) FROM tags
UNION ALL SELECT 'vectors', count(*) FROM emb"""
    return with_fixtures(["corpus", "mime", "tags", "emb"], body, ctes)


@query("index_build_summary", "I4/T4/A4/A10/A13", _index_summary_sql())
def index_build_summary(spark, sf_dir):
    """Build every index table (documents, text, facets, statistics, tags,
    vectors) and report the rows of each."""
    from functools import reduce

    from docsift.operators.indexer import FACET_TABLES

    ix = search_index(spark, sf_dir)
    parts = [("documents", ix.documents), ("text", ix.text.postings)] + \
        [(t, getattr(ix, t)) for t in FACET_TABLES] + [("tags", ix.tags), ("vectors", ix.vectors)]
    frames = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table"), "n_rows") for t, df in parts]
    return reduce(lambda a, b: a.unionByName(b), frames)
