"""Registered source and sink queries.

File-based queries first write files derived from the driver tables into a
fresh folder under the shared checkpoint location, then read them back with
Spark's file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions.paths import full_rel_path
from docsift.operators import facets as A
from docsift.operators import incremental as I
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index
from docsift.plans.registry import query
from docsift.plans.scalar_queries import EXCLUDE, REL_SQL
from docsift.session import scratch_dir
from docsift.sources import convert as C
from docsift.sources import files as FS
from docsift.sources import sinks as K
from docsift.sources.fixtures import Fixtures, with_fixtures


# For the oracle: blocks, tags with quoted values, and the references that pages have.
BLOCKS = [r"(?is)<script\b.*?</script[^>]*>", r"(?is)<style\b.*?</style[^>]*>", r"(?s)<!--.*?-->"]
TAG = r"""(?i)<[a-z/!?]([^=>]|=\s*"[^"]*"|=\s*'[^']*'|=)*>"""
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _markup_sql(x: str) -> str:
    out = x
    for pat in BLOCKS:
        out = f"regexp_replace({out}, {Q.q(pat)}, ' ', 'g')"
    out = f"regexp_replace({out}, {Q.q(TAG)}, ' ', 'g')"
    for ent, ch in REFERENCES:
        out = f"replace({out}, {Q.q(ent)}, {Q.q(ch)})"
    return f"trim(regexp_replace({out}, {Q.q(C.SPACE)}, ' ', 'g'))"


@query("markup_to_text", "S8", with_fixtures(["urls"], f"SELECT id, {_markup_sql('html')} AS text FROM urls"))
def markup_to_text(spark, sf_dir):
    u = Fixtures(spark, sf_dir).urls
    return u.select("id", C.markup_to_text("html").alias("text"))


# Around every page: a quoted ">", an inner and an open comment, CDATA, all kinds of references.
BEFORE = """<i a="1>2" b='>' c=3>&#65;<!-- <b> -->"""
AFTER = " <![CDATA[1<2&amp;]]>&#233;&#x20AC;&hellip;&copy;&bogus; a < b &amp;lt; <p <!-- open > <!-- left > open"


@query("markup_broken", "S8", with_fixtures(["urls"], f"""
SELECT id, trim(regexp_replace('A ' || {_markup_sql('html')} || ' 1<2&amp;é€…©&bogus; a < b &lt;', {Q.q(C.SPACE)}, ' ', 'g')) AS text FROM urls"""))
def markup_broken(spark, sf_dir):
    u = Fixtures(spark, sf_dir).urls
    return u.select("id", C.markup_to_text(F.concat(F.lit(BEFORE), "html", F.lit(AFTER))).alias("text"))


@query("json_to_text", "S9", """
SELECT event_id AS id,
       array_to_string(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)), ' ') AS text
FROM events""")
def json_to_text(spark, sf_dir):
    e = Fixtures(spark, sf_dir).events
    return e.select(F.col("event_id").alias("id"), C.json_to_text("props").alias("text"))


SRC_FIELDS = ["name", "path", "extension", "size", "mtime"]


@query("export_ndjson", "S11", with_fixtures(["corpus"], """
SELECT CAST(to_json(struct_pack(_id := printf('%08x.%08x', index_id, id), _index := 'docs',
       _source := struct_pack(name := name, path := path, extension := extension, size := size, mtime := mtime)))
       AS VARCHAR) AS value
FROM corpus"""))
def export_ndjson(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    out = scratch_dir(spark, "ndjson")
    K.export_ndjson(c, out, SRC_FIELDS)
    return spark.read.text(out)


BULK_CTE = """dl AS (
  SELECT DISTINCT id FROM (SELECT old_id AS id FROM d WHERE status = 'deleted' UNION ALL SELECT id FROM prev)
  WHERE id NOT IN (SELECT id FROM applied)),
ops AS (
  SELECT 0 AS op, ((CAST(1 AS BIGINT) << 32) | id) AS sid,
         CAST(to_json(struct_pack(name := name, path := path, size := size)) AS VARCHAR) AS source FROM applied
  UNION ALL SELECT 1 AS op, ((CAST(1 AS BIGINT) << 32) | id) AS sid, CAST(NULL AS VARCHAR) AS source FROM dl),
numbered AS (SELECT *, row_number() OVER (ORDER BY op, sid) AS r FROM ops)"""


def _bulk_sql():
    from docsift.plans.incremental_queries import APPLY_CTE, PREV_DELETES

    return with_fixtures(["corpus", "old", "new"], """
SELECT CAST((r - 1) // 70 AS BIGINT) AS batch, CAST(r AS BIGINT) AS row, CAST(p - 1 AS INT) AS part, lines[p] AS line
FROM (SELECT r, CASE WHEN op = 0 THEN [a, source] ELSE [a] END AS lines FROM (
        SELECT *, '{"' || CASE WHEN op = 0 THEN 'index' ELSE 'delete' END || '":{"_id":"'
               || printf('%08x.%08x', sid >> 32, sid & 4294967295) || '","_index":"docs"}}' AS a FROM numbered)),
     LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS p)""", APPLY_CTE + ",\n" + PREV_DELETES + ",\n" + BULK_CTE)


@query("bulk_payload", "S12", _bulk_sql())
def bulk_payload(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    prev = fx.corpus.select("id").join(fx.old.select("id"), "id", "left_anti")
    applied = I.apply_snapshot(fx.old, fx.new)
    dl = I.delete_list(fx.old, applied, prev).withColumn("index_id", F.lit(1))
    rows = applied.withColumn("index_id", F.lit(1))
    return K.bulk_payload(rows, dl, ["name", "path", "size"])


@query("union_indices", "S13/U1", with_fixtures(["corpus", "new"], """
SELECT id, name, CAST(1 AS INT) AS index_id FROM corpus UNION ALL SELECT id, name, CAST(2 AS INT) FROM new"""))
def union_indices(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return K.union_indices({1: fx.corpus.select("id", "name"), 2: fx.new.select("id", "name")})


REGISTRY_CTE = """used AS (SELECT DISTINCT c.index_id, e.model_id, m.name FROM emb e JOIN corpus c ON e.id = c.id
                JOIN model m ON m.id = e.model_id)"""


@query("index_registry", "S14", with_fixtures(["corpus", "emb", "model"], """
SELECT p.index_id, 'index' || CAST(p.index_id AS VARCHAR) AS name, p.n_docs, CAST(1 AS BIGINT) AS version,
       p.timestamp, u.models FROM
  (SELECT index_id, count(*) AS n_docs, max(mtime) AS timestamp FROM corpus GROUP BY index_id) p
  LEFT JOIN (SELECT index_id, string_agg(name, ',' ORDER BY model_id) AS models FROM used GROUP BY index_id) u
  ON p.index_id = u.index_id""", REGISTRY_CTE))
def index_registry(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    r = K.index_registry(fx.corpus, fx.emb, fx.model)
    return r.select("index_id", "name", "n_docs", "version", "timestamp",
                    F.array_join(F.transform("models", lambda m: m["name"]), ",").alias("models"))


@query("distinct_models", "S15", with_fixtures(["corpus", "emb", "model"], """
SELECT model_id, arg_min(name, index_id) AS name, min(index_id) AS index_id FROM used GROUP BY model_id""",
    REGISTRY_CTE))
def distinct_models(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return K.distinct_models(K.index_registry(fx.corpus, fx.emb, fx.model))


@query("facet_tsv", "S16", with_fixtures(["corpus", "mime"], """
SELECT mime || chr(9) || CAST(count AS VARCHAR) AS value FROM (
  SELECT mime, count(*) AS count FROM idx WHERE mime IS NOT NULL GROUP BY mime)""", IDX_CTE))
def facet_tsv(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    out = scratch_dir(spark, "facets")
    K.facet_tsv(A.mime_facet(A.mime_index(doc_index(fx))), out, "mime")
    return spark.read.text(out)


def fx_labels(spark, sf_dir):
    return Fixtures(spark, sf_dir).labels


def _tree(spark, sf_dir, archive=False):
    c = Fixtures(spark, sf_dir).corpus
    root = scratch_dir(spark, "tree")
    FS.write_tree(c, root, archive=archive)
    return c, root


@query("scan_files", "S1", with_fixtures(["corpus"], f"""
SELECT {REL_SQL} AS rel_path, CAST(strlen(content) AS BIGINT) AS size, mtime FROM corpus"""))
def scan_files(spark, sf_dir):
    _, root = _tree(spark, sf_dir)
    return FS.scan_files(spark, root)


@query("scan_list", "S4", with_fixtures(["corpus"], f"""
SELECT rel_path FROM (SELECT {REL_SQL} AS rel_path FROM corpus)
WHERE NOT regexp_matches(rel_path, '{EXCLUDE}')
  AND NOT coalesce(list_bool_or(list_transform({Q.ancestors('rel_path')}[1:-2],
                                                lambda a: regexp_matches(a, '{EXCLUDE}'))), false)"""))
def scan_list(spark, sf_dir):
    c, root = _tree(spark, sf_dir)
    plain = root[5:] if root.startswith("file:") else root
    rel = full_rel_path("path", "name", "extension")
    # English documents are listed by absolute path, the others relative to the root;
    # every labelled document also lists a file that does not exist
    listed = c.select(F.when(F.col("path").contains("/en"), F.concat(F.lit(plain + "/"), rel)).otherwise(rel)
                      .alias("value"))
    ghosts = fx_labels(spark, sf_dir).select(F.concat(F.lit("ghost/"), F.col("doc_id").cast("string"),
                                                      F.lit(".txt")).alias("value"))
    list_path = scratch_dir(spark, "list")
    listed.unionByName(ghosts).write.mode("overwrite").text(list_path)
    files = FS.scan_files(spark, root)
    return FS.scan_list(spark.read.text(list_path), files, plain, EXCLUDE).select("rel_path")


@query("walk_files", "S1/S2/S3", with_fixtures(["corpus"], f"""
SELECT rel_path, size, mtime FROM (SELECT {REL_SQL} AS rel_path, CAST(strlen(content) AS BIGINT) AS size, mtime FROM corpus)
WHERE length(rel_path) - length(replace(rel_path, '/', '')) <= 2 AND NOT regexp_matches(rel_path, '{EXCLUDE}')
  AND NOT coalesce(list_bool_or(list_transform({Q.ancestors('rel_path')}[1:-2], lambda a: regexp_matches(a, '{EXCLUDE}'))), false)"""))
def walk_files(spark, sf_dir):
    """Listed directory by directory in tasks, pruned before listing."""
    from docsift.sources.walk import walk_files as walk

    _, root = _tree(spark, sf_dir)
    return walk(spark, root, depth=2, exclude=EXCLUDE)


@query("walk_list", "S4", with_fixtures(["corpus"], f"""
SELECT rel_path, size FROM (SELECT {REL_SQL} AS rel_path, CAST(strlen(content) AS BIGINT) AS size, id FROM corpus) WHERE id % 3 = 0"""))
def walk_list(spark, sf_dir):
    """Only the directories that the list names are looked at."""
    from docsift.sources.walk import walk_list as walk

    c, root = _tree(spark, sf_dir)
    listed = c.where(F.col("id") % 3 == 0).select(full_rel_path("path", "name", "extension").alias("value"))
    ghosts = c.select(F.concat(F.lit("ghost/"), F.col("id").cast("string")).alias("value"))
    return walk(spark, listed.unionByName(ghosts), root).select("rel_path", "size")


@query("expand_archives", "S10", with_fixtures(["corpus"], f"""
SELECT CASE WHEN length(path) = 0 THEN name || '.zip' ELSE path || '/' || name || '.zip' END AS archive,
       {REL_SQL.replace('path || ', "'' || ").replace("length(path) = 0", "true")} AS member,
       CAST(strlen(content) AS BIGINT) AS size, CAST(1 AS INT) AS depth, 'ok' AS status
FROM corpus"""))
def expand_archives(spark, sf_dir):
    _, root = _tree(spark, sf_dir, archive=True)
    return FS.read_archives(spark, root, "shallow").select("archive", "member", "size", "depth", "status")


@query("scan_documents", "S1/S2/S3/S5/S6/S7/P5", with_fixtures(["corpus", "mime"], f"""
SELECT rel_path, path, name, extension, size, mtime, mime, checksum, n_chars FROM (
  SELECT {REL_SQL} AS rel_path, i.path, i.name, i.extension, CAST(strlen(i.content) AS BIGINT) AS size, i.mtime,
         i.mime, sha1(i.content) AS checksum, CAST(length(substring(i.content, 1, 32768)) AS BIGINT) AS n_chars
  FROM idx i)
WHERE length(rel_path) - length(replace(rel_path, '/', '')) <= 2
  AND NOT regexp_matches(rel_path, '{EXCLUDE}')
  AND NOT coalesce(list_bool_or(list_transform({Q.ancestors('rel_path')}[1:-2],
                                                lambda a: regexp_matches(a, '{EXCLUDE}'))), false)""",
    IDX_CTE))
def scan_documents(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    _, root = _tree(spark, sf_dir)
    docs = FS.scan_documents(spark, root, fx.mime, depth=2, exclude=EXCLUDE)
    return docs.select("rel_path", "path", "name", "extension", "size", "mtime", "mime", "checksum",
                       F.length("content").cast("long").alias("n_chars"))
