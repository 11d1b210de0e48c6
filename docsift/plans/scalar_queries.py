"""Registered scalar-function and row-wise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions import fmt as FM
from docsift.functions.ids import format_sid, pack_sid, parse_sid, unpack_doc, unpack_index
from docsift.functions.paths import full_rel_path, path_depth, path_parent
from docsift.operators import documents as D
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index
from docsift.plans.registry import query
from docsift.sources import files as FS
from docsift.sources.fixtures import Fixtures, with_fixtures

REL = "CASE WHEN length(path) = 0 THEN {f} ELSE path || '/' || {f} END"
FILE = "CASE WHEN length(extension) > 0 THEN name || '.' || extension ELSE name END"
REL_SQL = REL.format(f=f"({FILE})")
SID_SQL = "((CAST(index_id AS BIGINT) << 32) | id)"


@query("path_functions", "P1/P2/P4", with_fixtures(["corpus"], f"""
SELECT id, rel, {Q.parent('rel')} AS parent, {Q.depth('path')} AS depth, sid,
       printf('%08x.%08x', sid >> 32, sid & 4294967295) AS sid_text,
       sid >> 32 AS index_back, sid & 4294967295 AS doc_back
FROM (SELECT id, path, {REL_SQL} AS rel, {SID_SQL} AS sid FROM corpus)"""))
def path_functions(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    rel = full_rel_path("path", "name", "extension")
    sid = pack_sid("index_id", "id")
    out = c.select("id", "path", rel.alias("rel"), sid.alias("sid"))
    return out.select("id", "rel", path_parent("rel").alias("parent"), path_depth("path").alias("depth"), "sid",
                      format_sid("sid").alias("sid_text"), unpack_index(parse_sid(format_sid("sid"))).alias(
                          "index_back"), unpack_doc(parse_sid(format_sid("sid"))).alias("doc_back"))


def _human_size_sql(b: str) -> str:
    u = f"least((length(CAST(abs({b}) AS VARCHAR)) - 1) // 3 - 1, 7)"
    unit = f"CAST(pow(1000, {u} + 1) AS HUGEINT)"
    tenths = f"((CAST(abs({b}) AS HUGEINT) * 10 + {unit} // 2) // {unit})"
    letters = "['k', 'M', 'G', 'T', 'P', 'E', 'Z', 'Y']"
    text = f"printf('%d.%d%s', {tenths} // 10, {tenths} % 10, {letters}[{u} + 1])"
    return (f"CASE WHEN {b} = 0 THEN '0 B' WHEN abs({b}) < 1000 THEN CAST({b} AS VARCHAR) || ' B' "
            f"WHEN {b} < 0 THEN '-' || {text} ELSE {text} END")


def _human_time_sql(s: str) -> str:
    h, m = f"({s} // 3600)", f"(({s} - ({s} // 3600) * 3600) // 60)"
    r = f"({s} - {h} * 3600 - {m} * 60)"
    return (f"CASE WHEN {s} < 60 THEN CAST({s} AS VARCHAR) || 's' "
            f"WHEN {s} < 3600 THEN lpad(CAST({m} AS VARCHAR), 2, '0') || ':' || lpad(CAST({r} AS VARCHAR), 2, '0') "
            f"ELSE (CASE WHEN {h} < 10 THEN lpad(CAST({h} AS VARCHAR), 2, '0') ELSE CAST({h} AS VARCHAR) END) || ':' "
            f"|| lpad(CAST({m} AS VARCHAR), 2, '0') || ':' || lpad(CAST({r} AS VARCHAR), 2, '0') END")


@query("human_formats", "P11/P12/P13", with_fixtures(["corpus"], f"""
SELECT id, {_human_size_sql('size')} AS size_text, {_human_size_sql('size // 4096')} AS chars_text,
       {_human_time_sql('(size // 4096)')} AS duration_text,
       strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') AS date_text
FROM corpus"""))
def human_formats(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    chars = F.floor(F.col("size") / 4096).cast("long")
    return c.select("id", FM.human_size("size").alias("size_text"), FM.human_size(chars).alias("chars_text"),
                    FM.human_time(chars).alias("duration_text"), FM.human_date("mtime").alias("date_text"))


@query("dms_to_decimal", "P16", with_fixtures(["meta"], """
SELECT id, round((d + m / 60 + s / 3600) * CASE WHEN gps_latitude_ref IN ('S', 'W') THEN -1.0 ELSE 1.0 END, 6)
       AS latitude
FROM (SELECT id, gps_latitude_ref,
        CAST(string_split(trim(string_split(gps_latitude_dms, ',')[1]), ':')[1] AS DOUBLE)
          / CAST(string_split(trim(string_split(gps_latitude_dms, ',')[1]), ':')[2] AS DOUBLE) AS d,
        CAST(string_split(trim(string_split(gps_latitude_dms, ',')[2]), ':')[1] AS DOUBLE)
          / CAST(string_split(trim(string_split(gps_latitude_dms, ',')[2]), ':')[2] AS DOUBLE) AS m,
        CAST(string_split(trim(string_split(gps_latitude_dms, ',')[3]), ':')[1] AS DOUBLE)
          / CAST(string_split(trim(string_split(gps_latitude_dms, ',')[3]), ':')[2] AS DOUBLE) AS s
      FROM meta)"""))
def dms_to_decimal(spark, sf_dir):
    m = Fixtures(spark, sf_dir).meta
    return m.select("id", F.round(FM.dms_to_decimal("gps_latitude_dms", "gps_latitude_ref"), 6).alias("latitude"))


@query("hit_props", "P17", with_fixtures(["meta"], """
SELECT id, false AS is_sub_document, false AS has_thumbnail, false AS has_vid_preview,
       split_part(mime, '/', 1) = 'image' AND coalesce(videoc, '') <> 'gif' AS is_image,
       split_part(mime, '/', 1) = 'image' AND coalesce(videoc, '') = 'gif' AS is_gif,
       split_part(mime, '/', 1) = 'image' AND width IS NOT NULL AND coalesce(videoc, '') NOT IN ('tiff', 'raw', 'ppm')
         AS is_playable_image,
       CASE WHEN split_part(mime, '/', 1) = 'image' AND width IS NOT NULL AND height IS NOT NULL
            THEN round(CAST(width AS DOUBLE) / CAST(height AS DOUBLE), 6) END AS image_aspect_ratio,
       split_part(mime, '/', 1) = 'video' AND videoc IS NOT NULL AS is_video,
       split_part(mime, '/', 1) = 'video' AND videoc IS NOT NULL AND starts_with(mime, 'video/')
         AND coalesce(extension, '') NOT IN ('mkv', 'avi', 'mov')
         AND coalesce(videoc, '') NOT IN ('hevc', 'mpeg1video', 'mpeg2video', 'wmv3') AS is_playable_video,
       false AS is_audio
FROM meta"""))
def hit_props(spark, sf_dir):
    return D.hit_props(Fixtures(spark, sf_dir).meta)


@query("file_url", "P18", with_fixtures(["corpus"], f"""
SELECT id, 'http://localhost/f/' || replace({REL_SQL}, '#', '%23') AS url FROM corpus"""))
def file_url(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    return c.select("id", FM.file_url("http://localhost/f/", "path", "name", "extension").alias("url"))


TEMPLATE = "${doc.name} | ${humanFileSize(doc.size)} | ${doc.mime} | ${doc.genre}"


@query("featured_line", "P19", with_fixtures(["meta"], f"""
SELECT id, name || ' | ' || ({_human_size_sql('size')}) || ' | ' || mime || ' | ' || coalesce(genre, 'undefined')
       AS line FROM meta"""))
def featured_line(spark, sf_dir):
    m = Fixtures(spark, sf_dir).meta
    return m.select("id", FM.featured_line(TEMPLATE).alias("line"))


@query("mime_by_extension", "P5/J1", with_fixtures(["corpus", "mime"], "SELECT id, extension, mime FROM idx", IDX_CTE))
def mime_by_extension(spark, sf_dir):
    return doc_index(Fixtures(spark, sf_dir)).select("id", "extension", "mime")


FILE_CLASS_SQL = """CASE WHEN mime IS NULL THEN 'none'
  WHEN (split_part(mime, '/', 1) = 'video' AND size >= 65536) OR (split_part(mime, '/', 1) = 'image' AND size >= 512)
       OR split_part(mime, '/', 1) = 'audio' THEN 'media'
  WHEN mime IN ('application/pdf', 'application/epub+zip') THEN 'ebook'
  WHEN mime IN ('text/html', 'text/xml', 'application/xml', 'application/xhtml+xml') THEN 'markup'
  WHEN split_part(mime, '/', 1) = 'text' THEN 'text'
  WHEN mime = 'application/json' THEN 'json'
  ELSE 'none' END"""


@query("file_class", "P6/P7", with_fixtures(["meta"], f"""
SELECT id, split_part(mime, '/', 1) AS major, {FILE_CLASS_SQL} AS file_class FROM meta"""))
def file_class(spark, sf_dir):
    m = Fixtures(spark, sf_dir).meta
    return m.select("id", D.major_mime("mime").alias("major"), D.file_class().alias("file_class"))


@query("json_get", "P8", with_fixtures(["corpus"], "SELECT id, name, path, title, length(content) AS n FROM corpus"))
def json_get(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    rec = D.json_record(c, ["name", "path", "content", "title"])
    return rec.select("id", D.json_get("json_data", "name").alias("name"), D.json_get("json_data", "path").alias("path"),
                      D.json_get("json_data", "title").alias("title"),
                      F.length(D.json_get("json_data", "content")).cast("long").alias("n"))


@query("hit_source", "P9", with_fixtures(["corpus", "mime", "emb"], f"""
SELECT i.id, '{{"name":' || to_json(i.name) || ',"path":' || to_json(i.path)
       || ',"_id":"' || printf('%08x.%08x', i.index_id, i.id) || '","index":' || i.index_id
       || ',"thumbnail":' || i.thumbnail_count || CASE WHEN i.mime IS NULL THEN '' ELSE ',"mime":' || to_json(i.mime) END
       || ',"size":' || i.size || ',"embedding":' || CASE WHEN e.id IS NULL THEN 0 ELSE 1 END || '}}' AS source
FROM idx i LEFT JOIN (SELECT DISTINCT id FROM emb) e ON i.id = e.id""", IDX_CTE))
def hit_source(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return D.hit_source(doc_index(fx), fx.emb, ["name", "path"])


@query("get_documents", "P10", """
WITH toxic AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)
SELECT doc_id AS id, lang, n_chars FROM documents WHERE doc_id IN (SELECT id FROM toxic)""")
def get_documents(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    ids = fx.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    docs = fx.documents.select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return D.get_documents(docs, ids)


def _files(c):
    return c.select("id", full_rel_path("path", "name", "extension").alias("rel_path"))


@query("limit_depth", "S2", with_fixtures(["corpus"], f"""
SELECT id, rel_path FROM (SELECT id, {REL_SQL} AS rel_path FROM corpus)
WHERE length(rel_path) - length(replace(rel_path, '/', '')) <= 1"""))
def limit_depth(spark, sf_dir):
    return FS.limit_depth(_files(Fixtures(spark, sf_dir).corpus), 1)


EXCLUDE = "y[0-3]$|doc1[0-9]\\.txt"


@query("exclude_paths", "S3", with_fixtures(["corpus"], f"""
SELECT id, rel_path FROM (SELECT id, {REL_SQL} AS rel_path FROM corpus)
WHERE NOT regexp_matches(rel_path, '{EXCLUDE}')
  AND NOT coalesce(list_bool_or(list_transform({Q.ancestors('rel_path')}[1:-2],
                                                lambda a: regexp_matches(a, '{EXCLUDE}'))), false)"""))
def exclude_paths(spark, sf_dir):
    return FS.exclude_paths(_files(Fixtures(spark, sf_dir).corpus), EXCLUDE)


@query("split_file_path", "S5", with_fixtures(["corpus"], """
SELECT id, path, name, extension FROM corpus"""))
def split_file_path(spark, sf_dir):
    return FS.split_paths(_files(Fixtures(spark, sf_dir).corpus)).select("id", "path", "name", "extension")


@query("content_checksum", "S6", "SELECT doc_id AS id, sha1(text) AS checksum FROM documents")
def content_checksum(spark, sf_dir):
    d = Fixtures(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return FS.content_checksum(d).select("id", "checksum")


@query("truncate_content", "S7", """
SELECT doc_id AS id, length(substring(text, 1, 32768)) AS n_chars, md5(substring(text, 1, 32768)) AS digest
FROM documents""")
def truncate_content(spark, sf_dir):
    d = Fixtures(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    t = FS.truncate_content(d)
    return t.select("id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query("argmax_label", "T17", with_fixtures(["emb"], """
SELECT id, model_id, start, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS label FROM emb"""))
def argmax_label(spark, sf_dir):
    e = Fixtures(spark, sf_dir).emb
    return e.select("id", "model_id", "start",
                    (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("label"))
