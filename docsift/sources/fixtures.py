"""Derived input tables, built from the driver tables.

Each fixture is one SQL text that runs unchanged in Spark SQL and DuckDB.
Placeholders in braces name driver tables or other fixtures.  On the Spark
side the placeholders are bound to DataFrames through ``spark.sql(text,
**frames)``; for the DuckDB oracle they become plain view / CTE names, so both
engines read exactly the same definition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docsift.sources.tables import TABLES, read_table

FIXTURE_SQL: dict[str, str] = {
    # document table: 4 directory depths, 3 indices, parent chains, checksums
    "corpus": """
SELECT doc_id AS id,
      CAST(1 + doc_id % 3 AS INT) AS index_id,
      CASE WHEN doc_id % 20 = 7 THEN doc_id - 1 WHEN doc_id % 20 = 8 THEN doc_id - 1 END AS parent,
      concat('doc', CAST(doc_id AS STRING), CASE WHEN doc_id % 9 = 0 THEN concat(' (20', lpad(CAST(doc_id % 25 AS STRING), 2, '0'), ')') ELSE '' END) AS name,
      CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'json' WHEN 3 THEN 'pdf' WHEN 4 THEN 'PNG' ELSE '' END AS extension,
      CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 4 = 0 THEN concat(source, '/', lang, '/y', CAST(doc_id % 7 AS STRING)) WHEN doc_id % 4 = 1 THEN source ELSE concat(source, '/', lang) END AS path,
      n_chars * 4096 AS size,
      1704067200 + (doc_id * 7919 % 900) * 86400 AS mtime,
      CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS thumbnail_count,
      CASE WHEN doc_id % 13 = 0 THEN NULL ELSE sha1(text) END AS checksum,
      substring(text, 1, 60) AS title,
      text AS content
FROM {documents}""",
    # extension -> media type dimension (fixed, five rows)
    "mime": """
SELECT *
FROM (VALUES (1,'txt','text/plain'),(2,'html','text/html'),(3,'json','application/json'),(4,'pdf','application/pdf'),(5,'png','image/png')) AS m(mime_id, extension, mime)""",
    # dotted tags with a colour leaf
    "tags": """
SELECT id,
      index_id,
      concat('lang.', lang, '.#', color) AS tag
FROM (SELECT doc_id AS id, CAST(1 + doc_id % 3 AS INT) AS index_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'ff8800' ELSE '2196f3' END AS color FROM {documents} WHERE doc_id % 3 <> 2)
UNION ALL SELECT l.doc_id AS id,
      CAST(1 + l.doc_id % 3 AS INT) AS index_id,
      CASE WHEN l.quality = 1 THEN 'quality.high.#00ff00' ELSE 'quality.low.#ff0000' END AS tag
FROM {labels} l""",
    # vectors: model 1 one start-0 vector, model 2 three chunks
    "emb": """
SELECT CAST(floor(vec_id / 4) AS BIGINT) AS id,
      CAST(CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END AS INT) AS model_id,
      CAST(CASE CAST(vec_id % 4 AS INT) WHEN 2 THEN 100 WHEN 3 THEN 200 ELSE 0 END AS INT) AS start,
      embedding
FROM {embeddings}""",
    # vector models (fixed, two rows)
    "model": """
SELECT *
FROM (VALUES (1,'alpha','idx_64.alpha',64,'flat'),(2,'beta','64.beta',64,'nested')) AS m(id, name, path, size, type)""",
    # five-level tree region/nation/segment/customer/order
    "tree": """
SELECT o.o_orderkey AS id,
      concat(r.r_name, '/', n.n_name, '/', c.c_mktsegment, '/', c.c_name, '/o', CAST(o.o_orderkey AS STRING)) AS path,
      CAST(floor(o.o_totalprice) AS BIGINT) AS size
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    # host/path hierarchies and raw HTML
    "urls": """
SELECT page_id AS id,
      split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path,
      html
FROM {pages}""",
    # file metadata for rules and derived flags
    "meta": """
SELECT p_partkey AS id,
      concat(p_name, ' - ', p_brand) AS name,
      concat('ABCD-', lpad(CAST(p_size AS STRING), 3, '0'), ' ', replace(p_name, ' ', ',')) AS code_name,
      CASE WHEN p_partkey % 2 = 0 THEN 'pdf' ELSE 'mkv' END AS extension,
      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS genre,
      p_brand AS artist,
      concat(CAST(p_size AS STRING), ' 10') AS exif_fnumber,
      concat('20', lpad(CAST(p_partkey % 25 AS STRING), 2, '0'), ':', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), ':', lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), ' 10:00:00') AS exif_datetime,
      concat(CAST(p_partkey % 90 AS STRING), ':1, ', CAST(p_partkey % 60 AS STRING), ':1, ', CAST(p_partkey % 6000 AS STRING), ':100') AS gps_latitude_dms,
      CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'S' END AS gps_latitude_ref,
      p_size * 64 AS width,
      480 AS height,
      CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'image/png' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'audio/mpeg' ELSE 'text/plain' END AS mime,
      CASE WHEN p_partkey % 3 = 0 THEN 'hevc' ELSE 'h264' END AS videoc,
      CAST(floor(p_retailprice * 100) AS BIGINT) AS size
FROM {part}""",
    # job runs
    "runs": """
SELECT event_id AS id,
      event_type AS job,
      ts AS started
FROM {events}""",
    # ordered add/delete tag edits; later seq wins per (id, tag)
    "tag_edits": """
SELECT event_id AS seq,
      user_id AS id,
      concat('k', CAST(event_id % 5 AS STRING), '.#2196f3') AS tag,
      CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op
FROM {events}""",
    # previous snapshot
    "old": """
SELECT id,
      path,
      name,
      mtime,
      size
FROM {corpus}
WHERE id % 10 <> 3""",
    # next snapshot: 10 % deleted, 10 % new, 10 % modified
    "new": """
SELECT id,
      path,
      name,
      CASE WHEN id % 10 = 5 THEN mtime + 60 ELSE mtime END AS mtime,
      CASE WHEN id % 10 = 5 THEN size + 1 ELSE size END AS size
FROM {corpus}
WHERE id % 10 <> 4""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def dependencies(name: str) -> list[str]:
    """Fixtures (not driver tables) that ``name`` reads, in definition order."""
    out: list[str] = []
    for dep in _PLACEHOLDER.findall(FIXTURE_SQL[name]):
        if dep in FIXTURE_SQL and dep not in out:
            for d in dependencies(dep):
                if d not in out:
                    out.append(d)
            out.append(dep)
    return out


def fixture(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """Build fixture ``name`` on Spark from its shared SQL text."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    frames = {}
    for dep in set(_PLACEHOLDER.findall(FIXTURE_SQL[name])):
        if dep in TABLES:
            frames[dep] = read_table(spark, sf_dir, dep)
        else:
            frames[dep] = fixture(spark, sf_dir, dep, cache)
    df = spark.sql(FIXTURE_SQL[name], **frames) if frames else spark.sql(FIXTURE_SQL[name])
    cache[name] = df
    return df


class Fixtures:
    """Lazily built fixtures of one scale-factor folder (shared within a query)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return fixture(self.spark, self.sf_dir, name, self._cache)
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def oracle_ctes(names: list[str] | tuple[str, ...]) -> str:
    """``WITH`` clause body (without the keyword) defining fixtures for DuckDB."""
    order: list[str] = []
    for n in names:
        for d in dependencies(n) + [n]:
            if d not in order:
                order.append(d)
    parts = []
    for n in order:
        body = _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[n]).strip()
        parts.append(f"{n} AS ({body})")
    return ",\n".join(parts)


def with_fixtures(names, body: str, extra: str | None = None) -> str:
    """Oracle SQL: fixtures (and optional extra CTEs) followed by ``body``."""
    ctes = oracle_ctes(list(names))
    if extra:
        ctes = f"{ctes},\n{extra}" if ctes else extra
    return f"WITH {ctes}\n{body}" if ctes else body
