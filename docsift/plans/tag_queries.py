"""Registered tag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import search as S
from docsift.operators import tags as G
from docsift.plans import sqlfrag as Q
from docsift.plans.registry import query
from docsift.sources.fixtures import Fixtures, with_fixtures

COLOURED = r"regexp_matches(tag, '\.#[0-9a-fA-F]{6}')"
TAG_ID = f"CASE WHEN {COLOURED} THEN regexp_replace(tag, '\\.[^.]*$', '') ELSE tag END"
COLOUR = f"CASE WHEN {COLOURED} THEN string_split(tag, '.')[-1] END"

# Index-side tag set for the sync queries, as an earlier run wrote it: language
# tags only for documents of the old snapshot, and quality tags from the
# older toxicity rule.
TARGET_CTE = """target AS (
  SELECT t.id, t.index_id, t.tag FROM tags t WHERE starts_with(t.tag, 'lang.') AND t.id IN (SELECT id FROM old)
  UNION ALL SELECT l.doc_id AS id, CAST(1 + l.doc_id % 3 AS INT) AS index_id,
                   CASE WHEN l.toxic = 0 THEN 'quality.high.#00ff00' ELSE 'quality.low.#ff0000' END AS tag
  FROM labels l)"""


def _target(fx):
    lang = (fx.tags.where(F.col("tag").startswith("lang.")).join(fx.old.select("id"), "id", "left_semi")
            .select("id", "index_id", "tag"))
    quality = fx.labels.select(F.col("doc_id").alias("id"), (1 + F.col("doc_id") % 3).cast("int").alias("index_id"),
                               F.when(F.col("toxic") == 0, F.lit("quality.high.#00ff00"))
                               .otherwise(F.lit("quality.low.#ff0000")).alias("tag"))
    return lang.unionByName(quality)


@query("tags_any_filter", "F7/J6", with_fixtures(["corpus", "tags"], """
SELECT id FROM corpus c WHERE EXISTS (
  SELECT 1 FROM tags t WHERE t.id = c.id AND (starts_with(t.tag, 'lang.en.') OR starts_with(t.tag, 'quality.')))"""))
def tags_any_filter(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return S.tags_any(fx.corpus.select("id"), fx.tags, ["lang.en", "quality"])


@query("tags_all_filter", "F8", with_fixtures(["corpus", "tags"], """
SELECT id FROM corpus c
WHERE EXISTS (SELECT 1 FROM tags t WHERE t.id = c.id AND (lower(t.tag) = 'lang' OR starts_with(lower(t.tag), 'lang.')))
  AND EXISTS (SELECT 1 FROM tags t WHERE t.id = c.id
              AND (lower(t.tag) = 'quality.high' OR starts_with(lower(t.tag), 'quality.high.')))"""))
def tags_all_filter(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return G.tags_all(fx.corpus.select("id"), fx.tags, ["LANG", "quality.high"])


@query("tags_any_or_self", "F8", with_fixtures(["corpus", "tags"], """
SELECT id FROM corpus c WHERE EXISTS (
  SELECT 1 FROM tags t WHERE t.id = c.id AND (lower(t.tag) IN ('quality.low', 'lang.de')
    OR starts_with(lower(t.tag), 'quality.low.') OR starts_with(lower(t.tag), 'lang.de.')))"""))
def tags_any_or_self(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return G.tags_all(fx.corpus.select("id"), fx.tags, ["quality.low", "lang.de"], require_all=False)


@query("tag_counts", "A15", with_fixtures(["tags"], "SELECT tag, count(*) AS count FROM tags GROUP BY tag"))
def tag_counts(spark, sf_dir):
    return G.tag_counts(Fixtures(spark, sf_dir).tags)


@query("tag_facet_hierarchy", "A16", with_fixtures(["tags"], f"""
SELECT tag, count(DISTINCT id) AS count FROM (SELECT id, unnest({Q.ancestors('tag', '.')}) AS tag FROM tags)
GROUP BY tag"""))
def tag_facet_hierarchy(spark, sf_dir):
    return G.tag_facet_hierarchy(Fixtures(spark, sf_dir).tags)


@query("tag_tree", "A17", with_fixtures(["tags"], f"""
SELECT node, parent, depth, max(colour) AS colour FROM (
  SELECT n.node, CASE WHEN n.pos = 0 THEN NULL ELSE regexp_replace(n.node, '\\.[^.]*$', '') END AS parent,
         CAST(n.pos + 1 AS INT) AS depth,
         CASE WHEN n.node = k.tag_id THEN (SELECT {COLOUR} FROM (SELECT k.tag AS tag)) END AS colour
  FROM (SELECT tag_id, min(tag) AS tag FROM (SELECT DISTINCT tag, {TAG_ID} AS tag_id FROM tags) GROUP BY tag_id) k,
       LATERAL (SELECT i - 1 AS pos, array_to_string(list_slice(string_split(k.tag_id, '.'), 1, i), '.') AS node
                FROM range(1, len(string_split(k.tag_id, '.')) + 1) r(i)) n)
GROUP BY node, parent, depth"""))
def tag_tree(spark, sf_dir):
    return G.tag_tree(Fixtures(spark, sf_dir).tags)


@query("tags_as_array", "A18", with_fixtures(["tags"], """
SELECT id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tags GROUP BY id"""))
def tags_as_array(spark, sf_dir):
    return G.tags_as_array(Fixtures(spark, sf_dir).tags).select("id", F.array_join("tags", ",").alias("tags"))


@query("distinct_tags", "U2", with_fixtures(["tags"], "SELECT DISTINCT tag FROM tags"))
def distinct_tags(spark, sf_dir):
    return G.distinct_tags(Fixtures(spark, sf_dir).tags)


@query("tag_sync_diff", "U3", with_fixtures(["corpus", "tags", "old"], """
SELECT id, tag, 'insert' AS op FROM (SELECT id, tag FROM tags EXCEPT SELECT id, tag FROM target)
UNION ALL
SELECT id, tag, 'delete' AS op FROM (SELECT id, tag FROM target EXCEPT SELECT id, tag FROM tags)""", TARGET_CTE))
def tag_sync_diff(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return G.tag_sync_diff(fx.tags, _target(fx))


@query("sync_tags", "I9", with_fixtures(["corpus", "tags", "old"], """
SELECT DISTINCT id, tag FROM tags WHERE index_id = 1""", TARGET_CTE))
def sync_tags(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    src = fx.tags.where(F.col("index_id") == 1)
    tgt = _target(fx).where(F.col("index_id") == 1)
    return G.apply_diff(tgt, G.tag_sync_diff(src, tgt))


EDITS_CTE = """last AS (SELECT id, tag, arg_max(op, seq) AS op FROM tag_edits GROUP BY id, tag),
edited AS (
  SELECT DISTINCT t.id, t.tag FROM tags t WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.id = t.id AND l.tag = t.tag)
  UNION ALL SELECT id, tag FROM last WHERE op = 'add')"""


@query("apply_tag_edits", "I7", with_fixtures(["tags", "tag_edits"], "SELECT id, tag FROM edited", EDITS_CTE))
def apply_tag_edits(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return G.apply_tag_edits(fx.tags, fx.tag_edits)


@query("refresh_tag_arrays", "I8", with_fixtures(["tags", "tag_edits"], """
SELECT id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tags
WHERE id NOT IN (SELECT id FROM tag_edits) GROUP BY id
UNION ALL
SELECT t.id, coalesce(array_to_string(list_sort(list_distinct(list(e.tag) FILTER (WHERE e.tag IS NOT NULL))), ','), '')
       AS tags
FROM (SELECT DISTINCT id FROM tag_edits) t LEFT JOIN edited e ON e.id = t.id GROUP BY t.id""", EDITS_CTE))
def refresh_tag_arrays(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    arrays = G.tags_as_array(fx.tags)
    new = G.apply_tag_edits(fx.tags, fx.tag_edits)
    out = G.refresh_tag_arrays(arrays, new, fx.tag_edits)
    return out.select("id", F.array_join("tags", ",").alias("tags"))


@query("suggest_tags", "O8", with_fixtures(["tags"], """
SELECT DISTINCT tag FROM tags WHERE starts_with(tag, 'lang.') ORDER BY tag LIMIT 100"""))
def suggest_tags(spark, sf_dir):
    return G.suggest_tags(Fixtures(spark, sf_dir).tags, "lang.", 100)


@query("suggest_tags_stored", "O8", with_fixtures(["tags"], """
SELECT tag AS value, count(*) AS weight FROM tags WHERE starts_with(tag, 'lang.') GROUP BY tag"""))
def suggest_tags_stored(spark, sf_dir):
    from docsift.operators.completion import write_completions
    from docsift.session import scratch_dir

    return write_completions(Fixtures(spark, sf_dir).tags, scratch_dir(spark, "completions"), "tag", contains=False).suggest("lang.")


@query("suggest_tags_no_colour", "O9", with_fixtures(["tags"], f"""
SELECT tag_id, min(tag) AS tag FROM (SELECT DISTINCT tag, {TAG_ID} AS tag_id FROM tags WHERE starts_with(tag, 'q'))
GROUP BY tag_id ORDER BY tag_id LIMIT 100"""))
def suggest_tags_no_colour(spark, sf_dir):
    return G.suggest_tags_no_colour(Fixtures(spark, sf_dir).tags, "q", 100)


@query("parse_tags", "P14/P15", with_fixtures(["tags"], f"""
SELECT tag, {TAG_ID} AS tag_id, {COLOUR} AS colour, {COLOURED} AS is_leaf,
       CAST(round(0.2126 * r + 0.7152 * g + 0.0722 * b, 4) AS DOUBLE) AS luminance,
       CASE WHEN {COLOURED} THEN CASE WHEN 0.2126 * r + 0.7152 * g + 0.0722 * b > 50 THEN '#000' ELSE '#fff' END END
       AS fg
FROM (SELECT tag,
        CAST(('0x' || substring({COLOUR}, 2, 2)) AS INT) AS r,
        CAST(('0x' || substring({COLOUR}, 4, 2)) AS INT) AS g,
        CAST(('0x' || substring({COLOUR}, 6, 2)) AS INT) AS b
      FROM (SELECT DISTINCT tag FROM tags))"""))
def parse_tags(spark, sf_dir):
    return G.parse_tags(Fixtures(spark, sf_dir).tags)
