"""Registered search queries: filters, sorts, keyset pages, totals (O*, F*, A9, W1, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import search as S
from docsift.plans.common import IDX_CTE, doc_index
from docsift.plans.registry import query
from docsift.sources.fixtures import Fixtures, with_fixtures

# The flagship filter-only request: F1 + F4 + F5, size descending, 60 rows.
SLICE = S.SearchRequest(path="src1", size_min=1_000_000, size_max=200_000_000,
                        mime_types=["text/plain", "text/html", "application/pdf", "image/png"],
                        sort="size", sort_asc=False, page_size=60)
SLICE_WHERE = ("(path = 'src1' OR starts_with(path, 'src1/')) AND size BETWEEN 1000000 AND 200000000 "
               "AND mime IN ('text/plain', 'text/html', 'application/pdf', 'image/png')")
PAGE_COLS = "id, index_id, name, path, size, mtime, mime"


@query("search_filtered_page", "O6/O1/F1/F4/F5/F11", with_fixtures(["corpus", "mime"], f"""
SELECT {PAGE_COLS}, size AS sort_var FROM idx WHERE {SLICE_WHERE}
ORDER BY size DESC, id ASC LIMIT 60""", IDX_CTE))
def search_filtered_page(spark, sf_dir):
    return S.search_page(doc_index(Fixtures(spark, sf_dir)), SLICE)


@query("hit_totals", "A9", with_fixtures(["corpus", "mime"], f"""
SELECT count(*) AS total_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size
FROM idx WHERE {SLICE_WHERE}""", IDX_CTE))
def hit_totals(spark, sf_dir):
    return S.hit_totals(doc_index(Fixtures(spark, sf_dir)), SLICE)


DATE_REQ = S.SearchRequest(date_min=1710000000, date_max=1740000000, index_ids=[1, 3], sort="mtime",
                           sort_asc=True, page_size=100)


@query("search_by_date_page", "O1/F2/F3", with_fixtures(["corpus", "mime"], f"""
SELECT {PAGE_COLS}, mtime AS sort_var FROM idx
WHERE mtime BETWEEN 1710000000 AND 1740000000 AND index_id IN (1, 3)
ORDER BY mtime ASC, id ASC LIMIT 100""", IDX_CTE))
def search_by_date_page(spark, sf_dir):
    return S.search_page(doc_index(Fixtures(spark, sf_dir)), DATE_REQ)


NAME_REQ = S.SearchRequest(size_max=50_000_000, sort="name", sort_asc=False, page_size=1000,
                           after=("doc5", 0))


@query("search_name_after_page", "O5/O1", with_fixtures(["corpus", "mime"], f"""
SELECT {PAGE_COLS}, name AS sort_var FROM idx
WHERE size <= 50000000 AND (name < 'doc5' OR (name = 'doc5' AND id > 0))
ORDER BY name DESC, id ASC LIMIT 1000""", IDX_CTE))
def search_name_after_page(spark, sf_dir):
    return S.search_page(doc_index(Fixtures(spark, sf_dir)), NAME_REQ)


SIZE_AFTER_REQ = S.SearchRequest(sort="size", sort_asc=True, page_size=200, after=(2_000_000, 400))


@query("search_size_after_page", "O5", with_fixtures(["corpus", "mime"], f"""
SELECT {PAGE_COLS}, size AS sort_var FROM idx
WHERE size > 2000000 OR (size = 2000000 AND id > 400)
ORDER BY size ASC, id ASC LIMIT 200""", IDX_CTE))
def search_size_after_page(spark, sf_dir):
    return S.search_page(doc_index(Fixtures(spark, sf_dir)), SIZE_AFTER_REQ)


RANDOM_REQ = S.SearchRequest(sort="random", seed=42, sort_asc=True, page_size=60, mime_types=["text/plain"])


@query("search_random_page", "O3", with_fixtures(["corpus", "mime"], f"""
SELECT {PAGE_COLS}, md5(concat('42', ':', CAST(id AS VARCHAR))) AS sort_var FROM idx
WHERE mime IN ('text/plain')
ORDER BY sort_var ASC, id ASC LIMIT 60""", IDX_CTE))
def search_random_page(spark, sf_dir):
    return S.search_page(doc_index(Fixtures(spark, sf_dir)), RANDOM_REQ)


@query("search_path_ci", "F6/F10", with_fixtures(["corpus"], """
SELECT id, path FROM corpus
WHERE (lower(path) = 'src1' OR starts_with(lower(path), 'src1/')) AND starts_with(path, 'src1/de') = false"""))
def search_path_ci(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    return c.where(S.conjunction([S.path_under_ci("SRC1/"), ~S.path_prefix("src1/de")])).select("id", "path")


@query("search_path_prefix", "F10", with_fixtures(["corpus"], """
SELECT id, path FROM corpus WHERE starts_with(path, 'src1')"""))
def search_path_prefix(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    return c.where(S.path_prefix("src1")).select("id", "path")


@query("hide_duplicates", "W1", with_fixtures(["corpus"], """
SELECT id, checksum, size FROM (
  SELECT id, checksum, size,
         row_number() OVER (PARTITION BY checksum ORDER BY size DESC, id ASC) AS rn
  FROM corpus)
WHERE checksum IS NULL OR rn = 1"""))
def hide_duplicates(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus.select("id", "checksum", "size")
    return S.hide_duplicates(c, [("size", False)])


@query("unseen_hits", "U4", with_fixtures(["corpus", "mime"], f"""
SELECT p.id, p.size FROM (SELECT id, size FROM idx ORDER BY size DESC, id ASC LIMIT 120) p
WHERE p.id NOT IN (SELECT id FROM idx ORDER BY size DESC, id ASC LIMIT 60)""", IDX_CTE))
def unseen_hits(spark, sf_dir):
    d = doc_index(Fixtures(spark, sf_dir))
    page2 = S.search_page(d, S.SearchRequest(sort="size", sort_asc=False, page_size=120), columns=["id", "size"])
    page1 = S.search_page(d, S.SearchRequest(sort="size", sort_asc=False, page_size=60), columns=["id"])
    return S.unseen_hits(page2, page1).select("id", "size")


TAG_REQ = S.SearchRequest(tags=["lang.en", "quality"], path="src0", sort="mtime", sort_asc=False, page_size=100)


@query("search_tagged_page", "O6/F7/F5", with_fixtures(["corpus", "mime", "tags"], f"""
SELECT {PAGE_COLS}, mtime AS sort_var FROM idx i
WHERE (path = 'src0' OR starts_with(path, 'src0/'))
  AND EXISTS (SELECT 1 FROM tags t WHERE t.id = i.id
              AND (starts_with(t.tag, 'lang.en.') OR starts_with(t.tag, 'quality.')))
ORDER BY mtime DESC, id ASC LIMIT 100""", IDX_CTE))
def search_tagged_page(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return S.search_page(doc_index(fx), TAG_REQ, tags=fx.tags)


@query("search_tagged_totals", "A9/F7", with_fixtures(["corpus", "mime", "tags"], """
SELECT count(*) AS total_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM idx i
WHERE (path = 'src0' OR starts_with(path, 'src0/'))
  AND EXISTS (SELECT 1 FROM tags t WHERE t.id = i.id
              AND (starts_with(t.tag, 'lang.en.') OR starts_with(t.tag, 'quality.')))""", IDX_CTE))
def search_tagged_totals(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return S.hit_totals(doc_index(fx), TAG_REQ, tags=fx.tags)


@query("search_by_embedding_page", "O6/O4/V2/J5", with_fixtures(["corpus", "mime", "emb"], f"""
SELECT i.id, i.index_id, i.name, i.path, i.size, i.mtime, i.mime, round(CASE WHEN e.embedding IS NULL THEN -1.0
       ELSE coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), -1.0) END, 6)
       AS sort_var
FROM idx i LEFT JOIN (SELECT * FROM emb WHERE model_id = 1 AND start = 0) e ON i.id = e.id,
     (SELECT embedding AS v FROM emb WHERE id = 7 AND model_id = 1 AND start = 0) q
WHERE i.mime IN ('text/plain', 'text/html', 'application/pdf')
ORDER BY CASE WHEN e.embedding IS NULL THEN -1.0
       ELSE coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), -1.0) END DESC, i.id ASC LIMIT 30""", IDX_CTE))
def search_by_embedding_page(spark, sf_dir):
    from docsift.operators.vectors import vector_of

    fx = Fixtures(spark, sf_dir)
    req = S.SearchRequest(mime_types=["text/plain", "text/html", "application/pdf"], sort="embedding",
                          sort_asc=False, page_size=30, model=1)
    req.embedding = vector_of(fx.emb, 7)
    return S.search_page(doc_index(fx), req, emb=fx.emb).withColumn("sort_var", F.round("sort_var", 6))
