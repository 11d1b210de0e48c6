"""Registered queries that ask every part of a search request through the one
call ``search()``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import fulltext as T
from docsift.operators import search as S
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index, text_index
from docsift.plans.registry import query
from docsift.plans.text_queries import _fuzzy_sql, _highlight_full_sql, _highlight_sql, _postings_cte, bm25_cte
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures, with_fixtures

COLS = "i.id, i.name, i.size"
TYPES = ["text/plain", "text/html", "application/json", "application/pdf"]
WEIGHT = "CASE " + " ".join(f"WHEN field = '{f}' THEN {w}" for f, w in T.FIELD_WEIGHTS.items()) + " ELSE 0.0 END"


def _scored(ff: str, name: str) -> str:
    """BM25 of one artificial term whose matches (id, f) are ``ff``."""
    idf = f"ln((st.n_docs - (SELECT count(*) FROM {name}_ff) + 0.5) / ((SELECT count(*) FROM {name}_ff) + 0.5))"
    return f"""{name}_ff AS ({ff}),
{name} AS (SELECT x.id, CASE WHEN {idf} <= 0 THEN {T.IDF_FLOOR} ELSE {idf} END * x.f * ({T.BM25_K1} + 1)
  / (x.f + {T.BM25_K1} * (1 - {T.BM25_B} + {T.BM25_B} * dl.dl / st.avgdl)) AS score
  FROM {name}_ff x JOIN dl ON x.id = dl.id CROSS JOIN st)"""


def _page(where: str, frm: str = "idx i JOIN sc ON i.id = sc.id", key: str = "sc.score", limit: int = 60, order: str = "DESC") -> str:
    return f"""SELECT {COLS}, round({key}, 6) AS sort_var FROM {frm} WHERE {where}
ORDER BY round({key}, 14) {order}, i.id ASC LIMIT {limit}"""


def _ask(spark, sf_dir, req, **more):
    fx = Fixtures(spark, sf_dir)
    page, _ = S.search(doc_index(fx), req, index=text_index(spark, sf_dir), tags=fx.tags, emb=fx.emb,
                       columns=["id", "name", "size"], **more)
    return page.withColumn("sort_var", F.round("sort_var", 6)) if req.sort == "score" else page


FREQUENT = S.SearchRequest(terms=["for", "with"], mime_types=TYPES, sort="score", sort_asc=False, search_in_path=True)


@query("search_frequent_page", "O6/T5/T6", with_fixtures(["corpus", "mime"], _page(f"i.mime IN {Q.in_list(TYPES)}"),
       IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(FREQUENT.terms)))
def search_frequent_page(spark, sf_dir):
    return _ask(spark, sf_dir, FREQUENT)


ANY = S.SearchRequest(any_terms=["estion", "for", "whon"], sort="score", sort_asc=False, search_in_path=True)


@query("search_any_terms_page", "O6/T7", with_fixtures(["corpus", "mime"], _page("true"),
       IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(ANY.any_terms, require_all=False)))
def search_any_terms_page(spark, sf_dir):
    return _ask(spark, sf_dir, ANY)


NONE = S.SearchRequest(terms=["the"], none_terms=["for", "with"], sort="score", sort_asc=False, search_in_path=True)


@query("search_none_terms_page", "O6/T7", with_fixtures(["corpus", "mime"], _page(
       "i.id NOT IN (SELECT id FROM post WHERE token IN ('for', 'with'))"),
       IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(NONE.terms)))
def search_none_terms_page(spark, sf_dir):
    return _ask(spark, sf_dir, NONE)


PREFIX = S.SearchRequest(prefix="Tio", sort="score", sort_asc=False, search_in_path=True)


@query("search_prefix_page", "O6/T9", with_fixtures(["corpus", "mime"], _page("true"), IDX_CTE + ",\n" + _postings_cte() + ",\n"
       + _scored(f"SELECT id, sum(tf * {WEIGHT}) AS f FROM post WHERE starts_with(token, 'tio') GROUP BY id", "sc")))
def search_prefix_page(spark, sf_dir):
    return _ask(spark, sf_dir, PREFIX)


RANKED_PHRASE = S.SearchRequest(phrase=["of", "the"], sort="score", sort_asc=False)


@query("search_ranked_phrase_page", "O6/T8", with_fixtures(["corpus", "mime"], _page("true"), IDX_CTE + ",\n" + _postings_cte() + ",\n"
       + _scored("SELECT id, f FROM (SELECT id, " + " + ".join(
           f"{T.FIELD_WEIGHTS[x]} * len(list_filter(range(1, len({x}_t)), lambda i: {x}_t[i] = 'of' AND {x}_t[i + 1] = 'the'))" for x in S.TEXT_FIELDS_NO_PATH)
           + " AS f FROM (SELECT id, " + ", ".join(f"{Q.tokens(x)} AS {x}_t" for x in S.TEXT_FIELDS_NO_PATH) + " FROM corpus)) WHERE f > 0", "sc")))
def search_ranked_phrase_page(spark, sf_dir):
    return _ask(spark, sf_dir, RANKED_PHRASE)


FUZZY = S.SearchRequest(fuzzy="Estión", sort="score", sort_asc=False)


@query("search_fuzzy_page", "O6/T11/T2", with_fixtures(["corpus", "mime"], _page("true"), IDX_CTE + ",\nsc AS (" + _fuzzy_sql() + ")"))
def search_fuzzy_page(spark, sf_dir):
    path = scratch_dir(spark, "trigrams")
    T.write_trigram_index(Fixtures(spark, sf_dir).corpus, path, ["content", "name"])
    return _ask(spark, sf_dir, FUZZY, grams=spark.read.parquet(path))


ALL_TAGS = S.SearchRequest(tags_all=["lang", "quality"], sort="size", page_size=100)


@query("search_all_tags_page", "O6/F8", with_fixtures(["corpus", "mime", "tags"], f"""
SELECT {COLS}, i.size AS sort_var FROM idx i WHERE (
  SELECT count(DISTINCT split_part(lower(t.tag), '.', 1)) FROM tags t
  WHERE t.id = i.id AND split_part(lower(t.tag), '.', 1) IN ('lang', 'quality')) = 2
ORDER BY i.size, i.id LIMIT 100""", IDX_CTE))
def search_all_tags_page(spark, sf_dir):
    return _ask(spark, sf_dir, ALL_TAGS)


HAS_VECTOR = S.SearchRequest(has_model=2, size_min=100_000, sort="size", sort_asc=False, page_size=100)


@query("search_has_vector_page", "O6/F9", with_fixtures(["corpus", "mime", "emb"], f"""
SELECT {COLS}, i.size AS sort_var FROM idx i
WHERE i.size >= 100000 AND EXISTS (SELECT 1 FROM emb e WHERE e.id = i.id AND e.model_id = 2)
ORDER BY i.size DESC, i.id LIMIT 100""", IDX_CTE))
def search_has_vector_page(spark, sf_dir):
    return _ask(spark, sf_dir, HAS_VECTOR)


MARKED = S.SearchRequest(terms=["estion", "ated"], mime_types=TYPES, sort="score", sort_asc=False, search_in_path=True, highlight=True)


@query("search_marked_page", "O6/T13/T14", with_fixtures(["corpus", "mime"], """
SELECT pg.id, pg.name, pg.size, pg.sort_var, hl.snippet, nm.marked AS name_marked
FROM pg LEFT JOIN hl ON pg.id = hl.id LEFT JOIN nm ON pg.id = nm.id""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(MARKED.terms) + ",\npg AS (" + _page(f"i.mime IN {Q.in_list(TYPES)}") + """),
m AS (SELECT id FROM pg),
hl AS (""" + _highlight_sql() + "),\nnm AS (" + _highlight_full_sql().replace("c.content", "c.name") + ")"))
def search_marked_page(spark, sf_dir):
    return _ask(spark, sf_dir, MARKED)


@query("match_fuzzy_stored", "T11/T2", with_fixtures(["corpus"], _fuzzy_sql()))
def match_fuzzy_stored(spark, sf_dir):
    """On the stored 3-grams of all content, without a look at any text."""
    path = scratch_dir(spark, "trigrams")
    T.write_trigram_index(Fixtures(spark, sf_dir).corpus, path)
    return T.match_fuzzy_index(spark.read.parquet(path), "Estión").select("id", F.round("score", 6).alias("score"))


@query("match_phrase_stored", "T8/T4", with_fixtures(["corpus"], f"""
SELECT id FROM corpus WHERE contains(' ' || array_to_string({Q.tokens('content')}, ' ') || ' ', ' of the ')"""))
def match_phrase_stored(spark, sf_dir):
    """On positional postings: no text is read."""
    c = Fixtures(spark, sf_dir).corpus
    ix = T.build_text_index(c, scratch_dir(spark, "positional"), fields=("content",), positions=True)
    return T.match_phrase(c, ix.postings, ["of", "the"])
