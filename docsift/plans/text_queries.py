"""Registered full-text queries (T1-T14, O2, flagship BM25 page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions.paths import path_ancestors
from docsift.functions.text import WORD_TOKEN, standard_tokens
from docsift.operators import fulltext as T
from docsift.operators import search as S
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index, search_index, text_index
from docsift.plans.registry import query
from docsift.sources.fixtures import Fixtures, with_fixtures

FIELDS = list(T.FIELD_WEIGHTS)


def _postings_cte(fields=FIELDS, src="corpus") -> str:
    parts = " UNION ALL ".join(
        f"SELECT id, '{f}' AS field, unnest({Q.tokens(f)}) AS token FROM {src}" for f in fields)
    lens = " + ".join(f"coalesce(len({Q.tokens(f)}), 0)" for f in fields)
    return (f"toks AS ({parts}),\n"
            f"post AS (SELECT token, id, field, count(*) AS tf FROM toks GROUP BY token, id, field),\n"
            f"dl AS (SELECT id, CAST({lens} AS BIGINT) AS dl FROM {src}),\n"
            f"st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl)")


def bm25_cte(terms, weights=None, fields=None, require_all=True, name="sc") -> str:
    """Oracle BM25 over ``post``/``dl``/``st`` (see ``_postings_cte``)."""
    weights = weights or T.FIELD_WEIGHTS
    qt = sorted(set(T.fold_terms(terms)))
    wcase = "CASE " + " ".join(f"WHEN field = '{f}' THEN {w}" for f, w in weights.items()) + " ELSE 0.0 END"
    fcond = f" AND field IN {Q.in_list(fields)}" if fields is not None else ""
    idf = "ln((st.n_docs - nt.n + 0.5) / (nt.n + 0.5))"
    having = f" HAVING count(*) = {len(qt)}" if require_all else ""
    return (f"ff AS (SELECT id, token, sum(tf * {wcase}) AS f FROM post WHERE token IN {Q.in_list(qt)}{fcond} "
            f"GROUP BY id, token),\n"
            f"nt AS (SELECT token, count(*) AS n FROM ff GROUP BY token),\n"
            f"{name} AS (SELECT ff.id, sum(CASE WHEN {idf} <= 0 THEN {T.IDF_FLOOR} ELSE {idf} END * ff.f * "
            f"({T.BM25_K1} + 1) / (ff.f + {T.BM25_K1} * (1 - {T.BM25_B} + {T.BM25_B} * dl.dl / st.avgdl))) AS score "
            f"FROM ff JOIN nt ON ff.token = nt.token JOIN dl ON ff.id = dl.id CROSS JOIN st "
            f"GROUP BY ff.id{having})")


def _text_index(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    ix = text_index(spark, sf_dir)
    return fx, fx.corpus, ix.postings, ix


QUERY_TERMS = ["estion", "ated"]
FLAG_REQ = S.SearchRequest(terms=QUERY_TERMS, mime_types=["text/plain", "text/html", "application/json",
                                                           "application/pdf"],
                           sort="score", sort_asc=False, page_size=60, search_in_path=True,
                           fetch_aggregations=True)


@query("search_text_bm25_page", "O6/O2/T5/T6/J4", with_fixtures(["corpus", "mime"], f"""
SELECT i.id, i.index_id, i.name, i.path, i.size, i.mtime, i.mime, round(sc.score, 6) AS sort_var
FROM idx i JOIN sc ON i.id = sc.id
WHERE i.mime IN ('text/plain', 'text/html', 'application/json', 'application/pdf')
ORDER BY round(sc.score, 14) DESC, i.id ASC LIMIT 60""", IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(QUERY_TERMS)))
def search_text_bm25_page(spark, sf_dir):
    fx, docs, post, ix = _text_index(spark, sf_dir)
    page, _ = S.search(doc_index(fx), FLAG_REQ, index=ix)
    return page.withColumn("sort_var", F.round("sort_var", 6))


@query("search_text_totals", "A9/T6", with_fixtures(["corpus", "mime"], """
SELECT count(*) AS total_count, CAST(coalesce(sum(i.size), 0) AS BIGINT) AS total_size
FROM idx i JOIN sc ON i.id = sc.id
WHERE i.mime IN ('text/plain', 'text/html', 'application/json', 'application/pdf')""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(QUERY_TERMS)))
def search_text_totals(spark, sf_dir):
    fx, docs, post, ix = _text_index(spark, sf_dir)
    _, totals = S.search(doc_index(fx), FLAG_REQ, index=ix)
    return totals


@query("tokenize_standard", "T1", with_fixtures(["corpus"], f"""
SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct
FROM (SELECT unnest({Q.tokens('content')}) AS token FROM corpus)"""))
def tokenize_standard(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    t = c.select(F.explode(standard_tokens("content")).alias("token"))
    return t.agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("token").alias("n_distinct"))


@query("postings_stats", "T4", with_fixtures(["corpus"], """
SELECT field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS total_tf, count(DISTINCT token) AS n_tokens,
       max(tf) AS max_tf
FROM post GROUP BY field""", _postings_cte()))
def postings_stats(spark, sf_dir):
    _, _, post, _ = _text_index(spark, sf_dir)
    return post.groupBy("field").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").cast("long").alias("total_tf"),
                                     F.count_distinct("token").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query("trigram_doc_freq", "T2", with_fixtures(["corpus"], f"""
SELECT gram, field, count(*) AS df FROM (
  SELECT DISTINCT id, field, gram FROM (
    SELECT id, field, unnest(CASE WHEN length(t) < 3 THEN []::VARCHAR[]
                              ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS gram
    FROM (SELECT id, 'name' AS field, {Q.fold('name')} AS t FROM corpus
          UNION ALL SELECT id, 'title' AS field, {Q.fold('title')} AS t FROM corpus)))
GROUP BY gram, field"""))
def trigram_doc_freq(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    return T.trigram_postings(c, ["name", "title"]).groupBy("gram", "field").agg(F.count(F.lit(1)).alias("df"))


@query("path_hierarchy_tokens", "T3/P3", with_fixtures(["urls"], """
SELECT token, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
                               lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS token
  FROM urls WHERE length(path) > 0)
GROUP BY token"""))
def path_hierarchy_tokens(spark, sf_dir):
    u = Fixtures(spark, sf_dir).urls
    return (u.select(F.explode(path_ancestors("path")).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


OR_TERMS = ["estion", "ated", "whon"]


@query("bm25_any_terms", "T5/T7", with_fixtures(["corpus"], """
SELECT id, round(score, 6) AS score FROM sc""", _postings_cte() + ",\n" + bm25_cte(OR_TERMS, require_all=False)))
def bm25_any_terms(spark, sf_dir):
    _, _, post, lens = _text_index(spark, sf_dir)
    return lens.bm25(OR_TERMS, require_all=False).select("id", F.round("score", 6).alias("score"))


@query("match_all_terms", "T6", with_fixtures(["corpus"], f"""
SELECT id FROM post WHERE token IN {Q.in_list(sorted(QUERY_TERMS))} GROUP BY id
HAVING count(DISTINCT token) = 2""", _postings_cte()))
def match_all_terms(spark, sf_dir):
    _, _, post, _ = _text_index(spark, sf_dir)
    return T.match_all(post, QUERY_TERMS)


@query("match_not_terms", "T7", with_fixtures(["corpus"], """
SELECT id FROM corpus WHERE id NOT IN (SELECT id FROM post WHERE token IN ('the', 'and'))""", _postings_cte()))
def match_not_terms(spark, sf_dir):
    _, docs, post, _ = _text_index(spark, sf_dir)
    return T.match_not(docs.select("id"), post, ["the", "and"])


PHRASE = ["of", "the"]


@query("match_phrase", "T8", with_fixtures(["corpus"], f"""
SELECT id FROM corpus
WHERE contains(' ' || array_to_string({Q.tokens('content')}, ' ') || ' ', ' of the ')"""))
def match_phrase(spark, sf_dir):
    _, docs, post, _ = _text_index(spark, sf_dir)
    return T.match_phrase(docs, post, PHRASE)


@query("match_prefix", "T9", with_fixtures(["corpus"], """
SELECT DISTINCT id FROM post WHERE starts_with(token, 'estio')""", _postings_cte()))
def match_prefix(spark, sf_dir):
    _, _, post, _ = _text_index(spark, sf_dir)
    return T.match_prefix(post, "Estio")


NOPATH = S.TEXT_FIELDS_NO_PATH


@query("match_fields_no_path", "T10", with_fixtures(["corpus"], """
SELECT id, round(score, 6) AS score FROM sc""",
    _postings_cte() + ",\n" + bm25_cte(["de", "y3"], fields=NOPATH, require_all=False)))
def match_fields_no_path(spark, sf_dir):
    _, _, post, ix = _text_index(spark, sf_dir)
    return ix.bm25(["de", "y3"], fields=S.TEXT_FIELDS_NO_PATH, require_all=False).select(
        "id", F.round("score", 6).alias("score"))


FUZZY = "Estión"


def _fuzzy_sql() -> str:
    q = T.fold_terms([FUZZY])[0]
    grams = sorted({q[i:i + 3] for i in range(len(q) - 2)})
    cn, nn = Q.fold("content"), Q.fold("name")
    every = " AND ".join(f"(contains({cn}, {Q.q(g)}) OR contains({nn}, {Q.q(g)}))" for g in grams)
    score = " + ".join(f"(CASE WHEN contains({cn}, {Q.q(g)}) THEN 1.0 ELSE 0.0 END + "
                       f"CASE WHEN contains({nn}, {Q.q(g)}) THEN 3.0 ELSE 0.0 END)" for g in grams)
    return f"SELECT id, CAST(round({score}, 6) AS DOUBLE) AS score FROM corpus WHERE {every}"


@query("match_fuzzy", "T11", with_fixtures(["corpus"], _fuzzy_sql()))
def match_fuzzy(spark, sf_dir):
    c = Fixtures(spark, sf_dir).corpus
    return T.match_fuzzy(c, FUZZY).select("id", F.round("score", 6).alias("score"))


META_FIELDS = ["name", "artist", "genre"]
META_TERMS = ["small", "economy"]


@query("match_metadata", "T12", with_fixtures(["meta"], """
SELECT id, round(score, 6) AS score FROM sc""",
    _postings_cte(META_FIELDS, "meta") + ",\n"
    + bm25_cte(META_TERMS, weights={k: T.METADATA_BOOSTS[k] for k in META_FIELDS}, require_all=False)))
def match_metadata(spark, sf_dir):
    m = Fixtures(spark, sf_dir).meta
    post = T.build_postings(m, META_FIELDS)
    lens = T.doc_lengths(m, META_FIELDS)
    w = {k: T.METADATA_BOOSTS[k] for k in META_FIELDS}
    return T.bm25(post, lens, META_TERMS, weights=w, require_all=False).select(
        "id", F.round("score", 6).alias("score"))


def _highlight_sql() -> str:
    qt = Q.str_list(T.fold_terms(QUERY_TERMS))
    ft, ot = Q.folded_words("content"), Q.words("content")
    n = T.SNIPPET_TOKENS
    return f"""
SELECT id, CASE WHEN len(ot) = 0 THEN '' ELSE array_to_string(list_transform(
         range(st, least(st + {n} - 1, len(ot)) + 1),
         lambda i: CASE WHEN list_contains({qt}, ft[i]) THEN '<mark>' || ot[i] || '</mark>' ELSE ot[i] END), ' ') END
       AS snippet
FROM (SELECT id, ot, ft, CASE WHEN len(hits) = 0 THEN 1 ELSE hits[list_position(cnt, list_max(cnt))] END AS st
      FROM (SELECT id, ot, ft, hits,
                   list_transform(hits, lambda p: 999 * len(list_distinct(list_transform(list_filter(hits, lambda r: r >= p AND r < p + {n}), lambda r: ft[r])))
                                                  + len(list_filter(hits, lambda r: r >= p AND r < p + {n}))) AS cnt
            FROM (SELECT id, ot, ft,
                         list_filter(range(1, greatest(len(ft), 1) + 1), lambda i: list_contains({qt}, ft[i])) AS hits
                  FROM (SELECT c.id, {ot} AS ot, {ft} AS ft FROM corpus c JOIN m ON c.id = m.id))))"""


_MATCHED = ("m AS (SELECT id FROM post WHERE token IN " + Q.in_list(sorted(QUERY_TERMS))
            + " GROUP BY id HAVING count(DISTINCT token) = 2)")


@query("highlight_snippet", "T13", with_fixtures(["corpus"], _highlight_sql(), _postings_cte() + ",\n" + _MATCHED))
def highlight_snippet(spark, sf_dir):
    _, docs, post, _ = _text_index(spark, sf_dir)
    hits = docs.join(T.match_all(post, QUERY_TERMS), "id", "left_semi")
    return T.highlight(hits, QUERY_TERMS)


@query("search_page_highlight", "O6/T13", with_fixtures(["corpus", "mime"], """
SELECT pg.id, pg.name, pg.sort_var, hl.snippet FROM pg LEFT JOIN hl ON pg.id = hl.id""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(QUERY_TERMS) + """,
pg AS (SELECT i.id, i.name, round(sc.score, 6) AS sort_var
       FROM idx i JOIN sc ON i.id = sc.id
       WHERE i.mime IN ('text/plain', 'text/html', 'application/json', 'application/pdf')
       ORDER BY round(sc.score, 14) DESC, i.id ASC LIMIT 60),
m AS (SELECT id FROM pg),
hl AS (""" + _highlight_sql() + ")"))
def search_page_highlight(spark, sf_dir):
    fx, docs, post, ix = _text_index(spark, sf_dir)
    page = S.search_page(doc_index(fx), FLAG_REQ, scores=ix.bm25(FLAG_REQ.terms), columns=["id", "name"])
    return T.highlight_page(docs, page, QUERY_TERMS).select("id", "name", F.round("sort_var", 6).alias("sort_var"), "snippet")


SNIPPET_PARTS = ["of the", "for", "with"]


def _phrase_snippet_sql() -> str:
    """Hits as (place, words, part); a window scores its different parts first."""
    n = T.SNIPPET_TOKENS
    return f"""
SELECT id, CASE WHEN len(ot) = 0 THEN '' ELSE array_to_string(list_transform(range(st, least(st + {n} - 1, len(ot)) + 1),
         lambda i: CASE WHEN len(list_filter(hits, lambda h: h.p >= st AND h.p + h.n <= st + {n} AND i >= h.p AND i < h.p + h.n)) > 0
                        THEN '<mark>' || ot[i] || '</mark>' ELSE ot[i] END), ' ') END AS snippet
FROM (SELECT id, ot, hits, CASE WHEN len(hits) = 0 THEN 1 ELSE hits[list_position(cnt, list_max(cnt))].p END AS st
  FROM (SELECT id, ot, hits, list_transform(hits, lambda x:
          999 * len(list_distinct(list_transform(list_filter(hits, lambda h: h.p >= x.p AND h.p + h.n <= x.p + {n}), lambda h: h.part)))
          + len(list_filter(hits, lambda h: h.p >= x.p AND h.p + h.n <= x.p + {n}))) AS cnt
    FROM (SELECT id, ot, list_filter(list_transform(range(1, len(ft) + 1), lambda i: {{'p': i,
            'n': CASE WHEN ft[i] = 'of' THEN 2 ELSE 1 END,
            'part': CASE WHEN ft[i] = 'of' AND ft[i + 1] = 'the' THEN 0 WHEN ft[i] = 'for' THEN 1 WHEN ft[i] = 'with' THEN 2 ELSE -1 END}}),
            lambda h: h.part >= 0) AS hits
          FROM (SELECT id, {Q.words('content')} AS ot, {Q.folded_words('content')} AS ft FROM corpus))))"""


@query("snippet_phrase", "T13", with_fixtures(["corpus"], _phrase_snippet_sql()))
def snippet_phrase(spark, sf_dir):
    """Whole texts; a phrase is a hit where its words stand together."""
    return T.highlight(Fixtures(spark, sf_dir).corpus, SNIPPET_PARTS)


def _highlight_full_sql() -> str:
    qt = Q.str_list(T.fold_terms(QUERY_TERMS))
    return f"""
SELECT id, seps[1] || array_to_string(list_transform(range(1, len(w) + 1),
         lambda i: CASE WHEN list_contains({qt}, {Q.fold('w[i]')}) THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END
                   || coalesce(seps[i + 1], '')), '') AS marked
FROM (SELECT c.id, {Q.words('c.content')} AS w, regexp_split_to_array(c.content, {Q.q(WORD_TOKEN)})
      AS seps FROM corpus c JOIN m ON c.id = m.id)"""


@query("highlight_full", "T14", with_fixtures(["corpus"], _highlight_full_sql(), _postings_cte() + ",\n" + _MATCHED))
def highlight_full(spark, sf_dir):
    _, docs, post, _ = _text_index(spark, sf_dir)
    hits = docs.join(T.match_all(post, QUERY_TERMS), "id", "left_semi")
    return T.highlight_full(hits, QUERY_TERMS)


PHRASE_REQ = S.SearchRequest(terms=["the"], phrase=["of", "the"], sort="size", sort_asc=True, page_size=50,
                             size_min=100_000)


@query("search_phrase_page", "O6/T8/T10", with_fixtures(["corpus", "mime"], f"""
SELECT i.id, i.index_id, i.name, i.path, i.size, i.mtime, i.mime, i.size AS sort_var
FROM idx i JOIN sc ON i.id = sc.id
WHERE i.size >= 100000
  AND ({" OR ".join(f"contains(' ' || array_to_string({Q.tokens('i.' + f)}, ' ') || ' ', ' of the ')" for f in S.TEXT_FIELDS_NO_PATH)})
ORDER BY sort_var ASC, i.id ASC LIMIT 50""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(["the"], fields=S.TEXT_FIELDS_NO_PATH)))
def search_phrase_page(spark, sf_dir):
    fx, docs, post, ix = _text_index(spark, sf_dir)
    page, _ = S.search(doc_index(fx), PHRASE_REQ, index=ix)
    return page


STORED_REQ = S.SearchRequest(terms=QUERY_TERMS + ["the"], index_ids=[1, 2], sort="score", sort_asc=False,
                             page_size=60, search_in_path=True)


@query("search_stored_index_page", "O6/F3/T5", with_fixtures(["corpus", "mime"], """
SELECT i.id, i.index_id, i.name, i.path, i.size, i.mtime, i.mime, round(sc.score, 6) AS sort_var
FROM idx i JOIN sc ON i.id = sc.id
WHERE i.index_id IN (1, 2)
ORDER BY round(sc.score, 14) DESC, i.id ASC LIMIT 60""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(QUERY_TERMS + ["the"])))
def search_stored_index_page(spark, sf_dir):
    page, _ = search_index(spark, sf_dir).search(STORED_REQ)
    return page.select("id", F.col("index_id").cast("int").alias("index_id"), "name", "path", "size", "mtime",
                       "mime", F.round("sort_var", 6).alias("sort_var"))


@query("mime_facet_for_text_query", "A6/T6", with_fixtures(["corpus", "mime"], """
SELECT i.mime, count(*) AS count FROM idx i JOIN sc ON i.id = sc.id WHERE i.mime IS NOT NULL
GROUP BY i.mime""",
    IDX_CTE + ",\n" + _postings_cte() + ",\n" + bm25_cte(["the", "and"])))
def mime_facet_for_text_query(spark, sf_dir):
    from docsift.operators import facets as A

    fx, docs, post, ix = _text_index(spark, sf_dir)
    hits = doc_index(fx).join(ix.bm25(["the", "and"]).select("id"), "id", "left_semi")
    return A.mime_facet_for_query(hits)
