"""Registered search expressions (T7, T8, T9, T10): words joined by AND, OR and
NOT, phrases, prefixes, fields, words near each other, and a nested one.  The
oracle decides on the token lists of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import fulltext as T
from docsift.operators import matching as M
from docsift.operators import search as S
from docsift.plans import sqlfrag as Q
from docsift.plans.common import IDX_CTE, doc_index, text_index
from docsift.plans.registry import query
from docsift.plans.text_queries import _postings_cte
from docsift.sources.fixtures import Fixtures, with_fixtures

FIELDS = tuple(T.FIELD_WEIGHTS)
LISTS = "tk AS (SELECT id, " + ", ".join(f"{Q.tokens(f)} AS {f}_t" for f in FIELDS) + " FROM corpus)"


def _any(test, fields) -> str:
    return "(" + " OR ".join(f"coalesce({test(f + '_t')}, false)" for f in fields) + ")"


def _has(word: str, fields=FIELDS) -> str:
    return _any(lambda t: f"list_contains({t}, '{word}')", fields)


def _starts(prefix: str, fields=FIELDS) -> str:
    return _any(lambda t: f"len(list_filter({t}, lambda w: starts_with(w, '{prefix}'))) > 0", fields)


def _phrase(words: str, fields=FIELDS) -> str:
    return _any(lambda t: f"contains(' ' || array_to_string({t}, ' ') || ' ', ' {words} ')", fields)


def _near(a: str, b: str, n: int, fields=FIELDS) -> str:
    one = lambda t, x, y: (f"len(list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{x}' AND "  # noqa: E731
                           f"list_contains(list_slice({t}, i, i + 1 + {n}), '{y}'))) > 0")
    return _any(lambda t: f"({one(t, a, b)} OR {one(t, b, a)})", fields)


def _register(name: str, ids: str, text: str, where: str) -> None:
    @query(name, ids, with_fixtures(["corpus"], f"SELECT id FROM tk WHERE {where}", LISTS))
    def run(spark, sf_dir):
        return M.matching(text_index(spark, sf_dir).postings, M.parse_query(text))


_register("query_and", "T7/T6", "the AND for", f"{_has('the')} AND {_has('for')}")
_register("query_side_by_side", "T7/T6", "estion ated", f"{_has('estion')} AND {_has('ated')}")
_register("query_or", "T7", "estion OR whon", f"{_has('estion')} OR {_has('whon')}")
_register("query_not", "T7", "the NOT (with OR whon)", f"{_has('the')} AND NOT ({_has('with')} OR {_has('whon')})")
_register("query_phrase", "T7/T8", '"of the"', _phrase("of the"))
_register("query_prefix", "T7/T9", "Esti*", _starts("esti"))
_register("query_field", "T7/T10", "path : de OR {name title} : the", f"{_has('de', ['path'])} OR {_has('the', ['name', 'title'])}")
_register("query_near", "T7/T8", "NEAR(for the, 3)", _near("for", "the", 3))
NESTED = 'the AND (for OR "of the") NOT (NEAR(with for, 5) OR whon*) AND {content title} : (and OR estion*)'
_register("query_nested", "T7/T8/T9/T10", NESTED,
          f"{_has('the')} AND (({_has('for')} OR {_phrase('of the')}) AND NOT ({_near('with', 'for', 5)} OR {_starts('whon')}))"
          f" AND ({_has('and', ['content', 'title'])} OR {_starts('estion', ['content', 'title'])})")

RANKED = S.SearchRequest(query='(estion* OR "of the") NOT whon', sort="score", sort_asc=False, search_in_path=True)
_WEIGHT = "CASE " + " ".join(f"WHEN field = '{f}' THEN {w}" for f, w in T.FIELD_WEIGHTS.items()) + " ELSE 0.0 END"
_IDF = "ln((st.n_docs - nt.n + 0.5) / (nt.n + 0.5))"
_PAIRS = " + ".join(f"{w} * coalesce(len(list_filter(range(1, len({f}_t)), lambda i: {f}_t[i] = 'of' AND {f}_t[i + 1] = 'the')), 0)"
                    for f, w in T.FIELD_WEIGHTS.items())


@query("search_query_page", "O6/T7/T8/T9/T5", with_fixtures(["corpus", "mime"], """
SELECT i.id, i.name, i.size, round(sc.score, 6) AS sort_var FROM idx i JOIN sc ON i.id = sc.id
ORDER BY round(sc.score, 14) DESC, i.id LIMIT 60""", IDX_CTE + ",\n" + _postings_cte() + ",\n" + LISTS + f""",
ff AS (SELECT id, 1 AS token, sum(tf * {_WEIGHT}) AS f FROM post WHERE starts_with(token, 'estion') GROUP BY id
       UNION ALL SELECT id, 2, f FROM (SELECT id, {_PAIRS} AS f FROM tk) WHERE f > 0),
nt AS (SELECT token, count(*) AS n FROM ff GROUP BY token),
sc AS (SELECT ff.id, sum(CASE WHEN {_IDF} <= 0 THEN {T.IDF_FLOOR} ELSE {_IDF} END * ff.f * ({T.BM25_K1} + 1)
         / (ff.f + {T.BM25_K1} * (1 - {T.BM25_B} + {T.BM25_B} * dl.dl / st.avgdl))) AS score
       FROM ff JOIN nt ON ff.token = nt.token JOIN dl ON ff.id = dl.id CROSS JOIN st
       WHERE ff.id IN (SELECT id FROM tk WHERE NOT {_has('whon')}) GROUP BY ff.id)"""))
def search_query_page(spark, sf_dir):
    page, _ = S.search(doc_index(Fixtures(spark, sf_dir)), RANKED, index=text_index(spark, sf_dir), columns=["id", "name", "size"])
    return page.withColumn("sort_var", F.round("sort_var", 6))
