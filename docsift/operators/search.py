"""Filtered, sorted, keyset-paged search over the document index (F1-F11,
O1-O11, A9, U4, W1).

The request is a dataclass; each supplied field becomes one column predicate
and the predicates are AND-ed, so Catalyst pushes them into the parquet scan.
A page is ``orderBy(...).limit(n)`` which plans as TakeOrderedAndProject:
every partition keeps its own top ``n`` and only ``n x partitions`` rows meet,
whatever the table size.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.paths import under
from docsift.functions.tags import tag_strict_prefixes
from docsift.operators.facets import first_rows

MAX_PAGE = 1000  # fixed value: largest page a request may ask for
DEFAULT_PAGE = 60  # fixed value: UI page size
SCORE_PLACES = 14  # fixed value: decimal places of a score used as sort value


@dataclass
class SearchRequest:
    """One search request; absent fields add no predicate.  Documents match
    the ``query`` (a search expression, written or as a tree of ``matching``),
    all of ``terms``, the ``phrase``, some word with the ``prefix``, any of
    ``any_terms``, none of ``none_terms`` and the 3-grams of ``fuzzy``."""

    query: object | None = None
    terms: list[str] | None = None
    phrase: list[str] | None = None
    any_terms: list[str] | None = None
    none_terms: list[str] | None = None
    prefix: str | None = None
    fuzzy: str | None = None
    path: str | None = None
    size_min: int = 0
    size_max: int = 0
    date_min: int = 0
    date_max: int = 0
    page_size: int = DEFAULT_PAGE
    after: tuple | None = None
    seed: int = 0
    fetch_aggregations: bool = False
    sort: str = "score"  # score | size | mtime | name | id | random | embedding
    sort_asc: bool = True
    index_ids: list[int] | None = None
    mime_types: list[str] | None = None
    tags: list[str] | None = None
    tags_all: list[str] | None = None
    has_model: int | None = None  # only documents with a vector of this model
    highlight: bool = False
    context: int = 20  # tokens of a snippet
    search_in_path: bool = False
    embedding: list[float] | None = None
    model: int | None = None

    def validate(self) -> None:
        if not (1 <= self.page_size <= MAX_PAGE):
            raise ValueError(f"page_size must be in 1..{MAX_PAGE}")
        if self.after is not None and len(self.after) != 2:
            raise ValueError("after must be (sort_value, id)")
        if (self.embedding is not None or self.sort == "embedding") and self.model is None:
            raise ValueError("an embedding needs its model")
        if self.sort == "embedding" and self.embedding is None:
            raise ValueError("sorting by embedding needs one")

    def marked(self) -> list[str]:
        """Words and phrases that a snippet shows."""
        from docsift.operators.matching import Phrase, _ranked, parse_query

        tree = parse_query(self.query) if isinstance(self.query, str) else self.query
        asked = [" ".join(leaf.words) for leaf, _ in (_ranked(tree, None) if tree else []) if isinstance(leaf, Phrase)]
        return list(dict.fromkeys([*asked, *(self.terms or []), *(self.any_terms or []), *([" ".join(self.phrase)] if self.phrase else [])]))


# ---------------------------------------------------------------- predicates

def size_between(lo: int, hi: int, col: str = "size") -> Column | None:
    """inclusive bounds; a bound <= 0 is absent."""
    c = F.col(col)
    if lo > 0 and hi > 0:
        return c.between(lo, hi)
    if lo > 0:
        return c >= lo
    if hi > 0:
        return c <= hi
    return None


def date_between(lo: int, hi: int, col: str = "mtime") -> Column | None:
    """as F1 on the modification time."""
    return size_between(lo, hi, col)


def index_in(ids: list[int] | None, col: str = "index_id") -> Column | None:
    """membership; an empty list matches nothing, None means no filter."""
    if ids is None:
        return None
    if len(ids) == 0:
        return F.lit(False)
    return F.col(col).isin(list(ids))


def mime_in(names: list[str] | None, col: str = "mime") -> Column | None:
    """membership; empty or None means no filter."""
    if not names:
        return None
    return F.col(col).isin(list(names))


def path_under(p: str | None, col: str = "path") -> Column | None:
    """directory equal to ``p`` or below it (case-sensitive, '/' boundary)."""
    if not p:
        return None
    return under(F.col(col), p)


def path_under_ci(p: str | None, col: str = "path") -> Column | None:
    """as F5 after lower-casing both sides and dropping a trailing '/'."""
    if not p:
        return None
    q = p.lower().rstrip("/")
    c = F.lower(F.col(col))
    return (c == F.lit(q)) | c.startswith(q + "/")


def path_prefix(prefix: str | None, col: str = "path") -> Column | None:
    """plain text prefix, no '/' boundary."""
    if prefix is None:
        return None
    return F.col(col).startswith(prefix)


def conjunction(preds) -> Column:
    """AND of the supplied predicates; none -> TRUE."""
    preds = [p for p in preds if p is not None]
    if not preds:
        return F.lit(True)
    return functools.reduce(lambda a, b: a & b, preds)


def tags_any(docs: DataFrame, tags: DataFrame, query_tags: list[str], id_col: str = "id") -> DataFrame:
    """Documents with a tag strictly below one of ``query_tags``.

    Each tag row is exploded into its strict '.'-prefixes and equi-joined with
    the (tiny, literal) query list; the semi join to documents then shuffles on
    the document id only.
    """
    spark = docs.sparkSession
    q = F.broadcast(spark.createDataFrame([(t,) for t in query_tags], "qtag string"))
    hits = (
        tags.select(F.col(id_col).alias("_tid"), F.explode(tag_strict_prefixes("tag")).alias("qtag"))
        .join(q, "qtag", "left_semi")
        .select("_tid")
    )
    return docs.join(hits, docs[id_col] == hits["_tid"], "left_semi")


# ------------------------------------------------------------------- sorting

SORT_COLUMNS = {"size": "size", "mtime": "mtime", "name": "name", "id": "id"}


def random_key(seed: int, id_col: str = "id") -> Column:
    """O3: repeatable shuffle key: md5 of 'seed:id' (same seed, same order)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def sort_value(req: SearchRequest, score_col: str | None = None) -> Column:
    sort = req.sort
    if sort == "score" and score_col is None:
        sort = "id"  # no text query: fall back to id
    if sort == "score":
        return F.round(F.col(score_col), SCORE_PLACES)
    if sort == "random":
        return random_key(req.seed)
    if sort == "embedding":
        return F.col("similarity")
    return F.col(SORT_COLUMNS[sort])


def page_after(df: DataFrame, after: tuple | None, asc: bool, key: str = "sort_var", id_col: str = "id") -> DataFrame:
    """Keyset predicate.  The sort key is mirrored for descending order;
    the id tie-break is always ascending, so no tied row is skipped."""
    if after is None:
        return df
    a, b = after
    k, i = F.col(key), F.col(id_col)
    beyond = (k > F.lit(a)) if asc else (k < F.lit(a))
    return df.where(beyond | ((k == F.lit(a)) & (i > F.lit(b))))


def sort_page(df: DataFrame, asc: bool, n: int, key: str = "sort_var", id_col: str = "id") -> DataFrame:
    """O1: order by key (asc/desc) then id ascending; keep ``n`` rows."""
    k = F.col(key).asc_nulls_last() if asc else F.col(key).desc_nulls_last()
    return df.orderBy(k, F.col(id_col).asc()).limit(n)


def filter_documents(docs: DataFrame, req: SearchRequest) -> DataFrame:
    """All non-text, non-paging predicates of a request."""
    pred = conjunction([
        path_under(req.path),
        size_between(req.size_min, req.size_max),
        date_between(req.date_min, req.date_max),
        index_in(req.index_ids),
        mime_in(req.mime_types),
    ])
    return docs.where(pred)


def matching_documents(docs: DataFrame, req: SearchRequest, tags: DataFrame | None = None,
                       emb: DataFrame | None = None) -> DataFrame:
    """All predicates of a request but the text ones."""
    from docsift.operators.tags import tags_all
    from docsift.operators.vectors import has_embedding

    hits = filter_documents(docs, req)
    if req.tags:
        hits = tags_any(hits, tags, req.tags)
    if req.tags_all:
        hits = tags_all(hits, tags, req.tags_all)
    if req.has_model is not None:
        hits = has_embedding(hits, emb, req.has_model)
    return hits


def search_page(docs: DataFrame, req: SearchRequest, scores: DataFrame | None = None,
                tags: DataFrame | None = None, columns: list[str] | None = None,
                emb: DataFrame | None = None) -> DataFrame:
    """Filters + optional text scores + sort + keyset page.

    ``scores`` is (id, score) from a text match (T5/T6...); when given, only
    matching documents are candidates (inner join, J4).  With
    ``sort='embedding'`` the request's vector is compared with each
    document's vector of ``req.model`` (one per document, Q7); documents
    without one score -1 (J5, V2).
    """
    req.validate()
    hits = matching_documents(docs, req, tags, emb)
    score_col = None
    if scores is not None:
        hits = hits.join(scores, "id", "inner")
        score_col = "score"
    if req.sort == "embedding":
        from docsift.operators.vectors import _arr, cosine_sim, model_vectors

        # similarities are taken on the vector rows, so the join carries numbers, not vectors
        vec = model_vectors(emb, req.model).withColumn("_q", _arr(req.embedding))
        vec = vec.select(F.col("id").alias("_vid"), cosine_sim(F.col("_q"), F.col("embedding")).alias("_sim"))
        hits = hits.join(vec, hits["id"] == vec["_vid"], "left").withColumn("similarity", F.coalesce("_sim", F.lit(-1.0)))
        hits = hits.drop("_vid", "_sim")
    hits = hits.withColumn("sort_var", sort_value(req, score_col))
    hits = page_after(hits, req.after, req.sort_asc)
    page = sort_page(hits, req.sort_asc, req.page_size)
    cols = columns or ["id", "index_id", "name", "path", "size", "mtime", "mime"]
    return page.select(*cols, "sort_var")


def hit_totals(docs: DataFrame, req: SearchRequest, scores: DataFrame | None = None,
               tags: DataFrame | None = None, emb: DataFrame | None = None) -> DataFrame:
    """Total count and size of a request, independent of paging."""
    hits = matching_documents(docs, req, tags, emb)
    if scores is not None:
        hits = hits.join(scores.select("id"), "id", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("total_count"),
                    F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def unseen_hits(page: DataFrame, shown: DataFrame, id_col: str = "id") -> DataFrame:
    """U4: page minus ids already shown."""
    return page.join(shown.select(id_col), id_col, "left_anti")


def hide_duplicates(hits: DataFrame, order: list[tuple[str, bool]], checksum: str = "checksum",
                    id_col: str = "id") -> DataFrame:
    """First hit per checksum in result order; hits without checksum stay.

    Written as a min-aggregate per checksum (map-side combined, so a checksum
    shared by a third of all rows costs one partial row per task) and a semi
    join back, instead of a window that would pull a hot checksum into one task.
    Descending keys (numeric) are negated so one ``min(struct)`` gives the
    first hit in result order.
    """
    numeric = {f.name for f in hits.schema.fields
               if f.dataType.typeName() in ("long", "integer", "short", "byte", "double", "float", "decimal")}
    keys = []
    for col, asc in order:
        if not asc and col not in numeric:
            raise ValueError(f"descending key {col!r} must be numeric (it is negated inside the struct order)")
        c = F.col(col)
        keys.append(c if asc else -c)
    keys.append(F.col(id_col))
    ranked = hits.where(F.col(checksum).isNotNull()).select(
        checksum, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"), id_col)
    firsts = ranked.groupBy(checksum).agg(F.min(F.struct("_key", id_col)).alias("_m")).select(
        F.col(f"_m.{id_col}").alias("_keep"))
    keep = hits.join(firsts, hits[id_col] == firsts["_keep"], "left_semi")
    return keep.unionByName(hits.where(F.col(checksum).isNull()))


def top_by(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    """Fullest bins / biggest media types (descending, tie ascending)."""
    return df.orderBy(F.col(col).desc(), F.col(tie).asc()).limit(n)


def suggest_paths(paths: DataFrame, text: str, n: int | None = None, col: str = "path") -> DataFrame:
    """Directories starting with ``text``; when none does, those that
    contain it ignoring case.  Shortest first, then alphabetical; all of them,
    or the first ``n``."""
    c = F.col(col)
    pref = paths.where(c.startswith(text)).select(col, F.lit(0).alias("_rank"))
    cont = paths.where(~c.startswith(text) & F.lower(c).contains(text.lower())).select(col, F.lit(1).alias("_rank"))
    allc = pref.unionByName(cont)
    has_prefix = pref.select(F.count(F.lit(1)).alias("n")).scalar() > 0
    chosen = allc.where((F.col("_rank") == 0) | ~has_prefix)
    return first_rows(chosen.orderBy(F.length(c), c), n).select(col)


# Fields searched when "search in path" is off (T10, Q9: applies to every term).
TEXT_FIELDS_NO_PATH = ["name", "content", "title"]


def text_scores(docs: DataFrame, req: SearchRequest, index, grams: DataFrame | None = None) -> DataFrame | None:
    """(id, score) of the documents that match the text parts of a request,
    the scores of the parts added up; None if it has none.  ``grams`` is the
    stored 3-gram index (by default that of ``index``); without it a fuzzy part
    reads the texts."""
    from docsift.operators import fulltext as T

    grams = index.grams if grams is None and index is not None else grams
    fields = None if req.search_in_path else TEXT_FIELDS_NO_PATH
    parts = []
    if req.query:
        from docsift.operators.matching import query_scores

        parts.append(query_scores(index, req.query, fields))
    if req.terms:
        parts.append(index.bm25(req.terms, fields=fields))
    if req.any_terms:
        parts.append(index.bm25(req.any_terms, fields=fields, require_all=False))
    if req.prefix:
        parts.append(index.prefix_scores(req.prefix, fields))
    if req.phrase:
        parts.append(index.phrase_scores(docs, req.phrase, fields))
    if req.fuzzy:
        parts.append(T.match_fuzzy(docs, req.fuzzy, req.search_in_path) if grams is None
                     else T.match_fuzzy_index(grams, req.fuzzy, req.search_in_path))
    if not parts:
        return None
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.join(p.withColumnRenamed("score", "_s"), "id").select("id", (F.col("score") + F.col("_s")).alias("score"))
    return scores


def search(docs: DataFrame, req: SearchRequest, index=None, tags: DataFrame | None = None,
           emb: DataFrame | None = None, columns: list[str] | None = None, grams: DataFrame | None = None,
           scores: DataFrame | None = None):
    """O6 in one call: the request's text parts (BM25 over the text index,
    path field only when ``search_in_path``), its filters, tag and vector
    parts, the page with the snippets asked for, and - when
    ``fetch_aggregations`` - the totals (A9).  Returns ``(page,
    totals_or_None)``; ``highlight`` adds ``snippet`` and the marked name.
    ``scores``: (id, score) of the text parts, if they are known already."""
    from docsift.operators import fulltext as T

    req.validate()
    scores = text_scores(docs, req, index, grams) if scores is None else scores
    if req.none_terms:
        docs = T.match_not(docs, index.postings, req.none_terms)
    page = search_page(docs, req, scores=scores, tags=tags, columns=columns, emb=emb)
    if req.highlight:
        marked = req.marked()
        page = T.highlight_page(docs, page, marked, n=req.context)
        names = T.highlight_full(page.select("id", "name"), [w for m in marked for w in m.split()], "name").withColumnRenamed("marked", "name_marked")
        page = page.join(names, "id", "left")
    totals = hit_totals(docs, req, scores=scores, tags=tags, emb=emb) if req.fetch_aggregations else None
    return page, totals
