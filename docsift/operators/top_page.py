"""The best page of a word search without scoring every match.

The index keeps, for each token and block of ids, the largest part that it has in
the score of a document there.  With the query's idf this bounds the score of any
document of a block.  The blocks with the highest bounds are scored
first; the page's last score among them is a threshold, and only blocks whose
bound reaches it are read after that.  No block that could hold a document of the
page is skipped, so the page equals that of a full scoring.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.operators.fulltext import BM25_K1, FIELD_WEIGHTS, IDF_FLOOR, _weight, fold_terms, score_matches
from docsift.operators.search import SCORE_PLACES, TEXT_FIELDS_NO_PATH, SearchRequest, matching_documents
from docsift.operators.segments import BLOCK, SegmentedIndex

FIRST_BLOCKS = 32    # blocks scored for the threshold
MOST_RANGES = 512    # blocks named in a filter; beyond, they are joined
SLACK = 1e-9         # of a bound, against rounding


@dataclass(frozen=True)
class BestScores:
    """(id, score) of the best documents, and what was read for them: blocks and
    (token, document) pairs, of all that the query's tokens have."""
    scores: DataFrame
    blocks: int
    blocks_read: int
    pairs: int
    pairs_read: int


def _ranges(blocks: list[int]) -> Column:
    """Ids of some blocks as ranges, neighbours in one, which Parquet can use to
    skip pages."""
    parts, run = [], []
    for b in [*sorted(blocks), None]:
        if run and b != run[-1] + 1:
            parts.append(F.col("id").between(run[0] * BLOCK, run[-1] * BLOCK + BLOCK - 1))
            run = []
        run.append(b)
    while len(parts) > 1:
        parts = [functools.reduce(lambda a, b: a | b, parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def top_scores(index: SegmentedIndex, terms: list[str], k: int, require_all: bool = True, fields: list[str] | None = None,
               among: DataFrame | None = None, after: tuple | None = None) -> BestScores:
    """The ``k`` best (id, score) of the documents with all (or any) ``terms``,
    by score down and id up, as ``index.bm25`` scores them.  ``among``: only
    these ids; ``after``: only what follows this (score, id)."""
    spark, tokens = index.spark, sorted(set(fold_terms(terms)))
    none = spark.createDataFrame([], "id long, score double")
    frequency = {r.token: r.n for r in index.document_frequency(tokens, fields).collect()}  # a row a term
    n_docs = sum(s.n_docs - s.dead_docs for s in index.segments)
    if not frequency or (require_all and len(frequency) < len(tokens)):
        return BestScores(none, 0, 0, 0, 0)
    idf = F.lit(0.0)
    for t, n in frequency.items():
        raw = math.log((n_docs - n + 0.5) / (n + 0.5))
        idf = F.when(F.col("token") == t, F.lit(raw if raw > 0 else IDF_FLOOR)).otherwise(idf)
    bound = idf * F.col("most") * (BM25_K1 + 1)
    bounds = index.blocks(list(frequency)).groupBy("block").agg(
        F.sum(bound).alias("bound"), F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n"))
    if require_all:
        bounds = bounds.where(F.col("tokens") == len(tokens))
    counted = spark.createDataFrame(list(frequency.items()), "token string, n long")

    def scored(postings: DataFrame) -> DataFrame:
        p = postings.where(F.col("token").isin(tokens))
        p = p if fields is None else p.where(F.col("field").isin(list(fields)))
        f = p.groupBy("id", "token", "dl").agg(F.sum(F.col("tf") * _weight(FIELD_WEIGHTS)).alias("f"))
        rows = score_matches(f, index.stats, len(tokens) if require_all else None, frequency=counted)
        rows = rows if among is None else rows.join(among.select("id"), "id", "left_semi")
        if after is not None:
            s = F.round("score", SCORE_PLACES)
            rows = rows.where((s < after[0]) | ((s == after[0]) & (F.col("id") > after[1])))
        return rows

    order = [F.round("score", SCORE_PLACES).desc(), F.col("id").asc()]
    whole = bounds.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()
    if not first:
        return BestScores(none, 0, 0, 0, 0)
    best = scored(index.postings.where(_ranges([r.block for r in first]))).orderBy(*order).limit(k).collect()  # a page
    threshold = round(best[-1].score, SCORE_PLACES) if len(best) == k else -math.inf
    rest = bounds.where(~F.col("block").isin([r.block for r in first]) & (F.col("bound") >= threshold - SLACK))
    n_rest, pairs_rest = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = spark.createDataFrame([tuple(r) for r in best], "id long, score double") if best else none
    if n_rest:
        if n_rest <= MOST_RANGES:
            more = index.postings.where(_ranges([r.block for r in rest.select("block").collect()]))
        else:
            more = index.postings.withColumn("block", F.floor(F.col("id") / BLOCK).cast("long")).join(rest.select("block"), "block", "left_semi")
        found = found.unionByName(scored(more).orderBy(*order).limit(k)).orderBy(*order).limit(k)
    return BestScores(found, whole[0], len(first) + n_rest, whole[1], sum(r.n for r in first) + pairs_rest)


def best_scores(index: SegmentedIndex, req: SearchRequest, docs: DataFrame, tags: DataFrame | None = None, emb: DataFrame | None = None) -> DataFrame | None:
    """Scores that are enough for the page of a request, where it asks for the
    best matches of words alone; None where all matches are needed."""
    words = [w for w in (req.terms, req.any_terms) if w]
    if (len(words) != 1 or req.sort != "score" or req.sort_asc or req.fetch_aggregations
            or req.query or req.phrase or req.prefix or req.fuzzy or req.none_terms):
        return None
    filtered = req.path or req.size_min > 0 or req.size_max > 0 or req.date_min > 0 or req.date_max > 0 or req.index_ids is not None \
        or req.mime_types or req.tags or req.tags_all or req.has_model is not None
    among = matching_documents(docs, req, tags, emb).select("id") if filtered else None
    fields = None if req.search_in_path else TEXT_FIELDS_NO_PATH
    return top_scores(index, words[0], req.page_size, bool(req.terms), fields, among, req.after).scores
