"""Shared pieces of the registered queries: the document index built from
fixtures on Spark (and the same table as an oracle CTE), and the text and
search indexes, each built once per application and scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docsift.operators import fulltext as T
from docsift.operators.documents import EMPTY_MIME, index_documents
from docsift.session import scratch_dir
from docsift.sources.fixtures import Fixtures

# Oracle CTE: corpus with its media type (J1) - same rule as mime_by_extension.
IDX_CTE = f"""idx AS (
  SELECT c.*, CASE WHEN c.size = 0 THEN '{EMPTY_MIME}'
                   WHEN length(c.extension) > 0 AND length(c.name) > 0 THEN m.mime END AS mime
  FROM corpus c LEFT JOIN mime m ON lower(c.extension) = lower(m.extension))"""


def doc_index(fx: Fixtures) -> DataFrame:
    return index_documents(fx.corpus, fx.mime)


_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark, sf_dir) -> T.TextIndex:
    """The corpus text index of ``sf_dir``, built once per application into
    the shared checkpoint folder and reused by every text query."""
    key = (spark.conf.get("spark.app.id", "app"), sf_dir)
    if key not in _INDEXES:
        path = scratch_dir(spark, "text-index")
        T.build_text_index(Fixtures(spark, sf_dir).corpus, path, positions=True)
        _INDEXES[key] = path
    return T.open_text_index(spark, _INDEXES[key])


_SEARCH_INDEXES: dict[tuple[str, str], str] = {}


def search_index(spark, sf_dir):
    """The complete search index of ``sf_dir``, built once per application
    into the shared checkpoint folder."""
    from docsift.operators.indexer import SearchIndex, build_index

    key = (spark.conf.get("spark.app.id", "app"), sf_dir)
    if key not in _SEARCH_INDEXES:
        fx = Fixtures(spark, sf_dir)
        path = scratch_dir(spark, "search-index")
        build_index(fx.corpus, path, fx.mime, fx.tags, fx.emb)
        _SEARCH_INDEXES[key] = path
    return SearchIndex(spark, _SEARCH_INDEXES[key])
