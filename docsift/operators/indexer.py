"""Building and opening a complete search index (the index step that sits
between a scan and searches).

``build_index`` writes every table a search request or a statistics page
reads, each laid out for its access path:

* ``text`` - segments with the document rows (media type and packed id, in id
  order, partitioned by ``index_id`` so that index filters prune whole folders),
  token-ordered postings with positions, document counts, and the 3-grams;
* ``facets/run=N`` - ``mime_index``, ``path_index``, ``date_range``,
  ``size_histogram``, ``date_histogram``, ``mime_totals``, ``treemap``:
  facets and statistics (a facet request reads a few rows instead of the
  documents);
* ``tags/run=N``, ``vectors`` - tag rows and vectors keyed by document id, the
  vectors with a pre-normalised copy so similarity is one dot product.

``SearchIndex.upsert`` takes new, changed and deleted documents: texts follow as
a new segment and tombstones, facets are computed anew from the narrow columns of
the live documents.

Each table is one Spark job with its own partitioning; nothing passes
through the driver except the treemap's per-level scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.paths import full_rel_path
from docsift.operators import facets as A
from docsift.operators.documents import index_documents, mime_dimension
from docsift.operators.segments import SegmentedIndex, create_index, open_index
from docsift.operators.treemap import treemap
from docsift.operators.vectors import knn_unit, model_vectors, unit_vectors
from docsift.session import ensure_checkpoint_dir

FACET_TABLES = ("mime_index", "path_index", "date_range", "size_histogram", "date_histogram", "mime_totals",
                "treemap")


class SearchIndex:
    """Handle on a built index: one DataFrame per table, plus the text index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.text: SegmentedIndex = open_index(spark, f"{path}/text")
        self.documents = self.text.documents
        self.run, self.tags_run = spark.read.parquet(f"{path}/runs").orderBy(F.desc("run")).select("run", "tags_run").first()
        for t in FACET_TABLES:
            setattr(self, t, spark.read.parquet(f"{path}/facets/run={self.run}/{t}"))
        self.tags = spark.read.parquet(f"{path}/tags/run={self.tags_run}")
        self.vectors = spark.read.parquet(f"{path}/vectors")

    def search(self, req, columns: list[str] | None = None):
        """O6 against the stored tables: an ``index_ids`` filter prunes the
        document partitions; words, phrases and 3-grams read only their rows."""
        from docsift.operators.search import search
        from docsift.operators.top_page import best_scores

        req.validate()
        scores = best_scores(self.text, req, self.documents, self.tags, self.vectors)
        return search(self.documents, req, index=self.text, tags=self.tags, emb=self.vectors, columns=columns, scores=scores)

    def more_like(self, doc_id: int, k: int, model_id: int = 1, columns: list[str] | None = None) -> DataFrame:
        """V4 on the stored vectors: the document's unit vector (a scalar
        subquery) against every stored unit vector - one dot product per row."""
        q = (model_vectors(self.vectors, model_id).where(F.col("id") == doc_id)
             .select(F.col("unit")).scalar())
        return knn_unit(self.documents.select(*(columns or ["id", "name"])), self.vectors, q, k, model_id)

    def upsert(self, docs: DataFrame | None = None, deletes: DataFrame | None = None, mime_dim: DataFrame | None = None) -> SearchIndex:
        """The index after a run that adds or replaces ``docs`` (columns
        of the corpus) and deletes the ids of ``deletes``."""
        mime_dim = mime_dim if mime_dim is not None else mime_dimension(self.spark)
        rows = None if docs is None else index_documents(docs, mime_dim).select(*self.documents.columns)
        text = self.text.upsert(rows, deletes)
        _write_facets(text.documents, self.path, self.run + 1, mime_dim, self.tags_run)
        return SearchIndex(self.spark, self.path)

    def apply_script(self, script, mime_dim: DataFrame | None = None) -> SearchIndex:
        """The index after a script has changed records: changed documents
        are upserted, and their tags are those that the record holds."""
        from docsift.operators import scripts as X

        ensure_checkpoint_dir(self.spark)
        records = X.as_records(self.documents, self.tags)
        changed = X.run_script(records, script)[1].select("id", F.col("record").cast("string").alias("json")).checkpoint(eager=True)
        changed = changed.select("id", F.parse_json("json").alias("record"))
        run, of = self.run + 1, self.documents.select("id", "index_id")
        fresh = X.record_tags(changed).join(of, "id").select(*self.tags.columns)
        kept = self.tags.join(changed.select("id"), "id", "left_anti").select(*self.tags.columns)
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{self.path}/tags/run={run}")
        text = self.text.upsert(X.as_documents(changed, self.documents))
        _write_facets(text.documents, self.path, run, mime_dim if mime_dim is not None else mime_dimension(self.spark), run)
        return SearchIndex(self.spark, self.path)


def _write_facets(stored: DataFrame, out: str, run: int, mime_dim: DataFrame, tags_run: int) -> None:
    """Facets of a run; the run counts once its last table is there."""
    files = stored.where(F.col("parent").isNull()).select(full_rel_path("path", "name", "extension").alias("path"), "size")
    tables = {
        "mime_index": A.mime_index(stored), "path_index": A.path_index(stored), "date_range": A.date_range(stored),
        "size_histogram": A.size_histogram(stored), "date_histogram": A.date_histogram(stored),
        "mime_totals": A.mime_totals(stored, mime_dim), "treemap": treemap(files)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/facets/run={run}/{name}")
    stored.sparkSession.range(1).select(F.lit(tags_run).alias("tags_run")).write.mode("overwrite").parquet(f"{out}/runs/run={run}")


def build_index(corpus: DataFrame, out: str, mime_dim: DataFrame | None = None, tags: DataFrame | None = None,
                emb: DataFrame | None = None) -> SearchIndex:
    """Write all index tables under ``out`` and return a handle on them."""
    spark = corpus.sparkSession
    mime_dim = mime_dim if mime_dim is not None else mime_dimension(spark)
    text = create_index(index_documents(corpus, mime_dim), f"{out}/text", grams=True, partition_by=("index_id",))
    empty_tags = spark.createDataFrame([], "id long, index_id int, tag string")
    (tags if tags is not None else empty_tags).write.mode("overwrite").parquet(f"{out}/tags/run=1")
    empty_emb = spark.createDataFrame([], "id long, model_id int, start int, embedding array<float>")
    unit_vectors(emb if emb is not None else empty_emb).write.mode("overwrite").parquet(f"{out}/vectors")
    _write_facets(text.documents, out, 1, mime_dim, 1)  # from the written rows, not the scan
    return SearchIndex(spark, out)
