"""A corpus pipeline: toxic documents go, near-duplicates go, repeated passages
are cut, sources are mixed to their targets, and the mix is packed.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept; all but the last return the columns of ``documents``.
``run`` writes each stage's documents to the shared folder and reads them again
for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.llm.common import shared_path, table
from docsift.llm.mixing import mixed_documents
from docsift.llm.packing import pack_documents
from docsift.llm.simhash import keep_one_of_each
from docsift.llm.suffix_dedup import without_repeats
from docsift.llm.toxicity import filter_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores below 0.5."""
    return filter_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return keep_one_of_each(docs, shingle=4, bits=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 bytes or more that one with a
    smaller id has; a document may be left without text."""
    return without_repeats(docs, bucket_bytes=8 << 20)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents of a source in demand twice, of others
    once, in part or not at all; those without words are never taken."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0, block_words=4, shard_words=1 << 16, seed=17)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows with their token ids."""
    return pack_documents(docs, window=2048)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup),
          ("mixing", mixing), ("packing", packing)]

# The classifier and the fingerprints are beyond SQL; the tests compare with a
# brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
