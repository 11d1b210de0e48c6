"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op9_token_counts(spark, sf_dir):
    from docsift.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), limit=4096)


@_query
def op3_packing(spark, sf_dir):
    from docsift.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), window=2048).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_tokens", "step_group")


@_query
def op10_warc(spark, sf_dir):
    from docsift.llm.common import shared_path
    from docsift.llm.warc import payload_digests, write_archive

    pages = table(spark, sf_dir, "pages")
    archive = write_archive(pages, shared_path(spark, "warc"), revisit_bytes=1000)
    return payload_digests(archive, pages)


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS origin FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND origin <> page_id THEN origin END AS refers_to
FROM r
"""


@_query
def op1_mixing(spark, sf_dir):
    from docsift.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, block_words=4,
                       shard_words=1 << 16, seed=17).drop("source_no", "shard", "passes", "runs")


# Lists every quotient of every source and shard (one per block of 4 words);
# a source has fewer than 1024 shards here, so there is one super-shard.
ORACLES["op1_mixing"] = """
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM base GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(no % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
levels AS (  -- the level if exactly the sources that fill up before this one are full
  SELECT a.no, a.cap / a.w AS fill,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(b.cap), 0)) /
         ((SELECT sum(w) FROM weighed) - coalesce(sum(b.w), 0)) AS level
  FROM weighed a LEFT JOIN weighed b ON b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.no < a.no)
  GROUP BY a.no, a.cap, a.w),
final AS (SELECT arg_min(level, fill) AS level FROM levels WHERE fill > level),
tgt AS (SELECT *, least(cap, w * coalesce((SELECT level FROM final), 1e300)) AS target FROM weighed),
seats AS (SELECT round(1.5::DOUBLE * sum(source_size)::DOUBLE / 4)::BIGINT AS n FROM tgt),
quot AS (SELECT no, target / (2 * s + 1) AS q FROM tgt, range(0, (target / 4)::BIGINT * 2 + 8) r(s) WHERE target > 0),
won AS (SELECT no, count(*) AS quota FROM
        (SELECT no, row_number() OVER (ORDER BY q DESC, no) AS rank FROM quot) WHERE rank <= (SELECT n FROM seats) GROUP BY no),
placed AS (
  SELECT b.*, t.no, t.source_size, t.target, coalesce(w.quota, 0) AS source_quota,
         place % greatest(1, ceil(t.source_size / 65536))::BIGINT AS shard
  FROM base b JOIN tgt t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN won w ON w.no = t.no),
sh AS (SELECT no, shard, sum(size)::BIGINT AS words, max(source_quota) AS source_quota FROM placed GROUP BY no, shard),
shquot AS (SELECT no, shard, source_quota, words / (2 * s + 1) AS q
           FROM sh, range(0, greatest(source_quota, 0) + 1) r(s) WHERE words > 0),
shwon AS (SELECT no, shard, count(*) AS quota FROM
          (SELECT *, row_number() OVER (PARTITION BY no ORDER BY q DESC, shard) AS rank FROM shquot)
          WHERE rank <= source_quota GROUP BY no, shard),
plan AS (
  SELECT sh.no, sh.shard, words, least(coalesce(quota, 0) * 4, 2 * words) AS take,
         CASE WHEN words > 0 THEN ('0x' || substr(md5('18/' || sh.no || '/' || sh.shard), 1, 8))::BIGINT
                                  % ceil(words / 4)::BIGINT * 4 ELSE 0 END AS start
  FROM sh LEFT JOIN shwon USING (no, shard)),
run AS (SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes,
               CASE WHEN words > 0 THEN take % words ELSE 0 END AS run FROM plan),
stream AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, r.*,
         sum(p.size) OVER (PARTITION BY p.no, p.shard ORDER BY p.place, p.doc_id NULLS FIRST, p.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM placed p JOIN run r ON r.no = p.no AND r.shard = p.shard)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(stop, start + run, words) - greatest(stop - size, start))
        + greatest(0, least(stop, start + run - words) - greatest(stop - size, 0)))::BIGINT AS taken
FROM stream
"""


@_query
def op6_toxicity(spark, sf_dir):
    from docsift.llm.toxicity import score_toxicity, train_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


@_query
def op8_simhash(spark, sf_dir):
    from docsift.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


@_query
def op7_embedding_dedup(spark, sf_dir):
    from docsift.llm.embedding_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9, window=32)


@_query
def op4_vp_tree(spark, sf_dir):
    from docsift.llm.vp_tree import nearest_vectors

    rows = table(spark, sf_dir, "embeddings")
    return nearest_vectors(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, factor=0.2)


@_query
def op5_suffix_dedup(spark, sf_dir):
    from docsift.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_lm_scoring(spark, sf_dir):
    from docsift.llm.lm_scoring import score_language

    return score_language(table(spark, sf_dir, "documents"))


@_query
def op11_clusters(spark, sf_dir):
    from docsift.llm.zone_clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dims=64, seed=3)


def _clusters_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> str:
    """Every round as two tables: nearest centroids, then their floored means."""
    nearest = """near{r} AS MATERIALIZED (
  SELECT no, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM (
    SELECT x.no, c.j, list_sum(list_transform(range(1, {dims} + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::HUGEINT AS d
    FROM x, cent{r} c) GROUP BY no)"""
    means = """cent{s} AS MATERIALIZED (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM cent{r} c LEFT JOIN (
    SELECT j, list(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END ORDER BY i)::BIGINT[] AS v FROM (
      SELECT near{r}.j, p.i, sum(p.c)::HUGEINT AS total, count(*)::HUGEINT AS n
      FROM near{r} JOIN (SELECT no, unnest(v) AS c, unnest(range(1, {dims} + 1)) AS i FROM x) p USING (no) GROUP BY near{r}.j, p.i)
    GROUP BY j) m USING (j))"""
    steps = [f"""WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims}),
cent0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS j, v FROM x ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for r in range(rounds):
        steps += [nearest.format(r=r, k=k, dims=dims), means.format(r=r, s=r + 1, dims=dims)]
    steps.append(nearest.format(r=rounds, k=k, dims=dims))
    return ",\n".join(steps) + f"""
SELECT x.vec_id, n.j::INT AS cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.j))::BIGINT AS cluster_inertia,
       (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM x JOIN near{rounds} n USING (no) JOIN cent{rounds} c ON c.j = n.j
"""


ORACLES["op11_clusters"] = _clusters_sql()


@_query
def op13_top_k(spark, sf_dir):
    from docsift.llm.top_k import exact_top_k

    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


ORACLES["op13_top_k"] = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM x q JOIN x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


@_query
def op12_spelling(spark, sf_dir):
    from docsift.llm.spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), min_length=7, min_count=2, damage=31),
                             ratio=10, min_length=7)
