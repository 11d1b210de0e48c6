"""Registered token-level and retention queries."""

from __future__ import annotations


from docsift.operators import nlp as N
from docsift.operators import windows as W
from docsift.plans import sqlfrag as Q
from docsift.plans.registry import query
from docsift.sources.fixtures import Fixtures, with_fixtures

WORD = Q.q(N.WORD_TOKEN)
TOKS = f"regexp_extract_all(lower(content), {WORD})"


@query("tokenize_with_offsets", "T15", with_fixtures(["corpus"], f"""
SELECT id, CAST(pos AS BIGINT) AS pos, lower(w) AS token,
       CAST(sum(length(w) + coalesce(length(s), 0)) OVER (PARTITION BY id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(w) AS BIGINT) AS start
FROM (SELECT id, i - 1 AS pos, ws[i] AS w, ss[i] AS s
      FROM (SELECT id, regexp_extract_all(content, {WORD}) AS ws, regexp_split_to_array(content, {WORD}) AS ss
            FROM corpus), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i))"""))
def tokenize_with_offsets(spark, sf_dir):
    return N.tokenize_with_offsets(Fixtures(spark, sf_dir).corpus)


@query("chunk_tokens", "T16", with_fixtures(["corpus"], f"""
SELECT id, CAST(c AS BIGINT) AS chunk, CAST(len(toks) AS BIGINT) AS n_tokens,
       array_to_string(list_concat(['[CLS]'], toks, ['[SEP]'], list_transform(range({N.CHUNK_TOKENS} - len(toks)),
                       lambda x: '[PAD]')), ' ') AS text
FROM (SELECT id, c, t[c * {N.CHUNK_TOKENS} + 1 : (c + 1) * {N.CHUNK_TOKENS}] AS toks
      FROM (SELECT id, {TOKS} AS t FROM corpus),
           LATERAL (SELECT unnest(range(0, CAST(ceil(len(t) / {N.CHUNK_TOKENS}) AS BIGINT))) AS c)
      WHERE len(t) > 0)"""))
def chunk_tokens(spark, sf_dir):
    return N.chunk_tokens(Fixtures(spark, sf_dir).corpus)


@query("merge_label_spans", "W3", with_fixtures(["corpus"], f"""
SELECT id, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS "end", any_value(label) AS label,
       count(*) AS n_words
FROM (SELECT id, pos, label, sum(chg) OVER (PARTITION BY id ORDER BY pos) AS span
      FROM (SELECT id, pos, label,
                   CASE WHEN lag(label) OVER (PARTITION BY id ORDER BY pos) = label THEN 0 ELSE 1 END AS chg
            FROM (SELECT id, i - 1 AS pos, CASE WHEN length(t[i]) > 8 THEN 'ENT' ELSE 'O' END AS label
                  FROM (SELECT id, {TOKS} AS t FROM corpus), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i))))
GROUP BY id, span"""))
def merge_label_spans(spark, sf_dir):
    return N.merge_label_spans(Fixtures(spark, sf_dir).corpus)


@query("keep_last_n", "W2", with_fixtures(["runs"], """
SELECT id, job, epoch_us(started) AS started_us FROM (
  SELECT id, job, started, row_number() OVER (PARTITION BY job ORDER BY started DESC, id DESC) AS rn FROM runs)
WHERE rn > 100"""))
def keep_last_n(spark, sf_dir):
    from pyspark.sql import functions as F

    return W.keep_last_n(Fixtures(spark, sf_dir).runs, 100).select(
        "id", "job",
        # microseconds since the epoch of the zone-less start time, independent of the session zone
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', started)").alias("started_us"))
