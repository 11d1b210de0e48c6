"""Token-level text operators.

A document is one row, so everything that stays within a document is done
row-locally (no shuffle): fixed-size chunks and label spans with array
expressions, character offsets with a running sum in a vectorised pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import WORD_TOKEN

CHUNK_TOKENS = 126  # fixed value: tokens per chunk of a 128-slot model
CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"  # fixed values
ENTITY_MIN_LENGTH = 9  # tokens longer than 8 characters are labelled ENT


def tokens_lower(col: str = "content"):
    return F.regexp_extract_all(F.lower(F.col(col)), F.lit(WORD_TOKEN), 0)


def _token_starts(word_lengths, sep_lengths):
    """Pandas UDF body: start offset of each token = running sum of the
    separator and token lengths before it (numpy per row, Arrow batches)."""
    import numpy as np
    import pandas as pd

    out = []
    for w, s in zip(word_lengths, sep_lengths):
        w = np.asarray(w, dtype=np.int64)
        s = np.asarray(s, dtype=np.int64)[: len(w)]
        out.append(np.cumsum(s + w) - w)
    return pd.Series(out)


def tokenize_with_offsets(docs: DataFrame, col: str = "content") -> DataFrame:
    """(id, pos, token, start): lower-case word tokens and the character
    offset where each starts in the original text.

    Tokens and separators come from built-in regex functions; only the running
    sum of their lengths runs in a vectorised pandas UDF, row by row, so the
    tokens of a document are never shuffled or regrouped."""
    starts = F.pandas_udf(_token_starts, "array<long>")
    base = docs.select("id", F.regexp_extract_all(F.col(col), F.lit(WORD_TOKEN), 0).alias("_w"),
                       F.split(F.col(col), WORD_TOKEN, -1).alias("_s"))
    lens = base.select("id", "_w", starts(F.transform("_w", lambda x: F.length(x).cast("long")),
                                          F.transform("_s", lambda x: F.length(x).cast("long"))).alias("_st"))
    rows = lens.select("id", F.posexplode(F.arrays_zip(F.col("_w").alias("w"), F.col("_st").alias("st")))
                       .alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.lower(F.col("p.w")).alias("token"),
                       F.col("p.st").alias("start"))


def chunk_tokens(docs: DataFrame, n: int = CHUNK_TOKENS, col: str = "content") -> DataFrame:
    """Consecutive chunks of ``n`` tokens framed by [CLS] ... [SEP] and
    padded with [PAD] to n + 2 slots; row-local, no shuffle."""
    base = docs.select("id", tokens_lower(col).alias("_t"))
    n_chunks = F.ceil(F.size("_t") / n).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))),
                         lambda c: F.slice("_t", c * n + 1, n))
    chunks = F.when(F.size("_t") > 0, chunks).otherwise(F.array().cast("array<array<string>>"))
    ex = base.select("id", F.posexplode(chunks).alias("chunk", "toks"))
    framed = F.concat(F.array(F.lit(CLS)), F.col("toks"), F.array(F.lit(SEP)),
                      F.array_repeat(F.lit(PAD), F.lit(n) - F.size("toks")))
    return ex.select("id", F.col("chunk").cast("long").alias("chunk"), F.size("toks").cast("long").alias("n_tokens"),
                     F.array_join(framed, " ").alias("text"))


def merge_label_spans(docs: DataFrame, col: str = "content") -> DataFrame:
    """Consecutive tokens with one label become one span (id, start, end,
    label, n_words), positions 0-based; label ENT for tokens longer than 8
    characters, else O.  Span starts are the positions where the label
    changes - found row-locally, so no window or shuffle is needed.  Labels
    are kept as booleans until the spans are built."""
    base = docs.select("id", F.transform(tokens_lower(col), lambda t: F.length(t) >= ENTITY_MIN_LENGTH).alias("_e"))
    # the previous token's label, aligned with each token (the first has none)
    prev = F.concat(F.array(F.lit(None).cast("boolean")), F.slice("_e", 1, F.greatest(F.size("_e") - 1, F.lit(0))))
    # (zip_with pads the shorter array, so an empty token list needs its own branch)
    starts = F.filter(F.transform(F.zip_with("_e", prev, lambda a, b: b.isNull() | (a != b)),
                                  lambda c, i: F.when(c, i + 1)), lambda x: x.isNotNull())
    base = base.select("id", "_e", F.when(F.size("_e") > 0, starts).otherwise(F.array().cast("array<int>"))
                       .alias("_st"))
    spans = F.transform("_st", lambda s, k: F.struct(
        (s - 1).cast("long").alias("start"),
        (F.when(k + 1 < F.size("_st"), F.try_element_at(F.col("_st"), k + 2) - 2)
         .otherwise(F.size("_e") - 1)).cast("long").alias("end"),
        F.when(F.try_element_at(F.col("_e"), s), F.lit("ENT")).otherwise(F.lit("O")).alias("label")))
    out = base.select("id", F.inline(spans))
    return out.select("id", "start", "end", "label", (F.col("end") - F.col("start") + 1).alias("n_words"))


def words(docs: DataFrame, col: str = "content") -> DataFrame:
    """The ``words`` input: (id, pos, token, label)."""
    return docs.select("id", F.posexplode(tokens_lower(col)).alias("pos", "token")).select(
        "id", F.col("pos").cast("long").alias("pos"), "token",
        F.when(F.length("token") >= ENTITY_MIN_LENGTH, F.lit("ENT")).otherwise(F.lit("O")).alias("label"))
